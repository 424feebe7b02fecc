"""A grid of many levels: each box lies in cells of its own size, and cells where boxes are dense are split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.tables import written

MOST = 64  # boxes that begin or end in a cell before it is split
FINEST = 12  # splits of a cell at most
_UNIT = 1.3 / 8  # side of a cell of level 0: boxes of up to 8 sides


def cell_of(v: Column, cell: float | Column) -> Column:
    return F.floor(v / cell).cast("long")


def side_of(level: Column) -> Column:
    return F.pow(F.lit(4.0), level) * _UNIT


@dataclass
class Grid:
    """boxes: once for each cell (_level, _cx, _cy) they meet, with its side as _side; levels: those in use."""

    boxes: DataFrame
    levels: list[int]

    def keyed(self, points: DataFrame) -> DataFrame:
        """points once for each level in use, with _level, _cx and _cy."""
        level = F.lit(self.levels[0] if self.levels else 0) if len(self.levels) < 2 else F.explode(F.array(*[F.lit(x) for x in self.levels]))
        own = points.withColumn("_level", level)
        return own.withColumns({"_cx": cell_of(F.col("x"), side_of(F.col("_level"))), "_cy": cell_of(F.col("y"), side_of(F.col("_level")))})

    def at(self, level: int) -> dict[str, Column]:
        """The cell (_cx, _cy) of a point at one level."""
        return {"_cx": cell_of(F.col("x"), side_of(F.lit(level))), "_cy": cell_of(F.col("y"), side_of(F.lit(level)))}


KEYS = ["_level", "_cx", "_cy"]


def _spread(boxes: DataFrame, cx: tuple[Column, Column], cy: tuple[Column, Column]) -> DataFrame:
    return boxes.withColumn("_cx", F.explode(F.sequence(*cx))).withColumn("_cy", F.explode(F.sequence(*cy)))


def _parts(dense: DataFrame) -> DataFrame:
    """Boxes in dense cells (kept as _wx, _wy) → in those of a cell's 16 parts that they meet."""
    finer = dense.withColumnsRenamed({"_cx": "_wx", "_cy": "_wy"}).withColumn("_level", F.col("_level") - 1).withColumn("_side", side_of(F.col("_level")))
    span = lambda c, lo, hi: (
        F.greatest(cell_of(F.col(lo), F.col("_side")), F.col(f"_w{c}") * 4), F.least(cell_of(F.col(hi), F.col("_side")), F.col(f"_w{c}") * 4 + 3)
    )
    x, y = span("x", "min_x", "max_x"), span("y", "min_y", "max_y")
    return _spread(finer.where((x[0] <= x[1]) & (y[0] <= y[1])), x, y)


BOUNDS = ["min_x", "min_y", "max_x", "max_y"]


def level_of() -> Column:
    """The level of a box: that of its longer side."""
    size = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    far = F.greatest(*[F.abs(c) for c in BOUNDS])
    return F.ceil(F.log(F.greatest(size, far * 1e-9, F.lit(1e-12)) / 1.3) / F.log(F.lit(4.0))).cast("int")


def _span(lo: str, hi: str) -> tuple[Column, Column]:
    return cell_of(F.col(lo), F.col("_side")), cell_of(F.col(hi), F.col("_side"))


def pairs_by_cell(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b with bounds (a_min_x, …; b_min_x, …) → pairs of rows whose boxes meet, each once.

    A box lies in the cells of its own level and of each coarser level in use; a pair meets at the coarser of its two
    levels, in the cell where the boxes' common part begins. So ten thousand lots under one county are paired with it, and
    with each other only where they are near. The levels in use come to the driver, one row each.
    """
    own = {p: df.withColumnsRenamed({f"{p}_{c}": c for c in BOUNDS}).where("min_x <= max_x and min_y <= max_y").withColumn("_own", level_of()) for p, df in (("a", a), ("b", b))}
    levels = sorted(r._own for r in own["a"].select("_own").unionByName(own["b"].select("_own")).distinct().collect())
    used = F.array(*[F.lit(x) for x in levels]).cast("array<int>")

    def spread(p: str) -> DataFrame:
        at = own[p].withColumn("_level", F.explode(F.filter(used, lambda x: x >= F.col("_own")))).withColumn("_side", side_of(F.col("_level")))
        every = _spread(at, _span("min_x", "max_x"), _span("min_y", "max_y")).withColumnsRenamed({c: f"{p}_{c}" for c in (*BOUNDS, "_own")})
        return every.drop("_side")

    side = side_of(F.col("_level"))
    begins = [cell_of(F.greatest(f"a_min_{c}", f"b_min_{c}"), side) == F.col(f"_c{c}") for c in ("x", "y")]
    meets = [F.greatest(f"a_min_{c}", f"b_min_{c}") <= F.least(f"a_max_{c}", f"b_max_{c}") for c in ("x", "y")]
    met = spread("a").join(spread("b"), KEYS).where(begins[0] & begins[1] & meets[0] & meets[1] & (F.greatest("a__own", "b__own") == F.col("_level")))
    return met.drop(*KEYS, "a__own", "b__own")


def grid_of(boxes: DataFrame, most: int = MOST) -> Grid:
    """boxes (min_x, min_y, max_x, max_y, …) → their grid. Boxes with a null bound are left out.

    A box's level is that of its longer side, in steps of four, so that it meets 81 cells at most and the boxes of a cell
    are of like size: one county and ten thousand lots are two levels, not one grid that suits neither. A cell that more
    than `most` different boxes meet without covering it whole is split in 16, and its parts again, where that helps: the
    fullest part has half of its boxes at most, or the parts together no more than twice as many. A cell that half as many
    boxes cover whole is not split, since its points are in those whatever its size, and each of its parts would list them:
    so boxes that lie on one another stay together, staggered ones too. Splitting works on the different bounds alone, in tables of the shared folder, FINEST times at
    most; one row a level comes to the driver, and one more for each turn.
    """
    good = boxes.where("min_x <= max_x and min_y <= max_y")
    spread = lambda df: _spread(
        df.withColumn("_level", level_of()).withColumn("_side", side_of(F.col("_level"))), _span("min_x", "max_x"), _span("min_y", "max_y")
    )
    cuts = ~(
        (F.col("min_x") <= F.col("_cx") * F.col("_side")) & (F.col("max_x") >= (F.col("_cx") + 1) * F.col("_side")) &
        (F.col("min_y") <= F.col("_cy") * F.col("_side")) & (F.col("max_y") >= (F.col("_cy") + 1) * F.col("_side"))
    )
    now, cells, levels = spread(good.select(*BOUNDS).distinct()), None, set()
    for turn in range(FINEST + 1):
        counts = now.groupBy(*KEYS).agg(F.count_if(cuts).alias("n"), F.count_if(~cuts).alias("whole"))
        full = (F.col("n") > most) & (F.col("n") > F.col("whole") * 2)
        worst = counts.groupBy("_level").agg(F.bool_or(full).alias("full")).collect()
        levels |= {r._level for r in worst}
        if turn == FINEST or not any(r.full for r in worst):
            break
        now = written(now) if turn == 0 else now
        dense = now.groupBy(*KEYS).agg(F.count_if(cuts).alias("n"), F.count_if(~cuts).alias("whole")).where(full).select(*KEYS, "n")
        parts = written(_parts(now.join(dense.select(*KEYS), KEYS, "left_semi")))
        old = [(F.col("_level") + 1).alias("_level"), F.col("_wx").alias("_cx"), F.col("_wy").alias("_cy")]
        fuller = parts.groupBy("_level", "_wx", "_wy", "_cx", "_cy").agg(F.count_if(cuts).alias("n")).groupBy("_level", "_wx", "_wy").agg(
            F.max("n").alias("most"), F.sum("n").alias("all")
        ).select(*old, "most", "all")
        helped = written(dense.join(fuller, KEYS).where("most * 2 <= n or all <= n * 2").select(*KEYS))
        kept = now.join(helped, KEYS, "left_anti")
        cells = kept if cells is None else cells.unionByName(kept)
        own = helped.select((F.col("_level") - 1).alias("_level"), F.col("_cx").alias("_wx"), F.col("_cy").alias("_wy"))
        now = written(parts.join(own, ["_level", "_wx", "_wy"], "left_semi").drop("_wx", "_wy"))
    if cells is None:
        return Grid(spread(good), sorted(levels))
    return Grid(good.join(cells.unionByName(now), BOUNDS), sorted(levels))
