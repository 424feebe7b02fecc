"""Point-in-polygon classification and nearest-neighbour joins over nested-column geometry.

features: feature_id, polygons ARRAY<ARRAY<ARRAY<STRUCT<x,y>>>> (polygon → closed ring → vertex), and any other columns.
points: pid, x, y; a pid stands for one place (deduplicate first).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.scalars import distance, haversine, segment_foot
from wardlight.operators.cells import KEYS, Grid, cell_of, grid_of
from wardlight.tables import written

PART = 4_096  # items of a cell's list that one row holds
ROUNDS = 3  # of nearest centres before a box may be looked for by its extent
HELD = 100_000  # items whose lists each executor can hold, some 70 MB


def ring_pairs(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring as structs ax, ay, bx, by; pairs of equal points are dropped."""
    pairs = F.zip_with(
        F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a,
        b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    )
    return F.filter(pairs, lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))


def ring_edges(features: DataFrame) -> DataFrame:
    """features → one row per edge: the features' other columns, polygon_idx, ring_idx, seq, ax, ay, bx, by. No shuffle."""
    others = [c for c in features.columns if c != "polygons"]
    polygons = features.select(*others, F.posexplode("polygons").alias("polygon_idx", "_rings"))
    rings = polygons.select(*others, "polygon_idx", F.posexplode("_rings").alias("ring_idx", "_ring"))
    edges = rings.select(*others, "polygon_idx", "ring_idx", F.posexplode(ring_pairs(F.col("_ring"))).alias("seq", "_e"))
    return edges.select(*others, "polygon_idx", "ring_idx", "seq", "_e.ax", "_e.ay", "_e.bx", "_e.by")


def _bounds(points: Column) -> list[Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")]


def bounding_boxes(features: DataFrame) -> DataFrame:
    others = [c for c in features.columns if c != "polygons"]
    return features.select(*others, *_bounds(F.flatten(F.flatten("polygons"))))


def crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the right crosses an edge; half-open in y, so that shared borders count once."""
    return F.when((e["ay"] > y) != (e["by"] > y), x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]).otherwise(False)


def inside(parts: Column, x: Column, y: Column) -> Column:
    """Even-odd over all rings of a polygon, any polygon of the feature. parts: arrays of edges, one for each polygon."""
    odd = lambda edges: F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(e, x, y).cast("int")) % 2 == 1
    return F.exists(parts, odd)


def fitted_side(boxes: DataFrame, per_box: int = 16) -> Column:
    """Side of square cells so that boxes (min_x, min_y, max_x, max_y) meet some per_box of them on average, whatever the coordinates' units.

    A scalar subquery over the boxes: Spark evaluates it before the query that holds it.
    """
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    n = F.count("*") * F.lit(per_box)
    side = F.greatest(F.sqrt(F.sum(w * h) / n), F.sum(w + h) / n)
    return boxes.agg(F.when(side > 0, side).otherwise(1.0).alias("side")).scalar()


def boxes_by_cell(boxes: DataFrame, side: float | Column) -> DataFrame:
    """boxes once for each cell (cx, cy) that they meet, with the side as _side."""
    spans = boxes.withColumn("_side", side if isinstance(side, Column) else F.lit(float(side)))
    for c, lo, hi in (("cx", "min_x", "max_x"), ("cy", "min_y", "max_y")):
        spans = spans.withColumn(c, F.explode(F.sequence(cell_of(F.col(lo), F.col("_side")), cell_of(F.col(hi), F.col("_side")))))
    return spans


def _keyed(points: DataFrame, side: float | Column) -> DataFrame:
    side = side if isinstance(side, Column) else F.lit(float(side))
    return points.withColumns({"cx": cell_of(F.col("x"), side), "cy": cell_of(F.col("y"), side)})


def _grid(boxes: DataFrame, cell: float | None) -> Grid:
    """The boxes' grid, or where `cell` is given one level of cells of that side."""
    if cell is None:
        return grid_of(boxes)
    return _OneLevel(boxes_by_cell(boxes, cell).withColumnsRenamed({"cx": "_cx", "cy": "_cy"}).withColumn("_level", F.lit(0)), [0], cell)


@dataclass
class _OneLevel(Grid):
    side: float

    def keyed(self, points: DataFrame) -> DataFrame:
        side = F.lit(float(self.side))
        return points.withColumns({"_level": F.lit(0), "_cx": cell_of(F.col("x"), side), "_cy": cell_of(F.col("y"), side)})

    def at(self, level: int) -> dict[str, Column]:
        return {"_cx": cell_of(F.col("x"), F.lit(float(self.side))), "_cy": cell_of(F.col("y"), F.lit(float(self.side)))}


def cell_index(features: DataFrame, cell: float | None = None) -> tuple[DataFrame, Grid]:
    """features → rows (_level, _cx, _cy, …, parts), for each cell that a bounding box meets the edges a ray from the cell can cross; and their grid.

    A cell keeps the edges that reach its band and do not lie wholly to its left, so that a point tests few edges
    however long the ring is; parity is unaffected.
    """
    others = [c for c in features.columns if c != "polygons"]
    boxed = features.select(
        *others, F.transform("polygons", lambda rings: F.flatten(F.transform(rings, ring_pairs))).alias("parts"),
        *_bounds(F.flatten(F.flatten("polygons")))
    )
    grid = _grid(boxed, cell)
    x0, y0, y1 = F.col("_cx") * F.col("_side"), F.col("_cy") * F.col("_side"), (F.col("_cy") + 1) * F.col("_side")
    near = lambda e: (F.greatest(e["ay"], e["by"]) >= y0) & (F.least(e["ay"], e["by"]) <= y1) & (F.greatest(e["ax"], e["bx"]) >= x0)
    return grid.boxes.select(*KEYS, *others, F.transform("parts", lambda p: F.filter(p, near)).alias("parts")), grid


def classify(points: DataFrame, features: DataFrame, cell: float | None = None) -> DataFrame:
    """Every (point, feature that contains it): the points' columns and the features' columns but polygons.

    Points meet the cells of the features by an equi-join and test the cell's edges within the row, so that nothing is
    grouped afterwards: with a small layer, which adaptive execution broadcasts, points are never shuffled. The cells are
    those of a grid of many levels (see cells.grid_of), so that a cell has few features where large and small ones are
    mixed and where they are dense; a point is looked up once for each level in use. cell: one level of that side instead.
    """
    others = [c for c in features.columns if c != "polygons"]
    index, grid = cell_index(features, cell)
    met = grid.keyed(points).join(index, KEYS)
    return met.where(inside(F.col("parts"), F.col("x"), F.col("y"))).select(*points.columns, *others)


def bbox_prereject(points: DataFrame, features: DataFrame, cell: float | None = None) -> DataFrame:
    """(point, feature) pairs whose bounding box holds the point: the cheap reject before the ring test."""
    grid = _grid(bounding_boxes(features), cell)
    return grid.keyed(points).join(grid.boxes, KEYS).where("x between min_x and max_x and y between min_y and max_y").select("pid", "x", "y", "feature_id")


def fold_hits(
    points: DataFrame, features: DataFrame, start: dict[str, Column], step: Callable[[Column], dict[str, Column]], cell: float | None = None
) -> DataFrame:
    """points, each row once, with the columns of `start` after `step` has told them anew of arrays of the features that contain the point.

    Each cell lists its features in parts of about PART; a point meets the list of its cell by one left join for each level
    in use and part, and tests it within the row. So points are neither multiplied nor grouped nor joined with themselves
    afterwards, whatever their number; with a small layer they are not shuffled at all. One row a level comes to the driver.
    """
    others, kept = [c for c in features.columns if c != "polygons"], [*points.columns, *start]
    index, grid = cell_index(features, cell)
    sizes = index.groupBy(*KEYS).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    levels = {r._level: r.n for r in sizes.groupBy("_level").agg(F.max("_parts").alias("n")).collect()}
    if max(levels.values(), default=1) > 1:
        index = index.join(sizes, KEYS).withColumn("_part", F.pmod(F.xxhash64("feature_id"), F.col("_parts")).cast("int"))
    else:
        index = index.withColumn("_part", F.lit(0))
    lists = index.groupBy(*KEYS, "_part").agg(F.collect_list(F.struct(*others, "parts")).alias("_near"))
    out = points.withColumns(start)
    for level, parts in sorted(levels.items()):
        for part in range(parts):
            own = lists.where((F.col("_level") == level) & (F.col("_part") == part)).select("_cx", "_cy", "_near")
            found = F.transform(
                F.filter("_near", lambda f: inside(f["parts"], F.col("x"), F.col("y"))), lambda f: F.struct(*[f[c].alias(c) for c in others])
            )
            met = out.withColumns(grid.at(level)).join(own, ["_cx", "_cy"], "left").select(*kept, found.alias("_found"))
            told = {c: F.when(F.size("_found") > 0, v).otherwise(F.col(c)) for c, v in step(F.col("_found")).items()}
            out = met.withColumns(told).select(*kept)
    return out


def with_status(points: DataFrame, features: DataFrame, cell: float | None = None) -> DataFrame:
    """points, each row once, with n, status NONE / OK / MULTI and feature_id where it is the only one."""
    ids = features.select("feature_id", "polygons")
    start = {"_n": F.lit(0).cast("long"), "_one": F.lit(None).cast(ids.schema["feature_id"].dataType)}
    out = fold_hits(points, ids, start, lambda hits: {"_n": F.col("_n") + F.size(hits), "_one": F.coalesce("_one", hits[0]["feature_id"])}, cell)
    n = F.col("_n")
    return out.select(
        *points.columns, n.alias("n"), F.when(n == 0, "NONE").when(n == 1, "OK").otherwise("MULTI").alias("status"),
        F.when(n == 1, F.col("_one")).alias("feature_id")
    )


def classify_status(points: DataFrame, features: DataFrame, cell: float | None = None) -> DataFrame:
    """pid, n, status NONE / OK / MULTI, feature_id where it is the only one."""
    return with_status(points.select("pid", "x", "y"), features, cell).select("pid", "n", "status", "feature_id")


def with_held(points: DataFrame, outlines: DataFrame, name: str, cell: float | None = None) -> DataFrame:
    """points, each row once, with whether any outline contains it as `name`."""
    return fold_hits(points, outlines.select("feature_id", "polygons"), {name: F.lit(False)}, lambda hits: {name: F.lit(True)}, cell)


def dispatch(points: DataFrame, entries: DataFrame, cell: float | None = None) -> DataFrame:
    """entries: features with entry_order, source, available. The first containing entry wins.

    An entry that is not available is skipped; a point that no available entry contains is ERROR while any entry is
    unavailable, else NONE: absence is only reported when every source has answered.
    """
    able = entries.where("available").select("entry_order", "feature_id", "source", "polygons")
    kind = able.select(F.struct("entry_order", "feature_id", "source").alias("s")).schema["s"].dataType
    won = fold_hits(
        points.select("pid", "x", "y"), able, {"won": F.lit(None).cast(kind)}, lambda hits: {"won": F.least(F.array_min(hits), F.col("won"))}, cell
    )
    gap = entries.agg(F.coalesce(F.bool_or(~F.col("available")), F.lit(False)).alias("gap"))
    out = won.join(F.broadcast(gap))  # one row by construction
    return out.select(
        "pid", F.when(F.col("won").isNotNull(), "OK").when(F.col("gap"), "ERROR").otherwise("NONE").alias("status"), "won.source",
        "won.feature_id"
    )


def covered(points: DataFrame, outlines: DataFrame, cell: float | None = None) -> DataFrame:
    """Points inside any outline."""
    return with_held(points, outlines, "_held", cell).where("_held").select(*points.columns)


def carve_out(points: DataFrame, include: DataFrame, exclude: DataFrame, cell: float | None = None) -> DataFrame:
    """Points in an outline of include and in none of exclude."""
    return with_held(covered(points, include, cell), exclude, "_out", cell).where("not _out").select(*points.columns)


def envelope_filter(points: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    return points.where(F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y))


def fitted_cell(items: DataFrame, boxes: list[Column], per_cell: float) -> float:
    """Side of a square cell that holds about per_cell items over their bounding box, no smaller than the average item.

    boxes: the items' least x, greatest x, least y and greatest y. One row of aggregates comes to the driver.
    """
    x0, x1, y0, y1 = boxes
    r = items.agg(
        F.count("*").alias("n"), (F.max(x1) - F.min(x0)).alias("w"), (F.max(y1) - F.min(y0)).alias("h"),
        F.avg(F.greatest(x1 - x0, y1 - y0)).alias("own")
    ).first()
    span = max(r.w or 0.0, r.h or 0.0)
    if not span:
        return 1.0
    return max((max(r.w, span / 1000) * max(r.h, span / 1000) * per_cell / r.n) ** 0.5, r.own)


def _expanding(
    points: DataFrame, items: DataFrame, boxes: list[Column], far: Callable[[Column], Column], tie: str, n: int, cell: float | None,
    reach: Callable[[float], Column], rest: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """points (pid, x, y) → pid, best: the n nearest items as an array of (dist, tie), nearest first, ties by `tie`.

    Each cell lists the items whose box comes within one cell of it, in parts of about PART items; a point meets the
    parts of its own cell's list and sorts those of each that are within one cell (`reach`: the distance that a side
    stands for), so that no row grows with the items of a dense place. A point with n such items is settled, since
    nothing outside can be nearer; the grid doubles its side for the others, and only for the cells that they lie in,
    until one cell and its neighbours hold every item: then a point has all there is. The first side is fitted to the
    number of items, so that lists stay short however many there are. Where every list is one part, as where the grid
    fits, points are neither multiplied nor grouped. Points are dealt out evenly first, since each costs a list. Each
    round is written to the shared folder. Points without finite coordinates have no neighbours. An item whose distance is
    null is none for the point. Lists of up to HELD items are broadcast, so that points are not shuffled and sorted by
    cell. rest: what answers the points that are left when ROUNDS rounds are over and one has settled less than half.
    """
    spark = points.sparkSession
    x0, x1, y0, y1 = boxes
    items = items.where(" and ".join(f"{c} - {c} = 0" for c in items.columns if c != tie))
    side = cell or fitted_cell(items, boxes, (n + 1) / 2)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    todo, done, bounds, first, everything = points.where("x - x = 0 and y - y = 0").repartition(tasks), None, None, True, False
    turn, before, held = 0, 0, items.count() <= HELD
    while True:
        near = items.withColumn(
            "cx", F.explode(F.sequence(cell_of(x0, side) - 1, cell_of(x1, side) + 1))
        ).withColumn("cy", F.explode(F.sequence(cell_of(y0, side) - 1, cell_of(y1, side) + 1)))
        keyed = _keyed(todo, side)
        if not first:  # few points are left: only their cells' lists are made
            near = near.join(keyed.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
        parts = near.groupBy("cx", "cy").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        dealt = near.join(parts, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64(tie), F.col("parts")).cast("int"))
        lists = dealt.groupBy("cx", "cy", "part").agg(F.first("parts").alias("parts"), F.collect_list(F.struct(*items.columns)).alias("near"))
        told = F.transform("near", lambda s: F.struct(far(s).alias("dist"), s[tie].alias(tie)))
        told = F.filter(told, (lambda b: b["dist"].isNotNull()) if everything else lambda b: b["dist"] <= reach(side))  # noqa: B023
        best = F.slice(F.sort_array(told), 1, n).alias("best")
        met = keyed.join(F.broadcast(lists) if held else lists, ["cx", "cy"], "left").select("pid", "x", "y", F.coalesce("parts", F.lit(1)).alias("parts"), best)
        if parts.where("parts > 1").isEmpty():
            met = met.select("pid", "x", "y", "best")
        else:
            several = met.where("parts > 1").groupBy("pid", "x", "y").agg(
                F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, n).alias("best")
            )
            met = met.where("parts = 1").select("pid", "x", "y", "best").unionByName(several)
        met = written(met.withColumn("sure", F.coalesce(F.size("best") == n, F.lit(False))))
        part = met.where("best is not null and size(best) > 0" if everything else "sure").select("pid", "best")
        done = part if done is None else done.unionByName(part)
        if everything:
            return done
        todo = met.where(~F.col("sure")).select("pid", "x", "y")
        left = todo.agg(
            F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
        ).first()
        if not left.n:
            return done
        turn += 1
        if rest and turn >= ROUNDS and left.n * 2 > before:
            return done.unionByName(rest(todo))
        before = left.n
        bounds = bounds or items.agg(F.min(x0).alias("x0"), F.max(x1).alias("x1"), F.min(y0).alias("y0"), F.max(y1).alias("y1")).first()
        side, first = side * 2, False
        everything = bounds.x0 is None or side >= max(
            max(left.x1, bounds.x1) - min(left.x0, bounds.x0), max(left.y1, bounds.y1) - min(left.y0, bounds.y0)
        )


def nearest_n(points: DataFrame, sites: DataFrame, n: int = 3, cell: float | None = None) -> DataFrame:
    """points (pid, x, y) × sites (sid, sx, sy) → pid, rank, sid, dist: the n nearest, ties by sid, planar distance; fewer where there are no more."""
    far = lambda s: distance(F.col("x") - s["sx"], F.col("y") - s["sy"])
    return _ranked(points, sites, far, n, cell, F.lit)


def nearest_n_globe(points: DataFrame, sites: DataFrame, n: int = 3, cell: float | None = None) -> DataFrame:
    """nearest_n for degrees (x: longitude, y: latitude), by great-circle metres.

    A cell is at least as wide as its narrower side at 60 degrees of latitude, which bounds what lies outside.
    """
    far = lambda s: haversine(F.col("y"), F.col("x"), s["sy"], s["sx"])
    return _ranked(points, sites, far, n, cell, lambda side: F.lit(110_000.0 * side) * F.cos(F.radians(F.lit(60.0))))


def nearest_lists(points: DataFrame, sites: DataFrame, n: int = 3, cell: float | None = None) -> DataFrame:
    """pid, best: nearest_n's sites of a point as one array of (dist, sid), nearest first; points without any are absent."""
    return _nearest(points, sites, lambda s: distance(F.col("x") - s["sx"], F.col("y") - s["sy"]), n, cell, F.lit)


def _nearest(points: DataFrame, sites: DataFrame, far: Callable[[Column], Column], n: int, cell: float | None, reach: Callable[[float], Column]) -> DataFrame:
    sx, sy = F.col("sx"), F.col("sy")
    return _expanding(points.select("pid", "x", "y"), sites.select("sid", "sx", "sy"), [sx, sx, sy, sy], far, "sid", n, cell, reach)


def _ranked(points: DataFrame, sites: DataFrame, far: Callable[[Column], Column], n: int, cell: float | None, reach: Callable[[float], Column]) -> DataFrame:
    best = _nearest(points, sites, far, n, cell, reach)
    return best.select("pid", F.posexplode("best").alias("rank", "b")).select("pid", (F.col("rank") + 1).alias("rank"), "b.sid", "b.dist")


def nearest_segment(points: DataFrame, edges: DataFrame, cell: float | None = None, digits: int | None = None) -> DataFrame:
    """points × edges (eid, ax, ay, bx, by) → pid, eid, dist: the nearest segment, ties by eid; digits: distances are rounded to so many first."""
    raw = lambda s: segment_foot(F.col("x"), F.col("y"), s["ax"], s["ay"], s["bx"], s["by"])["dist"]
    far = raw if digits is None else lambda s: F.round(raw(s), digits)
    boxes = [F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by")]
    best = _expanding(points.select("pid", "x", "y"), edges.select("eid", "ax", "ay", "bx", "by"), boxes, far, "eid", 1, cell, F.lit)
    return best.select("pid", F.col("best")[0]["eid"].alias("eid"), F.col("best")[0]["dist"].alias("dist"))


def area_share(samples: DataFrame, units: DataFrame, districts: DataFrame, cell: float | None = None) -> DataFrame:
    """Share of each unit's sample points in each district: unit, district, n, n_unit, share."""
    both = classify(samples.select("pid", "x", "y"), units.select(F.col("feature_id").alias("unit"), "polygons"), cell)
    placed = classify(both, districts.select(F.col("feature_id").alias("district"), "polygons"), cell)
    n_unit = both.groupBy("unit").agg(F.count("*").alias("n_unit"))
    return placed.groupBy("unit", "district").agg(F.count("*").alias("n")).join(n_unit, "unit").withColumn("share", F.col("n") / F.col("n_unit"))


def bbox_region(points: DataFrame, boxes: DataFrame, cell: float | None = None) -> DataFrame:
    """The box (box_id, min_x, min_y, max_x, max_y) that holds a point, of several the one with the nearest centre; malformed boxes are skipped.

    Where boxes lie on one another a point is in very many of them, but one of the nearest centres mostly holds it: those
    are asked first, ROUNDS times in cells fitted to the number of boxes, and on while a round settles half of its points. The
    grid of boxes answers the points that are left.
    """
    good = boxes.where("min_x < max_x and min_y < max_y").select(
        "box_id", "min_x", "min_y", "max_x", "max_y", ((F.col("min_x") + F.col("max_x")) / 2).alias("mx"), ((F.col("min_y") + F.col("max_y")) / 2).alias("my")
    )
    x, y, mx, my = F.col("x"), F.col("y"), F.col("mx"), F.col("my")
    square = lambda bx, by: (x - bx) * (x - bx) + (y - by) * (y - by)
    far = lambda b: F.when(x.between(b["min_x"], b["max_x"]) & y.between(b["min_y"], b["max_y"]), square(b["mx"], b["my"]))

    def by_extent(todo: DataFrame) -> DataFrame:
        grid = _grid(good, cell)
        met = grid.keyed(todo).join(grid.boxes, KEYS).where("x between min_x and max_x and y between min_y and max_y")
        return met.groupBy("pid").agg(F.array(F.min(F.struct(square(mx, my).alias("dist"), "box_id"))).alias("best"))

    within = lambda side: F.lit(side * side * (1 - 1e-9))
    best = _expanding(points.select("pid", "x", "y"), good, [mx, mx, my, my], far, "box_id", 1, cell, within, by_extent)
    return best.select("pid", F.col("best")[0]["box_id"].alias("box_id"))


def assign_labels(features: DataFrame, labels: DataFrame, tolerance: float, cell: float | None = None) -> DataFrame:
    """labels (label, x, y) → feature_id, label, how: a bijection, or nulls.

    A feature takes the label inside it, of several the nearest to its centroid (a tie gives none). If exactly one
    feature and one label are left, they are a pair when the label is within tolerance of the feature's bounding box.
    """
    centres = ring_measures(features).groupBy("feature_id").agg(
        (F.sum(F.col("cx") * F.col("area")) / F.sum("area")).alias("mx"), (F.sum(F.col("cy") * F.col("area")) / F.sum("area")).alias("my")
    )
    points = labels.select(F.col("label").alias("pid"), "x", "y")
    hits = classify(points, features.select("feature_id", "polygons"), cell).join(centres, "feature_id")
    d = F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))
    ranked = hits.withColumn("r", F.rank().over(Window.partitionBy("feature_id").orderBy(d))).where("r = 1")
    sure = ranked.groupBy("feature_id").agg(
        F.count("*").alias("k"), F.min("pid").alias("label")
    ).where("k = 1").select("feature_id", "label", F.lit("inside").alias("how"))
    left_f = bounding_boxes(features.select("feature_id", "polygons")).join(sure, "feature_id", "left_anti")
    left_l = labels.join(sure, "label", "left_anti")
    one = lambda df: df.agg(F.count("*").alias("_n"), F.first(F.struct(*df.columns)).alias("_r")).where("_n = 1").select("_r.*")
    dx = F.greatest(F.col("min_x") - F.col("x"), F.col("x") - F.col("max_x"), F.lit(0.0))
    dy = F.greatest(F.col("min_y") - F.col("y"), F.col("y") - F.col("max_y"), F.lit(0.0))
    pair = one(left_f).withColumn("_k", F.lit(1)).join(one(left_l).withColumn("_k", F.lit(1)), "_k").where(F.hypot(dx, dy) <= tolerance)
    return sure.unionByName(pair.select("feature_id", "label", F.lit("leftover").alias("how")))


def ring_measures(features: DataFrame) -> DataFrame:
    """Per ring: signed area (shoelace), centroid, bounds and vertex count."""
    return edge_measures(ring_edges(features.select("feature_id", "polygons")), ["feature_id", "polygon_idx", "ring_idx"])


def edge_measures(edges: DataFrame, keys: list[str]) -> DataFrame:
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    area = F.sum(cross) / 2
    return edges.groupBy(*keys).agg(
        area.alias("area"), (
            F.sum((F.col("ax") + F.col("bx")) * cross) / (6 * area)
        ).alias("cx"), (F.sum((F.col("ay") + F.col("by")) * cross) / (6 * area)).alias("cy"),
        F.min("ax").alias("min_x"), F.min("ay").alias("min_y"), F.max("ax").alias("max_x"), F.max("ay").alias("max_y"), F.count("*").alias("vertices"),
    )


def interior_points(features: DataFrame) -> DataFrame:
    """feature_id, x, y: the middle of the widest even-odd span of a scan-line just off the mid-height of each feature."""
    edges = ring_edges(features.select("feature_id", "polygons"))
    lines = edges.groupBy("feature_id").agg((F.min("ay") + (F.max("ay") - F.min("ay")) * F.lit(0.4997)).alias("y"))
    met = edges.join(lines, "feature_id").where((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y")))
    xs = met.select(
        "feature_id", "y", ((F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")).alias("x")
    )
    w = Window.partitionBy("feature_id").orderBy("x")
    spans = xs.select(
        "feature_id", "y", "x", F.lead("x").over(w).alias("x2"), F.row_number().over(w).alias("k")
    ).where("k % 2 = 1 and x2 is not null")
    best = spans.groupBy("feature_id").agg(
        F.max_by(
            F.struct(((F.col("x") + F.col("x2")) / 2).alias("x"), "y"),
            F.struct((F.col("x2") - F.col("x")).alias("w"), (-F.col("x")).alias("l"))
        ).alias("p")
    )
    return best.select("feature_id", "p.x", "p.y")
