"""Exact areas of overlays: what two layers of features share, pair by pair, and how often the ground is covered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wardlight.operators.cells import BOUNDS, pairs_by_cell
from wardlight.operators.spatial import bounding_boxes, boxes_by_cell, fitted_side, ring_pairs
from wardlight.tables import written


def edge_list(polygons: Column) -> Column:
    """All edges of polygons as one array of ax, ay, bx, by; level ones left out, which no scan-line crosses."""
    return F.filter(F.flatten(F.flatten(F.transform(polygons, lambda rings: F.transform(rings, ring_pairs)))), lambda e: e["ay"] != e["by"])


def edge_arrays(edges: pa.ListArray) -> list[np.ndarray]:
    """Edges (n, 4: ax, ay, bx, by) of each row; none for a null."""
    flat = np.column_stack([edges.values.field(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by")])
    ends = edges.offsets.to_numpy()
    return [flat[a:b] if ok else flat[:0] for a, b, ok in zip(ends, ends[1:], edges.is_valid().to_pylist(), strict=False)]


def _crossing_heights(a: np.ndarray, b: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Heights at which an edge of a meets one of b, some rows of all pairs at a time."""
    found = []
    step = max(1, block // max(len(b), 1))
    n, nd = b[:, :2], b[:, 2:] - b[:, :2]
    for lo in range(0, len(a), step):
        m = a[lo : lo + step, None, :2]
        md = a[lo : lo + step, None, 2:] - m
        off = n[None] - m
        turn = md[..., 0] * nd[None, :, 1] - md[..., 1] * nd[None, :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (off[..., 0] * nd[None, :, 1] - off[..., 1] * nd[None, :, 0]) / turn
            u = (off[..., 0] * md[..., 1] - off[..., 1] * md[..., 0]) / turn
        i, j = np.nonzero((turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
        found.append(m[i, 0, 1] + t[i, j] * md[i, 0, 1])
    return np.concatenate(found) if found else np.zeros(0)


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area inside both of two sets of closed rings (edges as _edges gives them), each by the even-odd rule.

    The plane is cut into level bands at every vertex and crossing. Within a band edges do not cross, so that their order
    at its middle holds throughout, and each piece between two neighbours is a trapezoid: its width at the middle times
    the band's height. All bands are swept at once.
    """
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    of_a = np.arange(len(both)) < len(a)
    heights = np.unique(np.concatenate([both[:, 1], both[:, 3], _crossing_heights(a, b)]))
    low, high = (np.searchsorted(heights, f(both[:, 1], both[:, 3])) for f in (np.minimum, np.maximum))
    size = high - low
    edge = np.repeat(np.arange(len(both)), size)
    band = np.arange(len(edge)) - np.repeat(np.cumsum(size) - size, size) + low[edge]
    middle = (heights[band] + heights[band + 1]) / 2
    ax, ay, bx, by = both[edge].T
    x = ax + (bx - ax) * (middle - ay) / (by - ay)
    order = np.lexsort((x, band))
    x, band, own = x[order], band[order], of_a[edge][order]
    inside = (np.cumsum(own)[:-1] % 2 == 1) & (np.cumsum(~own)[:-1] % 2 == 1) & (band[1:] == band[:-1])
    return float((np.diff(x) * np.diff(heights)[band[:-1]])[inside].sum())


@F.arrow_udf(DoubleType())
def overlap_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area that two columns of edges (see edge_list) share; Arrow-fed, a row being a pair."""
    return pa.array([shared_area(x, y) for x, y in zip(edge_arrays(a), edge_arrays(b), strict=True)], pa.float64())


def overlay_areas(a: DataFrame, b: DataFrame, least: float = 1e-12) -> DataFrame:
    """a, b (feature_id, polygons) → a_id, b_id, area_a, area_b, shared, iou, share_a: pairs that share more than `least`.

    Pairs whose boxes meet are tried once (see cells.pairs_by_cell), so that nothing is made distinct afterwards. Rings of a feature count by the even-odd rule: holes are left
    out, and parts must not overlap each other. share_a: the part of a that lies in b.
    """
    boxed = lambda df, p: bounding_boxes(
        df.select(F.col("feature_id").alias(p + "_id"), edge_list(F.col("polygons")).alias(p + "_edges"), "polygons")
    ).withColumnsRenamed({c: f"{p}_{c}" for c in BOUNDS})
    pairs = pairs_by_cell(boxed(a, "a"), boxed(b, "b"))
    own = lambda c: overlap_area(F.col(c), F.col(c))
    out = pairs.select(
        "a_id", "b_id", overlap_area("a_edges", "b_edges").alias("shared"), own("a_edges").alias("area_a"),
        own("b_edges").alias("area_b")
    ).where(F.col("shared") > least)
    return out.select(
        "a_id", "b_id", "area_a", "area_b", "shared",
        (F.col("shared") / (F.col("area_a") + F.col("area_b") - F.col("shared"))).alias("iou"),
        (F.col("shared") / F.col("area_a")).alias("share_a")
    )


CROWDED = 1_000  # edges in a cell before it is quartered
QUARTERS = 8  # times that a cell is quartered at most


def _covers(edges: list[np.ndarray], box: tuple[float, float, float, float]) -> dict[tuple[int, ...], float]:
    """Area of a cell's ground by the set of features that cover it (their numbers; the empty set too).

    The cell is cut into level bands at every vertex, every crossing of two edges, and every crossing with its left and
    right sides. In a band edges keep their order; from the right, each toggles its own feature, and each piece between two
    neighbours is a trapezoid. An edge that lies right of the cell only toggles.
    """
    x0, y0, x1, y1 = box
    own = np.concatenate([*edges, [[x0, y0, x0, y1], [x1, y0, x1, y1]]])
    of = np.concatenate([np.full(len(e), k) for k, e in enumerate([*edges, np.zeros((2, 4))])])
    heights = np.unique(np.clip(np.concatenate([own[:, 1], own[:, 3], _crossing_heights(own, own)]), y0, y1))
    middle, tall = (heights[:-1] + heights[1:]) / 2, np.diff(heights)
    found: dict[tuple[int, ...], float] = {}
    for y, h in zip(middle.tolist(), tall.tolist(), strict=True):
        met = np.flatnonzero((own[:, 1] > y) != (own[:, 3] > y))
        ax, ay, bx, by = own[met].T
        x = ax + (bx - ax) * (y - ay) / (by - ay)
        order = np.argsort(-x, kind="stable")
        inside: set[int] = set()
        here, last = False, x1
        for at, k in zip(x[order].tolist(), of[met][order].tolist(), strict=True):
            if here and last > at:
                key = tuple(sorted(inside))
                found[key] = found.get(key, 0.0) + (last - max(at, x0)) * h
            if k == len(edges):
                here = not here
            else:
                inside ^= {k}
            last = min(at, x1)
    return found


def cover_areas(features: DataFrame, outline: DataFrame | None = None, cell: float | None = None) -> DataFrame:
    """features (and outline) → members (sorted feature ids), in_parent, area: the ground by exactly what covers it.

    The plane is cut into square cells, fitted to the features or of side `cell`; one with over CROWDED edges is quartered
    while that lightens the fullest. A row is a cell with its own edges, so that no task holds a county; the areas of each
    cell's sets are summed. in_parent: whether the ground lies in the outline (true without one). Ground in no feature and
    no outline is not told. Rings of a feature count by the even-odd rule.
    """
    told = lambda df, parent: df.select(F.col("feature_id"), F.lit(parent).alias("parent"), "polygons")
    both = told(features, False)
    if outline is not None:
        none = F.lit(None).cast(dict(features.dtypes)["feature_id"])
        both = both.unionByName(outline.select(none.alias("feature_id"), F.lit(True).alias("parent"), "polygons"))
    boxed = bounding_boxes(both.select("feature_id", "parent", edge_list(F.col("polygons")).alias("edges"), "polygons"))
    side = cell or fitted_side(bounding_boxes(features.select("polygons")))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))

    def trimmed(df: DataFrame) -> DataFrame:
        near = lambda e: (F.greatest(e["ay"], e["by"]) > y0) & (F.least(e["ay"], e["by"]) < y1) & (F.greatest(e["ax"], e["bx"]) >= x0)
        return df.withColumn("edges", F.filter("edges", near)).where(F.size("edges") > 0)

    at = F.col("_side")
    now = trimmed(
        boxes_by_cell(boxed, side).select(
            "feature_id", "parent", "edges", (F.col("cx") * at).alias("x0"), (F.col("cy") * at).alias("y0"), ((F.col("cx") + 1) * at).alias("x1"),
            ((F.col("cy") + 1) * at).alias("y1")
        )
    )
    box, done, worst = ["x0", "y0", "x1", "y1"], None, None
    for turn in range(QUARTERS + 1):
        counts = now.groupBy(*box).agg(F.sum(F.size("edges")).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= CROWDED or turn == QUARTERS or worst is not None and most > 0.75 * worst:
            break
        worst, now = most, written(now)
        full = written(now.groupBy(*box).agg(F.sum(F.size("edges")).alias("n")).where(F.col("n") > CROWDED).select(*box))
        kept = now.join(full, box, "left_anti")
        done = kept if done is None else done.unionByName(kept.select(*done.columns))
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        parts = F.array(*[F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")) for a, c in ((x0, mx), (mx, x1)) for b, d in ((y0, my), (my, y1))])
        split = now.join(full, box, "left_semi").select("feature_id", "parent", "edges", F.explode(parts).alias("q"))
        now = trimmed(split.select("feature_id", "parent", "edges", "q.*")).select(*kept.columns)
    cells = (now if done is None else done.unionByName(now)).groupBy(*box).agg(F.collect_list(F.struct("feature_id", "parent", "edges")).alias("own"))
    kind = dict(features.dtypes)["feature_id"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own")
            ids, parents, edges = own.values.field("feature_id"), own.values.field("parent").to_pylist(), edge_arrays(own.values.field("edges"))
            ends, took, sizes, inside, areas = own.offsets.to_pylist(), [], [], [], []
            for (a, b), bounds in zip(zip(ends, ends[1:], strict=False), zip(*(batch.column(c).to_pylist() for c in box), strict=True), strict=True):
                for members, area in _covers(edges[a:b], bounds).items():
                    if members:
                        real = [a + k for k in members if not parents[a + k]]
                        took += real
                        sizes.append(len(real))
                        inside.append(sum(parents[a + k] for k in members) % 2 == 1)
                        areas.append(area)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), ids.take(pa.array(took, pa.int64())))
            yield pa.RecordBatch.from_arrays([lists, pa.array(inside, pa.bool_()), pa.array(areas, pa.float64())], names=["members", "in_parent", "area"])

    found = cells.mapInArrow(sweep, f"members array<{kind}>, in_parent boolean, area double")
    parent = F.col("in_parent") if outline is not None else F.lit(True)
    return found.groupBy(F.sort_array("members").alias("members"), parent.alias("in_parent")).agg(F.sum("area").alias("area"))


def tiling_areas(features: DataFrame, outline: DataFrame, least: float = 1e-12) -> DataFrame:
    """One row: area of the outline, of its ground covered once, never (cracks) and more than once, of ground covered outside (spill), and of the largest crack-free double claim.

    worst: the largest area that one set of two or more features shares; coverage: the share of the outline that is covered.
    """
    sets = cover_areas(features, outline).where(F.col("area") > least)
    n, own = F.size("members"), F.col("in_parent")
    part = lambda where: F.coalesce(F.sum(F.when(where, F.col("area"))), F.lit(0.0))
    told = sets.agg(
        part(own).alias("parent"), part(own & (n == 1)).alias("once"), part(own & (n == 0)).alias("cracks"), part(n > 1).alias("overlaps"),
        part(~own & (n > 0)).alias("spill"), F.coalesce(F.max(F.when(n > 1, F.col("area"))), F.lit(0.0)).alias("worst")
    )
    return told.withColumn("coverage", F.when(F.col("parent") > 0, 1 - F.col("cracks") / F.col("parent")))


def clip_areas(features: DataFrame, outline: DataFrame) -> DataFrame:
    """Per feature: its area, and the share of it outside the outline; both are exact."""
    each = cover_areas(features, outline).select(F.explode("members").alias("feature_id"), "in_parent", "area")
    out = F.coalesce(F.sum(F.when(~F.col("in_parent"), F.col("area"))), F.lit(0.0))
    return each.groupBy("feature_id").agg(F.sum("area").alias("area"), (out / F.sum("area")).alias("outside"))


def outline_difference_area(features: DataFrame, outline: DataFrame) -> DataFrame:
    """One row: the area in exactly one of the features' union and the outline, and its share of the area in either."""
    sets = cover_areas(features, outline)
    differ = F.coalesce(F.sum(F.when((F.size("members") > 0) != F.col("in_parent"), F.col("area"))), F.lit(0.0))
    return sets.agg(differ.alias("differ"), (differ / F.sum("area")).alias("share"))


def _half(ring: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of a ring (open, n × 2) on the left of the line from a to b; a concave ring keeps its area, with edges along the line."""
    if not len(ring):
        return ring
    side = (b[0] - a[0]) * (ring[:, 1] - a[1]) - (b[1] - a[1]) * (ring[:, 0] - a[0])
    nxt, after = np.roll(ring, -1, axis=0), np.roll(side, -1)
    out = []
    for p, q, s, t in zip(ring, nxt, side, after, strict=True):
        if s >= 0:
            out.append(p)
        if (s > 0 > t) or (s < 0 < t):
            out.append(p + (q - p) * (s / (s - t)))
    return np.array(out).reshape(-1, 2)


def _ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - (ring[0, 0] if len(ring) else 0), ring[:, 1] - (ring[0, 1] if len(ring) else 0)
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def split_polygons(features: DataFrame, path: DataFrame) -> DataFrame:
    """features and a path (k, x, y; x grows with k) → feature_id, side (above, below, off), part, ring, area: the features cut along the path.

    A ring is cut at the path's vertices into upright strips, and each strip by the path's edge; ground left and right of the
    path is `off`. area is signed like the ring, so that holes are taken away; the areas of a ring's parts add up to its own.
    Edges of the path meet features by cells along x, so that a feature is cut by those over it only; a row is a feature.
    """
    nxt = path.alias("p").join(path.alias("q"), F.col("q.k") == F.col("p.k") + 1).select(
        F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1")
    )
    ends = path.agg(F.min("x").alias("first"), F.max("x").alias("last"))
    boxed = bounding_boxes(features.select("feature_id", F.col("polygons").alias("own"), "polygons"))
    side = boxed.agg(F.coalesce(F.nullif(F.avg(F.col("max_x") - F.col("min_x")), F.lit(0.0)), F.lit(1.0)).alias("s")).scalar()
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side).cast("long"), F.floor(F.col(hi) / side).cast("long")))
    keyed = boxed.select("feature_id", "min_x", "max_x").withColumn("cx", cells("min_x", "max_x"))
    met = keyed.join(nxt.withColumn("cx", cells("x0", "x1")), "cx").where("x0 < max_x and x1 > min_x").select("feature_id", F.struct("x0", "y0", "x1", "y1").alias("e"))
    over = met.distinct().groupBy("feature_id").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    rows = boxed.join(over, "feature_id", "left").join(F.broadcast(ends)).select("feature_id", F.explode(F.flatten("own")).alias("ring"), "edges", "first", "last")  # ends: one row
    kind = dict(features.dtypes)["feature_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = 1.0
        for batch in batches:
            of, sides, parts, rings, areas = [], [], [], [], []
            for i, r in enumerate(batch.select(["ring", "edges", "first", "last"]).to_pylist()):
                ring = np.array([(p["x"], p["y"]) for p in r["ring"][:-1]], float)

                def keep(name, piece, i=i):
                    if len(piece) > 2 and (area := _ring_area(piece)):
                        of.append(i)
                        sides.append(name)
                        parts.append(parts[-1] + 1 if len(of) > 1 and of[-2] == i else 0)
                        rings.append([{"x": x, "y": y} for x, y in [*piece.tolist(), piece[0].tolist()]])
                        areas.append(area)

                up = lambda x: (np.array([x, 0.0]), np.array([x, far]))  # noqa: E731  what is left of it has smaller x
                keep("off", _half(ring, *up(r["first"])))
                for e in r["edges"] or []:
                    strip = _half(_half(ring, *up(e["x1"])), *up(e["x0"])[::-1])
                    a, b = np.array([e["x0"], e["y0"]]), np.array([e["x1"], e["y1"]])
                    keep("above", _half(strip, a, b))
                    keep("below", _half(strip, b, a))
                keep("off", _half(ring, *up(r["last"])[::-1]))
            kinds = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("feature_id").take(pa.array(of, pa.int64())), pa.array(sides, pa.string()), pa.array(parts, pa.int32()), pa.array(rings, kinds), pa.array(areas, pa.float64())],
                names=["feature_id", "side", "part", "ring", "area"]
            )

    return rows.mapInArrow(cut, f"feature_id {kind}, side string, part int, ring array<struct<x:double,y:double>>, area double")
