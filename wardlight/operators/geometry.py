"""Boundary derivation and checks on tables of rings, edges, sample points and grid cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from wardlight.functions.scalars import chord_deviation, densify, norm_alnum
from wardlight.operators.components import components
from wardlight.operators.rosters import population_rollup, reconcile_partition
from wardlight.operators.spatial import (
    bounding_boxes, classify, classify_status, edge_measures, fold_hits, interior_points, nearest_segment, ring_edges, ring_measures, with_held, with_status
)
from wardlight.tables import written

RING = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def _key() -> list[Column]:
    """Undirected key of an edge: the smaller end first."""
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return [lo["x"].alias("x1"), lo["y"].alias("y1"), hi["x"].alias("x2"), hi["y"].alias("y2")]


def dissolve(units: DataFrame, composition: DataFrame) -> DataFrame:
    """units (feature_id, polygons) and composition (district, unit) → boundary edges district, x1, y1, x2, y2.

    Edges that two units of a district share cancel; a unit listed twice counts once. Needs exactly shared vertices.
    """
    edges = ring_edges(units.select(F.col("feature_id").alias("unit"), "polygons")).join(composition.select("district", "unit").distinct(), "unit")
    return edges.select("district", *_key()).groupBy("district", "x1", "y1", "x2", "y2").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def chain_rings(edges: DataFrame) -> DataFrame:
    """district boundary edges → district, ring_no, ring (closed, counter-clockwise, from its least vertex). One group is one district's boundary.

    Where a boundary meets itself, edges that are neighbours by angle belong together, so that rings touch but never
    cross. A vertex with an odd number of edges raises: the chain is open there.
    """

    def chain(key, pdf):
        import pandas as pd

        rings = rings_of(np.stack([pdf[["x1", "y1"]].to_numpy(float), pdf[["x2", "y2"]].to_numpy(float)], axis=1), key[0])
        return pd.DataFrame(
            {"district": [key[0]] * len(rings), "ring_no": range(len(rings)), "ring": [[{"x": x, "y": y} for x, y in r] for r in rings]}
        )

    kind = dict(edges.dtypes)["district"]
    return edges.groupBy("district").applyInPandas(chain, f"district {kind}, ring_no int, ring array<struct<x:double,y:double>>")


def rings_of(edges: np.ndarray, name) -> list[list[list[float]]]:
    """Closed rings of undirected edges (n, 2 ends, 2 coordinates).

    Each edge has two half-edges, one leaving either end. The half-edges of a vertex are sorted by angle and paired with
    their neighbour; the walk from a half-edge to the mate of its other end is a permutation, whose cycles are the rings.
    """
    own = edges.reshape(-1, 2)
    twin = np.arange(len(own)) ^ 1
    _, vertex, degree = np.unique(own, axis=0, return_inverse=True, return_counts=True)
    if (degree % 2).any():
        raise ValueError(f"open chain in district {name}")
    away = own[twin] - own
    by_angle = np.lexsort((np.arctan2(away[:, 1], away[:, 0]), vertex.ravel()))
    mate = np.empty(len(own), np.int64)
    mate[by_angle[0::2]], mate[by_angle[1::2]] = by_angle[1::2], by_angle[0::2]
    after = mate[twin].tolist()
    waiting = np.ones(len(own), bool)
    rings = []
    for start in np.lexsort((own[:, 1], own[:, 0])).tolist():
        if not waiting[start]:
            continue
        cycle, at = [start], after[start]
        while at != start:
            cycle.append(at)
            at = after[at]
        waiting[cycle] = waiting[twin[cycle]] = False  # the other direction is the same ring
        ring = own[cycle]
        nxt = np.roll(ring, -1, axis=0)
        if (ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]).sum() < 0:
            ring = np.roll(ring[::-1], 1, axis=0)
        rings.append([*ring.tolist(), ring[0].tolist()])
    return rings


def nest_rings(rings: DataFrame, cell: float | None = None) -> DataFrame:
    """rings (feature_id, ring_no, ring) → with area, depth (larger rings of the feature that contain its first vertex) and hole (odd depth)."""
    as_feature = rings.select(
        F.concat_ws("/", "feature_id", "ring_no").alias("feature_id"), F.col("feature_id").alias("owner"),
        F.col("ring_no").alias("outer_no"), F.array(F.array("ring")).alias("polygons")
    )
    areas = ring_measures(as_feature).select(F.col("feature_id").alias("k"), F.abs("area").alias("area"))
    sized = rings.withColumn("k", F.concat_ws("/", "feature_id", "ring_no")).join(areas, "k").drop("k")
    probes = sized.select(
        F.concat_ws("/", "feature_id", "ring_no").alias("pid"), F.col("feature_id").alias("own"), "ring_no", F.col("area").alias("small"),
        F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y")
    )
    hits = classify(probes, as_feature.join(areas.withColumnRenamed("k", "feature_id"), "feature_id"), cell)
    depth = hits.where(
        "own = owner and ring_no <> outer_no and area > small"
    ).groupBy(F.col("own").alias("feature_id"), "ring_no").agg(F.count("*").alias("depth"))
    out = sized.join(depth, ["feature_id", "ring_no"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return out.withColumn("hole", F.col("depth") % 2 == 1)


def _farthest_kept(line: np.ndarray, tol: float) -> np.ndarray:
    """Which points of an open line (n, 2) Douglas and Peucker's rule keeps: spans are split at their farthest point while it is beyond tol."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    spans = [(0, len(line) - 1)]
    while spans:
        lo, hi = spans.pop()
        inner = line[lo + 1 : hi] - line[lo]
        if not len(inner):
            continue
        along = line[hi] - line[lo]
        length = along @ along
        share = np.clip(inner @ along / length, 0, 1) if length else np.zeros(len(inner))
        off = ((inner - share[:, None] * along) ** 2).sum(axis=1)
        far = int(off.argmax())
        if off[far] > tol * tol:
            keep[lo + 1 + far] = True
            spans += [(lo, lo + 1 + far), (lo + 1 + far, hi)]
    return keep


def _ring_udf(f):
    """A function of one ring's (x, y) list as an Arrow-fed column function; rows are rings, so nothing is grouped."""

    @F.pandas_udf(RING)
    def run(rings):
        return rings.map(lambda r: [{"x": x, "y": y} for x, y in f([(p["x"], p["y"]) for p in r])])

    return run


def simplify_dp(rings: DataFrame, tol: float) -> DataFrame:
    """Douglas-Peucker with tolerance tol in the ring's units; a ring that would have under 4 points stays as it is."""

    def one(ring):
        if len(ring) < 4:
            return ring
        line = np.array(ring)
        far = int(((line - line[0]) ** 2).sum(axis=1).argmax())
        keep = np.concatenate([_farthest_kept(line[: far + 1], tol)[:-1], _farthest_kept(line[far:], tol)])
        return [ring[i] for i in np.flatnonzero(keep)] if keep.sum() >= 4 else ring

    return rings.withColumn("ring", _ring_udf(one)("ring"))


def simplify_area(rings: DataFrame, keep: float) -> DataFrame:
    """Removes the vertex of the smallest triangle until a share `keep` of the vertices is left, never under a triangle."""

    def one(ring):
        import heapq

        n = len(ring) - 1
        goal = max(3, round(n * keep))
        prev, nxt = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)]
        area = lambda i: abs(
            (ring[i][0] - ring[prev[i]][0]) * (ring[nxt[i]][1] - ring[prev[i]][1]) - (ring[nxt[i]][0] - ring[prev[i]][0]) * (ring[i][1] - ring[prev[i]][1])
        ) / 2
        now = [area(i) for i in range(n)]
        heap = [(a, i) for i, a in enumerate(now)]
        heapq.heapify(heap)
        left, gone = n, [False] * n
        while left > goal and heap:
            a, i = heapq.heappop(heap)
            if gone[i] or a != now[i]:
                continue
            gone[i], left = True, left - 1
            p, q = prev[i], nxt[i]
            nxt[p], prev[q] = q, p
            for j in (p, q):
                now[j] = max(area(j), a)
                heapq.heappush(heap, (now[j], j))
        out = [ring[i] for i in range(n) if not gone[i]]
        return [*out, out[0]]

    return rings.withColumn("ring", _ring_udf(one)("ring"))


def despike(rings: DataFrame, deviation: float, chord: float) -> DataFrame:
    """Drops vertices farther than `deviation` from a chord shorter than `chord`, to a fixpoint."""

    def one(ring):
        from math import hypot

        pts = ring[:-1]
        i = 0
        while i < len(pts) and len(pts) > 4:
            (ax, ay), (px, py), (bx, by) = pts[i - 1], pts[i], pts[(i + 1) % len(pts)]
            length = hypot(bx - ax, by - ay)
            off = abs((bx - ax) * (ay - py) - (ax - px) * (by - ay)) / length if length else hypot(px - ax, py - ay)
            if off > deviation and length < chord:
                del pts[i]
                i = 0 if i == len(pts) else max(i - 1, 0)  # only the neighbours have changed: the first, after the last, else the one before
            else:
                i += 1
        return [*pts, pts[0]]

    return rings.withColumn("ring", _ring_udf(one)("ring"))


def spikes(edges: DataFrame, deviation: float, chord: float) -> DataFrame:
    """Vertices (feature_id, polygon_idx, ring_idx, seq, x, y) off their neighbours' chord, in one pass over each closed ring."""
    w = Window.partitionBy("feature_id", "polygon_idx", "ring_idx")
    o = w.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {c: F.coalesce(F.lag(c).over(w.orderBy("seq")), F.last(c).over(o)) for c in ("ax", "ay")}
    v = edges.withColumns({"px": ends["ax"], "py": ends["ay"]})
    off = chord_deviation(F.col("ax"), F.col("ay"), F.col("px"), F.col("py"), F.col("bx"), F.col("by"))
    return v.where((off > deviation) & (F.hypot(F.col("bx") - F.col("px"), F.col("by") - F.col("py")) < chord)).select(
        "feature_id", "polygon_idx", "ring_idx", "seq", F.col("ax").alias("x"), F.col("ay").alias("y")
    )


def check_anchors(anchors: DataFrame, features: DataFrame) -> DataFrame:
    """anchors (pid, x, y, expected; null: must miss) → with got, status and ok."""
    got = with_status(anchors, features).withColumnRenamed("feature_id", "got").drop("n")
    return got.withColumn(
        "ok",
        F.when(F.col("expected").isNull(), F.col("status") == "NONE").otherwise((F.col("status") == "OK") & (F.col("got") == F.col("expected")))
    )


def check_envelope(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """One row a side: what the data reach, what is declared, and whether the declared box holds it."""
    e = bounding_boxes(features).agg(
        F.min("min_x").alias("west"), F.min("min_y").alias("south"), F.max("max_x").alias("east"), F.max("max_y").alias("north")
    )
    sides = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("side"), F.col(n).alias("reach"), F.lit(float(v)).alias("declared"),
                    (F.col(n) >= v if n in ("west", "south") else F.col(n) <= v).alias("ok")
                ) for n,
                v in zip(("west", "south", "east", "north"), box, strict=True)
            ]
        )
    )
    return e.select(sides.alias("s")).select("s.*")


def agreement(points: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: points, share with equal status and key in both layers, and double hits in b."""
    sa = with_status(points.select("x", "y"), a).select("x", "y", F.concat_ws("/", "status", "feature_id").alias("a"))
    sb = with_status(sa, b).select("a", F.concat_ws("/", "status", "feature_id").alias("b"), F.col("n").alias("hits"))
    return sb.agg(
        F.count("*").alias("n"), F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")).alias("share"),
        F.count_if(F.col("hits") > 1).alias("doubles")
    )


def check_simplification(points: DataFrame, source: DataFrame, new: DataFrame, least: float = 0.995) -> DataFrame:
    n = source.agg(F.count("*").alias("n_source")).withColumn("_k", F.lit(1)).join(
        new.agg(F.count("*").alias("n_new")).withColumn("_k", F.lit(1)), "_k"
    )
    both = agreement(points, source, new).withColumn("_k", F.lit(1)).join(n, "_k").drop("_k")
    return both.withColumn("ok", (F.col("n_source") == F.col("n_new")) & (F.col("doubles") == 0) & (F.col("share") >= least))


def edge_multiplicity(units: DataFrame) -> DataFrame:
    """Exact part of a tiling check: undirected edges by how often and in which directions they are walked."""
    e = ring_edges(units.select("feature_id", "polygons"))
    forward = F.when(F.struct("ax", "ay") < F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay")), 1).otherwise(-1)
    return e.select(*_key(), forward.alias("d")).groupBy("x1", "y1", "x2", "y2").agg(F.count("*").alias("n"), F.sum("d").alias("turn"))


def tiling_report(samples: DataFrame, features: DataFrame, outline: DataFrame) -> DataFrame:
    """One row over sample points: in the outline, covered once, never, more than once, and covered outside (spill)."""
    s = with_status(with_held(samples.select("x", "y"), outline, "in_parent"), features)
    return s.agg(
        F.count_if("in_parent").alias("parent"), F.count_if(F.col("in_parent") & (F.col("n") == 1)).alias("once"),
        F.count_if(F.col("in_parent") & (F.col("n") == 0)).alias("cracks"), F.count_if(F.col("n") > 1).alias("overlaps"),
        F.count_if(~F.col("in_parent") & (F.col("n") > 0)).alias("spill")
    )


def overlap_pairs(samples: DataFrame, features: DataFrame) -> DataFrame:
    """Sample points that two features share, by pair."""
    ids = features.select("feature_id", "polygons")
    none = F.array().cast(ids.select(F.array("feature_id").alias("s")).schema["s"].dataType)
    hits = fold_hits(samples.select("x", "y"), ids, {"s": none}, lambda found: {"s": F.concat("s", F.transform(found, lambda f: f["feature_id"]))})
    sets = hits.select(F.array_sort(F.array_distinct("s")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def fill_gaps(cells: DataFrame, features: DataFrame, reach: float | None = None) -> DataFrame:
    """cells (pid, x, y) that no feature owns → pid, owner: the feature whose boundary is nearest (within reach, if given)."""
    free = with_status(cells, features).where("n = 0").select(*cells.columns)
    edges = ring_edges(features.select("feature_id", "polygons")).withColumn("eid", F.struct("feature_id", "polygon_idx", "ring_idx", "seq"))
    found = nearest_segment(free, edges)
    own = found if reach is None else found.where(F.col("dist") <= reach)
    return own.select("pid", F.col("eid.feature_id").alias("owner"), "dist")


def fill_gap_pieces(cells: DataFrame, features: DataFrame, most: int, reach: float | None = None) -> DataFrame:
    """cells (cx, cy, x, y: a grid and its centres) that no feature owns → cx, cy, piece, cells, neighbours, owner, how.

    Unowned cells that share a side are a piece, named by its least cell. A piece's contact with a feature is the number of
    sides that it shares with the feature's cells. A piece with one neighbour goes to it (`only`); one of at most `most`
    cells goes whole to the neighbour of the largest contact, of several the least (`whole`); the cells of a larger one go
    each to the nearest boundary, distances being told apart to nine digits, if within reach (`split`, else `far`). Ground
    that several features claim is nobody's neighbour. A piece without a neighbour has a null owner where it isn't split.
    """
    owned = classify_status(cells.select(F.struct("cx", "cy").alias("pid"), "x", "y"), features)
    known = written(owned.select("pid", "n", F.col("feature_id").alias("own")))
    free = known.where("n = 0").select(F.col("pid").alias("u"))
    beside = lambda dx, dy: F.struct((F.col("u.cx") + dx).alias("cx"), (F.col("u.cy") + dy).alias("cy"))
    forward = free.select("u", F.explode(F.array(beside(1, 0), beside(0, 1))).alias("v"))
    piece = written(components(free, forward.join(free.select(F.col("u").alias("v")), "v", "left_semi")))
    sides = piece.select("component", F.explode(F.array(beside(1, 0), beside(-1, 0), beside(0, 1), beside(0, -1))).alias("v"))
    contact = sides.join(known.where("n = 1").select(F.col("pid").alias("v"), "own"), "v").groupBy("component", "own").agg(F.count("*").alias("c"))
    told = contact.groupBy("component").agg(
        F.count("*").alias("neighbours"), F.min_by("own", F.struct((-F.col("c")).alias("c"), "own")).alias("best")
    )
    size = piece.groupBy("component").agg(F.count("*").alias("cells")).join(told, "component", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))
    whole = (F.col("neighbours") == 1) | (F.col("cells") <= most)
    sized = written(piece.join(size, "component"))
    large = cells.select(F.struct("cx", "cy").alias("pid"), "x", "y").join(sized.where(~whole).select(F.col("u").alias("pid")), "pid", "left_semi")
    edges = ring_edges(features.select("feature_id", "polygons")).withColumn("eid", F.struct("feature_id", "polygon_idx", "ring_idx", "seq"))
    near = nearest_segment(large, edges, digits=9).select(F.col("pid").alias("u"), F.col("eid.feature_id").alias("near"), "dist")
    close = F.lit(True) if reach is None else F.col("dist") <= reach
    how = F.when(F.col("neighbours") == 1, "only").when(whole, "whole").when(close, "split").otherwise("far")
    return sized.join(near, "u", "left").select(
        "u.cx", "u.cy", F.col("component").alias("piece"), "cells", "neighbours", F.when(whole, F.col("best")).when(close, F.col("near")).alias("owner"), how.alias("how")
    )


def _disc(radius: int) -> Column:
    r = range(-radius, radius + 1)
    return F.array(
        *[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in r for j in r if i * i + j * j <= radius * radius]
    )


def close_voids(cells: DataFrame, radius: int) -> DataFrame:
    """cells (district, cx, cy): dilate, then erode each district by a disc; contested ground is given up, raw ground never."""
    n = sum(i * i + j * j <= radius * radius for i in range(-radius, radius + 1) for j in range(-radius, radius + 1))
    grow = lambda df: df.withColumn("o", F.explode(_disc(radius))).select(
        "district", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")
    )
    raw = cells.select("district", F.col("cx").cast("long"), F.col("cy").cast("long")).distinct()
    wide = grow(raw).distinct()
    closed = grow(wide).groupBy("district", "cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") == n).drop("n")
    sole = closed.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.min("district").alias("district")).where("n = 1").select("district", "cx", "cy")
    return raw.union(sole).distinct()


def drop_slivers(features: DataFrame, least: float) -> DataFrame:
    """Ring 0 of each polygon with its area: parts under `least` dropped; a feature that would vanish is flagged."""
    parts = ring_measures(features).where("ring_idx = 0").select("feature_id", "polygon_idx", F.abs("area").alias("area"))
    w = Window.partitionBy("feature_id")
    return parts.withColumn("kept", F.col("area") >= least).withColumn("vanished", ~F.bool_or("kept").over(w))


def fill_holes(rings: DataFrame, probes: DataFrame) -> DataFrame:
    """rings (feature_id, ring_no, ring, hole) and interior points (pid: feature) of the districts: a hole is kept only if it holds another district's ground."""
    holes = rings.where("hole").select(
        F.struct("feature_id", "ring_no").alias("h"), F.col("feature_id").alias("owner"), F.array(F.array("ring")).alias("polygons")
    )
    kept = classify(probes, holes).where("pid <> owner").select("h.feature_id", "h.ring_no").distinct()
    return rings.where("not hole").unionByName(rings.where("hole").join(kept, ["feature_id", "ring_no"], "left_semi"))


def clip_report(samples: DataFrame, features: DataFrame, outline: DataFrame) -> DataFrame:
    """Per feature: sample points, and the share outside the parent."""
    hits = classify(with_held(samples.select("x", "y"), outline, "inside"), features.select("feature_id", "polygons"))
    return hits.groupBy("feature_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("inside"), 0.0).otherwise(1.0)).alias("outside"))


def iou(samples: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Per key in either layer: intersection over union in sample points."""
    h = lambda f, c: classify(
        samples.select("pid", "x", "y"), f.select("feature_id", "polygons")
    ).select("pid", "feature_id", F.lit(True).alias(c))
    both = h(a, "in_a").join(h(b, "in_b"), ["pid", "feature_id"], "full_outer")
    return both.groupBy("feature_id").agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("both"), F.count("*").alias("either")
    ).withColumn("iou", F.col("both") / F.col("either"))


def check_interior_points(units: DataFrame, districts: DataFrame, composition: DataFrame) -> DataFrame:
    """Each unit's interior point must hit its own district and no other: unit, district, status, got, ok."""
    p = interior_points(units).withColumnRenamed("feature_id", "pid")
    got = classify_status(p, districts).select(F.col("pid").alias("unit"), "status", F.col("feature_id").alias("got"))
    return composition.select("unit", "district").join(got, "unit", "left").withColumn(
        "ok", (F.col("status") == "OK") & F.col("got").eqNullSafe(F.col("district"))
    )


def whole_unit_probes(units: DataFrame, shrink: float = 0.03, grid: int = 12) -> DataFrame:
    """Probe points of units: their vertices drawn towards the box centre by `shrink`, and a grid over their boxes."""
    boxes = bounding_boxes(units.select("feature_id", "polygons")).withColumns(
        {"mx": (F.col("min_x") + F.col("max_x")) / 2, "my": (F.col("min_y") + F.col("max_y")) / 2}
    )
    v = ring_edges(units.select("feature_id", "polygons")).join(boxes, "feature_id").select(
        "feature_id", F.concat(F.lit("v"), F.col("polygon_idx"), F.lit("/"), F.col("ring_idx"), F.lit("/"), F.col("seq")).alias("k"),
        (F.col("ax") + (F.col("mx") - F.col("ax")) * shrink).alias("x"), (F.col("ay") + (F.col("my") - F.col("ay")) * shrink).alias("y")
    )
    at = F.sequence(F.lit(0), F.lit(grid - 1))
    g = boxes.withColumn("i", F.explode(at)).withColumn("j", F.explode(at)).select(
        "feature_id", F.concat(F.lit("g"), F.col("i"), F.lit("/"), F.col("j")).alias("k"),
        (F.col("min_x") + (F.col("max_x") - F.col("min_x")) * (F.col("i") + 0.5) / grid).alias("x"),
        (F.col("min_y") + (F.col("max_y") - F.col("min_y")) * (F.col("j") + 0.5) / grid).alias("y")
    )
    return v.unionByName(g).select(F.concat_ws(":", "feature_id", "k").alias("pid"), F.col("feature_id").alias("probe_of"), "x", "y")


def check_whole_units(fine: DataFrame, coarse: DataFrame, parts: DataFrame) -> DataFrame:
    """parts (coarse, fine): per coarse unit, the probes on which being in it and being in its fine units disagree."""
    p = whole_unit_probes(coarse)
    in_coarse = classify(
        p, coarse.select(F.col("feature_id").alias("c"), "polygons")
    ).where("c = probe_of").select("pid").distinct().withColumn("a", F.lit(True))
    in_fine = classify(
        p, fine.select(F.col("feature_id").alias("fine"), "polygons")
    ).join(parts, "fine").where("coarse = probe_of").select("pid").distinct().withColumn("b", F.lit(True))
    both = p.select("pid", "probe_of").join(in_coarse, "pid", "left").join(in_fine, "pid", "left")
    return both.groupBy(F.col("probe_of").alias("coarse")).agg(
        F.count("*").alias("probes"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ")
    )


def adjudicate_blocks(blocks: DataFrame, pieces: DataFrame, expected: DataFrame) -> DataFrame:
    """blocks (pid, x, y, pop) → per piece: population by block points, the published one, ok; blocks in no piece come as a null piece."""
    got = with_status(blocks.select("x", "y", "pop"), pieces).groupBy(F.col("feature_id").alias("piece")).agg(
        F.sum("pop").alias("pop"), F.count("*").alias("blocks")
    )
    e = expected.select("piece", F.col("pop").alias("expected"))
    return got.join(e, got.piece.eqNullSafe(e.piece), "full_outer").select(F.coalesce(got.piece, e.piece).alias("piece"), "pop", "blocks", "expected").withColumn(
        "ok", F.col("piece").isNotNull() & F.col("pop").eqNullSafe(F.col("expected"))
    )


def shared_borders(units: DataFrame) -> DataFrame:
    """Adjacent pairs a < b with the length of their common border, and its share of either's outline."""
    e = ring_edges(units.select("feature_id", "polygons")).select("feature_id", *_key())
    sides = e.groupBy("x1", "y1", "x2", "y2").agg(F.array_sort(F.collect_set("feature_id")).alias("f")).where(F.size("f") == 2)
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    outline = e.groupBy("feature_id").agg(F.sum(length).alias("whole"))
    whole = lambda c: outline.select(F.col("feature_id").alias(c), F.col("whole").alias(f"whole_{c}"))
    pairs = sides.groupBy(F.col("f")[0].alias("a"), F.col("f")[1].alias("b")).agg(F.sum(length).alias("length"))
    return pairs.join(whole("a"), "a").join(whole("b"), "b").select(
        "a", "b", "length", (F.col("length") / F.col("whole_a")).alias("share_a"), (F.col("length") / F.col("whole_b")).alias("share_b")
    )


def check_descriptions(features: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (a, b, side ∈ north/south/east/west): whether a's centroid lies on that side of b's."""
    m = ring_measures(features).where("ring_idx = 0").groupBy("feature_id").agg(
        (F.sum(F.col("cx") * F.col("area")) / F.sum("area")).alias("x"), (F.sum(F.col("cy") * F.col("area")) / F.sum("area")).alias("y")
    )
    a, b = m.select(
        F.col("feature_id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya")
    ), m.select(F.col("feature_id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    ok = F.when(
        F.col("side") == "north", F.col("ya") > F.col("yb")
    ).when(
        F.col("side") == "south", F.col("ya") < F.col("yb")
    ).when(F.col("side") == "east", F.col("xa") > F.col("xb")).when(F.col("side") == "west", F.col("xa") < F.col("xb"))
    return rules.join(a, "a").join(b, "b").select("a", "b", "side", ok.alias("ok"))


def _centroids(features: DataFrame) -> DataFrame:
    m = ring_measures(features).where("ring_idx = 0").groupBy("feature_id")
    return m.agg((F.sum(F.col("cx") * F.col("area")) / F.sum("area")).alias("x"), (F.sum(F.col("cy") * F.col("area")) / F.sum("area")).alias("y"))


def check_bands(features: DataFrame, bands: DataFrame) -> DataFrame:
    """bands (feature_id, min_x, min_y, max_x, max_y; a null bound is open) → feature_id, x, y (centroid), ok: whether it lies in its band."""
    met = bands.join(_centroids(features), "feature_id", "left")
    within = lambda v, lo, hi: F.coalesce(F.col(v) >= F.col(lo), F.lit(True)) & F.coalesce(F.col(v) <= F.col(hi), F.lit(True))
    ok = F.col("x").isNotNull() & within("x", "min_x", "max_x") & within("y", "min_y", "max_y")
    return met.select("feature_id", "x", "y", ok.alias("ok"))


def check_area_shares(features: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (a, b, share, slack) → a, b, got, ok: whether a's area is that share of both areas together, give or take the slack."""
    area = ring_measures(features).where("ring_idx = 0").groupBy("feature_id").agg(F.sum(F.abs("area")).alias("area"))
    own = lambda c: area.select(F.col("feature_id").alias(c), F.col("area").alias(f"area_{c}"))
    got = F.col("area_a") / (F.col("area_a") + F.col("area_b"))
    met = rules.join(own("a"), "a", "left").join(own("b"), "b", "left").withColumn("got", got)
    return met.select("a", "b", "got", F.coalesce(F.abs(F.col("got") - F.col("share")) <= F.col("slack"), F.lit(False)).alias("ok"))


def check_extent(features: DataFrame, outline: DataFrame, tol: float) -> DataFrame:
    """One row: the largest difference between the bounds of features and parent, and whether it is within tol."""
    sides = ["min_x", "min_y", "max_x", "max_y"]
    agg = lambda df, p: bounding_boxes(df).agg(
        *[(F.min if s.startswith("min") else F.max)(s).alias(p + s) for s in sides]
    ).withColumn("_k", F.lit(1))
    both = agg(features, "a_").join(agg(outline, "b_"), "_k")
    return both.select(
        F.greatest(*[F.abs(F.col("a_" + s) - F.col("b_" + s)) for s in sides]).alias("differ")
    ).withColumn("ok", F.col("differ") <= tol)


def check_disjoint_sources(features: DataFrame) -> DataFrame:
    """features with source: interior points of one source inside a feature of another — probe, probe_source, feature_id, source."""
    p = interior_points(features).withColumnRenamed("feature_id", "pid").join(
        features.select(F.col("feature_id").alias("pid"), F.col("source").alias("probe_source")), "pid"
    )
    return classify(p, features.select("feature_id", "source", "polygons")).where("source <> probe_source").select(
        F.col("pid").alias("probe"), "probe_source", "feature_id", "source"
    )


def corridor_median(lines: DataFrame, step: float) -> DataFrame:
    """lines (ax, ay, bx, by) of a bundle → x, y: the median crossing at scan-lines every `step`."""
    ends = lines.withColumn("k0", F.ceil(F.least("ax", "bx") / step).cast("long")).withColumn(
        "k1", F.floor(F.greatest("ax", "bx") / step).cast("long")
    )
    spans = ends.where("k0 <= k1 and ax <> bx").withColumn("k", F.explode(F.sequence("k0", "k1")))
    y = F.col("ay") + (F.col("by") - F.col("ay")) * (F.col("k") * F.lit(step) - F.col("ax")) / (F.col("bx") - F.col("ax"))
    return spans.select("k", y.alias("y")).groupBy("k").agg(F.median("y").alias("y"), F.count("*").alias("n")).select(
        (F.col("k") * F.lit(step)).alias("x"), "y", "n", "k"
    )


def corridor_channel(lines: DataFrame, step: float, gap: float) -> DataFrame:
    """lines (path, ax, ay, bx, by) of bundles → path, k, x, y, channels: a line through each bundle that keeps to its channel.

    The crossings at a scan-line (every `step`) fall into channels where they lie more than `gap` apart; the middle of a
    channel is half way between its outer crossings. The line begins in the middle of the channel with most crossings
    (of several the lowest) and goes on in that whose middle is nearest to the one before, so that a side arm does not move
    it. The fold is over a path's scan-lines, which are one row.
    """
    ends = lines.withColumn("k0", F.ceil(F.least("ax", "bx") / step).cast("long")).withColumn("k1", F.floor(F.greatest("ax", "bx") / step).cast("long"))
    spans = ends.where("k0 <= k1 and ax <> bx").withColumn("k", F.explode(F.sequence("k0", "k1")))
    y = F.col("ay") + (F.col("by") - F.col("ay")) * (F.col("k") * F.lit(step) - F.col("ax")) / (F.col("bx") - F.col("ax"))
    own = Window.partitionBy("path", "k").orderBy("y")
    parted = spans.select("path", "k", y.alias("y")).withColumn("new", (F.coalesce(F.col("y") - F.lag("y").over(own), F.lit(0.0)) > gap).cast("int"))
    at = parted.withColumn("channel", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    middles = at.groupBy("path", "k", "channel").agg(((F.min("y") + F.max("y")) / 2).alias("m"), F.count("*").alias("n"))
    rows = middles.groupBy("path", "k").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("few"), "m"))).alias("c"))
    lists = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("s"))
    out = "array<struct<k:bigint,y:double,channels:int>>"
    empty = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast(out).alias("out"))

    def follow(now, line):
        nearest = F.sort_array(F.transform(line["c"], lambda c: F.struct(F.abs(c["m"] - now["y"]).alias("d"), c["m"].alias("m"))))[0]["m"]
        y = F.when(now["y"].isNull(), line["c"][0]["m"]).otherwise(nearest)
        return F.struct(y.alias("y"), F.concat(now["out"], F.array(F.struct(line["k"].alias("k"), y.alias("y"), F.size(line["c"]).alias("channels")))).alias("out"))

    told = lists.select("path", F.explode(F.aggregate("s", empty, follow)["out"]).alias("o"))
    return told.select("path", "o.k", (F.col("o.k") * F.lit(step)).alias("x"), "o.y", "o.channels")


def sample_gaps(samples: DataFrame, step: float, order: str = "x") -> DataFrame:
    """Where consecutive samples are more than 1.5 steps apart: before, after. For one path; partition by path id for many."""
    keys = [c for c in samples.columns if c == "path"]
    before = F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    return samples.select(*keys, before.alias("before"), F.col(order).alias("after")).where(F.col("after") - F.col("before") > 1.5 * step)


def split_by_line(cells: DataFrame, line: DataFrame, step: float) -> DataFrame:
    """cells (unit, x, y) by the side of a path (x, y at multiples of step): above or below, in cells; their sum is the unit's."""
    k = F.round(F.col("x") / step).cast("long")
    path = line.select(F.col("k").alias("lk"), F.col("y").alias("ly"))
    met = cells.withColumn("lk", k).join(path, "lk", "left")
    side = F.when(F.col("ly").isNull(), "off").when(F.col("y") > F.col("ly"), "above").otherwise("below")
    return met.groupBy("unit", side.alias("side")).agg(F.count("*").alias("cells"))


def merge_same_name(features: DataFrame) -> DataFrame:
    """features (name, polygons) → one multi-part feature a name; blank names together as one null row with their count."""
    name = F.nullif(F.trim("name"), F.lit(""))
    return features.groupBy(name.alias("name")).agg(F.count("*").alias("rows"), F.flatten(F.collect_list("polygons")).alias("polygons"))


def boundary_shift(a: DataFrame, b: DataFrame, step: float) -> DataFrame:
    """Median and greatest distance from samples every `step` on a's boundary to b's boundary, by feature of a."""
    s = ring_edges(a.select("feature_id", "polygons")).select(
        "feature_id", F.posexplode(densify(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), step)).alias("k", "p"), "polygon_idx",
        "ring_idx", "seq"
    )
    pts = s.select(F.struct("feature_id", "polygon_idx", "ring_idx", "seq", "k").alias("pid"), "p.x", "p.y")
    edges = ring_edges(b.select("feature_id", "polygons")).withColumn("eid", F.struct("feature_id", "polygon_idx", "ring_idx", "seq"))
    d = nearest_segment(pts, edges)
    return d.groupBy(F.col("pid.feature_id").alias("feature_id")).agg(
        F.median("dist").alias("median"), F.max("dist").alias("greatest"), F.count("*").alias("samples")
    )


def best_share(shares: DataFrame, floor: float) -> DataFrame:
    """shares (unit, district, share) → each unit's district of the largest share, of several the least, if it reaches the floor."""
    best = shares.groupBy("unit").agg(F.min_by("district", F.struct((-F.col("share")).alias("s"), "district")).alias("district"), F.max("share").alias("share"))
    return best.withColumn("district", F.when(F.col("share") >= floor, F.col("district")))


def membership(shares: DataFrame, split: float = 0.1) -> DataFrame:
    """Units with half or more in a district, and the districts of units that are split above `split`."""
    return shares.groupBy("unit").agg(
        F.max(F.when(F.col("share") >= 0.5, F.col("district"))).alias("home"),
        F.array_sort(F.collect_set(F.when(F.col("share") > split, F.col("district")))).alias("districts")
    )


def label_hits(labels: DataFrame, units: DataFrame) -> DataFrame:
    """labels (pid, x, y, names): whether the printed label falls in the unit it names."""
    return with_status(labels.select("pid", "x", "y", "names"), units).select(
        "pid", "names", F.col("feature_id").alias("got"), F.col("feature_id").eqNullSafe(F.col("names")).alias("ok")
    )


def outline_difference(samples: DataFrame, features: DataFrame, outline: DataFrame) -> DataFrame:
    """One row: share of sample points in exactly one of the features' union and the outline."""
    both = with_held(with_held(samples.select("x", "y"), features, "a"), outline, "b")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("differ"))


def first_owner(cells: DataFrame) -> DataFrame:
    """cells (district, cx, cy): ground claimed twice goes to the lowest key."""
    w = Window.partitionBy("cx", "cy")
    return cells.distinct().withColumn("_o", F.min("district").over(w)).where("district = _o").drop("_o")


def largest_part(features: DataFrame) -> DataFrame:
    return ring_measures(features).where("ring_idx = 0").groupBy("feature_id").agg(
        F.max_by("polygon_idx", F.struct(F.abs("area").alias("a"), (-F.col("polygon_idx")).alias("p"))).alias("polygon_idx"),
        F.max(F.abs("area")).alias("area")
    )


def check_fabric(units: DataFrame, composition: DataFrame, printed: DataFrame) -> DataFrame:
    """units (unit, pop), composition (district, unit) and the parents' printed totals (district, pop) → findings (problem, subject, got, expected).

    The fabric holds when names are one to one (a unit neither absent, unclaimed nor claimed twice) and each district's
    population is its printed total; then there is no finding. Units listed twice are counted once.
    """
    names = reconcile_partition(composition, units).select(
        "problem", F.col("unit").alias("subject"), F.lit(None).cast("long").alias("got"), F.lit(None).cast("long").alias("expected")
    )
    key = lambda df, *others: df.select(norm_alnum(F.col("unit").cast("string")).alias("unit"), *others)
    sums = population_rollup(key(units, "pop").distinct(), key(composition, "district").distinct(), printed).where("not ok")
    told = sums.select(
        F.lit("population").alias("problem"), F.col("district").cast("string").alias("subject"), F.col("pop").cast("long").alias("got"),
        F.col("printed").cast("long").alias("expected")
    )
    return names.unionByName(told)


def district_areas(edges: DataFrame) -> DataFrame:
    return edge_measures(edges, ["district"]).select("district", "area")
