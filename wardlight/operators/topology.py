"""Borders that neighbours share: chains between junctions, simplified once for all their owners, and borders made to meet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.operators.geometry import RING, _farthest_kept, _key, chain_rings
from wardlight.operators.spatial import ring_edges

ENDS = ["x1", "y1", "x2", "y2"]


def _walk(edges: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """Chains of undirected edges (n, 2 ends, 2 coordinates): paths between stops (n, 2: whether an end is a junction), and loops without one."""
    points, of = np.unique(edges.reshape(-1, 2), axis=0, return_inverse=True)
    of = of.reshape(-1, 2)
    stop = np.zeros(len(points), bool)
    stop[of[stops]] = True
    at: list[list[int]] = [[] for _ in points]
    for k, (a, b) in enumerate(of.tolist()):
        at[a].append(k)
        at[b].append(k)
    ends, left, chains = of.tolist(), np.ones(len(of), bool), []

    def follow(start: int, edge: int) -> None:
        path, now = [start], start
        while True:
            left[edge] = False
            now = ends[edge][0] if ends[edge][1] == now else ends[edge][1]
            path.append(now)
            further = [k for k in at[now] if left[k]]
            if stop[now] or now == start or not further:
                break
            edge = further[0]
        chains.append(points[path])

    for first in (np.flatnonzero(stop).tolist(), range(len(points))):  # paths between junctions, then loops from their least vertex
        for v in first:
            for k in at[v]:
                if left[k]:
                    follow(v, k)
    return chains


def shared_chains(features: DataFrame) -> DataFrame:
    """features (feature_id, polygons) → owners (sorted feature ids), chain (its vertices, from junction to junction), closed, twin.

    A chain is a longest run of edges with the same owners; a vertex is a junction where other than two edges meet, or two
    with other owners. closed: a loop without a junction; twin: another chain joins the same junctions. Needs exactly
    shared vertices (see noded). Owners and junctions come from groups of an edge and of a vertex; a chain is walked in
    the group of its owners, which is the border of two neighbours or a feature's own outline.
    """
    edges = ring_edges(features.select("feature_id", "polygons")).select("feature_id", *_key())
    own = edges.groupBy("feature_id", *ENDS).agg(F.count("*").alias("n")).where("n % 2 = 1")  # a slit walked both ways is no border
    sides = own.groupBy(*ENDS).agg(F.array_sort(F.collect_list("feature_id")).alias("owners"))
    ends = sides.select("owners", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("v"))
    stops = ends.groupBy("v").agg(F.count("*").alias("n"), F.min("owners").alias("a"), F.max("owners").alias("b")).where("n <> 2 or a <> b").select("v")
    for k in ("1", "2"):
        here = stops.select(F.col("v.x").alias(f"x{k}"), F.col("v.y").alias(f"y{k}"), F.lit(True).alias(f"stop{k}"))
        sides = sides.join(here, [f"x{k}", f"y{k}"], "left").withColumn(f"stop{k}", F.coalesce(f"stop{k}", F.lit(False)))
    kind = dict(features.dtypes)["feature_id"]

    def walk(pdf):
        import pandas as pd

        found = _walk(pdf[ENDS].to_numpy(float).reshape(-1, 2, 2), pdf[["stop1", "stop2"]].to_numpy(bool))
        return pd.DataFrame({"owners": [pdf["owners"].iloc[0]] * len(found), "chain": [[{"x": x, "y": y} for x, y in c.tolist()] for c in found]})

    chains = sides.groupBy("owners").applyInPandas(walk, f"owners array<{kind}>, chain array<struct<x:double,y:double>>")
    a, b = F.col("chain")[0], F.element_at("chain", -1)
    closed = chains.withColumn("closed", a == b)
    return closed.withColumn("twin", F.count("*").over(Window.partitionBy(F.least(a, b), F.greatest(a, b))) > 1)


def _areas_kept(line: np.ndarray, least: float, fewest: int) -> np.ndarray:
    """Which points of an open line stay when the vertex of the smallest triangle is removed while that is under `least`."""
    import heapq

    n = len(line)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))

    def area(i):
        (ax, ay), (x, y), (bx, by) = line[before[i]], line[i], line[after[i]]
        return abs((x - ax) * (by - ay) - (bx - ax) * (y - ay)) / 2

    now = {i: area(i) for i in range(1, n - 1)}
    heap, keep, left = [(a, i) for i, a in now.items()], np.ones(n, bool), n
    heapq.heapify(heap)
    while heap and left > fewest:
        a, i = heapq.heappop(heap)
        if not keep[i] or a != now[i]:
            continue
        if a >= least:
            break
        keep[i], left = False, left - 1
        p, q = before[i], after[i]
        after[p], before[q] = q, p
        for j in (p, q):
            if 0 < j < n - 1:
                now[j] = max(area(j), a)
                heapq.heappush(heap, (now[j], j))
    return keep


def simplify_shared(features: DataFrame, tol: float | None = None, least_area: float | None = None) -> DataFrame:
    """features with polygons simplified so that neighbours keep a common border: each chain once, for all its owners.

    tol: Douglas and Peucker's rule; least_area: triangles under it go, smallest first. Junctions stay. A loop keeps four
    vertices at least and one of several chains between the same junctions three, so that no ring collapses. The rings of a
    feature are rebuilt as one even-odd polygon; other columns are kept; features without area go.
    """
    if (tol is None) == (least_area is None):
        raise ValueError("give tol or least_area")

    def one(chain, fewest):
        line = np.array([(p["x"], p["y"]) for p in chain])
        if len(line) <= fewest:
            return chain
        if least_area is not None:
            return [chain[i] for i in np.flatnonzero(_areas_kept(line, least_area, fewest))]
        cut = int(((line - line[0]) ** 2).sum(axis=1).argmax()) if fewest > 3 else len(line) - 1
        keep = np.zeros(len(line), bool)
        for lo, hi in ((0, cut), (cut, len(line) - 1)):
            if lo < hi:
                keep[lo : hi + 1] |= _farthest_kept(line[lo : hi + 1], tol)
        while keep.sum() < fewest:  # the point farthest from what is kept
            kept = np.flatnonzero(keep)
            far = np.full(len(line), -1.0)
            for lo, hi in zip(kept, kept[1:], strict=False):
                along = line[hi] - line[lo]
                inner = line[lo + 1 : hi] - line[lo]
                size = np.hypot(*along)
                far[lo + 1 : hi] = np.abs(inner[:, 0] * along[1] - inner[:, 1] * along[0]) / size if size else np.hypot(*inner.T)
            keep[far.argmax()] = True
        return [chain[i] for i in np.flatnonzero(keep)]

    @F.pandas_udf(RING)
    def run(chains, fewest):
        import pandas as pd

        return pd.Series([one(c, f) for c, f in zip(chains, fewest, strict=True)])

    chains = shared_chains(features)
    fewest = F.when(F.col("closed"), 4).when(F.col("twin"), 3).otherwise(2)
    thin = chains.select("owners", run("chain", fewest).alias("chain"))
    return _rebuilt(features, thin.select(F.explode("owners").alias("district"), "chain"))


def _rebuilt(features: DataFrame, chains: DataFrame) -> DataFrame:
    """features with the polygons that chains (district: feature_id, chain) enclose."""
    size = F.size("chain")
    pairs = F.zip_with(F.slice("chain", 1, size - 1), F.slice("chain", 2, size - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    edges = chains.select("district", F.explode(pairs).alias("e")).select("district", "e.*").where("ax <> bx or ay <> by").select("district", *_key())
    once = edges.groupBy("district", *ENDS).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")
    rings = chain_rings(once).groupBy(F.col("district").alias("feature_id")).agg(F.array(F.collect_list("ring")).alias("polygons"))
    return features.drop("polygons").join(rings, "feature_id").select(*features.columns)


def noded(features: DataFrame, snap: float) -> DataFrame:
    """features whose borders meet exactly: vertices within `snap` become one, and edges are split where another's vertex lies on them.

    Vertices meet by cells of side `snap` and their neighbours; each goes to the least vertex (by x, y) within reach, again
    until none moves, so that a run of near vertices becomes one. Edges and vertices then meet by the cells of a grid that
    an edge crosses; a vertex within `snap` of an edge, and not of its ends, splits it. An edge is cut in one row, however
    many vertices lie on it. Edges that become a point, and those that a feature then walks both ways, go.
    """
    from wardlight.operators.cells import KEYS, grid_of
    from wardlight.tables import written

    edges = written(ring_edges(features.select("feature_id", "polygons")).select("feature_id", *_key()))
    vertices = edges.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("v")).distinct()
    moved = written(vertices.select("v", F.col("v").alias("to")))
    cell = lambda c, v: F.floor(F.col(f"{v}.{c}") / snap).cast("long")
    for _ in range(20):
        to = moved.select("to").distinct()
        near = to.select("to", F.explode(F.sequence(cell("x", "to") - 1, cell("x", "to") + 1)).alias("cx"), cell("y", "to").alias("y0"))
        near = near.select("to", "cx", F.explode(F.sequence(F.col("y0") - 1, F.col("y0") + 1)).alias("cy"))
        least = to.select(F.col("to").alias("w"), cell("x", "to").alias("cx"), cell("y", "to").alias("cy"))
        best = near.join(least, ["cx", "cy"]).where(F.hypot(F.col("w.x") - F.col("to.x"), F.col("w.y") - F.col("to.y")) <= snap).groupBy("to").agg(F.min("w").alias("least"))
        step = best.where("least <> to")
        if step.isEmpty():
            break
        moved = written(moved.join(step, "to", "left").select("v", F.coalesce("least", "to").alias("to")))
    for k in ("1", "2"):
        here = moved.select(F.col("v.x").alias(f"x{k}"), F.col("v.y").alias(f"y{k}"), F.col("to").alias(f"to{k}"))
        edges = edges.join(here, [f"x{k}", f"y{k}"])
    sides = edges.where("to1 <> to2").select("feature_id", F.least("to1", "to2").alias("a"), F.greatest("to1", "to2").alias("b"))
    boxes = sides.select("a", "b").distinct().select(
        "a", "b", (F.col("a.x") - snap).alias("min_x"), (F.least("a.y", "b.y") - snap).alias("min_y"), (F.col("b.x") + snap).alias("max_x"),
        (F.greatest("a.y", "b.y") + snap).alias("max_y")
    )
    grid = grid_of(written(boxes))
    points = moved.select(F.col("to.x").alias("x"), F.col("to.y").alias("y"), "to").distinct()
    along = (F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    size = along[0] * along[0] + along[1] * along[1]
    t = ((F.col("x") - F.col("a.x")) * along[0] + (F.col("y") - F.col("a.y")) * along[1]) / size
    off = F.abs((F.col("x") - F.col("a.x")) * along[1] - (F.col("y") - F.col("a.y")) * along[0]) / F.sqrt(size)
    on = grid.keyed(points).join(grid.boxes, KEYS).where((F.col("to") != F.col("a")) & (F.col("to") != F.col("b")) & (off <= snap) & (t > 0) & (t < 1))
    cuts = on.select("a", "b", F.struct(t.alias("t"), F.col("to").alias("v")).alias("c")).distinct().groupBy("a", "b").agg(F.sort_array(F.collect_list("c")).alias("cuts"))
    path = F.concat(F.array("a"), F.coalesce(F.transform("cuts", lambda c: c["v"]), F.expr("array()").cast(RING)), F.array("b"))
    chains = sides.join(cuts, ["a", "b"], "left").select(F.col("feature_id").alias("district"), path.cast(RING).alias("chain"))
    return _rebuilt(features, chains)
