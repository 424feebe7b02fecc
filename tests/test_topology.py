"""Shared chains, noding and simplification against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wardlight.operators import geometry as G
from wardlight.operators import topology as T
from wardlight.operators.overlay import overlay_areas


def layer(spark, rings, kind="int"):
    rows = [(k, [[[(float(x), float(y)) for x, y in [*r, r[0]]] for r in own]], f"n{k}") for k, own in rings.items()]
    return spark.createDataFrame(rows, f"feature_id {kind}, polygons array<array<array<struct<x:double,y:double>>>>, name string")


def wavy(seed, n=3, size=4, steps=12):
    """A tiling of n by n cells of `size`, whose inner sides waver, and an island in the first."""
    rnd = random.Random(seed)
    side = {}

    def line(a, b):
        if (a, b) not in side:
            fixed = (a[0] == b[0] and a[0] in (0, n * size)) or (a[1] == b[1] and a[1] in (0, n * size))
            push = [0 if fixed else rnd.uniform(-0.4, 0.4) for _ in range(steps)]
            way = (0, 1) if a[1] == b[1] else (1, 0)
            at = lambda k, i: a[k] + (b[k] - a[k]) * (i + 1) / (steps + 1) + way[k] * push[i]
            side[a, b] = [a, *((at(0, i), at(1, i)) for i in range(steps)), b]
            side[b, a] = side[a, b][::-1]
        return side[a, b][:-1]

    rings = {}
    for i in range(n):
        for j in range(n):
            c = [(i * size, j * size), (i * size + size, j * size), (i * size + size, j * size + size), (i * size, j * size + size)]
            rings[i * n + j] = [[p for a, b in zip(c, [*c[1:], c[0]], strict=True) for p in line(a, b)]]
    isle = [(1.5 + math.cos(a / 10 * math.pi), 2 + math.sin(a / 10 * math.pi)) for a in range(20)]
    rings[0].append(isle[::-1])
    rings[100] = [isle]
    return rings


def area(f):
    from wardlight.operators.overlay import edge_list, overlap_area

    own = f.withColumn("e", edge_list(F.col("polygons")))
    return {r.feature_id: r.a for r in own.select("feature_id", overlap_area("e", "e").alias("a")).collect()}


def doubles(f):
    return {(r.n, abs(r.turn)): r["count"] for r in G.edge_multiplicity(f).groupBy("n", "turn").count().collect()}


@pytest.mark.parametrize("how", [{"tol": 0.3}, {"least_area": 0.06}])
def test_neighbours_keep_a_common_border(spark, how):
    f = layer(spark, wavy(3))
    thin = T.simplify_shared(f, **how).cache()
    assert sorted(r.name for r in thin.collect()) == sorted(r.name for r in f.collect())
    count = lambda df: df.select(F.explode(F.flatten("polygons")).alias("r")).agg(F.sum(F.size("r"))).first()[0]
    assert count(thin) < 0.8 * count(f)
    assert {n for n, _ in doubles(thin)} == {1, 2}  # inner borders twice, the outline once
    assert math.isclose(sum(area(thin).values()), 144, rel_tol=1e-9)  # no crack ...
    both = overlay_areas(thin, thin, 1e-9).where("a_id < b_id").count()
    assert both == 0  # ... and no overlap
    assert all(abs(a - area(f)[k]) < 2.5 for k, a in area(thin).items())


def test_nothing_is_removed_without_tolerance_and_rings_never_collapse(spark):
    f = layer(spark, wavy(5, n=2))
    assert area(T.simplify_shared(f, least_area=0.0)) == pytest.approx(area(f))
    flat = T.simplify_shared(f, tol=100.0)
    assert set(area(flat)) == set(area(f)) and all(a > 0 for a in area(flat).values())
    lens = layer(spark, {1: [[(0, 0), (1, 0.1), (2, 0), (1, -0.1)]], 2: [[(0, 0), (1, 0.1), (2, 0), (2, 3), (0, 3)]]})
    assert all(a > 0 for a in area(T.simplify_shared(lens, tol=5.0)).values())


def test_chains_end_at_junctions(spark):
    f = layer(spark, {1: [[(0, 0), (1, 0), (1, 1), (0, 1)]], 2: [[(1, 0), (2, 0), (2, 1), (1, 1)]], 3: [[(5, 5), (6, 5), (6, 6)]]})
    got = sorted((r.owners, len(r.chain), r.closed, r.twin) for r in T.shared_chains(f).collect())
    assert got == [([1], 4, False, True), ([1, 2], 2, False, True), ([2], 4, False, True), ([3], 4, True, False)]
    assert T.shared_chains(f.limit(0)).count() == 0


def test_noded_borders_dissolve_like_clean_ones(spark):
    """T-junctions and noise of 1e-7: the dissolved boundary is the clean units', but for the noise."""
    clean = {1: [[(0, 0), (2, 0), (2, 1), (2, 2), (0, 2)]], 2: [[(2, 0), (4, 0), (4, 1), (2, 1)]], 3: [[(2, 1), (4, 1), (4, 2), (2, 2)]]}
    rnd = random.Random(4)
    shake = lambda r: [(x + rnd.uniform(-1, 1) * 1e-7, y + rnd.uniform(-1, 1) * 1e-7) for x, y in r]
    noisy = {k: [shake([p for p in r if (k, p) != (1, (2, 1))]) for r in own] for k, own in clean.items()}  # unit 1 has no vertex where 2 and 3 meet
    parts = spark.createDataFrame([(7, k) for k in clean], "district int, unit int")
    near = lambda *p: tuple(round(v, 5) + 0.0 for v in p)
    bound = lambda f: {frozenset((near(r.x1, r.y1), near(r.x2, r.y2))) for r in G.dissolve(f, parts).collect()}
    raw = layer(spark, noisy)
    assert len(bound(raw)) > len(bound(layer(spark, clean)))
    assert bound(T.noded(raw, 1e-5)) == bound(layer(spark, clean))
    assert bound(T.noded(layer(spark, clean), 1e-5)) == bound(layer(spark, clean))
    assert T.noded(raw.limit(0), 1e-5).count() == 0


def test_cover_areas_against_many_points(spark, monkeypatch):
    """Overlapping features with holes and an outline; cells so crowded that they are quartered."""
    from wardlight.operators import overlay as O

    monkeypatch.setattr(O, "CROWDED", 8)
    rings = {1: [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]], 2: [[(2, 2), (6, 2.5), (5, 6)]], 3: [[(0, 0), (4, 0), (4, 4), (0, 4)]], 4: [[(9, 9), (10, 9), (9, 10)]]}
    f, parent = layer(spark, rings), layer(spark, {9: [[(0.5, 0.5), (5.5, 0.5), (5.5, 5.0), (0.5, 5.5)]]})

    def inside(own, x, y):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for r in own for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]], strict=True)) % 2 == 1

    for cell in (None, 2.5, 100.0):
        got = {(tuple(r.members), r.in_parent): r.area for r in O.cover_areas(f, parent, cell).where("area > 1e-9").collect()}
        want, n = {}, 500
        for i in range(n):
            for j in range(n):
                x, y = (i + 0.5) * 11 / n, (j + 0.5) * 11 / n
                key = tuple(k for k, own in rings.items() if inside(own, x, y)), inside([[(0.5, 0.5), (5.5, 0.5), (5.5, 5.0), (0.5, 5.5)]], x, y)
                if key != ((), False):
                    want[key] = want.get(key, 0) + (11 / n) ** 2
        assert {k for k, a in want.items() if a > 0.05} <= set(got)
        assert all(abs(got.get(k, 0) - want.get(k, 0)) < 0.06 for k in set(got) | set(want))
        total = lambda k: sum(a for (members, _), a in got.items() if k in members)
        assert total(1) == pytest.approx(12) and total(3) == pytest.approx(16) and total(4) == pytest.approx(0.5)
