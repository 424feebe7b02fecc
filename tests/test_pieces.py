"""Components, gaps by piece, polygons split by a path, and a line that keeps to its channel."""

import random

import pytest
from pyspark.sql import functions as F

from wardlight.operators import geometry as G
from wardlight.operators.components import components
from wardlight.operators.overlay import split_polygons


def square(x0, y0, x1, y1):
    return [[(float(x), float(y)) for x, y in [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]


def layer(spark, rings):
    return spark.createDataFrame([(k, [own]) for k, own in rings.items()], "feature_id int, polygons array<array<array<struct<x:double,y:double>>>>")


def test_components_against_a_walk(spark):
    rnd = random.Random(3)
    edges = {tuple(sorted(rnd.sample(range(120), 2))) for _ in range(90)} | {(k, k + 1) for k in range(200, 260)}
    nodes = sorted({x for e in edges for x in e} | {999})
    near = {x: {b if a == x else a for a, b in edges if x in (a, b)} for x in nodes}
    want, seen = {}, set()
    for x in nodes:
        if x not in seen:
            todo, part = [x], set()
            while todo:
                now = todo.pop()
                if now not in part:
                    part.add(now)
                    todo += near[now]
            seen |= part
            want |= dict.fromkeys(part, min(part))
    got = components(spark.createDataFrame([(x,) for x in nodes], "u int"), spark.createDataFrame(sorted(edges), "u int, v int"))
    assert {r.u: r.component for r in got.collect()} == want
    none = components(spark.createDataFrame([], "u int"), spark.createDataFrame([], "u int, v int"))
    assert none.count() == 0


def test_gaps_by_piece(spark):
    """A small crack goes whole to the longest contact, one in reach of one feature to that, a large one by cell, far cells to nobody."""
    f = layer(spark, {1: square(0, 0, 10, 10), 2: square(10, 0, 20, 4), 3: square(12, 4, 20, 10), 4: square(0, 12, 4, 40)})
    cells = spark.createDataFrame([(i, j, i + 0.5, j + 0.5) for i in range(20) for j in range(40)] + [(50, 50, 50.5, 50.5)], "cx int, cy int, x double, y double")
    got = {(r.cx, r.cy): r for r in G.fill_gap_pieces(cells, f, 20, 6.0).collect()}
    crack = [got[i, j] for i in (10, 11) for j in range(4, 10)]  # joins the large gap above, at row 10
    assert {r.how for r in crack} == {"split"} and {r.piece for r in crack} == {got[10, 39].piece} and crack[0].owner == 1
    assert got[19, 39].how == "far" and got[19, 39].owner is None and got[50, 50].owner is None and got[50, 50].neighbours == 0
    shut = layer(spark, {1: square(0, 0, 10, 10), 2: square(10, 0, 20, 4), 3: square(12, 4, 20, 10), 5: square(0, 10, 20, 40)})
    whole = {(r.cx, r.cy): (r.owner, r.how, r.cells) for r in G.fill_gap_pieces(cells, shut, 20, 6.0).collect() if r.cx < 20}
    assert set(whole.values()) == {(1, "whole", 12)}  # 6 sides on 1 and on 3, 2 on each of the others: the least of the longest
    ring = layer(spark, {7: [*square(0, 0, 20, 40), *square(5, 5, 8, 8)]})
    assert {(r.owner, r.how) for r in G.fill_gap_pieces(cells.where("cx < 20"), ring, 1).collect()} == {(7, "only")}
    assert G.fill_gap_pieces(cells.limit(0), ring, 1).count() == 0


def test_split_polygons_keep_their_area(spark):
    hole = [(float(x), float(y)) for x, y in [(3, 3), (3, 6), (6, 6), (6, 3), (3, 3)]]
    comb = [(0, 0), (9, 0), (9, 8), (8, 1), (7, 8), (6, 1), (5, 8), (4, 1), (3, 8), (0, 8), (0, 0)]
    f = layer(spark, {1: [*square(0, 0, 10, 10), hole], 2: [[(x + 20.0, float(y)) for x, y in comb]], 3: square(50, 0, 51, 1)})
    path = spark.createDataFrame([(k, 1.0 + 2 * k, 4.0 + (k % 3)) for k in range(14)], "k int, x double, y double")
    got = split_polygons(f, path).groupBy("feature_id").agg(F.sum("area").alias("a"), F.collect_set("side").alias("s")).collect()
    area = {r.feature_id: r.a for r in got}
    shoelace = sum(a * d - c * b for (a, b), (c, d) in zip(comb, comb[1:], strict=False)) / 2
    assert area[1] == pytest.approx(91, abs=1e-9) and area[2] == pytest.approx(shoelace, abs=1e-9) and area[3] == pytest.approx(1, abs=1e-9)
    assert {r.feature_id: sorted(r.s) for r in got} == {1: ["above", "below", "off"], 2: ["above", "below", "off"], 3: ["off"]}


def test_a_side_arm_does_not_move_the_line(spark):
    main = [("p", 0.0, y, 10.0, y + 1) for y in (0.0, 0.2, 0.4)]
    arm = [("p", 4.0, 5.0, 10.0, 9.0), ("p", 4.0, 5.2, 10.0, 9.2)]
    rows = G.corridor_channel(spark.createDataFrame(main + arm, "path string, ax double, ay double, bx double, by double"), 1.0, 1.0).orderBy("k").collect()
    assert [round(r.y, 6) for r in rows] == [round(0.2 + k / 10, 6) for k in range(11)] and [r.channels for r in rows] == [1] * 4 + [2] * 7
