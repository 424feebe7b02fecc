"""Edge cases of the civic operators on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wardlight.operators import gates as Q
from wardlight.operators import geometry as G
from wardlight.operators import rosters as R
from wardlight.operators import spatial as P
from wardlight.sources import features as X

SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]
POINT = "array<array<array<struct<x:double,y:double>>>>"


def layer(spark, *features):
    rows = [(k, [[[{"x": x, "y": y} for x, y in ring] for ring in poly] for poly in polys]) for k, polys in features]
    return spark.createDataFrame(rows, f"feature_id int, polygons {POINT}")


def at(spark, *pts):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "pid long, x double, y double")


def test_holes_toggle_parity_and_borders_count_once(spark):
    f = layer(spark, (1, [[SQUARE, HOLE]]), (2, [[[[4.0, 0.0], [8.0, 0.0], [8.0, 4.0], [4.0, 4.0], [4.0, 0.0]]]]))
    p = at(spark, (0.5, 0.5), (1.5, 1.5), (4.0, 1.0), (9.0, 9.0))
    got = {r.pid: (r.status, r.feature_id) for r in P.classify_status(p, f).collect()}
    assert got == {0: ("OK", 1), 1: ("NONE", None), 2: ("OK", 2), 3: ("NONE", None)}


def test_parts_of_a_feature_are_alternatives(spark):
    f = layer(spark, (1, [[SQUARE], [SQUARE]]))
    assert P.classify(at(spark, (1, 1)), f).count() == 1


def test_empty_layer_and_no_points(spark):
    f = layer(spark, (1, [[SQUARE]]))
    assert P.classify_status(at(spark, (1, 1)), f.where("feature_id > 9")).first().status == "NONE"
    assert P.classify(at(spark, (1, 1)).where("pid > 9"), f).count() == 0


def test_dispatch_says_none_only_when_every_source_answered(spark):
    f = layer(spark, (1, [[SQUARE]])).withColumns({"entry_order": F.lit(0), "source": F.lit("a"), "available": F.lit(True)})
    assert [r.status for r in P.dispatch(at(spark, (9, 9)), f).collect()] == ["NONE"]
    assert [r.status for r in P.dispatch(at(spark, (1, 1)), f.withColumn("available", F.lit(False))).collect()] == ["ERROR"]


def test_nearest_ties_by_id_and_far_sites(spark):
    s = spark.createDataFrame([(2, 1.0, 0.0), (1, -1.0, 0.0), (3, 40.0, 40.0)], "sid int, sx double, sy double")
    got = [(r.rank, r.sid) for r in P.nearest_n(at(spark, (0, 0)), s, 3).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]


def test_nearest_in_clusters_and_far_away(spark):
    r = random.Random(1)
    places = [(i, r.random() * 1e-3, r.random() * 1e-3) for i in range(60)] + [(60 + i, 1000 + r.random(), -500.0 * i) for i in range(5)]
    spots = [(0.0, 0.0), (900.0, -700.0), (-5e4, 3.0), (5e-4, 5e-4), (1000.5, -2000.0)]
    s = spark.createDataFrame(places, "sid int, sx double, sy double")
    for n in (1, 3, 70):
        got = {}
        for x in P.nearest_n(at(spark, *spots), s, n).collect():
            got.setdefault(x.pid, []).append((x.rank, x.sid))
        for pid, (px, py) in enumerate(spots):
            near = sorted((math.hypot(px - x, py - y), i) for i, x, y in places)[:n]
            assert sorted(got[pid]) == [(k + 1, i) for k, (_, i) in enumerate(near)]
    assert P.nearest_n(at(spark, (0, 0)), s.where("sid < 0"), 2).count() == 0
    assert P.nearest_n(at(spark, (float("nan"), 0.0), (float("inf"), 1.0)), s, 2).count() == 0


def test_open_chain_raises(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0)], "district int, x1 double, y1 double, x2 double, y2 double")
    with pytest.raises(Exception, match="open chain"):
        G.chain_rings(e).collect()


def test_features_reject_empty_and_open_geometry(spark):
    doc = '{"features":[{"properties":{"id":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"properties":{"id":"b"},"geometry":null},{"properties":{"id":"c"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[2,2]]]}}]}'
    good, bad = X.features_of(spark.createDataFrame([(doc,)], "text string"), "l", "id")
    assert [r.feature_id for r in good.collect()] == ["a"]
    assert {(r.feature_id, r.reason) for r in bad.collect()} == {("b", "no geometry"), ("c", "open ring")}


def test_repeated_reference_key_fails(spark):
    with pytest.raises(Exception, match="repeated key"):
        X.unique_key(spark.createDataFrame([("a",), ("a",)], "k string"), "k").collect()


def test_ambiguous_people_are_left_alone(spark):
    base = spark.createDataFrame([("b", "Ann Lee", ""), ("b", "Anna Lee", ""), ("b", "Tom Day", None)], "body string, name string, phone string")
    extra = spark.createDataFrame([("b", "Ann Lee", "1"), ("b", "Thomas Day", "2"), ("b", "No One", "3")], "body string, name string, phone string")
    got = {r.name: (r.phone, r.matched_by) for r in R.enrich_people(base, extra, ["phone"]).collect()}
    assert got == {"Ann Lee": ("", None), "Anna Lee": ("", None), "Tom Day": ("2", "surname")}


def test_gates_refuse_vacuous_passes(spark):
    empty = spark.createDataFrame([], "file string")
    assert Q.enough_compared(empty, "file").first().severity == "FAIL"


def test_rings_touch_but_do_not_cross(spark):
    """Two squares that share a corner, a hole, and a boundary given in any order and direction."""
    square = lambda x, y, n=1.0: [
        ((x, y), (x + n, y)), ((x + n, y), (x + n, y + n)), ((x + n, y + n), (x, y + n)), ((x, y + n), (x, y))
    ]
    edges = square(0, 0) + [(b, a) for a, b in square(1, 1)] + square(5, 5, 3.0) + square(6, 6)
    random.Random(4).shuffle(edges)
    df = spark.createDataFrame([(1, *map(float, (*a, *b))) for a, b in edges], "district int, x1 double, y1 double, x2 double, y2 double")
    rings = [[(p.x, p.y) for p in r.ring] for r in G.chain_rings(df).orderBy("ring_no").collect()]
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2
    assert all(r[0] == r[-1] == min(r) for r in rings) and sorted(map(area, rings)) in ([1.0, 1.0, 1.0, 9.0], [1.0, 2.0, 9.0])
    assert sorted(sorted((a, b)) for r in rings for a, b in zip(r, r[1:], strict=False)) == sorted(sorted(e) for e in edges)


def naive_despike(ring, deviation, chord):
    pts, i = list(ring[:-1]), 0
    while i < len(pts) and len(pts) > 4:
        (ax, ay), (px, py), (bx, by) = pts[i - 1], pts[i], pts[(i + 1) % len(pts)]
        n = math.hypot(bx - ax, by - ay)
        off = abs((bx - ax) * (ay - py) - (ax - px) * (by - ay)) / n if n else math.hypot(px - ax, py - ay)
        if off > deviation and n < chord:
            del pts[i]
            i = 0
        else:
            i += 1
    return [*pts, pts[0]]


def test_despike_is_the_fixpoint_from_the_start(spark):
    r = random.Random(9)
    rings = []
    for k in range(40):
        pts = [(math.cos(a / 20) * 10, math.sin(a / 20) * 10) for a in range(0, 125, 5)]
        for _ in range(8):
            i = r.choice([0, len(pts), r.randrange(len(pts))])
            x, y = pts[i % len(pts)]
            pts[i:i] = [(x + r.uniform(-3, 3), y + r.uniform(-3, 3)), (x + r.uniform(-0.05, 0.05), y)]
        rings.append((k, [*pts, pts[0]]))
    df = spark.createDataFrame(
        [(k, [{"x": x, "y": y} for x, y in ring]) for k, ring in rings], "feature_id int, ring array<struct<x:double,y:double>>"
    )
    got = {x.feature_id: [(p.x, p.y) for p in x.ring] for x in G.despike(df, 0.5, 0.2).collect()}
    assert all(got[k] == naive_despike(ring, 0.5, 0.2) for k, ring in rings) and any(len(got[k]) < len(ring) for k, ring in rings)


def test_cells_fit_the_features_whatever_their_units(spark):
    f = layer(
        spark, (1, [[[[0.0, 0.0], [1200.0, 0.0], [1200.0, 1200.0], [0.0, 1200.0], [0.0, 0.0]]]]),
        (2, [[[[5e5, 0.0], [5e5 + 1, 0.0], [5e5 + 1, 2.0], [5e5, 0.0]]]])
    )
    one = f.where("feature_id = 1")
    assert P.cell_index(one)[0].count() < 100 and P.cell_index(f)[0].count() < 200
    assert sorted(
        (x.pid, x.feature_id) for x in P.classify(at(spark, (1, 1), (1199, 1199), (1201, 5), (5e5 + 0.9, 1)), f).collect()
    ) == [(0, 1), (1, 1), (3, 2)]


def test_nearest_where_all_sites_are_on_one_spot(spark, monkeypatch):
    monkeypatch.setattr(P, "PART", 16)
    s = spark.createDataFrame([(i, 1.0, 1.0) for i in range(200)] + [(500, 9.0, 9.0)], "sid int, sx double, sy double")
    got = {}
    for x in P.nearest_n(at(spark, (1, 1), (8, 8), (-700, 3)), s, 3).orderBy("pid", "rank").collect():
        got.setdefault(x.pid, []).append(x.sid)
    assert got == {0: [0, 1, 2], 1: [500, 0, 1], 2: [0, 1, 2]}


def test_street_keys_stop_at_units_and_know_the_long_forms(spark):
    from wardlight.functions.scalars import street_key

    told = {
        "100 N. Main Street, Suite 4 Springfield": "100 main st", "100 Main St": "100 main st", "12 Northeast Oak Terrace": "12 oak ter", "12 oak ter": "12 oak ter", "7 Lake Av Rm 2 East Wing": "7 ave lake", "#7 Lake Avenue": "7 ave lake",
        "P.O. Box 12": None, "9 Elm Parkway PO Box 3": "9 elm pkwy", "5 Mill Trail 2nd Floor Annex": "5 mill trl", "n/a": None, "Main Street": None,
    }
    got = spark.createDataFrame([(k,) for k in told], "s string").select("s", street_key(F.col("s")).alias("k"))
    assert {r.s: r.k for r in got.collect()} == told


def test_names_and_domains_meet_within_their_edits(spark):
    from wardlight.operators.gates import domain_typo

    a = spark.createDataFrame(
        [(1, "x", "Ann Smith"), (2, "x", "Bo Li"), (3, "x", "Cy"), (4, "y", "Ann Smith"), (5, None, "Ann Smith"), (6, "x", "Al Jones")],
        "id int, block string, name string"
    )
    b = spark.createDataFrame(
        [
            (11, "x", "Anna Smyth"), (12, "x", "Bob Smit"), (13, "x", "Bo Lie"), (14, "x", "Cy"), (15, "z", "Ann Smith"),
            (16, "x", "Al Jones"), (17, "x", "Al Jones")
        ],
        "cid int, block string, name string"
    )
    got = {r.id: (r.cid, r.n) for r in R.match_unique(a, b).collect()}
    assert got == {1: (11, 2), 2: (13, 1), 3: (14, 1), 4: (None, 0), 5: (None, 0), 6: (None, 2)}
    mails = ["a@city.org"] * 3 + ["b@ciyt.org", "c@town.org", "d@cities.org", "e@citt.or"]
    assert {
        (r.domain, r.near) for r in domain_typo(spark.createDataFrame([(m,) for m in mails], "email string")).collect()
    } == {("ciyt.org", "city.org"), ("citt.or", "city.org")}


def test_numeric_order_of_keys(spark):
    keys = ["10", "9", "2", "x", "2", "002", None, "1.5"]
    got = {r.key: r.at for r in R.numeric_key_order(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()}
    assert got == {"x": 1, None: 1, "1.5": 2, "2": 3, "002": 3, "9": 4, "10": 5}
    assert R.numeric_key_order(spark.createDataFrame([], "k string"), "k").count() == 0


def test_records_nested_too_deep_raise(spark):
    doc = '{"name":"a","kids":[{"name":"b","kids":[{"name":"c"},{"no":1}]}],"more":{"x":{"name":"d"}}}'
    df = spark.createDataFrame([(doc,)], "text string")
    assert sorted(r.path for r in X.walk_records(df).select("path").collect()) == ["$", "$/kids/0", "$/kids/0/kids/0", "$/more/x"]
    with pytest.raises(Exception, match="nested too deep"):
        X.walk_records(df, depth=2).count()


def test_overlay_areas_with_holes_parts_and_touching_sides(spark):
    from wardlight.operators.overlay import overlay_areas

    box = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    a = layer(spark, (1, [[box(0.0, 0.0, 4.0, 4.0), box(1.0, 1.0, 1.0, 1.0)]]), (2, [[box(4.0, 0.0, 4.0, 4.0)], [box(100.0, 0.0, 1.0, 1.0)]]))
    b = layer(
        spark, (7, [[box(0.5, 0.5, 2.0, 5.0)]]), (8, [[[[3.0, 0.0], [7.0, 4.0], [3.0, 4.0], [3.0, 0.0]]]]),
        (9, [[box(8.0, 0.0, 1.0, 1.0)], [box(100.5, 0.5, 9.0, 9.0)]])
    )
    got = {(r.a_id, r.b_id): round(r.shared, 9) for r in overlay_areas(a, b).collect()}
    assert got == {(1, 7): 2 * 3.5 - 1, (1, 8): 3.5, (2, 8): 4.5, (2, 9): 0.25}
    assert overlay_areas(a, b.where("feature_id > 99")).count() == 0


def test_overlay_areas_against_sample_points(spark):
    import numpy as np

    from wardlight.operators.overlay import shared_area

    r = random.Random(3)

    def star(cx, cy):
        at = [(k * math.tau / 30, r.uniform(0.3, 1.0)) for k in range(30)]
        pts = [(cx + f * math.cos(t), cy + f * math.sin(t)) for t, f in at]
        return np.array([(*p, *q) for p, q in zip(pts, pts[1:] + pts[:1], strict=True)])

    inside = lambda e, x, y: (
        ((e[:, 1] > y) != (e[:, 3] > y)) & (x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])
    ).sum() % 2 == 1
    for _ in range(4):
        a, b = star(0, 0), star(r.uniform(-0.5, 0.5), 0.2)
        n = sum(inside(a, x, y) and inside(b, x, y) for x, y in ((-1 + (i + 0.5) / 50, -1 + (j + 0.5) / 50) for i in range(100) for j in range(100)))
        assert abs(shared_area(a, b) - n * 4e-4) < 0.02


def test_a_long_house_number_is_an_address(spark):
    rows = spark.createDataFrame([(1, "1234567 Elm Street"), (2, "12 Oak Ave"), (3, "room 4")], "id int, note string")
    assert sorted(r.id for r in Q.privacy(rows, "id", ["note"]).collect()) == [1, 2]


def test_a_segment_walked_both_ways_is_judged_as_in_sql(spark):
    """Both directions of a border round differently; the distances are SQL's to the last digit, and so is the nearest."""
    k = F.col("id")
    ends = spark.range(8).select(
        F.explode(F.array(F.lit(0), F.lit(100))).alias("turn"), k.alias("k"), (k * 0.61).alias("x0"), (k * 0.37 + 0.1).alias("y0"), (k * 0.53 + 0.7).alias("x1"), (k * 0.71 + 0.3).alias("y1")
    )
    edges = ends.selectExpr(
        "k + turn as eid", "if(turn = 0, x0, x1) as ax", "if(turn = 0, y0, y1) as ay", "if(turn = 0, x1, x0) as bx", "if(turn = 0, y1, y0) as by"
    )
    points = spark.range(3000).select(k.alias("pid"), (k * 7919 % 1009 * 5.0 / 1009).alias("x"), (k * 104729 % 997 * 5.0 / 997).alias("y"))
    p, e = points.toPandas(), edges.toPandas()  # noqa: F841  DuckDB reads them
    sql = """WITH f AS (SELECT *, greatest(0, least(1, ((x-ax)*(bx-ax)+(y-ay)*("by"-ay))/((bx-ax)*(bx-ax)+("by"-ay)*("by"-ay)))) AS t FROM p, e),
        g AS (SELECT pid, eid, sqrt(pow(x-(ax+t*(bx-ax)),2)+pow(y-(ay+t*("by"-ay)),2)) AS dist FROM f)
        SELECT pid, arg_min(eid, {'d': dist, 'e': eid}), min(dist) FROM g GROUP BY pid"""
    import duckdb

    want = sorted(duckdb.sql(sql).fetchall())
    assert sorted(tuple(r) for r in P.nearest_segment(points, edges).collect()) == want


def test_points_keep_their_rows_while_lists_are_dealt_in_parts(spark, monkeypatch):
    """With lists of two features, levels and parts are met one after the other; no point is grouped, joined with itself or lost, null and repeated ids not."""
    monkeypatch.setattr(P, "PART", 2)
    box = lambda a, s: [[[a, a], [a + s, a], [a + s, a + s], [a, a + s], [a, a]]]
    f = layer(spark, *[(k, [box(0.0, 4.0)]) for k in range(7)], (50, [box(0.0, 200.0)]), (60, [box(1.0, 0.125)]))
    pts = spark.createDataFrame([(1, 1.0625, 1.0625), (2, 3.0, 3.0), (3, 100.0, 9.0), (None, 100.0, 9.0), (3, -1.0, 1.0), (4, None, 1.0)], "pid long, x double, y double")
    got = P.classify_status(pts, f)
    want = [(1, 9, "MULTI", None), (2, 8, "MULTI", None), (3, 1, "OK", 50), (None, 1, "OK", 50), (3, 0, "NONE", None), (4, 0, "NONE", None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [pid" not in plan and "Join LeftOuter, (pid" not in plan
    first = f.withColumns({"entry_order": F.lit(1) + F.col("feature_id") % 3, "source": F.lit("s"), "available": F.lit(True)})
    assert sorted((r.pid, r.feature_id) for r in P.dispatch(pts.where("pid < 4 and x > 0"), first).collect()) == [(1, 0), (2, 0), (3, 50)]
    assert sorted(r.pid for r in P.carve_out(pts.where("pid < 4 and x > 0"), f.where("feature_id = 50"), f.where("feature_id < 7")).collect()) == [3]


def test_boxes_on_one_another_are_asked_by_their_centres(spark, monkeypatch):
    """The box of the nearest centre that holds the point, as comparing all finds it; points outside, far ones and malformed boxes too, and few points reach the grid."""
    draw = random.Random(5)
    boxes = [(k, *(a := (draw.uniform(0, 5), draw.uniform(0, 5))), a[0] + draw.uniform(0.5, 1), a[1] + draw.uniform(0.5, 1)) for k in range(600)]
    boxes += [(900, -50.0, -50.0, 60.0, 60.0), (901, 1.0, 1.0, 1.0, 2.0), (902, 20.0, 20.0, 20.001, 40.0), (903, 2.0, 3.0, 2.5, 3.5), (904, 2.0, 3.0, 2.5, 3.5)]
    pts = [(i, draw.uniform(-1, 7), draw.uniform(-1, 7)) for i in range(500)] + [(1000, 20.0005, 39.0), (1001, 99.0, 1.0), (1002, 2.25, 3.25)]
    keyed, seen = P.Grid.keyed, []
    monkeypatch.setattr(P.Grid, "keyed", lambda self, p: seen.append(p.count()) or keyed(self, p))
    got = P.bbox_region(
        spark.createDataFrame(pts, "pid long, x double, y double"),
        spark.createDataFrame(boxes, "box_id long, min_x double, min_y double, max_x double, max_y double")
    )
    want = {}
    for i, x, y in pts:
        held = [((x - (a + c) / 2) ** 2 + (y - (b + e) / 2) ** 2, k) for k, a, b, c, e in boxes if a < c and b < e and a <= x <= c and b <= y <= e]
        if held:
            want[i] = min(held)[1]
    assert {r.pid: r.box_id for r in got.collect()} == want and got.count() == len(want)
    assert seen and max(seen) < 300


def test_centres_are_asked_on_while_rounds_settle_their_points(spark, monkeypatch):
    """Points beside a dense field of centres, whose boxes hold them: a fourth round settles them all, and the grid is not made."""
    made, grid = [], P._grid
    monkeypatch.setattr(P, "_grid", lambda *a: made.append(1) or grid(*a))
    boxes = [(i * 50 + j, i / 49 - 0.2, j / 49 - 0.2, i / 49 + 0.2, j / 49 + 0.2) for i in range(50) for j in range(50)]
    pts = [(k, 0.003 + (k * 37 % 100) / 101, -0.1 * (k + 0.5) / 100) for k in range(100)]
    got = P.bbox_region(
        spark.createDataFrame(pts, "pid long, x double, y double"),
        spark.createDataFrame(boxes, "box_id long, min_x double, min_y double, max_x double, max_y double")
    ).collect()
    far = lambda x, y, b: ((x - (b[1] + b[3]) / 2) ** 2 + (y - (b[2] + b[4]) / 2) ** 2, b[0])
    want = {k: min(far(x, y, b) for b in boxes if b[1] <= x <= b[3] and b[2] <= y <= b[4])[1] for k, x, y in pts}
    assert {r.pid: r.box_id for r in got} == want and len(got) == 100 and not made


def test_points_are_dealt_out_by_their_count_before_they_are_made_distinct(spark, sf, monkeypatch):
    from wardlight.plans import base

    monkeypatch.setattr(base, "POINTS_A_TASK", 500)
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    own = base.points(spark, sf)
    assert own.rdd.getNumPartitions() == -(-n // 500) > spark.sparkContext.defaultParallelism
    assert own.count() == own.select("pid").distinct().count()


def test_a_layer_under_a_layer_of_polygons_joins_no_points(spark):
    from wardlight.operators import layers as L

    square = lambda i, x: (i, f"u{i}", [[[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]]])
    f = spark.createDataFrame([square(1, 0.0), square(2, 1.0)], "feature_id long, name string, polygons array<array<array<struct<x:double,y:double>>>>")
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 9.0, 9.0)], "pid long, x double, y double")
    parent = L.polygon_layer("parent", f.where("feature_id = 2"))
    found = L.sub_layer(L.polygon_layer("child", f), parent).query(p)
    assert [tuple(r) for r in found.collect()] == [(2, "OK", "2", "u2")]
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
    bare = L.LayerSpec("bare", parent.query)  # a layer that tells its hits only as rows
    assert L.sub_layer(L.polygon_layer("child", f), bare).query(p).collect() == found.collect()


def test_points_with_lists_of_officers_come_unit_by_unit(spark):
    from wardlight.operators import layers as L

    f = layer(spark, *[(k, [[[[float(k), 0.0], [k + 1.0, 0.0], [k + 1.0, 1.0], [float(k), 1.0], [float(k), 0.0]]]]) for k in range(5)])
    pts = at(spark, *[(i % 6 + 0.5, 0.5) for i in range(600)])
    officers = spark.createDataFrame([(k, f"n{k}{i}") for k in range(4) for i in (1, 0)], "district int, name string")
    found = L.identity_layer("unit", f, officers).query(pts).withColumn("task", F.spark_partition_id()).collect()
    want = {k: ("OK", str(k), f"n{k}0, n{k}1" if k < 4 else None) for k in range(5)} | {5: ("NONE", None, None)}
    assert sorted((r.pid, r.status, r.district, r.holder) for r in found) == [(i, *want[i % 6]) for i in range(600)]
    runs = [(r.task, r.district) for i, r in enumerate(found) if not i or (r.task, r.district) != (found[i - 1].task, found[i - 1].district)]
    assert len(runs) == len(set(runs)) and len({t for t, _ in runs}) > 1
