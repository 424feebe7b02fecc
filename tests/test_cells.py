"""The grid of many levels: mixed sizes, dense places, stacked boxes, against brute force."""

import random

from pyspark.sql import functions as F

from wardlight.operators import cells as C
from wardlight.operators import spatial as P


def boxes_df(spark, boxes):
    return spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "feature_id int, min_x double, min_y double, max_x double, max_y double")


def squares(spark, boxes):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("min_x", "min_y"), p("max_x", "min_y"), p("max_x", "max_y"), p("min_x", "max_y"), p("min_x", "min_y"))
    return boxes_df(spark, boxes).select("feature_id", F.array(F.array(ring)).alias("polygons"))


def crowd(boxes):
    return boxes.groupBy(*C.KEYS).count().agg(F.max("count")).first()[0]


def test_one_large_and_ten_thousand_small(spark):
    """A county and a city of lots: no cell holds more than 64 features, and the index stays in proportion to them."""
    lots = [(500 + i * 0.01, 500 + j * 0.01, 500.01 + i * 0.01, 500.01 + j * 0.01) for i in range(100) for j in range(100)]
    f = squares(spark, [(0, 0, 1000, 1000), *lots])
    index, grid = P.cell_index(f)
    assert crowd(index) <= C.MOST and index.count() < 81 * 10_001 and len(grid.levels) == 2
    rnd = random.Random(1)
    at = [(i, rnd.uniform(499, 502), rnd.uniform(499, 502)) for i in range(300)]
    got = sorted((x.pid, x.feature_id) for x in P.classify(spark.createDataFrame(at, "pid int, x double, y double"), f).collect())
    want = [(i, 0) for i, _, _ in at] + [
        (i, k + 1) for i, x, y in at for k, (x0, y0, x1, y1) in enumerate(lots) if x0 <= x < x1 and y0 <= y < y1
    ]
    assert got == sorted(want)


def test_dense_cells_are_split(spark):
    """Strips of one size in one place: only splitting parts them; boxes that cover one another stay together and end the splits."""
    rnd = random.Random(2)
    strips = [(i * 0.002, 0, i * 0.002 + 0.002, 1) for i in range(1500)]
    near = [(5 + x, 5 + y, 5 + x + 0.9, 5 + y + 0.9) for x, y in ((rnd.random() * 1e-3, rnd.random() * 1e-3) for _ in range(200))]
    grid = C.grid_of(boxes_df(spark, strips))
    assert crowd(grid.boxes) <= C.MOST and len(grid.levels) > 1
    both = strips + near + [(5, 5, 5, 5), (7, 7, 8, 7)]  # boxes without area too
    at = [(i, rnd.uniform(0, 3.1), rnd.random()) for i in range(200)] + [(1000 + i, 5 + rnd.random(), 5 + rnd.random()) for i in range(50)] + [(2000, 5.0, 5.0), (2001, 7.5, 7.0)]
    f = squares(spark, both)
    p = spark.createDataFrame(at, "pid int, x double, y double").withColumn("level", F.lit("own"))
    held = lambda x, y, b: b[0] <= x <= b[2] and b[1] <= y <= b[3]
    got = sorted((r.pid, r.feature_id) for r in P.bbox_prereject(p, f).collect())
    assert got == sorted((i, k) for i, x, y in at for k, b in enumerate(both) if held(x, y, b))
    inside = sorted((r.pid, r.feature_id, r.level) for r in P.classify(p, f).collect())
    assert inside == sorted((i, k, "own") for i, x, y in at for k, b in enumerate(both) if b[0] <= x < b[2] and b[1] <= y < b[3])


def test_staggered_boxes_on_one_another_are_not_split_without_end(spark):
    """Boxes that begin a little apart: each split would list the boxes that cover the cell in all its parts; a box lies in at most 256 cells."""
    rnd = random.Random(3)
    boxes = [(x, y, x + 0.8, y + 0.8) for x, y in ((rnd.uniform(0, 1.5), rnd.uniform(0, 1.5)) for _ in range(1200))]
    assert C.grid_of(boxes_df(spark, boxes)).boxes.count() <= 256 * len(boxes)
    at = [(i, rnd.uniform(0, 2.3), rnd.uniform(0, 2.3)) for i in range(60)]
    got = sorted((r.pid, r.feature_id) for r in P.bbox_prereject(spark.createDataFrame(at, "pid int, x double, y double"), squares(spark, boxes)).collect())
    assert got == sorted((i, k) for i, x, y in at for k, b in enumerate(boxes) if b[0] <= x <= b[2] and b[1] <= y <= b[3])


def test_no_boxes_and_null_bounds(spark):
    none = boxes_df(spark, []).unionByName(boxes_df(spark, [(0, 0, 1, 1)]).withColumn("min_x", F.lit(None).cast("double")))
    grid = C.grid_of(none)
    assert grid.levels == [] and grid.boxes.count() == 0


def test_pairs_of_mixed_sizes_meet_once(spark):
    """A county, lots and their shifted copies: every pair whose boxes meet, once; the pairs tried stay near the pairs that meet."""
    rnd = random.Random(5)
    own = [(0, 0, 1000, 1000), *((x, y, x + s, y + s) for x, y, s in ((rnd.uniform(500, 520), rnd.uniform(500, 520), rnd.choice([0.01, 0.5, 4])) for _ in range(700)))]
    other = [(x0 + 0.3, y0 + 0.3, x1 + 0.3, y1 + 0.3) for x0, y0, x1, y1 in own] + [(5000, 5000, 5001, 5001)]
    side = lambda boxes, p: boxes_df(spark, boxes).withColumnsRenamed({"feature_id": f"{p}_id", **{c: f"{p}_{c}" for c in C.BOUNDS}})
    got = sorted((r.a_id, r.b_id) for r in C.pairs_by_cell(side(own, "a"), side(other, "b")).collect())
    meet = lambda p, q: max(p[0], q[0]) <= min(p[2], q[2]) and max(p[1], q[1]) <= min(p[3], q[3])
    assert got == sorted((i, k) for i, p in enumerate(own) for k, q in enumerate(other) if meet(p, q))
    assert C.pairs_by_cell(side([], "a"), side(other, "b")).count() == 0
