"""Queries of the geometry jobs over unit polygons, sample points and grid cells derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import geometry as G
from wardlight.operators import spatial as P
from wardlight.operators import topology as T
from wardlight.operators.overlay import clip_areas, outline_difference_area, overlay_areas, split_polygons, tiling_areas
from wardlight.plans.base import EDGES, HITS, POINTS, VERTS, points, query, sites, table, units
from wardlight.plans.spatial_queries import _OVER, _overlaid

_KEYED = """SELECT *, CASE WHEN (ax, ay) < (bx, by) THEN ax ELSE bx END AS x1, CASE WHEN (ax, ay) < (bx, by) THEN ay ELSE by END AS y1, CASE
  WHEN (ax, ay) < (bx, by) THEN bx ELSE ax END AS x2, CASE WHEN (ax, ay) < (bx, by) THEN by ELSE ay END AS y2 FROM edges"""
_DISS = EDGES + f", ke AS ({_KEYED}), diss AS (SELECT district, x1, y1, x2, y2 FROM ke GROUP BY ALL HAVING count(*) = 1)"


def composition(spark, d):
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("district"), F.col("n_nationkey").alias("unit"))


def districts(spark, d):
    """Districts as features: units dissolved, their rings each a polygon (the fixture has no holes but rings in rings are told apart)."""
    rings = G.chain_rings(G.dissolve(units(spark, d), composition(spark, d)))
    return rings.groupBy(F.col("district").alias("feature_id")).agg(F.array(F.collect_list("ring")).alias("polygons"))


def ring_rows(spark, d):
    u = units(spark, d).select("feature_id", F.posexplode(F.flatten("polygons")).alias("ring_no", "ring"))
    return u


def _shift(df, by):
    return df.withColumn(
        "polygons",
        F.transform(
            "polygons",
            lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct((v["x"] + by).alias("x"), (v["y"] + by).alias("y"))))
        )
    )


@query("g01_dissolve", f"WITH {_DISS} SELECT district, x1, y1, x2, y2 FROM diss")
def dissolve(spark, d):
    return G.dissolve(units(spark, d), composition(spark, d))


@query("g01_district_areas", f"WITH {EDGES} SELECT district, round(sum(ax*by-bx*ay)/2, 9) AS area FROM edges GROUP BY 1")
def chained_areas(spark, d):
    # Rings are chained from the dissolved edges; even-odd nesting gives each district's area back.
    rings = G.chain_rings(G.dissolve(units(spark, d), composition(spark, d))).withColumnRenamed("district", "feature_id")
    nested = G.nest_rings(rings)
    return nested.groupBy(F.col("feature_id").alias("district")).agg(
        F.round(F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))), 9).alias("area")
    )


@query(
    "g02_nest_rings",
    f"""WITH {EDGES}, a AS (SELECT feature_id, abs(sum(ax*by-bx*ay)/2) AS area FROM edges GROUP BY 1)
SELECT feature_id, k::INT AS ring_no, k::BIGINT AS depth, k % 2 = 1 AS hole, round(area / pow(4, k), 9) AS area FROM a, range(3) t(k)""",
)
def nest(spark, d):
    u = units(spark, d)
    inner = lambda k: F.transform(
        F.col("polygons")[0][0],
        lambda v: F.struct((v["x"] * k + (F.col("cx") * (1 - k))).alias("x"), (v["y"] * k + F.col("cy") * (1 - k)).alias("y"))
    )
    m = P.ring_measures(u).select("feature_id", "cx", "cy")
    rings = u.join(m, "feature_id").select("feature_id", F.posexplode(F.array(inner(1.0), inner(0.5), inner(0.25))).alias("ring_no", "ring"))
    return G.nest_rings(rings).select("feature_id", "ring_no", F.col("depth").cast("long").alias("depth"), "hole", F.round("area", 9).alias("area"))


def _vertices(rings):
    """Vertices of rings (feature_id, ring), without the closing one."""
    v = rings.select("feature_id", F.explode(F.slice("ring", 1, F.size("ring") - 1)).alias("v"))
    return v.select("feature_id", F.round("v.x", 9).alias("x"), F.round("v.y", 9).alias("y"))


# A side's midpoint lies off its side by as much as it was pushed; corners are far from every chord.
_PUSHED = "CASE s WHEN 1 THEN abs(y - j) WHEN 3 THEN abs(x - (i + 1)) WHEN 5 THEN abs(y - (j + 1)) WHEN 7 THEN abs(x - i) END"


@query(
    "g03_simplify_dp",
    f"WITH {VERTS} SELECT feature_id, round(x, 9) AS x, round(y, 9) AS y FROM verts JOIN nat USING (feature_id) WHERE s % 2 = 0 OR {_PUSHED} > 0.15"
)
def simplify(spark, d):
    return _vertices(G.simplify_dp(ring_rows(spark, d), 0.15))


_TRIANGLE = "abs((x - px) * (ny - py) - (nx - px) * (y - py)) / 2"
_AROUND = "lag(x, 1, lx) OVER w AS px, lag(y, 1, ly) OVER w AS py, lead(x, 1, fx) OVER w AS nx, lead(y, 1, fy) OVER w AS ny"
_ENDS = "first_value(x) OVER v AS fx, first_value(y) OVER v AS fy, last_value(x) OVER v AS lx, last_value(y) OVER v AS ly"
_OVER_RING = "WINDOW v AS (PARTITION BY feature_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _removal(ring: str, least: str) -> str:
    """SQL: the ring's vertices with the areas of their triangles, no smaller than what was removed before."""
    ends = f"SELECT *, {_ENDS} FROM {ring} {_OVER_RING}"
    around = f"SELECT *, {_AROUND} FROM ({ends}) WINDOW w AS (PARTITION BY feature_id ORDER BY s)"
    return f"SELECT feature_id, s, x, y, greatest({_TRIANGLE}, {least}) AS area, row_number() OVER (PARTITION BY feature_id ORDER BY greatest({_TRIANGLE}, {least}), s) AS r FROM ({around})"


@query(
    "g04_simplify_area",
    f"""WITH {VERTS}, r0 AS (SELECT feature_id, s, x, y, 0.0::DOUBLE AS gone FROM verts), a1 AS ({_removal("r0", "gone")}),
r1 AS (SELECT feature_id, s, x, y, min(area) OVER (PARTITION BY feature_id) AS gone, r FROM a1), r2 AS (SELECT feature_id, s, x, y, gone FROM r1 WHERE r > 1), a2 AS ({_removal("r2", "gone")})
SELECT feature_id, round(x, 9) AS x, round(y, 9) AS y FROM a2 WHERE r > 1""",
)
def simplify_area(spark, d):
    # Six of eight vertices are left: the two smallest triangles go, the second as the ring is without the first.
    return _vertices(G.simplify_area(ring_rows(spark, d), 0.75))


@query(
    "g03_simplify_shared",
    f"WITH {VERTS} SELECT feature_id, round(x, 9) AS x, round(y, 9) AS y FROM verts JOIN nat USING (feature_id) WHERE s % 2 = 0 OR {_PUSHED} > 0.15"
)
def simplify_shared(spark, d):
    # Chains between the corners where units meet: the same vertices as by ring, but each border is simplified once.
    return _vertices(_rings(T.simplify_shared(units(spark, d), tol=0.15)))


def _rings(features):
    return features.select("feature_id", F.explode(F.flatten("polygons")).alias("ring"))


@query(
    "g04_simplify_area_shared",
    f"WITH {VERTS} SELECT feature_id, round(x, 9) AS x, round(y, 9) AS y FROM verts JOIN nat USING (feature_id) WHERE s % 2 = 0 OR {_PUSHED} / 2 >= 0.08"
)
def simplify_area_shared(spark, d):
    return _vertices(_rings(T.simplify_shared(units(spark, d), least_area=0.08)))


@query(
    "g03_shared_multiplicity",
    f"""WITH {VERTS}, kept AS (SELECT feature_id, s, x, y FROM verts JOIN nat USING (feature_id) WHERE s % 2 = 0 OR {_PUSHED} > 0.15),
nx AS (SELECT feature_id, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by FROM kept WINDOW w AS (PARTITION BY feature_id ORDER BY s)),
k AS (SELECT least((ax, ay), (bx, by)) AS p, greatest((ax, ay), (bx, by)) AS q, CASE WHEN (ax, ay) < (bx, by) THEN 1 ELSE -1 END AS d FROM nx)
SELECT n, turn, count(*) AS edges FROM (SELECT count(*) AS n, sum(d)::BIGINT AS turn FROM k GROUP BY p, q) GROUP BY 1, 2""",
)
def shared_multiplicity(spark, d):
    # Every inner border is still walked once from either side.
    return G.edge_multiplicity(T.simplify_shared(units(spark, d), tol=0.15)).groupBy("n", "turn").agg(F.count("*").alias("edges"))


def _shaken(spark, d):
    """The units with noise up to 1e-7, and without the vertices of even units that lie on a straight inner side."""
    k = F.col("feature_id")
    r = F.col("polygons")[0][0]
    straight = lambda v, at: (F.abs(r[at - 1]["x"] + r[at + 1]["x"] - 2 * v["x"]) < 1e-9) & (F.abs(r[at - 1]["y"] + r[at + 1]["y"] - 2 * v["y"]) < 1e-9)
    inner = lambda v: ~v["x"].isin(0.0, 5.0) & ~v["y"].isin(0.0, 5.0)
    less = F.filter(r, lambda v, at: ~F.when((k % 2 == 0) & (at % 2 == 1), straight(v, at) & inner(v)).otherwise(False))
    noise = lambda v, c, m: (v[c] + ((k * m) % 5 - 2) * 2e-8).alias(c)
    return units(spark, d).withColumn("polygons", F.array(F.array(F.transform(less, lambda v: F.struct(noise(v, "x", 3), noise(v, "y", 7))))))


@query(
    "g01_dissolve_noded",
    f"WITH {_DISS} SELECT district, round(x1, 5) AS x1, round(y1, 5) AS y1, round(x2, 5) AS x2, round(y2, 5) AS y2 FROM diss"
)
def dissolve_noded(spark, d):
    # Units whose borders differ by a vertex and by noise dissolve to the clean boundary.
    edges = G.dissolve(T.noded(_shaken(spark, d), 1e-5), composition(spark, d))
    near = lambda k: F.struct((F.round(f"x{k}", 5) + 0.0).alias("x"), (F.round(f"y{k}", 5) + 0.0).alias("y"))
    a, b = F.least(near(1), near(2)), F.greatest(near(1), near(2))
    return edges.select("district", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def _spiked(spark, d):
    r = ring_rows(spark, d)
    tip = F.struct((F.col("ring")[0]["x"] + 0.01).alias("x"), (F.col("ring")[0]["y"] + 0.4).alias("y"))
    near = F.struct((F.col("ring")[0]["x"] + 0.02).alias("x"), F.col("ring")[0]["y"].alias("y"))
    return r.withColumn("ring", F.concat(F.slice("ring", 1, 1), F.array(tip, near), F.slice("ring", 2, 100)))


@query("g20_despike", f"""WITH {VERTS} SELECT feature_id, round(x, 9) AS x, round(y, 9) AS y FROM verts
UNION ALL SELECT feature_id, round(x + 0.02, 9), round(y, 9) FROM verts WHERE s = 0""")
def despiked(spark, d):
    return _vertices(G.despike(_spiked(spark, d), 0.3, 0.1))


@query("w09_spikes", f"WITH {VERTS} SELECT feature_id, 1 AS seq, round(x + 0.01, 9) AS x, round(y + 0.4, 9) AS y FROM verts WHERE s = 0")
def spiked(spark, d):
    f = _spiked(spark, d).select("feature_id", F.array(F.array("ring")).alias("polygons"))
    return G.spikes(P.ring_edges(f), 0.3, 0.1).select("feature_id", "seq", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("g05_check_anchors", f"""WITH {HITS} SELECT p.pid, CASE WHEN p.pid % 7 = 0 THEN NULL ELSE (p.pid % 25)::INT END AS expected, CASE
  WHEN p.pid % 7 = 0 THEN false ELSE feature_id = p.pid % 25 END AS ok FROM pts p LEFT JOIN hits h ON p.pid = h.pid""")
def anchors(spark, d):
    a = points(spark, d).withColumn("expected", F.when(F.col("pid") % 7 != 0, (F.col("pid") % 25).cast("int")))
    return G.check_anchors(a, units(spark, d)).select("pid", "expected", "ok")


@query("g06_check_envelope", f"""WITH {EDGES} SELECT 'west' AS side, min(ax) AS reach, 0.0::DOUBLE AS declared, min(ax) >= 0 AS ok FROM edges
UNION ALL SELECT 'south', min(ay), 0.5, min(ay) >= 0.5 FROM edges
UNION ALL SELECT 'east', max(ax), 5, max(ax) <= 5 FROM edges
UNION ALL SELECT 'north', max(ay), 4.5, max(ay) <= 4.5 FROM edges""")
def envelope(spark, d):
    return G.check_envelope(units(spark, d), (0.0, 0.5, 5.0, 4.5))


# Points in the units before and after their shared borders are simplified.
_THIN = f"""{HITS}, kept AS (SELECT feature_id, s, x, y FROM verts JOIN nat USING (feature_id) WHERE s % 2 = 0 OR {_PUSHED} > 0.15),
thin AS (SELECT feature_id, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by FROM kept WINDOW w AS (PARTITION BY feature_id ORDER BY s)),
h2 AS (SELECT pid, feature_id FROM pts JOIN thin ON (ay > y) <> (by > y) AND x < (bx-ax)*(y-ay)/(by-ay)+ax GROUP BY pid, feature_id HAVING count(*)%2 = 1)"""


@query(
    "g07_check_simplification",
    f"""WITH {_THIN}, t AS (SELECT count(*) AS n, avg((h.feature_id IS NOT DISTINCT FROM h2.feature_id)::INT) AS share FROM pts LEFT JOIN hits h USING (pid) LEFT JOIN h2 USING (pid))
SELECT n, round(share, 9) AS share, (SELECT count(*) FROM (SELECT pid FROM h2 GROUP BY 1 HAVING count(*) > 1)) AS doubles, 25::BIGINT AS n_source, 25::BIGINT AS n_new, share >= 0.995 AS ok FROM t"""
)
def simplification(spark, d):
    u = units(spark, d)
    return G.check_simplification(points(spark, d), u, T.simplify_shared(u, tol=0.15)).withColumn("share", F.round("share", 9))


@query("a08_agreement", f"""WITH {EDGES}, {POINTS},
e2 AS (SELECT feature_id, ax+0.05::DOUBLE AS ax, ay+0.05::DOUBLE AS ay, bx+0.05::DOUBLE AS bx, by+0.05::DOUBLE AS by FROM edges),
h1 AS (SELECT pid, feature_id FROM pts JOIN edges ON (ay > y) <> (by > y) AND x < (bx-ax)*(y-ay)/(by-ay)+ax GROUP BY 1, 2 HAVING count(*)%2 = 1),
h2 AS (SELECT pid, feature_id FROM pts JOIN e2 ON (ay > y) <> (by > y) AND x < (bx-ax)*(y-ay)/(by-ay)+ax GROUP BY 1, 2 HAVING count(*)%2 = 1)
SELECT count(*) AS n, round(avg((h1.feature_id IS NOT DISTINCT FROM h2.feature_id)::INT), 9) AS share, 0::BIGINT AS doubles FROM pts LEFT JOIN h1 USING (pid)
  LEFT JOIN h2 USING (pid)""")
def agree(spark, d):
    return G.agreement(points(spark, d), units(spark, d), _shift(units(spark, d), 0.05)).withColumn("share", F.round("share", 9))


@query("g08_tiling_edges", f"""WITH {EDGES},
ke AS ({_KEYED})
SELECT n, turn, count(*) AS edges FROM (SELECT count(*) AS n, sum(CASE WHEN (ax, ay) < (bx, by) THEN 1 ELSE -1 END)::BIGINT AS turn FROM ke
  GROUP BY x1, y1, x2, y2) GROUP BY 1, 2""")
def tiling_edges(spark, d):
    return G.edge_multiplicity(units(spark, d)).groupBy("n", "turn").agg(F.count("*").alias("edges"))


@query("g08_tiling_report", f"""WITH {_OVER},
par AS (SELECT pid, bool_or(x BETWEEN 0 AND 5 AND y < 4) AS inside FROM (SELECT *, y AS yy FROM pts) GROUP BY pid),
c AS (SELECT p.pid, count(o.feature_id) AS n FROM pts p LEFT JOIN oh o ON p.pid = o.pid GROUP BY 1)
SELECT count(*) FILTER (inside) AS parent, count(*) FILTER (inside AND n = 1) AS once, count(*) FILTER (inside AND n = 0) AS cracks,
  count(*) FILTER (n > 1) AS overlaps, count(*) FILTER (NOT inside AND n > 0) AS spill FROM c JOIN par USING (pid)""")
def tiling(spark, d):
    return G.tiling_report(points(spark, d), _overlaid(spark, d), _box(spark, d))


def _box(spark, d):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    return table(spark, d, "region").agg(F.min("r_regionkey").alias("feature_id")).select(
        "feature_id", F.array(F.array(F.array(p(-1, -1), p(6, -1), p(6, 4), p(-1, 4), p(-1, -1)))).alias("polygons")
    )


@query(
    "g08_overlap_pairs",
    f"""WITH {_OVER} SELECT a.feature_id AS a, b.feature_id AS b, count(*) AS n FROM oh a JOIN oh b ON a.pid = b.pid AND a.feature_id < b.feature_id GROUP BY 1, 2"""
)
def overlaps(spark, d):
    return G.overlap_pairs(points(spark, d), _overlaid(spark, d))


_DIST = "min(sqrt(pow(x-(ax+t*(bx-ax)),2)+pow(y-(ay+t*(by-ay)),2)))"
_FOOT = "greatest(0, least(1, ((x-ax)*(bx-ax)+(y-ay)*(by-ay))/((bx-ax)*(bx-ax)+(by-ay)*(by-ay)))) AS t"


@query("g09_fill_gaps", f"""WITH {EDGES}, {POINTS},
s AS (SELECT * FROM pts),
own AS (SELECT * FROM edges WHERE feature_id < 20),
h AS (SELECT pid FROM s JOIN own ON (ay > y) <> (by > y) AND x < (bx-ax)*(y-ay)/(by-ay)+ax GROUP BY pid, feature_id HAVING count(*)%2 = 1),
f AS (SELECT pid, x, y, ax, ay, bx, by, {_FOOT} FROM s, own WHERE pid NOT IN (SELECT pid FROM h))
SELECT pid, round({_DIST}, 9) AS dist FROM f GROUP BY pid""")
def gaps(spark, d):
    # The ground of the top row of units is unowned.
    return G.fill_gaps(points(spark, d), units(spark, d).where("feature_id < 20")).select("pid", F.round("dist", 9).alias("dist"))


# A grid of a twelfth of a unit wherever there are points; the ground of units 7 and 13, which does not meet, and of the top row is unowned.
_FREE = f"""{EDGES}, {POINTS}, grid AS (SELECT DISTINCT floor(x*12)::BIGINT AS cx, floor(y*12)::BIGINT AS cy FROM pts),
cell AS (SELECT cx, cy, (cx+0.5)/12 AS x, (cy+0.5)/12 AS y FROM grid), own AS (SELECT * FROM edges WHERE feature_id < 20 AND feature_id NOT IN (7, 13)),
h AS (SELECT cx, cy, feature_id FROM cell JOIN own ON (ay > y) <> (by > y) AND x < (bx-ax)*(y-ay)/(by-ay)+ax GROUP BY 1, 2, feature_id HAVING count(*)%2 = 1),
free AS (SELECT * FROM cell WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.cx = cell.cx AND h.cy = cell.cy)), steps AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy)),
meet AS (SELECT f.cx, f.cy, g.cx AS nx, g.cy AS ny FROM free f, steps JOIN free g ON g.cx = f.cx + dx AND g.cy = f.cy + dy),
reach AS (SELECT cx, cy, cx AS px, cy AS py FROM free UNION SELECT m.nx, m.ny, px, py FROM reach r JOIN meet m ON m.cx = r.cx AND m.cy = r.cy),
pc AS (SELECT cx, cy, min((px, py)) AS piece FROM reach GROUP BY 1, 2),
ct AS (SELECT piece, h.feature_id AS own, count(*) AS c FROM pc, steps JOIN h ON h.cx = pc.cx + dx AND h.cy = pc.cy + dy GROUP BY 1, 2),
sz AS (SELECT piece, count(*) AS cells, (SELECT count(*) FROM ct WHERE ct.piece = pc.piece) AS neighbours, (SELECT arg_min(own, (-c, own)) FROM ct WHERE ct.piece = pc.piece) AS best FROM pc GROUP BY 1),
ds AS (SELECT cx, cy, feature_id, round(min(sqrt(pow(x-(ax+t*(bx-ax)),2)+pow(y-(ay+t*(by-ay)),2))), 9) AS dist FROM (SELECT cx, cy, feature_id, x, y, ax, ay, bx, by, {_FOOT} FROM free, own) GROUP BY 1, 2, 3),
nr AS (SELECT cx, cy, arg_min(feature_id, (dist, feature_id)) AS near, min(dist) AS dist FROM ds GROUP BY 1, 2)"""


@query(
    "g09_fill_gap_pieces",
    f"""WITH RECURSIVE {_FREE} SELECT cx, cy, cells, neighbours, CASE WHEN neighbours = 1 OR cells <= 150 THEN best WHEN dist <= 0.4 THEN near END AS owner,
 CASE WHEN neighbours = 1 THEN 'only' WHEN cells <= 150 THEN 'whole' WHEN dist <= 0.4 THEN 'split' ELSE 'far' END AS how FROM pc JOIN sz USING (piece) JOIN nr USING (cx, cy)""",
)
def gap_pieces(spark, d):
    twelfth = lambda c: F.floor(F.col(c) * 12).alias("c" + c)
    grid = points(spark, d).select(twelfth("x"), twelfth("y")).distinct()
    centres = grid.select("cx", "cy", ((F.col("cx") + 0.5) / 12).alias("x"), ((F.col("cy") + 0.5) / 12).alias("y"))
    own = units(spark, d).where("feature_id < 20 and feature_id not in (7, 13)")
    return G.fill_gap_pieces(centres, own, 150, 0.4).select("cx", "cy", "cells", "neighbours", "owner", "how")


_CELLS = HITS + ", cells AS (SELECT DISTINCT h.district, floor(x*12)::BIGINT AS cx, floor(y*12)::BIGINT AS cy FROM hits h JOIN pts p ON h.pid = p.pid)"


def cells(spark, d):
    return P.classify(points(spark, d), units(spark, d)).select(
        "district", F.floor(F.col("x") * 12).alias("cx"), F.floor(F.col("y") * 12).alias("cy")
    ).distinct()


@query("g10_close_voids", f"""WITH {_CELLS},
o AS (SELECT i, j FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE i*i+j*j <= 4),
wide AS (SELECT DISTINCT district, cx+i AS cx, cy+j AS cy FROM cells, o),
cl AS (SELECT district, cx+i AS cx, cy+j AS cy FROM wide, o GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM o)),
sole AS (SELECT min(district) AS district, cx, cy FROM cl GROUP BY cx, cy HAVING count(*) = 1)
SELECT * FROM cells UNION SELECT * FROM sole""")
def voids(spark, d):
    return G.close_voids(cells(spark, d), 2)


@query("w10_first_owner", f"WITH {_CELLS} SELECT min(district) AS district, cx, cy FROM cells GROUP BY cx, cy")
def owners(spark, d):
    return G.first_owner(cells(spark, d))


@query("g11_drop_slivers", f"""WITH {EDGES},
a AS (SELECT feature_id, abs(sum(ax*by-bx*ay)/2) AS area FROM edges GROUP BY 1)
SELECT feature_id, k::INT AS polygon_idx, round(area*f, 9) AS area, area*f >= 0.8 AS kept, area < 0.8 AS vanished
  FROM a, (VALUES (0, 1.0::DOUBLE), (1, 0.01::DOUBLE)) t(k, f)""")
def slivers(spark, d):
    small = F.transform(F.col("polygons")[0], lambda r: F.transform(r, lambda v: F.struct((v["x"] * 0.1).alias("x"), (v["y"] * 0.1).alias("y"))))
    two = units(spark, d).withColumn("polygons", F.array(F.col("polygons")[0], small))
    return G.drop_slivers(two, 0.8).withColumn("area", F.round("area", 9))


@query("g11_fill_holes", "SELECT n_nationkey AS feature_id, k::INT AS ring_no FROM nation, range(2) t(k) WHERE k = 0 OR n_nationkey % 2 = 0")
def holes(spark, d):
    u = units(spark, d)
    m = P.ring_measures(u).select("feature_id", "cx", "cy")
    inner = F.transform(F.col("polygons")[0][0], lambda v: F.struct(((v["x"] + F.col("cx")) / 2).alias("x"), ((v["y"] + F.col("cy")) / 2).alias("y")))
    rings = u.join(m, "feature_id").select(
        "feature_id", F.posexplode(F.array(F.col("polygons")[0][0], inner)).alias("ring_no", "ring")
    ).withColumn("hole", F.col("ring_no") == 1)
    probes = m.where("feature_id % 2 = 0").select((F.col("feature_id") + 1000).alias("pid"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return G.fill_holes(rings, probes).select("feature_id", "ring_no")


@query("s06_largest_part", f"WITH {EDGES} SELECT feature_id, 0 AS polygon_idx, round(abs(sum(ax*by-bx*ay)/2), 9) AS area FROM edges GROUP BY 1")
def largest(spark, d):
    small = F.transform(F.col("polygons")[0], lambda r: F.transform(r, lambda v: F.struct((v["x"] * 0.1).alias("x"), (v["y"] * 0.1).alias("y"))))
    return G.largest_part(units(spark, d).withColumn("polygons", F.array(F.col("polygons")[0], small))).withColumn("area", F.round("area", 9))


_PAIR = _OVER + ", ua AS (SELECT pid, feature_id FROM oh WHERE feature_id < 10), ub AS (SELECT pid, feature_id-100 AS feature_id FROM oh WHERE feature_id >= 100)"


@query("g12_clip_report", f"""WITH {_PAIR} SELECT ub.feature_id, count(*) AS n, round(avg((ua.pid IS NULL)::INT), 9) AS outside FROM ub LEFT JOIN (SELECT DISTINCT pid
  FROM ua) ua ON ua.pid = ub.pid GROUP BY 1""")
def clip(spark, d):
    u = units(spark, d).where("feature_id < 10")
    return G.clip_report(points(spark, d), _shift(u, 0.3), u).withColumn("outside", F.round("outside", 9))


@query("g13_iou", f"""WITH {_PAIR},
f AS (SELECT coalesce(ua.feature_id, ub.feature_id) AS feature_id, ua.pid IS NOT NULL AND ub.pid IS NOT NULL AS b FROM ua FULL JOIN ub ON ua.pid = ub.pid
  AND ua.feature_id = ub.feature_id)
SELECT feature_id, count(*) FILTER (b) AS both, count(*) AS either, round(count(*) FILTER (b) / count(*), 9) AS iou FROM f GROUP BY 1""")
def overlap(spark, d):
    u = units(spark, d).where("feature_id < 10")
    return G.iou(points(spark, d), u, _shift(u, 0.3)).withColumn("iou", F.round("iou", 9))


# Bands between all heights of vertices and crossings of a pair; at a band's middle the edges' order is that of the whole band.
_CROSS = "(m.bx-m.ax)*(n.by-n.ay)-(m.by-m.ay)*(n.bx-n.ax)"
_OVERLAY = f"""{EDGES}, ea AS (SELECT feature_id AS a, ax, ay, bx, by FROM edges WHERE feature_id < 10),
eb AS (SELECT feature_id AS b, ax+0.3::DOUBLE AS ax, ay+0.3::DOUBLE AS ay, bx+0.3::DOUBLE AS bx, by+0.3::DOUBLE AS by FROM edges WHERE feature_id < 10),
p AS (SELECT a, b FROM (SELECT DISTINCT a FROM ea), (SELECT DISTINCT b FROM eb)),
el AS (SELECT a, b, 1 AS s, ax, ay, bx, by FROM p JOIN ea USING (a) UNION ALL SELECT a, b, 2, ax, ay, bx, by FROM p JOIN eb USING (b)),
mn AS (SELECT m.a, m.b, m.ay AS y0, m.by AS y1, {_CROSS} AS d, (n.ax-m.ax)*(n.by-n.ay)-(n.ay-m.ay)*(n.bx-n.ax) AS t, (n.ax-m.ax)*(m.by-m.ay)-(n.ay-m.ay)*(m.bx-m.ax) AS u
 FROM el m JOIN el n ON m.a = n.a AND m.b = n.b AND m.s = 1 AND n.s = 2),
ys AS (SELECT a, b, ay AS y FROM el UNION SELECT a, b, y0 + t / d * (y1 - y0) FROM mn WHERE d <> 0 AND t / d BETWEEN 0 AND 1 AND u / d BETWEEN 0 AND 1),
sl AS (SELECT a, b, y AS y0, lead(y) OVER (PARTITION BY a, b ORDER BY y) AS y1 FROM ys),
ev AS (SELECT sl.a, sl.b, y0, y1, s, ax + (bx-ax)*((y0+y1)/2-ay)/(by-ay) AS x FROM sl JOIN el ON sl.a = el.a AND sl.b = el.b WHERE y1 IS NOT NULL AND (ay > (y0+y1)/2) <> (by > (y0+y1)/2)),
w AS (SELECT a, b, y1 - y0 AS h, lead(x) OVER q - x AS wide, sum((s = 1)::INT) OVER q % 2 AS ia, sum((s = 2)::INT) OVER q % 2 AS ib FROM ev WINDOW q AS (PARTITION BY a, b, y0 ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sh AS (SELECT a, b, sum(h * wide) AS shared FROM w WHERE ia = 1 AND ib = 1 AND wide IS NOT NULL GROUP BY 1, 2),
ar AS (SELECT feature_id, abs(sum(ax*by-bx*ay)/2) AS area FROM edges GROUP BY 1)"""


@query(
    "g13_overlay_areas",
    f"""WITH {_OVERLAY} SELECT sh.a AS a_id, sh.b AS b_id, round(shared, 7) AS shared, round(shared / (x.area + y.area - shared), 7) AS iou, round(shared / x.area, 7) AS share_a
FROM sh JOIN ar x ON x.feature_id = sh.a JOIN ar y ON y.feature_id = sh.b WHERE shared > 1e-9""",
)
def overlay(spark, d):
    u = units(spark, d).where("feature_id < 10")
    return overlay_areas(u, _shift(u, 0.3), 1e-9).select("a_id", "b_id", *[F.round(c, 7).alias(c) for c in ("shared", "iou", "share_a")])


_WIDE = _OVERLAY.replace("AS a, ax, ay, bx, by FROM edges WHERE feature_id < 10", "AS a, ax, ay, bx, by FROM edges WHERE feature_id < 20")


@query(
    "g08_tiling_areas",
    f"""WITH {_WIDE}, t AS (SELECT sum(area) FILTER (feature_id < 20) + sum(area) FILTER (feature_id < 10) AS claimed, (SELECT sum(shared) FROM sh) AS twice, (SELECT max(shared) FROM sh) AS worst,
 (SELECT sum(greatest(y - (j + 1), 0)) / 2 FROM verts JOIN nat USING (feature_id) WHERE s = 5 AND j = 3) AS over FROM ar)
SELECT 35.0::DOUBLE AS parent, round(claimed - 2 * twice - over, 7) AS once, round(35 - (claimed - twice - over), 7) AS cracks, round(twice, 7) AS overlaps, round(over, 7) AS spill,
 round(worst, 7) AS worst, round((claimed - twice - over) / 35, 7) AS coverage FROM t""",
)
def tiling_by_area(spark, d):
    told = tiling_areas(_overlaid(spark, d), _box(spark, d))
    return told.select(*[F.round(c, 7).alias(c) for c in ("parent", "once", "cracks", "overlaps", "spill", "worst", "coverage")])


@query(
    "g12_clip_areas",
    f"WITH {_OVERLAY} SELECT feature_id, round(area, 7) AS area, round(1 - (SELECT sum(shared) FROM sh WHERE sh.b = feature_id) / area, 7) AS outside FROM ar WHERE feature_id < 10"
)
def clip_by_area(spark, d):
    u = units(spark, d).where("feature_id < 10")
    return clip_areas(_shift(u, 0.3), u).select("feature_id", F.round("area", 7).alias("area"), F.round("outside", 7).alias("outside"))


@query(
    "g29_outline_difference_area",
    f"""WITH {_OVERLAY}, t AS (SELECT sum(area) AS a, (SELECT sum(shared) FROM sh) AS s FROM ar WHERE feature_id < 10)
SELECT round(2 * a - 2 * s, 7) AS differ, round((2 * a - 2 * s) / (2 * a - s), 7) AS share FROM t""",
)
def outlines_by_area(spark, d):
    u = units(spark, d).where("feature_id < 10")
    return outline_difference_area(u, _shift(u, 0.3)).select(F.round("differ", 7).alias("differ"), F.round("share", 7).alias("share"))


@query("g29_outline_difference", f"""WITH {_PAIR} SELECT count(*) AS n, count(*) FILTER ((a.pid IS NULL) <> (b.pid IS NULL)) AS differ FROM pts LEFT JOIN (SELECT DISTINCT pid
  FROM ua) a USING (pid) LEFT JOIN (SELECT DISTINCT pid FROM ub) b USING (pid)""")
def outlines(spark, d):
    u = units(spark, d).where("feature_id < 10")
    return G.outline_difference(points(spark, d), u, _shift(u, 0.3))


_IP = """l AS (SELECT feature_id, min(ay)+(max(ay)-min(ay))*0.4997::DOUBLE AS y FROM edges GROUP BY 1),
xs AS (SELECT feature_id, y, (bx-ax)*(y-ay)/(by-ay)+ax AS x FROM edges JOIN l USING (feature_id) WHERE (ay > y) <> (by > y)),
sp AS (SELECT feature_id, y, x, lead(x) OVER w AS x2, row_number() OVER w AS k FROM xs WINDOW w AS (PARTITION BY feature_id ORDER BY x)),
ip AS (SELECT feature_id AS p, arg_max(struct_pack(x := (x+x2)/2, y := y), x2-x) AS q FROM sp WHERE k%2=1 AND x2 IS NOT NULL GROUP BY 1)"""


@query(
    "g14_check_interior_points",
    f"""WITH {EDGES}, {_IP}, got AS (SELECT p, any_value(u.district) AS district FROM ip JOIN edges u ON (ay > q.y) <> (by > q.y) AND q.x < (bx-ax)*(q.y-ay)/(by-ay)+ax GROUP BY p, u.feature_id HAVING count(*)%2 = 1),
c AS (SELECT n_nationkey AS unit, CASE WHEN n_nationkey % 6 = 1 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS district FROM nation)
SELECT unit, c.district, CASE WHEN got.p IS NULL THEN 'NONE' ELSE 'OK' END AS status, got.district AS got, coalesce(got.district = c.district, false) AS ok FROM c LEFT JOIN got ON got.p = unit""",
)
def interiors(spark, d):
    # Every sixth unit is claimed for a district that does not hold it.
    claimed = composition(spark, d).withColumn("district", F.when(F.col("unit") % 6 == 1, (F.col("district") + 1) % 5).otherwise(F.col("district")))
    return G.check_interior_points(units(spark, d), districts(spark, d), claimed)


# Probes of districts: their vertices, once for each boundary edge that begins there, drawn to the box's centre, and a grid over the box.
_PROBES = f"""{_DISS}, ends AS (SELECT district, x1 AS x, y1 AS y FROM diss UNION ALL SELECT district, x2, y2 FROM diss),
box AS (SELECT district, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ends GROUP BY 1),
vert AS (SELECT district, x, y, unnest(range((count(*) // 2)::BIGINT)) AS k FROM ends GROUP BY 1, 2, 3),
probe AS (SELECT district, x + ((x0 + x1) / 2 - x) * 0.03 AS x, y + ((y0 + y1) / 2 - y) * 0.03 AS y FROM vert JOIN box USING (district)
 UNION ALL SELECT district, x0 + (x1 - x0) * (i + 0.5) / 12, y0 + (y1 - y0) * (j + 0.5) / 12 FROM box, range(12) a(i), range(12) b(j)),
numbered AS (SELECT *, row_number() OVER () AS no FROM probe),
held AS (SELECT n.no, n.district AS own, u.feature_id, any_value(u.district) AS district FROM numbered n JOIN edges u ON (ay > n.y) <> (by > n.y) AND n.x < (bx-ax)*(n.y-ay)/(by-ay)+ax GROUP BY n.no, n.district, u.feature_id HAVING count(*)%2 = 1),
told AS (SELECT no, bool_or(district = own) AS a, bool_or(CASE WHEN feature_id = 7 THEN own = 0 ELSE district = own END) AS b FROM held GROUP BY no)"""


@query("g15_check_whole_units", f"""WITH {_PROBES} SELECT n.district AS coarse, count(*) AS probes, count(*) FILTER (coalesce(a, false) <> coalesce(b, false)) AS differ FROM numbered n LEFT
  JOIN told USING (no) GROUP BY 1""")
def whole(spark, d):
    # Unit 7 is listed for district 0, whose ground it isn't.
    parts = composition(spark, d).select(F.when(F.col("unit") == 7, 0).otherwise(F.col("district")).alias("coarse"), F.col("unit").alias("fine"))
    return G.check_whole_units(units(spark, d), districts(spark, d), parts)


@query("g17_adjudicate_blocks", f"""WITH {HITS} SELECT feature_id AS piece, sum(pid % 100)::BIGINT AS pop, count(*) AS blocks, CASE
  WHEN feature_id = 3 THEN 0 ELSE sum(pid % 100) END::BIGINT AS expected, feature_id <> 3 AS ok FROM hits GROUP BY 1""")
def blocks(spark, d):
    b = points(spark, d).withColumn("pop", F.col("pid") % 100)
    told = P.classify(b, units(spark, d)).groupBy(F.col("feature_id").alias("piece")).agg(
        F.when(F.col("feature_id") == 3, F.lit(0)).otherwise(F.sum("pop")).alias("pop")
    )
    return G.adjudicate_blocks(b, units(spark, d), told)


@query("g18_shared_borders", f"""WITH {EDGES},
ke AS ({_KEYED}),
ol AS (SELECT feature_id, sum(sqrt(pow(x2-x1,2)+pow(y2-y1,2))) AS whole FROM ke GROUP BY 1)
SELECT p.feature_id AS a, q.feature_id AS b, round(sum(sqrt(pow(p.x2-p.x1,2)+pow(p.y2-p.y1,2))), 9) AS length,
 round(sum(sqrt(pow(p.x2-p.x1,2)+pow(p.y2-p.y1,2))) / (SELECT whole FROM ol WHERE ol.feature_id = p.feature_id), 9) AS share_a,
 round(sum(sqrt(pow(p.x2-p.x1,2)+pow(p.y2-p.y1,2))) / (SELECT whole FROM ol WHERE ol.feature_id = q.feature_id), 9) AS share_b FROM ke p
  JOIN ke q ON p.feature_id < q.feature_id AND p.x1=q.x1 AND p.y1=q.y1 AND p.x2=q.x2 AND p.y2=q.y2 GROUP BY 1, 2""")
def borders(spark, d):
    return G.shared_borders(units(spark, d)).select("a", "b", *[F.round(c, 9).alias(c) for c in ("length", "share_a", "share_b")])


@query("g19_check_descriptions", f"""WITH {EDGES},
m AS (SELECT feature_id, sum((ax+bx)*(ax*by-bx*ay))/(3*sum(ax*by-bx*ay)) AS x, sum((ay+by)*(ax*by-bx*ay))/(3*sum(ax*by-bx*ay)) AS y FROM edges GROUP BY 1),
r AS (SELECT n_nationkey AS a, (n_nationkey*7+3)%25 AS b, CASE n_nationkey%4 WHEN 0 THEN 'north' WHEN 1 THEN 'south'
  WHEN 2 THEN 'east' ELSE 'west' END AS side FROM nation)
SELECT a, b, side, CASE side WHEN 'north' THEN p.y > q.y WHEN 'south' THEN p.y < q.y WHEN 'east' THEN p.x > q.x ELSE p.x < q.x END AS ok FROM r
  JOIN m p ON p.feature_id = a JOIN m q ON q.feature_id = b WHERE a <> b""")
def descriptions(spark, d):
    r = table(spark, d, "nation").selectExpr(
        "n_nationkey as a", "(n_nationkey*7+3)%25 as b",
        "CASE n_nationkey%4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'east' ELSE 'west' END as side"
    ).where("a <> b")
    return G.check_descriptions(units(spark, d), r)


@query("g19_check_bands", f"""WITH {EDGES},
m AS (SELECT feature_id, sum((ax+bx)*(ax*by-bx*ay))/(3*sum(ax*by-bx*ay)) AS x, sum((ay+by)*(ax*by-bx*ay))/(3*sum(ax*by-bx*ay)) AS y FROM edges GROUP BY 1)
SELECT feature_id, round(x, 9) AS x, round(y, 9) AS y, x >= feature_id % 5 + 0.48 AND (feature_id % 3 = 0 OR y <= feature_id // 5 + 0.52) AS ok FROM m""")
def bands(spark, d):
    b = table(spark, d, "nation").selectExpr(
        "n_nationkey as feature_id", "n_nationkey % 5 + 0.48D as min_x", "cast(null as double) as min_y", "cast(null as double) as max_x",
        "CASE WHEN n_nationkey % 3 <> 0 THEN floor(n_nationkey / 5) + 0.52D END as max_y"
    )
    return G.check_bands(units(spark, d), b).select("feature_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "ok")


@query("g19_check_area_shares", f"""WITH {EDGES},
m AS (SELECT feature_id, abs(sum(ax*by-bx*ay)/2) AS area FROM edges GROUP BY 1)
SELECT p.feature_id AS a, q.feature_id AS b, round(p.area / (p.area + q.area), 9) AS got, abs(p.area / (p.area + q.area) - 0.5) <= 0.03 AS ok FROM m p JOIN m q ON q.feature_id = (p.feature_id*7+3)%25
WHERE p.feature_id <> q.feature_id""")
def area_shares(spark, d):
    r = table(spark, d, "nation").selectExpr("n_nationkey as a", "(n_nationkey*7+3)%25 as b", "0.5D as share", "0.03D as slack").where("a <> b")
    return G.check_area_shares(units(spark, d), r).withColumn("got", F.round("got", 9))


@query("g21_check_extent", f"""WITH {EDGES},
m AS (SELECT greatest(abs(min(ax + 0.3) - min(ax)), abs(max(ax + 0.3) - max(ax)), abs(min(ay + 0.3) - min(ay)), abs(max(ay + 0.3) - max(ay))) AS m FROM edges)
SELECT round(m, 9) AS differ, m <= 0.1 AS ok FROM m""")
def extent(spark, d):
    return G.check_extent(units(spark, d), _shift(units(spark, d), 0.3), 0.1).withColumn("differ", F.round("differ", 9))




@query("g22_check_disjoint_sources", f"""WITH {EDGES}, {_IP},
two AS (SELECT feature_id, 'a' AS source, ax, ay, bx, by FROM edges
UNION ALL SELECT feature_id + 100, 'b', ax+0.3::DOUBLE, ay+0.3::DOUBLE, bx+0.3::DOUBLE, by+0.3::DOUBLE FROM edges WHERE feature_id < 10),
pr AS (SELECT p, 'a' AS ps, q.x AS x, q.y AS y FROM ip
UNION ALL SELECT p + 100, 'b', q.x + 0.3::DOUBLE, q.y + 0.3::DOUBLE FROM ip WHERE p < 10)
SELECT p AS probe, ps AS probe_source, feature_id, source FROM pr JOIN two ON (ay > y) <> (by > y) AND x < (bx-ax)*(y-ay)/(by-ay)+ax AND ps <> source
  GROUP BY p, ps, feature_id, source HAVING count(*)%2 = 1""")
def disjoint(spark, d):
    # The units as one source and ten of them, moved, as another: the moved ones reach into the first.
    u = units(spark, d).select("feature_id", "polygons")
    two = u.withColumn("source", F.lit("a")).unionByName(
        _shift(u.where("feature_id < 10"), 0.3).select((F.col("feature_id") + 100).alias("feature_id"), "polygons", F.lit("b").alias("source"))
    )
    return G.check_disjoint_sources(two)


@query("g23_corridor_median", """WITH s AS (SELECT s_suppkey AS k, ((s_suppkey*7919)%100003)*5.0::DOUBLE/100003 AS x, (s_suppkey%7)/10.0::DOUBLE AS y FROM supplier),
l AS (SELECT k, x AS ax, y AS ay, x+1 AS bx, y+0.2 AS by FROM s),
c AS (SELECT unnest(range(ceil(ax/0.25)::BIGINT, floor(bx/0.25)::BIGINT + 1)) AS k, ax, ay, bx, by FROM l)
SELECT k, round(median(ay+(by-ay)*(k*0.25::DOUBLE-ax)/(bx-ax)), 9) AS y, count(*) AS n FROM c GROUP BY k""")
def corridor(spark, d):
    lines = sites(spark, d).selectExpr("sx as ax", "(sid % 7) / 10.0D as ay", "sx + 1 as bx", "(sid % 7) / 10.0D + 0.2D as by")
    return G.corridor_median(lines, 0.25).select("k", F.round("y", 9).alias("y"), "n")


@query("g23_corridor_channel", """WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_suppkey % 3 AS path, ((s_suppkey*7919)%100003)*5.0::DOUBLE/100003 AS x, (s_suppkey%7)/10.0::DOUBLE AS y FROM supplier),
l AS (SELECT path, x AS ax, CASE WHEN k % 4 = 0 THEN y + 5 ELSE y END AS ay, x+1 AS bx, CASE WHEN k % 4 = 0 THEN y + 6 ELSE y+0.2 END AS by FROM s),
c AS (SELECT path, unnest(range(ceil(ax/0.25)::BIGINT, floor(bx/0.25)::BIGINT + 1)) AS k, ax, ay, bx, by FROM l),
y AS (SELECT path, k, ay+(by-ay)*(k*0.25::DOUBLE-ax)/(bx-ax) AS y FROM c),
n AS (SELECT *, (coalesce(y - lag(y) OVER (PARTITION BY path, k ORDER BY y), 0) > 1)::INT AS new FROM y),
ch AS (SELECT *, sum(new) OVER (PARTITION BY path, k ORDER BY y ROWS UNBOUNDED PRECEDING) AS channel FROM n),
m AS (SELECT path, k, (min(y) + max(y)) / 2 AS m, count(*) AS n FROM ch GROUP BY path, k, channel),
r AS (SELECT *, dense_rank() OVER (PARTITION BY path ORDER BY k) AS i, count(*) OVER (PARTITION BY path, k) AS channels FROM m),
f AS (SELECT path, k, i, arg_min(m, (-n, m)) AS y, any_value(channels) AS channels FROM r WHERE i = 1 GROUP BY 1, 2, 3
  UNION ALL SELECT r.path, r.k, r.i, arg_min(r.m, (abs(r.m - f.y), r.m)), any_value(r.channels) FROM f JOIN r ON r.path = f.path AND r.i = f.i + 1 GROUP BY r.path, r.k, r.i)
SELECT path, k, round(y, 9) AS y, channels::INT AS channels FROM f""")
def channel(spark, d):
    # A fourth of the strands is a side arm far above, which the line must not follow.
    lines = sites(spark, d).selectExpr(
        "sid % 3 as path", "sx as ax", "(sid % 7) / 10.0D + CASE WHEN sid % 4 = 0 THEN 5D ELSE 0D END as ay", "sx + 1 as bx",
        "(sid % 7) / 10.0D + CASE WHEN sid % 4 = 0 THEN 6D ELSE 0.2D END as by"
    )
    return G.corridor_channel(lines, 0.25, 1.0).select("path", "k", F.round("y", 9).alias("y"), "channels")


@query("w08_sample_gaps", """WITH s AS (SELECT l_orderkey % 50 AS path, CAST(l_orderkey * 8 + l_linenumber AS DOUBLE) AS x FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT path, before, after FROM (SELECT path, lag(x) OVER (PARTITION BY path ORDER BY x) AS before, x AS after FROM s) WHERE after - before > 450""")
def gaps_in_samples(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().selectExpr(
        "l_orderkey % 50 as path", "cast(l_orderkey * 8 + l_linenumber as double) as x"
    )
    return G.sample_gaps(s, 300.0)


@query("g24_split_by_line", f"""WITH {HITS},
c AS (SELECT h.feature_id AS unit, x, y, round(x*4)::BIGINT AS lk FROM hits h JOIN pts p ON h.pid = p.pid),
ln AS (SELECT k AS lk, 1 + k*0.15::DOUBLE AS ly FROM range(0, 19) t(k))
SELECT unit, CASE WHEN ly IS NULL THEN 'off' WHEN y > ly THEN 'above' ELSE 'below' END AS side, count(*) AS cells FROM c LEFT JOIN ln USING (lk) GROUP BY 1, 2""")
def split_line(spark, d):
    cells_ = P.classify(points(spark, d), units(spark, d)).select(F.col("feature_id").alias("unit"), "x", "y")
    line = spark.range(19).select(F.col("id").alias("k"), (1 + F.col("id") * F.lit(0.15)).alias("y"))
    return G.split_by_line(cells_, line, 0.25)


# A path with teeth: the ground above it, below it and beyond its end as polygons (without their level sides) to overlay the units with.
_TOOTHED = """pt AS (SELECT k, k*0.25::DOUBLE AS x, 1 + k*0.15::DOUBLE + (k%2)*0.2::DOUBLE AS y FROM range(0, 19) t(k)),
sg AS (SELECT p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by FROM pt p JOIN pt q ON q.k = p.k + 1)"""
_SIDES = """SELECT b, ax, ay, bx, by FROM sg, (VALUES (1), (2)) t(b) UNION ALL SELECT 1, x, y, x, 10 FROM pt WHERE k IN (0, 18) UNION ALL SELECT 2, x, y, x, -10 FROM pt WHERE k IN (0, 18)
 UNION ALL SELECT 3, x, -10, x, 10 FROM (VALUES (4.5::DOUBLE), (10.0::DOUBLE)) t(x)"""
_CUT = (
    _OVERLAY.replace("FROM edges WHERE feature_id < 10),\neb AS", "FROM edges), " + _TOOTHED + ",\neb AS")
    .replace("SELECT feature_id AS b, ax+0.3::DOUBLE AS ax, ay+0.3::DOUBLE AS ay, bx+0.3::DOUBLE AS bx, by+0.3::DOUBLE AS by FROM edges WHERE feature_id < 10", _SIDES)
)


@query(
    "g24_split_polygons",
    f"""WITH {_CUT}, c AS (SELECT a, CASE b WHEN 1 THEN 'above' WHEN 2 THEN 'below' ELSE 'off' END AS side, shared FROM sh WHERE shared > 1e-9)
SELECT a AS feature_id, side, round(shared, 7) AS area, true AS whole FROM c"""
)
def split_by_path(spark, d):
    path = spark.range(19).selectExpr("id as k", "id * 0.25D as x", "1 + id * 0.15D + (id % 2) * 0.2D as y")
    u = units(spark, d)
    parts = split_polygons(u, path).groupBy("feature_id", "side").agg(F.sum("area").alias("area"))
    own = P.ring_measures(u).select("feature_id", F.col("area").alias("own"))
    sums = parts.groupBy("feature_id").agg(F.sum("area").alias("total")).join(own, "feature_id").select("feature_id", (F.abs(F.col("total") - F.col("own")) < 1e-9).alias("whole"))
    return parts.join(sums, "feature_id").where("area > 1e-9").select("feature_id", "side", F.round("area", 7).alias("area"), "whole")


@query("g25_merge_same_name", """SELECT CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE 'D' || (n_nationkey % 4)::VARCHAR END AS name, count(*) AS rows, count(*)::INT AS parts FROM nation
  GROUP BY 1""")
def same_name(spark, d):
    f = units(spark, d).withColumn("name", F.when(F.col("feature_id") % 6 == 0, " ").otherwise(F.concat(F.lit("D"), F.col("feature_id") % 4)))
    return G.merge_same_name(f).select("name", "rows", F.size("polygons").alias("parts"))


@query("g26_boundary_shift", f"""WITH {EDGES}, l AS (SELECT *, greatest(ceil(sqrt(pow(bx-ax,2)+pow(by-ay,2))/0.13::DOUBLE), 1)::INT AS n FROM edges WHERE feature_id < 10),
s AS (SELECT feature_id, seq, k, ax+(bx-ax)*k/n AS x, ay+(by-ay)*k/n AS y FROM l, range(0, n+1) t(k)),
o AS (SELECT ax+0.3::DOUBLE AS ax, ay+0.3::DOUBLE AS ay, bx+0.3::DOUBLE AS bx, by+0.3::DOUBLE AS by FROM edges WHERE feature_id < 10),
f AS (SELECT feature_id, seq, k, x, y, ax, ay, bx, by, {_FOOT} FROM s, o), d AS (SELECT feature_id, seq, k, {_DIST} AS d FROM f GROUP BY 1, 2, 3)
SELECT feature_id, round(median(d), 9) AS median, round(max(d), 9) AS greatest, count(*) AS samples FROM d GROUP BY 1""")
def shifted(spark, d):
    # The boundaries of ten units against the same ones moved by 0.3.
    u = units(spark, d).where("feature_id < 10")
    return G.boundary_shift(u, _shift(u, 0.3), 0.13).select(
        "feature_id", F.round("median", 9).alias("median"), F.round("greatest", 9).alias("greatest"), "samples"
    )


_SHARE = _PAIR + """,
sh AS (SELECT ua.feature_id AS unit, ub.feature_id AS district, count(*)::DOUBLE / any_value(n) AS share FROM ua JOIN ub USING (pid) JOIN (SELECT feature_id,
  count(*) AS n FROM ua GROUP BY 1) c ON c.feature_id = ua.feature_id GROUP BY 1, 2)"""


def _shares(spark, d):
    u = units(spark, d).where("feature_id < 10")
    return P.area_share(points(spark, d), u, _shift(u, 0.3))


@query(
    "g27_best_share",
    f"WITH {_SHARE} SELECT unit, CASE WHEN max(share) >= 0.55 THEN arg_max(district, share) END AS district, round(max(share), 9) AS share FROM sh GROUP BY 1"
)
def best(spark, d):
    return G.best_share(_shares(spark, d), 0.55).withColumn("share", F.round("share", 9))


@query(
    "j14_membership",
    f"""WITH {_SHARE} SELECT unit, max(CASE WHEN share >= 0.5 THEN district END) AS home, string_agg(district::VARCHAR, ',' ORDER BY district) FILTER (share > 0.1) AS districts FROM sh GROUP BY 1"""
)
def members(spark, d):
    return G.membership(_shares(spark, d)).withColumn("districts", F.array_join("districts", ","))


@query("g28_label_hits", f"WITH {HITS} SELECT pid, (pid % 25)::INT AS names, feature_id AS got, feature_id = pid % 25 AS ok FROM hits")
def hits(spark, d):
    return G.label_hits(points(spark, d).withColumn("names", (F.col("pid") % 25).cast("int")), units(spark, d))
