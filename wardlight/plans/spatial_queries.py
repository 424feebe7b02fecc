"""Queries of the spatial joins over points, sites and unit polygons derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import spatial as P
from wardlight.plans.base import EDGES, HITS, POINTS, SITES, VERTS, points, query, sites, table, units


@query("point_in_polygon", f"WITH {HITS} SELECT pid, feature_id, name, district, r_name AS region FROM hits JOIN region ON r_regionkey = district")
def point_in_polygon(spark, d):
    """The flagship: each point's unit and district, and who serves the district."""
    hits = P.classify(points(spark, d), units(spark, d))
    served = table(spark, d, "region").select(F.col("r_regionkey").alias("district"), F.col("r_name").alias("region"))
    return hits.join(served, "district").select("pid", "feature_id", "name", "district", "region")


@query("j01_classify_counts", f"WITH {HITS} SELECT feature_id, count(*) AS n FROM hits GROUP BY feature_id")
def classify_counts(spark, d):
    return P.classify(points(spark, d), units(spark, d)).groupBy("feature_id").agg(F.count("*").alias("n"))


# A layer with overlaps and gaps: units 0-9 again, moved by 0.3.
def _overlaid(spark, d):
    own = units(spark, d)
    moved = F.transform(
        "polygons",
        lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct((v["x"] + 0.3).alias("x"), (v["y"] + 0.3).alias("y"))))
    )
    return own.where("feature_id < 20").select("feature_id", "polygons").unionByName(
        own.where("feature_id < 10").select((F.col("feature_id") + 100).alias("feature_id"), moved.alias("polygons"))
    )


_OVER = EDGES + """,
over AS (SELECT feature_id, ax, ay, bx, by FROM edges WHERE feature_id < 20
UNION ALL SELECT feature_id+100, ax+0.3::DOUBLE, ay+0.3::DOUBLE, bx+0.3::DOUBLE, by+0.3::DOUBLE FROM edges WHERE feature_id < 10), """ + POINTS + ", oh AS (SELECT pid, feature_id FROM pts JOIN over ON (ay > y) <> (by > y) AND x < (bx-ax)*(y-ay)/(by-ay)+ax GROUP BY 1, 2 HAVING count(*)%2 = 1)"


@query("j02_classify_status", f"""WITH {_OVER} SELECT p.pid, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL THEN 'NONE' WHEN n = 1 THEN 'OK' ELSE 'MULTI' END AS status, CASE
  WHEN n = 1 THEN one END AS feature_id FROM pts p LEFT JOIN (SELECT pid, count(*) AS n, min(feature_id) AS one FROM oh GROUP BY pid) h ON p.pid = h.pid""")
def status(spark, d):
    return P.classify_status(points(spark, d), _overlaid(spark, d))


@query("j03_dispatch", f"""WITH {_OVER},
won AS (SELECT pid, arg_min(feature_id, (feature_id % 4) * 1000 + feature_id) AS f FROM oh WHERE feature_id % 5 <> 3 GROUP BY pid)
SELECT p.pid, CASE WHEN f IS NULL THEN 'ERROR' ELSE 'OK' END AS status, 'src' || (f % 4)::VARCHAR AS source, f AS feature_id FROM pts p LEFT
  JOIN won ON p.pid = won.pid""")
def dispatched(spark, d):
    k = F.col("feature_id")
    entries = _overlaid(spark, d).withColumns(
        {"entry_order": k % 4, "source": F.concat(F.lit("src"), (k % 4).cast("string")), "available": k % 5 != 3}
    )
    return P.dispatch(points(spark, d), entries)


@query("j04_carve_out", f"WITH {HITS} SELECT pid FROM hits WHERE district IN (0, 1) AND feature_id % 2 = 0")
def carved(spark, d):
    u = units(spark, d)
    return P.carve_out(points(spark, d), u.where("district in (0, 1)"), u.where("feature_id % 2 = 1")).select("pid")


@query("p06_coverage_filter", f"WITH {HITS} SELECT DISTINCT pid FROM hits WHERE district = 2")
def coverage(spark, d):
    return P.covered(points(spark, d), units(spark, d).where("district = 2")).select("pid")


@query("p07_envelope_filter", f"WITH {POINTS} SELECT pid, x, y FROM pts WHERE x BETWEEN 1 AND 2.5 AND y BETWEEN 0.5 AND 4")
def envelope(spark, d):
    return P.envelope_filter(points(spark, d), 1.0, 0.5, 2.5, 4.0)


@query("p05_bbox_prereject", f"""WITH {EDGES}, {POINTS},
b AS (SELECT feature_id, min(ax) x0, max(ax) x1, min(ay) y0, max(ay) y1 FROM edges GROUP BY 1)
SELECT feature_id, count(*) AS n FROM pts JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1""")
def prereject(spark, d):
    return P.bbox_prereject(points(spark, d), units(spark, d)).groupBy("feature_id").agg(F.count("*").alias("n"))


_NEAR = f"""WITH {POINTS}, {SITES} SELECT pid, rank, sid, round(dist, 9) AS dist
  FROM (SELECT pid, sid, dist, row_number() OVER (PARTITION BY pid ORDER BY dist, sid)::INT AS rank
  FROM (SELECT pid, sid, sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy)) AS dist FROM pts, sites)) WHERE rank <= 3"""


@query("j05_nearest_n", _NEAR)
def nearest(spark, d):
    return P.nearest_n(points(spark, d), sites(spark, d), 3).withColumn("dist", F.round("dist", 9))


@query(
    "s05_top_k_nearest",
    f"""WITH {POINTS}, {SITES} SELECT sid, count(*) AS n FROM (SELECT pid, arg_min(sid, (x-sx)*(x-sx)+(y-sy)*(y-sy)) AS sid FROM pts, sites GROUP BY pid) GROUP BY sid"""
)
def nearest_served(spark, d):
    return P.nearest_n(points(spark, d), sites(spark, d), 1).groupBy("sid").agg(F.count("*").alias("n"))


@query("j06_nearest_segment", f"""WITH {EDGES}, {SITES},
e AS (SELECT feature_id*8+seq AS eid, * FROM edges),
f AS (SELECT sid, eid, greatest(0, least(1, ((sx-ax)*(bx-ax)+(sy-ay)*(by-ay))/((bx-ax)*(bx-ax)+(by-ay)*(by-ay)))) AS t, sx, sy, ax, ay, bx, by FROM sites, e),
g AS (SELECT sid, eid, sqrt(pow(sx-(ax+t*(bx-ax)),2)+pow(sy-(ay+t*(by-ay)),2)) AS dist FROM f)
SELECT sid AS pid, arg_min(eid, {{'d': dist, 'e': eid}}) AS eid, round(min(dist), 9) AS dist FROM g GROUP BY sid""")
def nearest_edge(spark, d):
    edges = P.ring_edges(units(spark, d)).withColumn("eid", F.col("feature_id") * 8 + F.col("seq"))
    own = sites(spark, d).select(F.col("sid").alias("pid"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    return P.nearest_segment(own, edges).select("pid", "eid", F.round("dist", 9).alias("dist"))


@query("j13_attach_roster", f"""WITH {HITS},
r AS (SELECT c_nationkey, min(c_name) AS holder FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT pid, feature_id, holder FROM hits LEFT JOIN r ON c_nationkey = feature_id""")
def attach_roster(spark, d):
    from wardlight.operators.rosters import attach_roster as attach

    roster = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").groupBy(
        F.col("c_nationkey").alias("feature_id")
    ).agg(F.min("c_name").alias("holder"))
    return attach(P.classify(points(spark, d), units(spark, d)).select("pid", "feature_id"), roster, "feature_id")


@query("j14_area_share", f"""WITH {_OVER},
h AS (SELECT pid, feature_id FROM oh),
u AS (SELECT * FROM h WHERE feature_id < 100),
m AS (SELECT pid, feature_id - 100 AS d FROM h WHERE feature_id >= 100),
n AS (SELECT feature_id, count(*) AS n_unit FROM u GROUP BY 1)
SELECT u.feature_id AS unit, d AS district, count(*) AS n, any_value(n_unit) AS n_unit, round(count(*)::DOUBLE/any_value(n_unit), 9) AS share FROM u
  JOIN m ON u.pid = m.pid JOIN n ON n.feature_id = u.feature_id GROUP BY 1, 2""")
def shares(spark, d):
    both = _overlaid(spark, d)
    moved = both.where("feature_id >= 100").withColumn("feature_id", F.col("feature_id") - 100)
    return P.area_share(points(spark, d), both.where("feature_id < 100"), moved).withColumn("share", F.round("share", 9))


_BOXES = """boxes AS (SELECT s_suppkey AS box_id, sx - 0.2 - (s_suppkey%5)/10.0::DOUBLE AS x0, sy - 0.3 AS y0, sx + CASE
  WHEN s_suppkey%11=0 THEN -3 ELSE 0.4 END AS x1, sy + 0.5 AS y1 FROM (SELECT sid AS s_suppkey, sx, sy FROM sites))"""


@query("j18_bbox_region", f"""WITH {POINTS}, {SITES}, {_BOXES} SELECT pid, arg_min(box_id, {{'d': pow(x-(x0+x1)/2,2)+pow(y-(y0+y1)/2,2), 'b': box_id}}) AS box_id FROM pts
  JOIN boxes ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WHERE x0 < x1 AND y0 < y1 GROUP BY pid""")
def regions(spark, d):
    boxes = sites(spark, d).selectExpr(
        "sid as box_id", "sx - 0.2D - (sid % 5) / 10.0D as min_x", "sy - 0.3D as min_y",
        "sx + CASE WHEN sid % 11 = 0 THEN -3D ELSE 0.4D END as max_x", "sy + 0.5D as max_y"
    )
    return P.bbox_region(points(spark, d), boxes)


@query("j19_assign_labels", f"""WITH {EDGES},
m AS (SELECT feature_id, sum((ax+bx)*(ax*by-bx*ay))/(3*sum(ax*by-bx*ay)) AS cx, sum((ay+by)*(ax*by-bx*ay))/(3*sum(ax*by-bx*ay)) AS cy FROM edges GROUP BY 1)
SELECT feature_id, name AS label, CASE WHEN feature_id = 2 THEN 'leftover' ELSE 'inside' END AS how FROM m JOIN nation ON n_nationkey = feature_id""".replace("name AS label", "n_name AS label"))
def labels(spark, d):
    u = units(spark, d)
    centre = P.ring_measures(u).select("feature_id", "cx", "cy", "max_x", "max_y")
    # One label lies just below the map, outside its unit's box by a little less than the tolerance.
    own = centre.join(u.select("feature_id", "name"), "feature_id")
    away = F.col("feature_id") == 2
    return P.assign_labels(
        u,
        own.select(
            F.col("name").alias("label"), F.col("cx").alias("x"),
            F.when(away, F.lit(-0.05)).otherwise(F.col("cy")).alias("y")
        ),
        0.06
    )


@query(
    "a09_ring_measures",
    f"""WITH {EDGES} SELECT feature_id, round(sum(ax*by-bx*ay)/2, 9) AS area, round(sum((ax+bx)*(ax*by-bx*ay))/(3*sum(ax*by-bx*ay)), 9) AS cx, round(sum((ay+by)*(ax*by-bx*ay))/(3*sum(ax*by-bx*ay)), 9) AS cy, min(ax) AS min_x, max(ay) AS max_y, count(*) AS vertices FROM edges GROUP BY 1"""
)
def measures(spark, d):
    m = P.ring_measures(units(spark, d))
    return m.select(
        "feature_id", F.round("area", 9).alias("area"), F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"), "min_x", "max_y",
        "vertices"
    )


@query("w07_ring_edges", f"WITH {EDGES} SELECT feature_id, seq::INT AS seq, ax, ay, bx, by FROM edges")
def edges(spark, d):
    return P.ring_edges(units(spark, d)).select("feature_id", "seq", "ax", "ay", "bx", "by")


@query("f30_round_coords", f"""WITH {VERTS} SELECT feature_id, round(sum(x)+max(CASE WHEN s=0 THEN x END), 6) AS sx, round(sum(y)+max(CASE WHEN s=0 THEN y END), 6) AS sy, 9 AS n
  FROM (SELECT feature_id, s, round(x/3, 3) AS x, round(y/7, 3) AS y FROM verts) GROUP BY 1""")
def rounded(spark, d):
    from wardlight.functions.scalars import flatten_rings, round_coords

    thin = units(spark, d).select(
        "feature_id",
        F.transform(
            flatten_rings(F.col("polygons")),
            lambda r: F.transform(F.slice(r, 1, 8), lambda v: F.struct((v["x"] / 3).alias("x"), (v["y"] / 7).alias("y")))
        ).alias("rings")
    )
    out = thin.select("feature_id", F.explode(round_coords(F.col("rings"), 3)).alias("r"))
    total = lambda k: F.round(F.aggregate("r", F.lit(0.0), lambda s, v: s + v[k]), 6)
    return out.select("feature_id", total("x").alias("sx"), total("y").alias("sy"), F.size("r").alias("n"))


@query(
    "f33_flatten_rings",
    f"WITH {VERTS} SELECT feature_id, s::INT AS at, x, y FROM verts UNION ALL SELECT feature_id, 8, x, y FROM verts WHERE s = 0"
)
def flat(spark, d):
    from wardlight.functions.scalars import flatten_rings

    u = units(spark, d).withColumn("rings", flatten_rings(F.col("polygons")))
    each = u.select("feature_id", F.explode("rings").alias("ring")).select("feature_id", F.posexplode("ring").alias("at", "v"))
    return each.select("feature_id", "at", "v.x", "v.y")
