"""Queries of readers, extraction, layers and streams over documents that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import layers as L
from wardlight.operators import spatial as P
from wardlight.plans.base import EDGES, HITS, POINTS, SITES, points, query, sites, table, units
from wardlight.plans.roster_queries import health_input
from wardlight.plans.spatial_queries import _OVER, _overlaid
from wardlight.sources import features as X
from wardlight.streaming import streams as T
from wardlight.tables import scratch as _scratch


@query(
    "x01_read_features",
    f"WITH {EDGES} SELECT feature_id::VARCHAR AS feature_id, name, count(*)::BIGINT AS edges, round(sum(ax*by-bx*ay)/2, 6) AS area FROM edges GROUP BY 1, 2"
)
def read_features(spark, d):
    docs = X.feature_collections(units(spark, d).withColumn("g", F.col("district")), "g")
    rows, _ = X.features_of(docs, "units", "feature_id")
    e = P.ring_edges(rows.select("feature_id", F.col("props")["name"].alias("name"), "polygons"))
    return e.groupBy("feature_id", "name").agg(
        F.count("*").alias("edges"), F.round(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2, 6).alias("area")
    )


@query(
    "x01_read_large_features",
    """SELECT n_nationkey::VARCHAR AS feature_id, n_name AS name, n_regionkey::VARCHAR AS district FROM nation"""
)
def read_large(spark, d):
    """One collection of all units, read in splits that are cut where a feature begins."""
    path = _scratch(spark)
    docs = X.feature_collections(units(spark, d).withColumn("g", F.lit(1)), "g")
    docs.select("text").coalesce(1).write.text(path)
    found, _ = X.read_large_features(spark, path, "units", "feature_id")
    return found.select("feature_id", F.col("props")["name"].alias("name"), F.col("props")["district"].alias("district"))


@query("x10_write_features", "SELECT n_nationkey::VARCHAR AS feature_id FROM nation WHERE n_nationkey % 5 = 2")
def write_features(spark, d):
    """Keys that do not read back after writing: those of features whose rings were taken away."""
    shape = F.when(F.col("feature_id") % 5 == 2, F.slice("polygons", 1, 0)).otherwise(F.col("polygons"))
    return X.write_features(units(spark, d).withColumns({"g": F.col("district"), "polygons": shape}), _scratch(spark), "g")


@query(
    "x10_write_keyed_json",
    "SELECT c_custkey::VARCHAR AS key, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS seg, true AS ok FROM customer"
)
def write_keyed(spark, d):
    """What was written, read again, and beside it the keys that the writer's own check would refuse: none."""
    rows_, path = table(spark, d, "customer").selectExpr(
        "c_nationkey as g", "c_custkey as k", "c_name as name", "CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END as seg"
    ), _scratch(spark)
    bad = X.write_keyed_json(rows_, path, "g", "k")
    back = X.keyed_json(spark.read.text(path).withColumnRenamed("value", "text"), "name:string,seg:string")
    none = F.lit(None).cast("string")
    return back.withColumn("ok", F.lit(True)).unionByName(bad.select("key", none.alias("name"), none.alias("seg"), F.lit(False).alias("ok")))


@query(
    "x02_extract_links",
    "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))), ' ') AS links FROM pages"
)
def links(spark, d):
    return X.extract_links(table(spark, d, "pages")).withColumn("links", F.array_join("links", " "))


@query("x02_extract_table_rows", """SELECT c_nationkey::BIGINT AS page_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT AS row_no, c_name || '|' || c_mktsegment AS cells
  FROM customer""")
def rows(spark, d):
    tr = F.concat(F.lit("<tr class=x><td> <b>"), "c_name", F.lit("</b></td>\n<td>"), "c_mktsegment", F.lit(" </td></tr>"))
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("page_id")).agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", tr.alias("t")))).alias("ts")
    )
    html = F.concat(
        F.lit("<p>x</p><table><tr><td>no</td></tr></table><TABLE border=0><tr><th>Name</th><th>Seg</th></tr>"),
        F.array_join(F.transform("ts", lambda t: t["t"]), ""), F.lit("</TABLE>")
    )
    return X.extract_table_rows(g.select("page_id", html.alias("html")), "Name").withColumn("cells", F.array_join("cells", "|"))


@query("x03_split_terminated", """SELECT c_nationkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'Hall' WHEN c_custkey % 3 = 1 THEN 'Hall East' END AS label, CASE
  WHEN c_custkey % 3 = 2 THEN 'Room ' ELSE '' END || c_custkey::VARCHAR || ' Elm St' AS rest FROM customer""")
def notices(spark, d):
    row = F.expr(
        "concat(CASE WHEN c_custkey % 3 = 0 THEN 'Hall ' WHEN c_custkey % 3 = 1 THEN 'HALL EAST ' ELSE 'Room ' END, c_custkey, ' Elm St; 6 am')"
    )
    docs = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(
        F.concat(F.lit("x BEGIN "), F.array_join(F.collect_list(row), "\n"), F.lit(" END y")).alias("text")
    )
    labels = table(spark, d, "region").where("r_regionkey < 2").selectExpr("CASE r_regionkey WHEN 0 THEN 'Hall' ELSE 'Hall East' END as label")
    return X.split_terminated(docs, labels, "BEGIN", "END", r"; 6 am\s*").select("doc_id", "label", "rest")


@query("x04_expand_grouped_labels", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'N. Field ' || k::VARCHAR WHEN c_custkey % 3 = 1 THEN CASE k
  WHEN 2 THEN 'East Fork 2' ELSE 'Grand 3' END ELSE 'Plain' END AS label FROM customer, (VALUES (2), (3), (5)) t(k) WHERE CASE
  WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN k <= 3 ELSE k = 2 END""")
def expanded(spark, d):
    rows_ = table(spark, d, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 3 = 0 THEN 'N. Field 2,3 & 5' WHEN c_custkey % 3 = 1 THEN 'East Fork 2 & Grand 3' ELSE ' Plain ' END as t"
    )
    return X.expand_grouped_labels(rows_, "t").select("c_custkey", "label")


@query("x05_walk_records", """SELECT c_name AS name, '$/' || c_nationkey::VARCHAR || '/members/' || (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::VARCHAR AS path
  FROM customer
UNION ALL SELECT 'body' || n_nationkey::VARCHAR, '$/' || n_nationkey::VARCHAR FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def walked(spark, d):
    m = table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))),
            lambda x: F.struct(x["c_name"].alias("name"), x["c_custkey"].alias("no"))
        ).alias("members")
    )
    docs = X.keyed_documents(
        m.select(F.lit("all").alias("g"), F.col("c_nationkey").alias("k"), F.concat(F.lit("body"), "c_nationkey").alias("name"), "members"),
        "g", "k"
    )
    return X.walk_records(docs).select(F.variant_get("record", "$.name", "string").alias("name"), "path")


@query("x06_read_delimited", "SELECT p_partkey::VARCHAR AS k, p_brand AS brand FROM part WHERE p_size % 2 = 0")
def delimited(spark, d):
    path = _scratch(spark)
    table(spark, d, "part").selectExpr("p_partkey as k", "p_brand as brand", "p_size as size").write.csv(path, sep="|", header=True)
    return X.read_delimited(spark, path, "k", F.col("size").cast("int") % 2 == 0).select("k", "brand")


@query("x07_read_placemarks", """SELECT n_regionkey::VARCHAR AS folder, n_name AS name, n_nationkey::VARCHAR AS code, k::INT AS ring, 3 * k + n_nationkey AS x, round(CASE k
  WHEN 0 THEN 8 + n_nationkey * 4 / 2 ELSE 0.5 END, 9)::DOUBLE AS area FROM nation, range(2) t(k)""")
def placemarks(spark, d):
    path = _scratch(spark)
    pm = F.expr(
        "concat('<Placemark><name>', n_name, '</name><ExtendedData><Data name=\"code\"><value>', n_nationkey, '</value></Data></ExtendedData><Polygon><outerBoundaryIs><LinearRing><coordinates>', n_nationkey, ',0 ', n_nationkey + 4, ',0 ', n_nationkey + 4, ',', n_nationkey + 4, ' ', n_nationkey, ',0</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>', n_nationkey + 3, ',1 ', n_nationkey + 4, ',1,0 ', n_nationkey + 4, ',2 ', n_nationkey + 3, ',1</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>')"
    )
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(pm), "").alias("b"))
    g.select(
        F.concat(F.lit("<kml><Document><Folder><name>"), "n_regionkey", F.lit("</name>"), "b", F.lit("</Folder></Document></kml>")).alias("value")
    ).write.text(path)
    read = X.read_placemarks(spark, path).select(
        "folder", "name", F.col("props")["code"].alias("code"), F.posexplode(F.flatten("polygons")).alias("ring", "r")
    )
    e = F.aggregate(P.ring_pairs(F.col("r")), F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2)
    return read.select("folder", "name", "code", "ring", F.col("r")[0]["x"].cast("long").alias("x"), F.round(e, 9).alias("area"))


@query(
    "x08_read_keyed_json",
    "SELECT c_custkey::VARCHAR AS key, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS seg FROM customer"
)
def keyed(spark, d):
    docs = X.keyed_documents(
        table(spark, d, "customer").selectExpr(
            "c_nationkey as g", "c_custkey as k", "c_name as name", "CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END as seg"
        ),
        "g", "k"
    )
    return X.keyed_json(docs, "name:string,seg:string")


@query(
    "x10_keyed_documents",
    """SELECT c_nationkey AS g, '{' || string_agg('\"' || c_custkey::VARCHAR || '\":{\"seg\":\"' || c_mktsegment || '\"}', ',' ORDER BY c_custkey::VARCHAR) || '}' AS text FROM customer GROUP BY 1"""
)
def documents(spark, d):
    return X.keyed_documents(table(spark, d, "customer").selectExpr("c_nationkey as g", "c_custkey as k", "c_mktsegment as seg"), "g", "k")


@query("x09_normalise_flat_rings", f"""WITH {EDGES},
a AS (SELECT feature_id, abs(sum(ax*by-bx*ay)/2) AS area FROM edges GROUP BY 1)
SELECT feature_id, p::INT AS polygon_idx, r::INT AS ring_idx, round(area * f, 9) AS area FROM a, (VALUES (0, 0, 1.0), (0, 1, 0.25), (1, 0, 0.04)) t(p, r, f)""")
def flat_rings(spark, d):
    u = units(spark, d)
    m = P.ring_measures(u).select("feature_id", "cx", "cy")
    part = lambda k, dx=0.0: F.transform(
        F.col("polygons")[0][0],
        lambda v: F.struct((v["x"] * k + F.col("cx") * (1 - k) + dx).alias("x"), (v["y"] * k + F.col("cy") * (1 - k)).alias("y"))
    )
    rings = u.join(m, "feature_id").select(
        "feature_id", F.posexplode(F.array(part(0.5), part(1.0), part(0.001, 9.0), part(0.2))).alias("ring_no", "ring")
    )
    found = P.ring_measures(X.normalise_flat_rings(rings, 0.001)[0])
    return found.select("feature_id", "polygon_idx", "ring_idx", F.round(F.abs("area"), 9).alias("area"))


# Layers


def _roster(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("district")).agg(F.min("c_name").alias("holder"))


_STATUS = """s AS (SELECT p.pid, CASE WHEN h.pid IS NULL THEN 'NONE' ELSE 'OK' END AS status, feature_id::VARCHAR AS district, feature_id, name FROM pts p LEFT
  JOIN hits h ON h.pid = p.pid)"""


@query("l01_polygon_layer", f"WITH {HITS}, {_STATUS} SELECT pid, status, district, name AS holder FROM s")
def l01(spark, d):
    return L.polygon_layer("unit", units(spark, d)).query(points(spark, d))


@query("l02_school_zone_layer", f"""WITH {HITS}, {_STATUS} SELECT pid, status, district, CASE WHEN district IS NOT NULL THEN 'Zone' || CASE
  WHEN feature_id % 2 = 0 THEN ' HS (9–12)' ELSE ' Elementary (K, 2)' END END AS holder FROM s""")
def l02(spark, d):
    f = units(spark, d).withColumns(
        {
            "school": F.when(F.col("feature_id") % 2 == 0, "ZONE HS").otherwise("ZONE ELEMENTARY"),
            "grades": F.when(F.col("feature_id") % 2 == 0, "9, 10, 11, 12").otherwise("K, 2")
        }
    )
    return L.school_zone_layer("school", f).query(points(spark, d))


@query(
    "l03_network_layer",
    f"WITH {HITS}, {_STATUS} SELECT pid, status, district, CASE WHEN district IS NOT NULL THEN 'chief of ' || name END AS holder FROM s"
)
def l03(spark, d):
    return L.network_layer("network", units(spark, d).withColumn("chief", F.concat(F.lit("chief of "), "name")), "chief").query(points(spark, d))


_BUILD = "r AS (SELECT c_nationkey, min(c_name) AS holder FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)"


@query("l04_chamber_layer", f"WITH {HITS}, {_STATUS}, {_BUILD} SELECT pid, status, district, holder FROM s LEFT JOIN r ON c_nationkey = feature_id")
def l04(spark, d):
    return L.chamber_layer("chamber", units(spark, d), _roster(spark, d)).query(points(spark, d))


@query("l05_nearest_layer", f"""WITH {POINTS}, {SITES} SELECT pid, 'OK' AS status, string_agg(sid::VARCHAR, ',' ORDER BY r) AS district, NULL::VARCHAR AS holder
  FROM (SELECT pid, sid, row_number() OVER (PARTITION BY pid ORDER BY sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy)), sid) AS r FROM pts, sites) WHERE r <= 3 GROUP BY pid""")
def l05(spark, d):
    return L.nearest_layer("sites", sites(spark, d)).query(points(spark, d))


@query("l06_dispatched_layer", f"""WITH {_OVER},
w AS (SELECT pid, arg_min(feature_id, (feature_id % 4) * 1000 + feature_id) AS f FROM oh GROUP BY pid),
c AS (SELECT DISTINCT pid FROM oh WHERE feature_id < 10)
SELECT c.pid, 'OK' AS status, f::VARCHAR AS district, 'src' || (f % 4)::VARCHAR AS holder FROM c JOIN w USING (pid)""")
def l06(spark, d):
    k = F.col("feature_id")
    entries = _overlaid(spark, d).withColumns(
        {"entry_order": k % 4, "source": F.concat(F.lit("src"), (k % 4).cast("string")), "available": F.lit(True)}
    )
    return L.dispatched_layer("wards", entries, units(spark, d).where("feature_id < 10")).query(points(spark, d))


@query("l07_identity_layer", f"""WITH {HITS}, {_STATUS},
o AS (SELECT c_nationkey, string_agg(c_name, ', ' ORDER BY c_name) AS holder FROM customer GROUP BY 1)
SELECT pid, status, district, holder FROM s LEFT JOIN o ON c_nationkey = feature_id""")
def l07(spark, d):
    officers = table(spark, d, "customer").selectExpr("c_nationkey as district", "c_name as name")
    return L.identity_layer("unit", units(spark, d), officers).query(points(spark, d))


@query("l08_sub_layer", f"WITH {HITS} SELECT pid, 'OK' AS status, feature_id::VARCHAR AS district, name AS holder FROM hits WHERE district = 1")
def l08(spark, d):
    parent = L.polygon_layer("district", units(spark, d).where("district = 1"))
    return L.sub_layer(L.polygon_layer("unit", units(spark, d)), parent).query(points(spark, d))


@query("l09_civic_profile", f"""WITH {HITS}, {_STATUS}, {_BUILD} SELECT pid, 'unit' AS layer, status, district, name AS holder FROM s
UNION ALL SELECT pid, 'chamber', status, district, holder FROM s LEFT JOIN r ON c_nationkey = feature_id
UNION ALL SELECT pid, k, 'ERROR', NULL, NULL FROM pts, (VALUES ('broken'), ('failing')) t(k)""")
def l09(spark, d):
    # One layer cannot be planned, and one fails while it runs.
    def broken(p):
        raise ValueError("the source is away")

    def failing(p):
        told = F.when(F.col("pid") % 2 == 0, F.raise_error(F.lit("a row cannot be read"))).otherwise(F.lit(None).cast("string"))
        return p.select("pid", F.lit("OK").alias("status"), told.alias("district"), F.lit(None).cast("string").alias("holder"))

    u = units(spark, d)
    layers = [L.polygon_layer("unit", u), L.chamber_layer("chamber", u, _roster(spark, d)), L.LayerSpec("broken", broken), L.LayerSpec("failing", failing)]
    found = L.civic_profile(points(spark, d), layers)
    return found.withColumn("holder", F.when(F.col("status") != "ERROR", F.col("holder")))


# Streams: a table written as files, read as a stream to its end


def _stream(spark, df):
    path = _scratch(spark)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("t01_classify_stream", f"WITH {HITS} SELECT feature_id, count(*) AS n FROM hits GROUP BY 1")
def t01(spark, d):
    out = _scratch(spark)
    found = T.classify_stream(_stream(spark, points(spark, d)), units(spark, d).select("feature_id", "polygons"))
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", _scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("feature_id").agg(F.count("*").alias("n"))


def _batches(spark, *parts):
    """Tables as a stream that brings them one after the other."""
    path = _scratch(spark)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "t02_latest_only",
    """WITH e AS (SELECT user_id AS session, event_id AS seq, CASE event_id % 3 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS b FROM events),
m AS (SELECT session, b, max(seq) AS seq FROM e GROUP BY 1, 2)
SELECT session, seq FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.session = m.session AND o.b < m.b AND o.seq > m.seq)""",
)
def t02(spark, d):
    # Three batches; in the later ones many sessions' newest row is older than one before it, and must not come.
    src = table(spark, d, "events").selectExpr("user_id as session", "event_id as seq")
    out = _scratch(spark)
    late = _batches(spark, *(src.where(f"seq % 3 = {k}") for k in (1, 0, 2)))
    T.latest_only(late).writeStream.format("parquet").option("path", out).option("checkpointLocation", _scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(
    "t03_refresh",
    """SELECT 'published' AS outcome, 0 AS epoch, count(*) AS n FROM customer WHERE c_nationkey < 15
UNION ALL SELECT 'held', 1, 1 UNION ALL SELECT 'published', 2, count(*) FROM customer WHERE c_nationkey BETWEEN 15 AND 19"""
)
def t03(spark, d):
    # The second batch has no member of the nations that the gate asks for and is held; all three are replayed from a lost checkpoint.
    from wardlight.operators.gates import floors

    src = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    good, held, commits = _scratch(spark), _scratch(spark), _scratch(spark)
    stream = _batches(spark, src.where("c_nationkey < 15"), src.where("c_nationkey > 19"), src.where("c_nationkey between 15 and 19"))
    gate = lambda b: floors(b, {"members": (F.col("c_nationkey") < 20, 1, None)})
    add = lambda path: lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)  # noqa: E731  repeating shows
    for _ in range(2):
        T.refresh(stream, gate, add(good), add(held), _scratch(spark), commits=commits).awaitTermination()
    told = lambda path, what: spark.read.parquet(path).select(F.lit(what).alias("outcome"), "epoch")
    return told(good, "published").unionByName(told(held, "held")).groupBy("outcome", "epoch").agg(F.count("*").alias("n"))


@query(
    "t04_health_verdicts",
    """WITH e AS (SELECT 'job' || (user_id % 60)::VARCHAR AS job, event_id % 9 <> 0 AS done, CASE WHEN event_id % 5 = 0 THEN 'failure' WHEN event_id % 11 = 0 THEN 'cancelled' ELSE 'success' END AS c, epoch_us(ts) // 1000 AS t, event_id FROM events),
j AS (SELECT job, min(event_id) AS k, CASE WHEN min(event_id) % 3 = 0 THEN 7 WHEN min(event_id) % 3 = 1 THEN 1 ELSE 31 END AS cad FROM e GROUP BY 1),
r AS (SELECT e.*, k, cad, arg_max(CASE WHEN done THEN c END, CASE WHEN done THEN t END) OVER w AS latest, max(CASE WHEN done THEN t END) OVER w AS la, max(CASE WHEN done AND c = 'success' THEN t END) OVER w AS ok,
  lead(t) OVER (PARTITION BY job ORDER BY t) AS nt FROM e JOIN j USING (job) WINDOW w AS (PARTITION BY job ORDER BY t)),
v AS (SELECT job, t, nt, CASE WHEN k % 13 = 0 THEN 'DISABLED' WHEN la IS NULL THEN 'SILENT' WHEN latest = 'failure' THEN CASE WHEN k % 2 = 0 THEN 'UNPROVEN' ELSE 'FAILING' END
  WHEN ok IS NULL OR t - ok >= (cad * 2 + 3) * 86400000::BIGINT THEN 'STALE' ELSE 'OK' END AS verdict, ok + (cad * 2 + 3) * 86400000::BIGINT AS due FROM r),
x AS (SELECT job, t, verdict FROM v UNION ALL SELECT job, due, 'STALE' FROM v WHERE verdict = 'OK' AND due <= coalesce(nt, (SELECT max(t) FROM e) - 3600000)),
y AS (SELECT *, lag(verdict) OVER (PARTITION BY job ORDER BY t) AS was FROM x)
SELECT job, verdict, t AS at FROM y WHERE was IS DISTINCT FROM verdict""",
)
def health_verdicts(spark, d):
    # Runs in four batches by time; STALE comes from timers. Of a job's runs of one millisecond the first in the table counts, as in the SQL.
    runs, jobs = health_input(spark, d)
    runs = runs.where("created_at is not null")
    cuts = [F.date_trunc("day", "created_at") < F.lit(c) for c in _quarters(spark, d)]
    parts = [runs.where(cuts[0]), runs.where(~cuts[0] & cuts[1]), runs.where(~cuts[1] & cuts[2]), runs.where(~cuts[2])]
    out = _scratch(spark)
    found = T.health_verdicts(_batches(spark, *parts), jobs, "1 hour", "event_id")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", _scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("job", "verdict", F.unix_millis("at").alias("at"))


def _quarters(spark, d):
    """Three times that part the events' span in four, from one row of aggregates."""
    r = table(spark, d, "events").agg(F.min(F.col("ts").cast("timestamp")).alias("a"), F.max(F.col("ts").cast("timestamp")).alias("b")).first()
    return [r.a + (r.b - r.a) * k / 4 for k in (1, 2, 3)]


@query(
    "t04_health_stream",
    """SELECT 'job' || (user_id % 60)::VARCHAR AS job, count(*) AS runs, count(*) FILTER (event_id % 5 = 0) AS failures FROM events WHERE event_id % 9 <> 0 GROUP BY 1"""
)
def t04(spark, d):
    runs, _ = health_input(spark, d)
    out = _scratch(spark)
    T.health_stream(_stream(spark, runs.drop("event_id"))).writeStream.foreachBatch(
        lambda b, e: b.write.mode("overwrite").parquet(f"{out}/{e:09d}")
    ).outputMode("complete").option("checkpointLocation", _scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    fs = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(s.getPath().toString() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(out)))
    return spark.read.parquet(last).groupBy("job").agg(F.sum("runs").alias("runs"), F.sum("failures").alias("failures"))
