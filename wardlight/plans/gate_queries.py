"""Queries of the quality gates over snapshots, links and registries derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import gates as Q
from wardlight.plans.base import query, table
from wardlight.plans.roster_queries import _CITE, _STATE, _p, evidence, people, sql

_CUT = "CASE WHEN {m} THEN NULL ELSE {c} END"


def snapshots(spark, d):
    old = table(spark, d, "orders").selectExpr(
        "concat('f', o_orderkey % 6) as file", "concat('g', o_orderkey % 30) as grp", "o_orderkey as k", "o_orderstatus as status",
        "o_orderpriority as priority"
    )
    new = old.where("not (file = 'f4' and k % 3 <> 0)").withColumns(
        {
            "status": F.expr("CASE WHEN grp = 'g6' THEN null ELSE status END"),
            "priority": F.expr("CASE WHEN file = 'f2' OR (file = 'f0' AND k % 5 < 3) THEN ' ' ELSE priority END")
        }
    )
    return old, new


@query("q01_retention", """WITH o AS (SELECT 'f' || (o_orderkey % 6)::VARCHAR AS file, 'g' || (o_orderkey % 30)::VARCHAR AS grp, o_orderkey AS k FROM orders),
n AS (SELECT *, grp <> 'g6' AS st, NOT (file = 'f2' OR (file = 'f0' AND k % 5 < 3)) AS pr FROM o WHERE NOT (file = 'f4' AND k % 3 <> 0)),
f AS (SELECT o.file, count(*) AS was, (SELECT count(*) FROM n WHERE n.file = o.file) AS recs, (SELECT count(*) FILTER (st) FROM n WHERE n.file = o.file) AS st, (SELECT count(*) FILTER (pr) FROM n WHERE n.file = o.file) AS pr FROM o GROUP BY 1),
x AS (SELECT file, NULL AS grp, 'status' AS field, was, st AS now FROM f UNION ALL SELECT file, NULL, 'priority', was, pr FROM f),
gg AS (SELECT o.file, o.grp, count(*) AS was, (SELECT count(*) FROM n WHERE n.file = o.file AND n.grp = o.grp) AS recs, (SELECT count(*) FILTER (st) FROM n WHERE n.file = o.file AND n.grp = o.grp) AS st, (SELECT count(*) FILTER (pr) FROM n WHERE n.file = o.file AND n.grp = o.grp) AS pr FROM o GROUP BY 1, 2),
r AS (SELECT file, grp, field, CASE WHEN now = 0 AND was >= 2 THEN 'vanished' WHEN was - now >= 3 AND now <= was * 0.5 THEN 'halved' END AS rule, was, now FROM x UNION ALL SELECT file, NULL, NULL, CASE WHEN was >= 3 AND recs < was * 0.5 THEN 'records' END, was, recs FROM f
 UNION ALL SELECT file, grp, 'status', CASE WHEN st = 0 AND was >= 3 AND recs > 0 THEN 'vanished' END, was, st FROM gg UNION ALL SELECT file, grp, 'priority', CASE WHEN pr = 0 AND was >= 3 AND recs > 0 THEN 'vanished' END, was, pr FROM gg)
SELECT *, CASE WHEN file = 'f2' AND field = 'priority' THEN 'OK-accepted' ELSE 'FAIL' END AS severity FROM r WHERE rule IS NOT NULL""")
def retention(spark, d):
    old, new = snapshots(spark, d)
    ok = old.where("file = 'f2'").selectExpr("file", "cast(null as string) as grp", "'priority' as field").distinct()
    return Q.retention(old, new, ["status", "priority"], ok)


@query("q02_carry_forward", sql("SELECT id, name, id % 4 = 0 AS carried FROM p"))
def carried(spark, d):
    return Q.carry_forward(_p(spark, d, "id", "name").where("id % 4 <> 0"), _p(spark, d, "id", "name"), "id")[0]


@query("q02_carry_summary", sql("SELECT count(*) AS n, count(*) FILTER (id % 4 = 0) AS carried, 'OK' AS severity FROM p"))
def carried_summary(spark, d):
    return Q.carry_forward(_p(spark, d, "id", "name").where("id % 4 <> 0"), _p(spark, d, "id", "name"), "id")[1]


@query("q03_preserve", sql("""SELECT DISTINCT body AS source, 'also supplied fresh' AS problem FROM p WHERE body = 4
UNION ALL SELECT DISTINCT body, 'nothing to carry' FROM p WHERE body = 8
UNION ALL SELECT DISTINCT body, 'expected place missing' FROM p WHERE body IN (4, 8, 12) AND (body = 8 OR id % 2 = 1)"""))
def preserved(spark, d):
    rows = _p(spark, d, "body as source", "id as place")
    failed = rows.where("source in (4, 8, 12)").select("source").distinct()
    return Q.preserve(rows.where("source not in (8, 12)"), rows.where("source <> 8 and place % 2 = 0"), failed, rows)[1]


@query("q04_floors", sql("""SELECT 'members' AS rule, count(*) AS n, 'OK' AS severity FROM p
UNION ALL SELECT 'building', count(*) FILTER (seg = 'BUILDING'), CASE WHEN count(*) FILTER (seg = 'BUILDING') > 10 THEN 'FAIL' ELSE 'OK' END FROM p
UNION ALL SELECT 'rich', count(*) FILTER (bal > 0), CASE WHEN count(*) FILTER (bal > 0) < 1000000 THEN 'FAIL' ELSE 'OK' END FROM p"""))
def floors(spark, d):
    return Q.floors(
        _p(spark, d, "id", "seg", "bal"),
        {"members": (F.lit(True), 1, None), "building": (F.col("seg") == "BUILDING", None, 10), "rich": (F.col("bal") > 0, 1_000_000, None)}
    )


@query(
    "q04_seats_per_district",
    sql("SELECT CASE WHEN id % 30 = 0 THEN -id ELSE id // 2 END AS district, count(*) AS n FROM p GROUP BY 1 HAVING count(*) <> 2")
)
def seats(spark, d):
    return Q.seats_per_district(_p(spark, d, "CASE WHEN id % 30 = 0 THEN -id ELSE id div 2 END as district", "id"), 2)


@query(
    "q05_drift",
    sql("SELECT id, name, 'fresh' AS side FROM p WHERE id % 50 = 0 UNION ALL SELECT id, upper(name), 'shipped' FROM p WHERE id % 50 = 0")
)
def drift(spark, d):
    return Q.drift(_p(spark, d, "id", "name"), _p(spark, d, "id", "CASE WHEN id % 50 = 0 THEN upper(name) ELSE name END as name"))


@query("q06_watch", """SELECT 'k' || page_id::VARCHAR AS url, CASE WHEN page_id % 7 = 0 THEN 'gone' WHEN page_id % 5 = 0 THEN 'link gone'
  WHEN page_id % 3 = 0 THEN 'changed' ELSE 'same' END AS state FROM pages""")
def watched(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", "concat('k', page_id) as url", "html")
    rec = p.selectExpr(
        "url", "CASE WHEN page_id % 3 = 0 THEN 'old' ELSE sha2(html, 256) END as sha",
        "CASE WHEN page_id % 5 = 0 THEN '/nowhere' END as link"
    )
    return Q.watch(p.where("page_id % 7 <> 0").select("url", "html", F.array(F.lit("/a")).alias("links")), rec)


@query("q07_monotone_as_of", """WITH a AS (SELECT o_custkey, max(o_orderdate) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
b AS (SELECT o_custkey, max(o_orderdate) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT o_custkey, CASE WHEN n < s THEN 'FAIL' ELSE 'OK' END AS severity FROM a JOIN b USING (o_custkey)""")
def monotone(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey", "o_orderdate as as_of", "o_orderkey")
    return Q.monotone_as_of(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey").select("o_custkey", "severity")


@query("q08_validate_registry", """WITH g AS (SELECT 'gap' || (p_partkey // 2 * 2 + CASE WHEN p_partkey % 10 = 1 THEN 0 ELSE p_partkey % 2 END)::VARCHAR AS id, p_partkey AS k FROM part)
SELECT id, 'kind' AS problem FROM g WHERE k % 3 = 0
UNION ALL SELECT id, 'date' FROM g WHERE k % 4 = 0
UNION ALL SELECT id, 'address' FROM g WHERE k % 5 = 0
UNION ALL SELECT id, 'required' FROM g WHERE k % 11 = 0 AND k % 4 <> 0 AND k % 5 <> 0
UNION ALL SELECT id, 'repeated id' FROM g WHERE id IN (SELECT id FROM g GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT id, 'layer' FROM g WHERE k % 13 = 0
UNION ALL SELECT id, 'county' FROM g WHERE k % 17 = 0""")
def registry(spark, d):
    g = table(spark, d, "part").selectExpr(
        "concat('gap', p_partkey div 2 * 2 + CASE WHEN p_partkey % 10 = 1 THEN 0 ELSE p_partkey % 2 END) as id", "CASE WHEN p_partkey % 3 = 0 THEN 'odd' ELSE 'blocked' END as kind", "CASE WHEN p_partkey % 13 = 0 THEN 'no-layer' ELSE 'ward' END as layer",
        "array(CASE WHEN p_partkey % 17 = 0 THEN 'Nowhere' ELSE 'A' END) as counties",
        "CASE WHEN p_partkey % 4 = 0 AND p_partkey % 5 = 0 THEN 'see www.x.org of 2024-01-02' WHEN p_partkey % 4 = 0 THEN 'since 2024-01-02' WHEN p_partkey % 5 = 0 THEN 'see www.x.org' WHEN p_partkey % 11 = 0 THEN ' ' ELSE 'No map is published.' END as summary",
    )
    r = table(spark, d, "region").where("r_regionkey = 0")
    return Q.validate_registry(g, r.selectExpr("'ward' as layer"), r.selectExpr("'A' as county"))


@query("q09_freshness", """SELECT p_partkey AS series, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'reachable again' ELSE 'blocked as expected' END
  WHEN p_partkey % 3 <> 0 THEN 'unreachable' WHEN p_partkey % 2 = 0 THEN 'renamed' WHEN p_partkey % 7 = 0 THEN 'newer edition' ELSE 'current' END AS finding,
  CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'WARN' ELSE 'OK' END WHEN p_partkey % 3 <> 0 THEN 'FAIL'
  WHEN p_partkey % 2 = 0 OR p_partkey % 7 = 0 THEN 'WARN' ELSE 'OK' END AS severity FROM part""")
def fresh(spark, d):
    p = table(spark, d, "part")
    s = p.selectExpr("p_partkey as series", "concat('u', p_partkey) as url", "p_partkey % 5 = 0 as expect_blocked")
    probes = p.selectExpr(
        "concat('u', p_partkey) as url", "CASE WHEN p_partkey % 3 = 0 THEN 'ok' ELSE 'gone' END as state",
        "CASE WHEN p_partkey % 2 = 0 THEN 'other' ELSE concat('u', p_partkey) END as final_url"
    )
    return Q.freshness(s, probes, p.selectExpr("p_partkey as series", "CASE WHEN p_partkey % 7 = 0 THEN 'WARN' ELSE 'OK' END as severity"))


@query("q10_dataset_ranges", sql("""SELECT 'body' || body::VARCHAR AS dataset, CASE WHEN body % 6 <> 0 THEN count(*) END AS n, CASE WHEN body % 6 = 0 THEN 'missing' WHEN count(*) < 5 OR
  count(*) > 60 THEN 'range' ELSE 'ok' END AS finding FROM p GROUP BY body"""))
def ranges(spark, d):
    c = people(spark, d).groupBy(F.concat(F.lit("body"), "body").alias("dataset"), "body").agg(F.count("*").alias("n"))
    return Q.dataset_ranges(c.where("body % 6 <> 0").select("dataset", "n"), c.selectExpr("dataset", "5 as lo", "60 as hi"))


@query("q11_exactly_one_list", """SELECT 'f' || p_partkey::VARCHAR AS file, CASE WHEN p_partkey % 5 = 0 THEN 'unlisted' ELSE 'several' END AS problem FROM part
  WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0
UNION ALL SELECT 'x' || p_partkey::VARCHAR, 'unknown' FROM part WHERE p_partkey % 90 = 0""")
def one_list(spark, d):
    p = table(spark, d, "part")
    lists = p.where("p_partkey % 5 <> 0").selectExpr("concat('f', p_partkey) as file", "'weekly' as list").unionByName(
        p.where("p_partkey % 7 = 0 and p_partkey % 5 <> 0").selectExpr("concat('f', p_partkey) as file", "'yearly' as list")
    ).unionByName(p.where("p_partkey % 90 = 0").selectExpr("concat('x', p_partkey) as file", "'weekly' as list"))
    return Q.exactly_one_list(p.selectExpr("concat('f', p_partkey) as file"), lists)


@query("q12_two_way_coverage", sql("""SELECT DISTINCT body::VARCHAR AS county, 'not in the ring' AS problem FROM p WHERE body % 5 = 0
UNION ALL SELECT 'only' || body::VARCHAR, 'does not dispatch' FROM (SELECT DISTINCT body FROM p) WHERE body % 4 = 0
UNION ALL SELECT DISTINCT body::VARCHAR, 'repeated key' FROM p GROUP BY body, seg HAVING count(*) > 1
UNION ALL SELECT DISTINCT body::VARCHAR, 'foreign loader' FROM p WHERE id % 100 = 0"""))
def two_way(spark, d):
    disp = _p(
        spark, d, "cast(body as string) as county", "seg as concept",
        "CASE WHEN id % 100 = 0 THEN 'other' ELSE concat(seg, '_load') END as loader"
    )
    bodies = people(spark, d).select("body").distinct()
    ring = bodies.where("body % 5 <> 0").selectExpr("cast(body as string) as county").unionByName(
        bodies.where("body % 4 = 0").selectExpr("concat('only', body) as county")
    )
    return Q.two_way_coverage(disp, ring)


@query("q13_served_status", sql(""",
r AS (SELECT DISTINCT id % 40 AS county FROM p)
SELECT county, CASE WHEN county % 3 = 0 THEN 'dispatch' WHEN county % 5 = 0 THEN 'card only'
  WHEN county % 7 = 0 THEN 'frontier' ELSE 'unresearched' END AS status, CASE WHEN county % 3 = 0 THEN (SELECT count(DISTINCT seg) FROM p
  WHERE id % 40 = county) ELSE 0 END::BIGINT AS layers, CASE WHEN county % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS gaps, NOT (county % 3 = 0 OR county % 5 = 0 OR county % 7 = 0) AS unexplained FROM r"""))
def served(spark, d):
    rows = _p(spark, d, "id % 40 as county", "seg as layer")
    ring = rows.select("county").distinct()
    return Q.served_status(
        ring, rows.where("county % 3 = 0"), ring.where("county % 5 = 0"),
        ring.where("county % 7 = 0").select(F.array("county").alias("counties"))
    ).drop("outside")


@query("q13_judicial_status", sql(""",
r AS (SELECT DISTINCT id % 40 AS county FROM p),
s AS (SELECT county, CASE WHEN county % 3 = 0 THEN 'dispatch' WHEN county % 5 = 0 THEN 'card only' WHEN county % 4 <> 1 THEN 'judicial'
  WHEN county % 7 = 0 THEN 'frontier' ELSE 'unresearched' END AS status FROM r)
SELECT county, status, status IN ('dispatch', 'card only') AND county % 4 = 1 AS outside FROM s"""))
def judicial(spark, d):
    # The ring holds three counties in four; one that is served without being in it is told.
    rows = _p(spark, d, "id % 40 as county", "seg as layer")
    all_ = rows.select("county").distinct()
    gaps = all_.where("county % 7 = 0").select(F.array("county").alias("counties"))
    found = Q.served_status(all_, rows.where("county % 3 = 0"), all_.where("county % 5 = 0"), gaps, all_.where("county % 4 <> 1"))
    return found.select("county", "status", "outside")


@query("q14_fleet_diff", sql("""SELECT body AS site, id, CASE WHEN id % 9 = 0 THEN 'unlisted' WHEN id % 7 = 0 THEN 'phantom' ELSE 'content' END AS drift FROM p
  WHERE (id % 9 = 0) <> (id % 7 = 0) OR (id % 4 = 0 AND id % 9 <> 0 AND id % 7 <> 0)"""))
def fleet(spark, d):
    return Q.fleet_diff(
        _p(spark, d, "body as site", "id", "name as content").where("id % 7 <> 0"),
        _p(spark, d, "body as site", "id", "CASE WHEN id % 4 = 0 THEN upper(name) ELSE name END as content").where("id % 9 <> 0")
    )


@query(
    "q15_provenance",
    sql(
        """SELECT id::VARCHAR || name AS key, CASE WHEN id % 4 = 0 OR id % 4 = 3 THEN 'source' ELSE 'name' END AS problem FROM p WHERE id % 4 IN (0, 3) OR id % 10 = 1"""
    )
)
def sources(spark, d):
    return Q.provenance(
        _p(
            spark, d, "concat(id, name) as key", "CASE WHEN id % 10 = 1 THEN 'other' ELSE upper(name) END as name",
            "CASE WHEN id % 4 IN (0, 1) THEN 'u' END as source_url", "CASE WHEN id % 4 IN (0, 2) THEN 'd' END as source_doc"
        )
    )


@query("q16_closed_set", sql("SELECT DISTINCT name FROM p WHERE name NOT IN (SELECT name FROM p WHERE id % 2 = 0)"))
def closed(spark, d):
    return Q.closed_set(people(spark, d).where("id % 2 = 0"), people(spark, d).select("name").distinct(), "name")


_LINKS = f"""WITH c AS ({_CITE}),
e AS (SELECT url, bool_or(authored) AS authored, any_value((SELECT {_STATE}
  FROM (SELECT substr(url, 2)::INT AS k))) AS state, substr(url, 2)::INT % 3 = 0 AS exp FROM c GROUP BY url),
s AS (SELECT url, authored, CASE WHEN state = 'ok' THEN CASE WHEN exp THEN 'WARN' ELSE 'OK' END WHEN state = 'blocked' THEN CASE
  WHEN exp OR NOT authored THEN 'OK' ELSE 'WARN' END WHEN state IN ('gone', 'hollow') THEN 'FAIL' WHEN state IN ('rate-limited', 'root-redirect') THEN 'WARN'
  WHEN exp THEN 'OK' ELSE 'WARN' END AS raw FROM e),
f AS (SELECT url, CASE WHEN raw = 'FAIL' AND NOT authored THEN 'WARN' ELSE raw END AS severity FROM s)"""


def link_rows(spark, d):
    ev = evidence(spark, d)
    return Q.link_findings(ev, ev.where("cast(substr(url, 2) as int) % 3 = 0").selectExpr("url as host"))


@query("q17_link_findings", _LINKS + " SELECT url, severity FROM f")
def link_severity(spark, d):
    return link_rows(spark, d)


@query("a07_verdict_counts", _LINKS + " SELECT severity, count(*) AS n FROM f GROUP BY 1")
def verdicts(spark, d):
    return Q.verdict_counts(link_rows(spark, d), "severity")


@query("a07_severity_summary", _LINKS + """ SELECT substr(url, 2, 1) AS grp, count(*) AS n, count(*) FILTER (severity = 'FAIL') AS fails, CASE WHEN count(*) FILTER (severity = 'FAIL') > 0 THEN 'FAIL'
  WHEN count(*) FILTER (severity = 'WARN') > 0 THEN 'WARN' ELSE 'OK' END AS worst FROM f GROUP BY 1""")
def summary(spark, d):
    return Q.severity_summary(link_rows(spark, d).withColumn("grp", F.substring("url", 2, 1)), "grp")


@query("q18_districted_seat_check", sql("SELECT body, 'WARN' AS severity FROM p WHERE body % 2 = 0 GROUP BY body HAVING NOT bool_or(id % 40 = 7)"))
def districted(spark, d):
    r = people(spark, d).groupBy("body").agg(
        F.collect_list(F.expr("CASE WHEN id % 40 = 7 THEN 'Ward 1' WHEN id % 2 = 0 THEN 'At-Large' END")).alias("seats")
    )
    return Q.districted_seat_check(r, people(spark, d).where("body % 2 = 0"))


@query("q19_backfill_seats", sql("""SELECT body AS district, count(*) AS members, 58 AS seats, greatest(58 - count(*), 0)::BIGINT AS vacancies, CASE WHEN
  count(*) > 58 THEN 'FAIL' ELSE 'OK' END AS severity FROM p GROUP BY body"""))
def backfilled(spark, d):
    r = people(spark, d).groupBy(F.col("body").alias("district")).agg(F.count("*").alias("members"))
    once = Q.backfill_seats(r, r.selectExpr("district", "58 as seats"))
    return Q.backfill_seats(once, r.selectExpr("district", "58 as seats"))


@query("q20_source_pin", sql("""SELECT body AS source, CASE WHEN body % 5 = 0 THEN 'missing' WHEN body % 3 = 0 THEN 'edited' WHEN body % 4 = 0 THEN 'names' ELSE 'same' END AS state
  FROM (SELECT DISTINCT body FROM p)"""))
def pins(spark, d):
    m = people(spark, d).groupBy(F.col("body").alias("source")).agg(F.max("id").alias("edited"), F.count("*").alias("names"))
    p = m.selectExpr(
        "source", "CASE WHEN source % 3 = 0 THEN edited - 1 ELSE edited END as edited",
        "CASE WHEN source % 4 = 0 THEN names + 1 ELSE names END as names"
    )
    return Q.source_pin(m.where("source % 5 <> 0"), p)


_PH = "CASE WHEN id % 4 = 0 THEN NULL WHEN body % 6 = 0 THEN 'one' WHEN id % 9 = 1 THEN 'hall' ELSE 'n' || (id % 37)::VARCHAR END"


@query("q21_switchboard", sql(f""",
q AS (SELECT id, body, {_PH} AS phone FROM p),
r AS (SELECT id, phone, count(*) OVER (PARTITION BY body, phone) AS c,
  count(phone) OVER (PARTITION BY body) AS n, min(phone) OVER (PARTITION BY body) = max(phone) OVER (PARTITION BY body) AS one FROM q)
SELECT id, phone IS NOT NULL AND ((one AND n > 1) OR c >= 3 OR phone = 'hall') AS office_line FROM r"""))
def lines(spark, d):
    rows = _p(
        spark, d, "id", "body",
        "CASE WHEN id % 4 = 0 THEN null WHEN body % 6 = 0 THEN 'one' WHEN id % 9 = 1 THEN 'hall' ELSE concat('n', id % 37) END as phone",
        "'hall' as hall"
    )
    return Q.switchboard(rows).select("id", "office_line")


@query("q22_privacy", sql("""SELECT id, 'home_phone' AS field, 'forbidden' AS problem FROM p WHERE id % 20 = 0
UNION ALL SELECT id, 'note', 'street address' FROM p WHERE id % 7 = 0
UNION ALL SELECT id, 'note', 'personal mailbox' FROM p WHERE id % 7 = 1"""))
def private(spark, d):
    rows = _p(
        spark, d, "id", "CASE WHEN id % 20 = 0 THEN '1' ELSE ' ' END as home_phone",
        "CASE WHEN id % 7 = 0 THEN concat(id, ' Elm Street') WHEN id % 7 = 1 THEN 'a@Gmail.com' ELSE 'room 4' END as note"
    )
    return Q.privacy(rows, "id", ["note"])


@query("q23_seat_mailbox", sql("SELECT id, CASE WHEN id % 3 = 0 THEN 'off pattern' WHEN id % 3 = 1 THEN 'agrees' ELSE 'FAIL' END AS state FROM p"))
def mailbox(spark, d):
    return Q.seat_mailbox(
        _p(
            spark, d, "id", "body as district",
            "CASE WHEN id % 3 = 0 THEN 'clerk@x.org' WHEN id % 3 = 1 THEN concat('District0', body, '@x.org') ELSE concat('ward', body + 1, '@x.org') END as email"
        )
    )


@query("q24_domain_typo", sql(""",
q AS (SELECT CASE WHEN id % 100 = 0 THEN 'vill' || id::VARCHAR || 'x.org' ELSE 'body' || body::VARCHAR || '.example.org' END AS dom FROM p
UNION ALL SELECT 'bodi' || min(body)::VARCHAR || '.example.org' FROM p),
c AS (SELECT dom, count(*) AS n FROM q GROUP BY 1)
SELECT a.dom AS domain, min(b.dom) AS near FROM c a JOIN c b ON a.n = 1 AND b.n >= 3 AND levenshtein(a.dom, b.dom) BETWEEN 1 AND 2 GROUP BY 1"""))
def typos(spark, d):
    rows = _p(
        spark, d,
        "concat('a@', CASE WHEN id % 100 = 0 THEN concat('vill', id, 'x.org') ELSE concat('body', body, '.example.org') END) as email"
    )
    return Q.domain_typo(rows.unionByName(people(spark, d).agg(F.concat(F.lit("a@bodi"), F.min("body"), F.lit(".example.org")).alias("email"))))


@query(
    "g16_check_fabric",
    """WITH u AS (SELECT n_nationkey AS k, n_regionkey AS r, count(c_custkey) AS pop FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
c AS (SELECT r AS district, 'N' || k::VARCHAR AS unit FROM u WHERE k <> 4 UNION ALL SELECT 0, 'N9' UNION ALL SELECT 3, 'N77'),
t AS (SELECT district, sum(pop) AS pop FROM c JOIN u ON unit = 'N' || k::VARCHAR GROUP BY 1), e AS (SELECT r AS district, sum(pop) AS pop FROM u GROUP BY 1)
SELECT 'unclaimed' AS problem, 'N4' AS subject, NULL::BIGINT AS got, NULL::BIGINT AS expected UNION ALL SELECT 'twice', unit, NULL, NULL FROM c GROUP BY unit HAVING count(DISTINCT district) > 1
UNION ALL SELECT 'absent', unit, NULL, NULL FROM c WHERE unit NOT IN (SELECT 'N' || k::VARCHAR FROM u) UNION ALL SELECT 'population', district::VARCHAR, t.pop::BIGINT, e.pop::BIGINT FROM t JOIN e USING (district) WHERE t.pop <> e.pop""",
)
def fabric(spark, d):
    # Unit 4 is claimed by no district, unit 9 by another too, and unit 77 does not exist; sums of the districts differ accordingly.
    from wardlight.operators.geometry import check_fabric

    n = table(spark, d, "nation").selectExpr("n_nationkey as k", "n_regionkey as district")
    u = n.join(
        table(spark, d, "customer"), F.col("k") == F.col("c_nationkey"), "left"
    ).groupBy("k", "district").agg(F.count("c_custkey").alias("pop"))
    own = n.where("k <> 4").selectExpr("district", "concat('n-', k) as unit")
    extra = n.where("k in (9, 10)").selectExpr("CASE k WHEN 9 THEN 0 ELSE 3 END as district", "CASE k WHEN 9 THEN 'N 9' ELSE 'n77' END as unit")
    return check_fabric(u.selectExpr("concat('N', k) as unit", "pop"), own.unionByName(extra), u.groupBy("district").agg(F.sum("pop").alias("pop")))


@query(
    "u05_merge_fresh_and_kept",
    sql("SELECT id, CASE WHEN id % 6 = 0 THEN upper(name) ELSE name END AS name, id % 6 = 0 AS carried FROM p WHERE id % 3 = 0 OR id % 2 = 0")
)
def merged(spark, d):
    fresh = _p(spark, d, "id", "name").where("id % 6 <> 0 and (id % 3 = 0 or id % 2 = 0)")
    return Q.carry_forward(
        fresh, _p(spark, d, "id", "upper(name) as name").where("id % 3 = 0 or id % 2 = 0"), "id"
    )[0].select("id", "name", "carried")
