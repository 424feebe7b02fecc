"""Queries of matching, rosters, aggregates, windows and sets over people, offices and links derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import rosters as R
from wardlight.plans.base import query, table

# People: customers with names from their keys; a second publisher spells given names short. Both engines read these.
_GIVEN = "CASE c_custkey % 7 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Nathaniel' WHEN 2 THEN 'Thomas' WHEN 3 THEN 'Maria' WHEN 4 THEN 'Christine' WHEN 5 THEN 'Joseph' ELSE 'Lee' END"
_SUR = "concat('Sm', substr('abcdefghijklmnopqrstuvwxyz', CAST(1 + (c_custkey * 11) % 26 AS INT), 1), substr('aeiouxyzkt', CAST(1 + (c_custkey * 3) % 10 AS INT), 1), 'th')"
_PEOPLE = f"""SELECT c_custkey AS id, c_nationkey AS body, {_GIVEN} AS given, {_SUR} AS sur, concat({_GIVEN}, ' ', {_SUR}) AS name, c_mktsegment AS seg, c_acctbal AS bal
  FROM customer"""


def people(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey as id", "c_nationkey as body", f"{_GIVEN} as given", f"{_SUR} as sur", f"concat({_GIVEN}, ' ', {_SUR}) as name",
        "c_mktsegment as seg", "c_acctbal as bal"
    )


def _p(spark, d, *cols):
    return people(spark, d).selectExpr(*cols)


def sql(q):
    return f"WITH p AS ({_PEOPLE}) " + q if not q.startswith(",") else f"WITH p AS ({_PEOPLE}){q}"


_SEGNAME = "CASE WHEN id % 10 = 0 THEN 'City of Foo' ELSE name END"


@query("p01_eligible", sql("""SELECT id, body::VARCHAR AS district, CASE WHEN id % 10 = 0 THEN NULL ELSE name END AS name FROM p WHERE id % 9 <> 0 AND id % 10 <> 0 AND id % 10 <> 5
  AND seg = 'BUILDING'"""))
def eligible(spark, d):
    rows = _p(
        spark, d, "id", "cast(body as string) as district",
        "CASE WHEN id % 10 = 0 THEN ' ' WHEN id % 10 = 5 THEN 'City of Foo' ELSE name END as name",
        "CASE WHEN id % 9 = 0 THEN 'timeout' END as error", "concat(lower(seg), ' clerk') as title"
    )
    return R.eligible(rows, excluded="CITY OF", title="BUILDING").select("id", "district", "name")


@query(
    "p02_split_vacant",
    sql("SELECT body AS district, count(*) FILTER (id % 6 = 0) AS vacancies, count(*) FILTER (id % 6 <> 0) AS people FROM p GROUP BY 1")
)
def vacant(spark, d):
    rows = _p(
        spark, d, "id", "body as district",
        "CASE WHEN id % 6 = 0 THEN ' Vacant' WHEN id % 6 = 1 THEN cast(null as string) ELSE name END as name"
    )
    who, gone = R.split_vacant(rows)
    n = who.groupBy("district").agg(F.count("*").alias("people"))
    return n.join(gone, "district", "full_outer").select(
        "district", F.coalesce("vacancies", F.lit(0)).alias("vacancies"), F.coalesce("people", F.lit(0)).alias("people")
    )


@query(
    "p03_compact",
    sql(
        "SELECT id, CASE WHEN id % 3 = 0 THEN '{\"name\":\"' || name || '\"}' ELSE '{\"name\":\"' || name || '\",\"seg\":\"' || seg || '\"}' END AS json FROM p"
    )
)
def compact(spark, d):
    return R.to_compact_json(_p(spark, d, "id", "name", "CASE WHEN id % 3 = 0 THEN ' ' ELSE seg END as seg"), "id", ["name", "seg"])


@query("p08_field_findings", sql("""SELECT id, 'name' AS field, 'missing' AS problem FROM p WHERE id % 8 = 0
UNION ALL SELECT id, 'seg', 'unknown' FROM p WHERE seg NOT IN ('BUILDING', 'MACHINERY')"""))
def findings(spark, d):
    return R.field_findings(
        _p(spark, d, "id", "CASE WHEN id % 8 = 0 THEN ' ' ELSE name END as name", "seg"), "id", ["name"], {"seg": ["BUILDING", "MACHINERY"]}
    )


_OFFICE = "CASE WHEN id % 12 = 0 THEN 'Mayor' WHEN id % 12 = 6 THEN 'Acting President' WHEN id % 3 = 1 THEN 'Clerk' ELSE 'Trustee' END"


@query("p09_drop_head_duplicate", sql(f""",
q AS (SELECT id, body, name, {_OFFICE} AS office FROM p)
SELECT id, body, name, office FROM q WHERE office IN ('Mayor', 'Acting President') OR NOT EXISTS (SELECT 1 FROM q h WHERE h.body = q.body AND h.name = q.name
  AND h.office = 'Mayor')"""))
def heads_once(spark, d):
    return R.drop_head_duplicate(_p(spark, d, "id", "body", "name", f"{_OFFICE} as office"))


_PLACES = """SELECT n_nationkey AS k, n_regionkey::VARCHAR AS county, concat('Mt. ', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n_nationkey + 1, 1), CASE
  WHEN n_nationkey % 2 = 0 THEN ' city' ELSE ' village' END) AS place, 'G' || n_nationkey::VARCHAR AS geoid FROM nation
UNION ALL SELECT 100 + n_nationkey, ((n_regionkey+1)%5)::VARCHAR, concat('Mount ', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n_nationkey + 1, 1), ' town'), 'H' || n_nationkey::VARCHAR FROM nation WHERE n_nationkey % 4 = 0"""


@query("j07_resolve_geoid", f"""WITH pl AS ({_PLACES}),
q AS (SELECT c_custkey AS id, (c_custkey % 5)::VARCHAR AS county, n_name, n_nationkey AS nk, n_regionkey::VARCHAR AS home, n_nationkey % 4 = 0 AS twin, ((n_regionkey+1)%5)::VARCHAR AS other FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT id, CASE WHEN nk = 7 AND county = '2' THEN 'OVR' WHEN county = home THEN 'G' || nk::VARCHAR WHEN twin AND county = other THEN 'H' || nk::VARCHAR
  WHEN NOT twin THEN 'G' || nk::VARCHAR END AS geoid, CASE WHEN nk = 7 AND county = '2' THEN 'override' WHEN county = home OR (twin
  AND county = other) THEN 'county' WHEN twin THEN 'ambiguous' ELSE 'state' END AS how FROM q""")
def geoids(spark, d):
    n = table(spark, d, "nation")
    a = n.selectExpr(
        "cast(n_regionkey as string) as county",
        "concat('Mt. ', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n_nationkey + 1, 1), CASE WHEN n_nationkey % 2 = 0 THEN ' city' ELSE ' village' END) as place",
        "concat('G', n_nationkey) as geoid"
    )
    b = n.where("n_nationkey % 4 = 0").selectExpr(
        "cast((n_regionkey+1)%5 as string) as county",
        "concat('Mount ', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n_nationkey + 1, 1), ' town') as place", "concat('H', n_nationkey) as geoid"
    )
    rows = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).selectExpr(
        "c_custkey as id", "cast(c_custkey % 5 as string) as county",
        "concat('City of Mt ', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n_nationkey + 1, 1)) as place"
    )
    o = n.where("n_nationkey = 7").selectExpr(
        "'2' as county", "concat('Mount ', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n_nationkey + 1, 1)) as place", "'OVR' as geoid"
    )
    return R.resolve_geoid(rows, a.unionByName(b), o)


_ENRICH = f""", b AS (SELECT body, name, min(id) AS id, lower(any_value(given)) AS g, lower(any_value(sur)) AS s FROM p WHERE id % 3 <> 0 GROUP BY 1, 2),
e AS (SELECT body, substr(given, 1, 4) || ' ' || sur AS name, lower(substr(any_value(given), 1, 4)) AS g, lower(any_value(sur)) AS s, min('t' || id::VARCHAR) AS phone FROM p WHERE id % 3 = 0 GROUP BY 1, 2),
m AS (SELECT b.body, b.name AS bn, e.name AS en, e.phone, (b.g = e.g OR (length(b.g) >= 3 AND length(e.g) >= 3 AND (starts_with(b.g, e.g) OR starts_with(e.g, b.g)))) AS strong, count(*) OVER (PARTITION BY b.body, e.name) AS allhits FROM b JOIN e ON b.body = e.body AND b.s = e.s),
k AS (SELECT *, count(*) FILTER (strong) OVER (PARTITION BY body, en) AS n FROM m),
u AS (SELECT *, count(*) OVER (PARTITION BY body, bn) AS c FROM k WHERE (strong AND n = 1) OR (n = 0 AND allhits = 1))
SELECT b.body, b.name, CASE WHEN b.id % 5 = 0 THEN 'own' ELSE coalesce(u.phone, ' ') END AS phone, CASE WHEN u.bn IS NULL THEN NULL WHEN strong THEN 'name' ELSE 'surname' END AS matched_by FROM b LEFT JOIN u ON u.body = b.body AND u.bn = b.name AND u.c = 1"""


@query("j08_enrich_people", sql(_ENRICH))
def enrich(spark, d):
    base = people(spark, d).where("id % 3 <> 0").groupBy("body", "name").agg(F.min("id").alias("id")).selectExpr(
        "body", "name", "CASE WHEN id % 5 = 0 THEN 'own' ELSE ' ' END as phone"
    )
    extra = people(spark, d).where("id % 3 = 0").selectExpr(
        "body", "concat(substr(given, 1, 4), ' ', sur) as name", "concat('t', id) as phone"
    ).groupBy("body", "name").agg(F.min("phone").alias("phone"))
    return R.enrich_people(base, extra, ["phone"])


_MATCH = """,
a AS (SELECT id, body, lower(given) AS g, lower(sur) AS s FROM p WHERE id % 3 = 0),
c AS (SELECT id AS cid, body, lower(given) AS g, lower(sur) AS s FROM p WHERE id % 3 = 1),
h AS (SELECT a.id, cid, a.g = c.g OR starts_with(a.g, c.g) OR starts_with(c.g, a.g) OR substr(a.g,1,1) = substr(c.g,1,1) AS close FROM a
  JOIN c ON a.body = c.body AND levenshtein(a.s, c.s) <= 1),
g AS (SELECT id, count(*) AS n, min(cid) AS one, count(*) FILTER (close) AS k, min(cid) FILTER (close) AS two FROM h GROUP BY 1)"""


@query(
    "j09_match_unique",
    sql(
        _MATCH + " SELECT a.id, CASE WHEN n = 1 THEN one WHEN k = 1 THEN two END AS cid, coalesce(n, 0)::BIGINT AS n FROM a LEFT JOIN g ON g.id = a.id"
    )
)
def match(spark, d):
    return R.match_unique(
        _p(spark, d, "id", "body as block", "name").where("id % 3 = 0"),
        _p(spark, d, "id as cid", "body as block", "name").where("cid % 3 = 1")
    )


@query("j10_assign_role", sql(""",
m AS (SELECT *, count(*) OVER (PARTITION BY upper(name)) AS n FROM p),
o AS (SELECT upper(name) AS k, min('role' || (id % 2)::VARCHAR) AS role, count(DISTINCT id % 2) AS r FROM p WHERE id % 5 = 0 GROUP BY 1)
SELECT id, m.name, CASE WHEN n = 1 AND r = 1 THEN role END AS role FROM m LEFT JOIN o ON upper(m.name) = k"""))
def roles(spark, d):
    return R.assign_role(
        _p(spark, d, "id", "name"),
        _p(spark, d, "upper(name) as name", "concat('role', id % 2) as role", "id").where("id % 5 = 0").drop("id")
    )


@query("j11_match_two_way", sql(""",
a AS (SELECT body AS district, lower(sur) AS last, lower(substr(given,1,1)) AS initial, CASE WHEN min(id) % 2 = 0 THEN 'D' ELSE 'R' END AS party FROM p
  WHERE id % 2 = 0 GROUP BY 1, 2, 3),
b AS (SELECT body AS district, lower(sur) AS last, lower(substr(given,1,1)) AS initial, CASE WHEN min(id) % 3 = 0 THEN 'D' ELSE 'R' END AS party FROM p
  WHERE id % 3 = 0 GROUP BY 1, 2, 3)
SELECT coalesce(a.district, b.district) AS district, coalesce(a.last, b.last) AS last, coalesce(a.initial, b.initial) AS initial, CASE
  WHEN b.last IS NULL THEN 'page only' WHEN a.last IS NULL THEN 'certified only' WHEN a.party = b.party THEN 'same' ELSE 'party' END AS status FROM a FULL
  JOIN b ON a.district = b.district AND a.last = b.last AND a.initial = b.initial"""))
def two_way(spark, d):
    one = lambda k: people(spark, d).where(f"id % {k} = 0").groupBy("body", "sur", F.substring("given", 1, 1).alias("i")).agg(F.min("id").alias("id"), F.min("name").alias("name")).selectExpr(
        "body as district", "name", f"CASE WHEN id % {k} = 0 THEN 'D' ELSE 'R' END as party"
    )
    return R.match_two_way(one(2), one(3))


@query("j12_corroborated_office", """SELECT c_custkey AS id, (SELECT min(o.c_mktsegment) FROM customer o WHERE o.c_custkey % 4 <> 0 AND o.c_custkey % 9 <> 0
  AND o.c_mktsegment IN ('BUILDING', 'MACHINERY') AND o.c_custkey % 97 = c.c_custkey % 97 AND o.c_nationkey = c.c_nationkey) AS confirmed_by FROM customer c
  WHERE c_custkey % 4 = 0 AND c_custkey % 9 <> 0 AND confirmed_by IS NOT NULL""")
def corroborated(spark, d):
    from wardlight.functions.scalars import city_key, street_key

    rows = table(spark, d, "customer").selectExpr(
        "c_custkey as id", "c_mktsegment as title",
        "CASE WHEN c_custkey % 9 = 0 THEN 'PO Box 1' WHEN c_custkey % 2 = 0 THEN concat(c_custkey % 97, ' N Main Street, Room 3') ELSE concat('#', c_custkey % 97, ' Main St') END as street",
        "concat(c_nationkey, ' Town, IL 6') as city"
    )
    keyed = rows.withColumns({"street_key": street_key(F.col("street")), "city_key": city_key(F.col("city"))})
    return R.corroborated_office(keyed.where("id % 4 = 0"), keyed.where("id % 4 <> 0"), ["BUILDING", "MACHINERY"])


@query("j15_reconcile_partition", """WITH c AS (SELECT upper(replace(c_name, '#', '')) AS u, count(DISTINCT c_nationkey % 3) AS n FROM (SELECT c_name, c_nationkey FROM customer
  WHERE c_custkey % 7 <> 0
UNION ALL SELECT c_name, c_nationkey + 1 FROM customer WHERE c_custkey % 11 = 1) GROUP BY 1),
u AS (SELECT upper(replace(c_name, '#', '')) AS u FROM customer WHERE c_custkey % 5 <> 0)
SELECT 'absent' AS problem, u AS unit FROM c WHERE u NOT IN (SELECT u FROM u)
UNION ALL SELECT 'unclaimed', u FROM u WHERE u NOT IN (SELECT u FROM c)
UNION ALL SELECT 'twice', u FROM c WHERE n > 1""")
def partition(spark, d):
    c = table(spark, d, "customer")
    comp = c.where("c_custkey % 7 <> 0").selectExpr("c_nationkey % 3 as district", "c_name as unit").unionByName(
        c.where("c_custkey % 11 = 1").selectExpr("(c_nationkey + 1) % 3 as district", "upper(c_name) as unit")
    )
    return R.reconcile_partition(comp, c.where("c_custkey % 5 <> 0").selectExpr("c_name as unit"))


@query("j16_cross_directory", sql(""",
c AS (SELECT 'a' || id::VARCHAR AS email, name, seg FROM p WHERE id % 4 <> 0),
d AS (SELECT 'a' || id::VARCHAR AS email, name, CASE WHEN id % 6 = 1 THEN 'X' ELSE seg END AS seg FROM p WHERE id % 5 <> 0)
SELECT coalesce(c.email, d.email) AS email, CASE WHEN c.email IS NULL THEN CASE WHEN d.name IN (SELECT name FROM c) THEN 'other address' ELSE 'leftover' END
  WHEN d.email IS NULL THEN 'missing' WHEN c.seg = d.seg THEN 'agree' ELSE 'differs' END AS status FROM c FULL JOIN d ON c.email = d.email"""))
def directory(spark, d):
    return R.cross_directory(
        _p(spark, d, "concat('A', id) as email", "name", "seg as office", "id").where("id % 4 <> 0").drop("id"),
        _p(
            spark, d, "concat('a', id) as email", "upper(name) as name", "CASE WHEN id % 6 = 1 THEN 'X' ELSE seg END as office", "id"
        ).where("id % 5 <> 0").drop("id")
    )


@query("j16_check_directory", sql(""",
c AS (SELECT 'a' || id::VARCHAR AS email, name, seg FROM p WHERE id % 4 <> 0),
d AS (SELECT 'a' || id::VARCHAR AS email, name, CASE WHEN id % 6 = 1 THEN 'X' ELSE seg END AS seg FROM p WHERE id % 5 <> 0),
s AS (SELECT CASE WHEN c.email IS NULL THEN CASE WHEN d.name IN (SELECT name FROM c) THEN 'other address' ELSE 'leftover' END
  WHEN d.email IS NULL THEN 'missing' WHEN c.seg = d.seg THEN 'agree' ELSE 'differs' END AS status FROM c FULL JOIN d ON c.email = d.email),
n AS (SELECT status, count(*) AS n FROM s GROUP BY 1)
SELECT status, n, CASE WHEN status = 'agree' THEN 'OK' WHEN status IN ('leftover', 'missing') THEN CASE WHEN (SELECT sum(n) FROM n WHERE status IN ('leftover', 'missing')) > 50
  THEN 'FAIL' ELSE 'WARN' END ELSE 'FAIL' END AS severity FROM n"""))
def check_directory(spark, d):
    return R.check_directory(directory(spark, d), 50)


_ALIAS = """SELECT source, target FROM (SELECT 'u' || c_custkey::VARCHAR AS source, CASE WHEN c_custkey % 4 = 0 THEN 'u' || (c_custkey + 1)::VARCHAR
  WHEN c_custkey % 4 = 1 THEN 'new' || c_custkey::VARCHAR WHEN c_custkey % 4 = 2 THEN 'same' || (c_custkey // 16)::VARCHAR ELSE 'n' || c_custkey::VARCHAR END AS target, c_custkey FROM customer WHERE c_custkey % 3 = 0)"""


@query("j17_apply_aliases", f"""WITH u AS (SELECT 'u' || c_custkey::VARCHAR AS unit FROM customer WHERE c_custkey % 9 <> 0),
a AS ({_ALIAS}),
w AS (SELECT *, count(*) OVER (PARTITION BY target) AS nt FROM a),
g AS (SELECT source, target FROM w WHERE source IN (SELECT unit FROM u) AND target NOT IN (SELECT unit FROM u) AND nt = 1)
SELECT coalesce(target, unit) AS unit FROM u LEFT JOIN g ON source = unit""")
def aliased(spark, d):
    c = table(spark, d, "customer")
    a = c.where("c_custkey % 3 = 0").selectExpr(
        "concat('u', c_custkey) as source",
        "CASE WHEN c_custkey % 4 = 0 THEN concat('u', c_custkey + 1) WHEN c_custkey % 4 = 1 THEN concat('new', c_custkey) WHEN c_custkey % 4 = 2 THEN concat('same', c_custkey div 16) ELSE concat('n', c_custkey) END as target"
    )
    return R.apply_aliases(c.where("c_custkey % 9 <> 0").selectExpr("concat('u', c_custkey) as unit"), a)[0]


@query("j17_sole_numbered_aliases", """WITH k AS (SELECT c_custkey // 3 AS b, c_custkey % 3 AS m FROM customer),
u AS (SELECT CASE WHEN m = 0 OR b % 2 = 0 AND m = 1 THEN 'B' || b::VARCHAR || ' ' || (m + 1)::VARCHAR WHEN m = 2
  AND b % 5 = 0 THEN 'B' || b::VARCHAR ELSE 'C' || m::VARCHAR || 'x' || b::VARCHAR END AS unit FROM k),
b AS (SELECT split_part(unit, ' ', 1) AS base, min(unit) AS source, count(*) AS n FROM u WHERE strpos(unit, ' ') > 0 GROUP BY 1)
SELECT source, base AS target FROM b WHERE n = 1 AND base NOT IN (SELECT unit FROM u)""")
def numbered(spark, d):
    return R.sole_numbered_aliases(
        table(spark, d, "customer").selectExpr("c_custkey div 3 as b", "c_custkey % 3 as m").selectExpr(
            "CASE WHEN m = 0 OR b % 2 = 0 AND m = 1 THEN concat('B', b, ' ', m + 1) WHEN m = 2 AND b % 5 = 0 THEN concat('B', b) ELSE concat('C', m, 'x', b) END as unit"
        )
    )


@query("j20_blocklist", sql("""SELECT id, CASE WHEN seg = 'BUILDING' THEN NULL ELSE seg END AS seg, 0 AS retired FROM p
UNION ALL SELECT -1, 'GONE', 1 WHERE EXISTS (SELECT 1 FROM p)"""))
def blocked(spark, d):
    b = table(spark, d, "region").where("r_regionkey < 2").selectExpr("CASE r_regionkey WHEN 0 THEN 'BUILDING' ELSE 'GONE' END as seg")
    out, retired = R.blocklist(_p(spark, d, "id", "seg"), b, "seg")
    return out.withColumn("retired", F.lit(0)).unionByName(retired.selectExpr("-1L as id", "seg", "1 as retired"))


_CITE = "SELECT 'h' || (page_id % 40)::VARCHAR AS url, 'p' || (page_id % 7)::VARCHAR AS cited_at, page_id % 10 = 0 AS authored FROM pages"
_STATE = "CASE k % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'gone' WHEN 2 THEN 'blocked' WHEN 3 THEN 'hollow' WHEN 4 THEN 'rate-limited' WHEN 5 THEN 'root-redirect' WHEN 6 THEN 'unreachable' ELSE 'ok' END"


def evidence(spark, d):
    pages = table(spark, d, "pages")
    c = pages.selectExpr("concat('h', page_id % 40) as url", "concat('p', page_id % 7) as cited_at", "page_id % 10 = 0 as authored")
    probes = pages.selectExpr("page_id % 40 as k").distinct().selectExpr("concat('h', k) as url", f"{_STATE} as state")
    return R.link_evidence(c, probes)


@query("j21_link_evidence", f"""WITH c AS ({_CITE})
SELECT url, string_agg(DISTINCT cited_at, ',' ORDER BY cited_at) AS cited_at, bool_or(authored) AS authored, (SELECT {_STATE}
  FROM (SELECT substr(url, 2)::INT AS k)) AS state FROM c GROUP BY url""")
def links(spark, d):
    return evidence(spark, d).withColumn("cited_at", F.array_join("cited_at", ","))


@query("j22_cross_check", sql(_MATCH.replace("id % 3 = 1", "id % 3 = 1 AND body <> 4").replace(",\ng AS", """,
hb AS (SELECT * FROM h WHERE cid % 4 = 0),
gb AS (SELECT id, CASE WHEN count(*) = 1 THEN min(cid) WHEN count(*) FILTER (close) = 1 THEN min(cid) FILTER (close) END AS cid FROM hb GROUP BY 1),
cb AS (SELECT body, bool_or(cid % 4 = 0) AS hasb FROM c GROUP BY 1), g AS""") + """ SELECT a.id, CASE WHEN hasb IS NULL THEN 'unchecked' WHEN hasb THEN CASE WHEN gb.cid IS NOT NULL THEN 'agrees' ELSE 'differs' END
  WHEN n = 1 OR k = 1 THEN 'agrees' ELSE 'unchecked' END AS verdict FROM a LEFT JOIN g ON g.id = a.id LEFT JOIN gb ON gb.id = a.id LEFT
  JOIN cb ON cb.body = a.body"""))
def checked(spark, d):
    rosters = _p(spark, d, "id as cid", "body as block", "name", "id % 4 = 0 as badge").where("cid % 3 = 1 and block <> 4")
    return R.cross_check(_p(spark, d, "id", "body as block", "name").where("id % 3 = 0"), rosters)


@query("j23_invert_membership", sql(""",
u AS (SELECT DISTINCT given, sur FROM p),
m AS (SELECT lower(sur) || '/' || lower(substr(given,1,1)) AS k, given || ' ' || sur AS name FROM u),
s AS (SELECT 'c' || (id % 6)::VARCHAR AS committee, lower(sur) || '/' || lower(substr(given,1,1)) AS k FROM p WHERE id % 5 = 0)
SELECT name, string_agg(DISTINCT committee, ',' ORDER BY committee) AS committees FROM m JOIN s USING (k) GROUP BY name"""))
def inverted(spark, d):
    c = people(spark, d).where("id % 5 = 0").groupBy(F.expr("concat('c', id % 6)").alias("committee")).agg(F.collect_list("name").alias("names"))
    return R.invert_membership(c, people(spark, d).select("name").distinct())[0].withColumn("committees", F.array_join("committees", ","))


@query("j24_agreeing_contact", sql("SELECT id, body AS district FROM p WHERE (body, name) IN (SELECT body, name FROM p WHERE id % 4 = 0)"))
def agreeing(spark, d):
    return R.agreeing_contact(
        _p(spark, d, "id", "body as district", "upper(name) as name"), _p(spark, d, "body as district", "name", "id").where("id % 4 = 0")
    )[0].select("id", "district")


@query("j25_compare_composition", """WITH a AS (SELECT c_nationkey AS district, 'B' || (c_custkey % 11)::VARCHAR AS base, CASE
  WHEN c_custkey % 13 = 0 THEN NULL ELSE (c_custkey % 5)::VARCHAR END AS part FROM customer),
b AS (SELECT c_nationkey AS district, 'B' || (c_custkey % 11)::VARCHAR AS base, (c_custkey % 5)::VARCHAR AS part FROM customer WHERE c_custkey % 6 <> 0),
ga AS (SELECT district, base, list_sort(list(DISTINCT part) FILTER (part IS NOT NULL)) AS p, bool_or(part IS NULL) AS w FROM a GROUP BY 1, 2),
gb AS (SELECT district, base, list_sort(list(DISTINCT part)) AS s FROM b GROUP BY 1, 2)
SELECT coalesce(ga.district, gb.district) AS district, coalesce(ga.base, gb.base) AS base, coalesce(array_to_string(list_sort(list_filter(coalesce(p, []), lambda x: NOT list_contains(coalesce(s, []), x))), ','), '') AS missing, s IS NULL AS only_published FROM ga FULL JOIN gb ON ga.district = gb.district AND ga.base = gb.base WHERE s IS NULL OR ga.base IS NULL OR (NOT w AND p <> s)""")
def compositions(spark, d):
    c = table(spark, d, "customer")
    a = c.selectExpr(
        "c_nationkey as district", "concat('B', c_custkey % 11) as base",
        "CASE WHEN c_custkey % 13 = 0 THEN cast(null as string) ELSE cast(c_custkey % 5 as string) END as part"
    )
    b = c.where("c_custkey % 6 <> 0").selectExpr(
        "c_nationkey as district", "concat('B', c_custkey % 11) as base", "cast(c_custkey % 5 as string) as part"
    )
    return R.compare_composition(a, b).select("district", "base", F.array_join("missing", ",").alias("missing"), "only_published")


@query("j26_replace_whole_body", sql(""",
h AS (SELECT body, min('h' || (id % 3)::VARCHAR) AS hall FROM p GROUP BY 1)
SELECT body, name, 'h' || (id % 3)::VARCHAR AS hall FROM p WHERE body % 4 <> 0
UNION ALL SELECT p.body, upper(name), hall FROM p JOIN h USING (body) WHERE body % 4 = 0 AND id % 2 = 0"""))
def replaced(spark, d):
    base = _p(spark, d, "body", "name", "concat('h', id % 3) as hall")
    over = _p(spark, d, "body", "upper(name) as name", "id").where("body % 4 = 0 and id % 2 = 0").drop("id")
    return R.replace_whole_body(base, over)[0]


@query("a01_population_rollup", """SELECT n_regionkey AS district, sum(c)::BIGINT AS pop, CASE WHEN n_regionkey = 2 THEN 0 ELSE sum(c) END::BIGINT AS printed, n_regionkey <> 2 AS ok
  FROM nation JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1""")
def rollup(spark, d):
    u = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("unit")).agg(F.count("*").alias("pop"))
    comp = table(spark, d, "nation").selectExpr("n_regionkey as district", "n_nationkey as unit")
    printed = comp.join(u, "unit").groupBy("district").agg(F.sum("pop").alias("pop")).withColumn(
        "pop", F.when(F.col("district") == 2, F.lit(0)).otherwise(F.col("pop"))
    )
    return R.population_rollup(u, comp, printed)


@query("a02_balance", """WITH q AS (SELECT n_regionkey AS district, count(*) AS pop FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT district, pop, round(100*(pop/(SELECT avg(pop) FROM q)-1), 6) AS deviation FROM q""")
def balance(spark, d):
    q = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")
    ).groupBy(F.col("n_regionkey").alias("district")).agg(F.count("*").alias("pop"))
    return R.balance(q).withColumn("deviation", F.round("deviation", 6))


_CONTACT = "CASE WHEN id % 4 = 0 THEN ' ' ELSE 'x' END"


@query("a03_contact_counts", sql("""SELECT body, count(*) AS members, count(*) FILTER (id % 4 <> 0) AS with_phone, count(*) FILTER (id % 3 <> 0) AS with_email,
  count(*) FILTER (id % 25 = 1) AS chairs FROM p GROUP BY 1"""))
def contacts(spark, d):
    return R.contact_counts(
        _p(
            spark, d, "body", f"{_CONTACT} as phone", "CASE WHEN id % 3 <> 0 THEN 'e' END as email",
            "CASE WHEN id % 25 = 1 THEN 'Chair' ELSE 'member' END as role"
        ),
        "body"
    )


@query("a04_field_coverage", sql("""SELECT body, 'phone' AS field, count(*) AS records, count(*) FILTER (id % 4 <> 0) AS n FROM p GROUP BY 1
UNION ALL SELECT body, 'seg', count(*), count(*) FROM p GROUP BY 1"""))
def coverage(spark, d):
    return R.field_coverage(_p(spark, d, "body", f"{_CONTACT} as phone", "seg"), ["body"], ["phone", "seg"])


_SEAT = "CASE WHEN id % 5 = 0 THEN 'At large' ELSE concat('Ward ', CAST(id % 12 AS VARCHAR(9))) END"
_VNAME = "CASE WHEN id % 6 = 5 THEN 'Vacant' ELSE name END"


@query("a05_nest_roster", sql(f""",
q AS (SELECT body AS district, id, {_VNAME} AS name, {_OFFICE} AS office, CASE WHEN id % 5 = 0 THEN 999999 ELSE id % 12 END AS no FROM p)
SELECT district, count(*) FILTER (office IN ('Mayor', 'Acting President')) AS heads, CASE WHEN
  count(*) FILTER (office IN ('Mayor', 'Acting President')) = 1 THEN max(name) FILTER (office IN ('Mayor', 'Acting President')) END AS head, coalesce(string_agg(name, ',' ORDER BY no, name) FILTER (office = 'Trustee' AND name <> 'Vacant'), '') AS board, count(*) FILTER (office = 'Trustee') AS seats, count(*) FILTER (name = 'Vacant') AS vacancies FROM q GROUP BY 1"""))
def nested(spark, d):
    rows = _p(spark, d, "body as district", f"{_VNAME} as name", f"{_OFFICE} as office", _SEAT.replace("VARCHAR(9)", "STRING") + " as seat")
    return R.nest_roster(rows).select("district", "heads", "head", F.array_join("board", ",").alias("board"), "seats", "vacancies")


@query("a06_coverage_matrix", sql(""",
q AS (SELECT body, CASE WHEN id % 40 = 0 THEN seg ELSE 'base' END AS seg FROM p)
SELECT body AS county, string_agg(DISTINCT seg, ',' ORDER BY seg) AS layers, count(DISTINCT seg) AS n FROM q GROUP BY 1"""))
def matrix(spark, d):
    return R.coverage_matrix(
        _p(spark, d, "body as county", "CASE WHEN id % 40 = 0 THEN seg ELSE 'base' END as layer")
    ).withColumn("layers", F.array_join("layers", ","))


@query("a06_layer_coverage", sql("""SELECT seg AS layer, string_agg(DISTINCT body::VARCHAR, ',' ORDER BY body::VARCHAR) AS counties, count(DISTINCT body) AS n FROM p GROUP BY 1"""))
def layers(spark, d):
    own = _p(spark, d, "cast(body as string) as county", "seg as layer")
    return R.layer_coverage(own).withColumn("counties", F.array_join("counties", ","))


@query("a10_distance_quality", """SELECT round(avg((v <= 50)::INT), 9) AS within, round(median(v) FILTER (v < 100), 9) AS median, count(*) AS n FROM (SELECT abs(l_extendedprice) % 150 AS v
  FROM lineitem)""")
def quality(spark, d):
    return R.distance_quality(table(spark, d, "lineitem").selectExpr("abs(l_extendedprice) % 150 as dist")).select(
        F.round("within", 9).alias("within"), F.round("median", 9).alias("median"), "n"
    )


@query("a11_distinct_locations", sql("""SELECT 'place' || (id % 31)::VARCHAR AS place, (id % 7)::VARCHAR AS address, count(DISTINCT body) AS units, count(DISTINCT body) > 1 AS shared FROM p
  GROUP BY 1, 2"""))
def locations(spark, d):
    return R.distinct_locations(_p(spark, d, "concat('place', id % 31) as place", "cast(id % 7 as string) as address", "body as unit"))


@query("a12_richness", sql("SELECT id, CASE WHEN id % 3 = 0 THEN 2 WHEN id % 3 = 1 THEN 1 ELSE 0 END AS rich FROM p"))
def rich(spark, d):
    return _p(
        spark, d, "id", "CASE WHEN id % 3 < 2 THEN name END as head",
        "CASE WHEN id % 3 = 0 THEN array(name) WHEN id % 2 = 0 THEN cast(array() as array<string>) END as board"
    ).select("id", R.richness(F.col("head"), F.col("board")).alias("rich"))


@query("a13_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated(spark, d):
    return R.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("a14_modal_value", sql(""",
v AS (SELECT body, seg, count(*) AS n, count(DISTINCT name) AS h, min(id) AS f FROM p WHERE id % 12 = 0 GROUP BY 1, 2 /* the others carry no value */),
b AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY n DESC, f) AS r FROM v)
SELECT body, CASE WHEN n >= 2 AND h >= 2 THEN seg END AS seg, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT body FROM p) LEFT JOIN (SELECT * FROM b
  WHERE r = 1) USING (body)"""))
def modal(spark, d):
    return R.modal_value(_p(spark, d, "body", "CASE WHEN id % 12 = 0 THEN seg ELSE ' ' END as seg", "name", "id"), "body", "seg", "name", "id").drop("finding")


@query("a14_modal_finding", sql(""",
v AS (SELECT body, seg, count(*) AS n, count(DISTINCT name) AS h, min('k' || id::VARCHAR) AS f FROM p WHERE id % 6 = 0 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY n DESC, f, seg) AS r FROM v),
o AS (SELECT body, seg, n, CASE WHEN n IS NULL THEN 'none' WHEN n < 2 OR h < 2 THEN 'few' WHEN seg LIKE 'HOUSE%' THEN 'refused' END AS finding FROM (SELECT DISTINCT body FROM p) LEFT JOIN
 (SELECT * FROM b WHERE r = 1) USING (body))
SELECT body, CASE WHEN finding IS NULL THEN seg END AS seg, coalesce(n, 0)::BIGINT AS n, finding FROM o"""))
def modal_finding(spark, d):
    # Ties by a text, and values that are refused.
    own = _p(spark, d, "body", "CASE WHEN id % 6 = 0 THEN seg END as seg", "name", "concat('k', id) as id")
    return R.modal_value(own, "body", "seg", "name", "id", refuse=lambda c: F.startswith(c, F.lit("HOUSE")))


_VOTES = """SELECT c_custkey // 3 AS district, c_name AS candidate, CASE WHEN c_custkey % 17 = 0 THEN 'n/a' ELSE '1,' || lpad((c_custkey % 4)::VARCHAR, 3, '0') END AS votes FROM customer WHERE c_custkey % 7 <> 0"""


@query("a15_contest_winner", f"""WITH v AS (SELECT *, try_cast(replace(votes, ',', '') AS BIGINT) AS v FROM ({_VOTES})),
g AS (SELECT district, count(*) AS n, count(*) FILTER (v IS NULL) AS bad, max(v) AS top, min(candidate) AS sole FROM v GROUP BY 1),
k AS (SELECT district, count(*) AS k, min(candidate) AS who FROM v JOIN g USING (district) WHERE v = top GROUP BY 1)
SELECT district, CASE WHEN NOT (n > 1 AND bad > 0) AND coalesce(k, 0) <= 1 THEN coalesce(who, sole) END AS winner, CASE WHEN n > 1 AND bad > 0 THEN 'unread'
  WHEN k > 1 THEN 'tie' END AS finding FROM g LEFT JOIN k USING (district)""")
def winners(spark, d):
    rows = table(spark, d, "customer").where("c_custkey % 7 <> 0").selectExpr(
        "c_custkey div 3 as district", "c_name as candidate",
        "CASE WHEN c_custkey % 17 = 0 THEN 'n/a' ELSE concat('1,', lpad(cast(c_custkey % 4 as string), 3, '0')) END as votes"
    )
    return R.contest_winner(rows)


@query("a16_composition_from_results", sql("""SELECT body AS district, string_agg(DISTINCT 'u' || (id % 9)::VARCHAR, ',' ORDER BY 'u' || (id % 9)::VARCHAR) AS units,
  count(DISTINCT name)::INT AS candidates FROM p GROUP BY 1"""))
def results(spark, d):
    out = R.composition_from_results(_p(spark, d, "body as district", "concat('u', id % 9) as unit", "name as candidate"))
    return out.select("district", F.array_join("units", ",").alias("units"), F.size("candidates").alias("candidates"))


@query("a17_unanimous", sql(""",
q AS (SELECT body, CASE WHEN body % 3 = 0 THEN 'one' WHEN body % 3 = 1 THEN 'v' || (id % 2)::VARCHAR WHEN id % 5 > 0 THEN 'one' END AS stamp FROM p)
SELECT body, CASE WHEN count(DISTINCT stamp) = 1 AND count(*) = count(stamp) THEN min(stamp) END AS stamp FROM q GROUP BY 1"""))
def stamps(spark, d):
    return R.unanimous(
        _p(spark, d, "body", "CASE WHEN body % 3 = 0 THEN 'one' WHEN body % 3 = 1 THEN concat('v', id % 2) WHEN id % 5 > 0 THEN 'one' END as stamp"),
        "body", "stamp"
    )


@query("w01_current_term", """WITH o AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, o_orderkey FROM orders)
SELECT o_custkey AS id, o_orderkey AS term FROM o WHERE r = 1 AND o_orderstatus = 'F'""")
def terms(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("type")))).alias("terms")
    )
    return R.current_term(g, "F").select("id", F.col("term.o_orderkey").alias("term"))


@query("w02_seat_holder", sql("""SELECT body AS district, id AS member_id FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY (id % 29 = 3 AND body % 2 = 0) DESC, CASE
  WHEN id % 29 = 3 AND body % 2 = 0 THEN 100000 - id END, id DESC) AS r FROM p) WHERE r = 1"""))
def holders(spark, d):
    return R.seat_holder(
        _p(spark, d, "body as district", "id as member_id", "(id % 29 = 3 AND body % 2 = 0) as is_current", "100000 - id as input_order")
    ).select("district", "member_id")


@query("w03_pick_source", sql(""",
e AS (SELECT (id % 200) AS geoid, 'C' || (id % 3)::VARCHAR AS county, max(id % 4 % 3) AS rich FROM p GROUP BY 1, 2)
SELECT geoid, county FROM (SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY (geoid % 10 = 0 AND county = 'C1') DESC, rich DESC, CASE county
  WHEN 'C2' THEN 0 WHEN 'C0' THEN 1 ELSE 2 END, county) AS r FROM e) WHERE r = 1"""))
def picked(spark, d):
    e = people(spark, d).groupBy(
        F.expr("id % 200").alias("geoid"), F.expr("concat('C', id % 3)").alias("county")
    ).agg(F.max(F.expr("id % 4 % 3")).alias("richness"))
    o = e.select("geoid").distinct().where("geoid % 10 = 0").selectExpr("geoid", "'C1' as county", "'reviewed' as reason")
    return R.pick_source(e, o, {"C2": 0, "C0": 1})[0].select("geoid", "county")


@query("w04_newest_edition", """WITH c AS (SELECT p_brand AS series, p_partkey AS id, 1980 + p_size AS year FROM part),
t AS (SELECT series, arg_max(id, year * 1000000 + id) AS newest, max(year) AS year, min(id) AS own FROM c GROUP BY 1)
SELECT t.series, newest, t.year::INT AS year, CASE WHEN t.year > c.year AND newest <> own THEN 'WARN' ELSE 'OK' END AS severity FROM t JOIN c ON c.id = own
  AND c.series = t.series""")
def editions(spark, d):
    c = table(spark, d, "part").selectExpr("p_brand as series", "p_partkey as id", "concat('Districts ', 1980 + p_size, ' edition') as name")
    return R.newest_edition(c, c.groupBy("series").agg(F.min("id").alias("id")))


@query("w05_first_claim", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def claims(spark, d):
    return R.first_claim(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def health_input(spark, d):
    ev = table(spark, d, "events").selectExpr(
        "concat('job', user_id % 60) as job", "CASE WHEN event_id % 9 = 0 THEN 'queued' ELSE 'completed' END as status",
        "CASE WHEN event_id % 5 = 0 THEN 'failure' WHEN event_id % 11 = 0 THEN 'cancelled' ELSE 'success' END as conclusion",
        "cast(ts as timestamp) as created_at", "event_id"
    )
    jobs = ev.groupBy("job").agg(F.min("event_id").alias("k")).selectExpr(
        "job", "cast(CASE WHEN k % 3 = 0 THEN null WHEN k % 3 = 1 THEN 1 ELSE 31 END as int) as cadence_days",
        "CASE WHEN k % 13 = 0 THEN 'disabled' ELSE 'active' END as state", "cast(null as timestamp) as created",
        "CASE WHEN k % 2 = 0 THEN timestamp'2030-01-01 00:00:00' END as code_at"
    )
    return ev, jobs


@query("w06_run_health", """WITH e AS (SELECT 'job' || (user_id % 60)::VARCHAR AS job, event_id % 9 <> 0 AS done, CASE WHEN event_id % 5 = 0 THEN 'failure'
  WHEN event_id % 11 = 0 THEN 'cancelled' ELSE 'success' END AS c, ts, event_id FROM events),
j AS (SELECT job, min(event_id) AS k FROM e GROUP BY 1),
g AS (SELECT job, arg_max(c, ts) AS latest, max(ts) AS done_at, max(ts) FILTER (c = 'success') AS ok FROM e WHERE done GROUP BY 1),
n AS (SELECT max(ts) AS now FROM events),
q AS (SELECT j.job, k, latest, done_at, floor((epoch(now) - epoch(ok)) / 86400)::BIGINT AS age, CASE WHEN k % 3 = 0 THEN 7
  WHEN k % 3 = 1 THEN 1 ELSE 31 END AS cad FROM j LEFT JOIN g USING (job), n)
SELECT job, CASE WHEN k % 13 = 0 THEN 'DISABLED' WHEN done_at IS NULL THEN 'SILENT' WHEN latest = 'failure' THEN CASE
  WHEN k % 2 = 0 THEN 'UNPROVEN' ELSE 'FAILING' END WHEN age IS NULL OR age > cad * 2 + 2 THEN 'STALE' ELSE 'OK' END AS verdict, age FROM q""")
def health(spark, d):
    runs, jobs = health_input(spark, d)
    now = table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    return R.run_health(runs, jobs.join(F.broadcast(now)), F.col("now"))  # now is one row


@query("w11_top_per_group", sql("""SELECT body, id, r AS rank, greatest(n - 3, 0)::BIGINT AS more FROM (SELECT body, id, row_number() OVER (PARTITION BY body ORDER BY id)::INT AS r,
  count(*) OVER (PARTITION BY body) AS n FROM p) WHERE r <= 3"""))
def tops(spark, d):
    return R.top_per_group(_p(spark, d, "body", "id"), "body", "id", 3)


@query("w12_merge_continuations", """WITH r AS (SELECT DISTINCT l_orderkey % 100 AS doc, l_partkey % 10 AS key, l_suppkey AS page FROM lineitem),
g AS (SELECT *, CASE WHEN page - lag(page) OVER w = 1 THEN 0 ELSE 1 END AS n FROM r WINDOW w AS (PARTITION BY doc, key ORDER BY page))
SELECT doc, key, page, sum(n) OVER (PARTITION BY doc, key ORDER BY page)::BIGINT AS entry_no, sum(n) OVER (PARTITION BY doc, key ORDER BY page) > 1 AS repeated FROM g""")
def continued(spark, d):
    return R.merge_continuations(
        table(spark, d, "lineitem").selectExpr("l_orderkey % 100 as doc", "l_partkey % 10 as key", "l_suppkey as page").distinct()
    )


@query(
    "w13_attach_to_header",
    """SELECT user_id AS doc, event_id AS line_no, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events"""
)
def headed(spark, d):
    rows = table(spark, d, "events").selectExpr("user_id as doc", "event_id as line_no", "event_type", "value")
    return R.attach_to_header(rows, F.col("event_type") == "view", F.col("value")).select("doc", "line_no", "header")


@query("s01_numeric_key_order", sql("SELECT DISTINCT id::VARCHAR AS key, dense_rank() OVER (ORDER BY id)::INT AS at FROM p"))
def numeric_order(spark, d):
    return R.numeric_key_order(_p(spark, d, "cast(id as string) as key", "body"), "key")


@query("s02_natural_seat_order", sql(""",
q AS (SELECT id, body, name, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 12 END AS no FROM p)
SELECT id, row_number() OVER (PARTITION BY body ORDER BY no NULLS LAST, name, id)::INT AS at FROM q"""))
def seats(spark, d):
    from pyspark.sql import Window

    rows = _p(spark, d, "id", "body", "name", _SEAT.replace("VARCHAR(9)", "STRING") + " as seat")
    return rows.select(
        "id", F.row_number().over(Window.partitionBy("body").orderBy(R.natural_seat_key(F.col("seat"), F.col("name")), "id")).alias("at")
    )


@query(
    "s03_role_rank_order",
    sql("SELECT id, row_number() OVER (PARTITION BY body ORDER BY CASE id % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, name, id)::INT AS at FROM p")
)
def ranks(spark, d):
    from pyspark.sql import Window

    rows = _p(spark, d, "id", "body", "name", "CASE id % 10 WHEN 0 THEN 'Chair' WHEN 1 THEN 'Vice Chair' ELSE 'Member' END as role")
    return rows.select("id", F.row_number().over(Window.partitionBy("body").orderBy(R.role_rank_key(F.col("role"), F.col("name")), "id")).alias("at"))


@query(
    "s04_severity_order",
    sql("SELECT id, row_number() OVER (PARTITION BY body ORDER BY CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END, id)::INT AS at FROM p")
)
def severities(spark, d):
    from pyspark.sql import Window

    rows = _p(spark, d, "id", "body", "CASE id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'FAIL' ELSE 'WARN' END as severity")
    return rows.select("id", F.row_number().over(Window.partitionBy("body").orderBy(R.severity_rank(F.col("severity")), "id")).alias("at"))


@query("u01_set_diff", sql("""(SELECT name, 'unlisted' AS side FROM (SELECT name FROM p WHERE id % 2 = 0 EXCEPT ALL SELECT name FROM p WHERE id % 3 = 0))
UNION ALL (SELECT name, 'phantom' FROM (SELECT name FROM p WHERE id % 3 = 0 EXCEPT ALL SELECT name FROM p WHERE id % 2 = 0))"""))
def diffs(spark, d):
    return R.set_diff(people(spark, d).where("id % 2 = 0").select("name"), people(spark, d).where("id % 3 = 0").select("name"))


@query("u02_overlay_union", """SELECT n_nationkey AS k, n_name AS name, NULL::VARCHAR AS seg, 'nations' AS source FROM nation
UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'customers' FROM customer""")
def overlays(spark, d):
    return R.overlay_union(
        {
            "nations": table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) as k", "n_name as name"),
            "customers": table(spark, d, "customer").selectExpr("c_custkey as k", "c_name as name", "c_mktsegment as seg")
        }
    )


@query("u03_served_algebra", """WITH r AS (SELECT c_custkey AS c FROM customer),
t AS (SELECT c, c % 3 = 0 AS di, c % 5 = 0 AS ca, c % 7 = 0 AS ga FROM r)
SELECT c, 'dispatch' AS part FROM t WHERE di
UNION ALL SELECT c, 'card' FROM t WHERE ca AND NOT di
UNION ALL SELECT c, 'judicial' FROM t WHERE NOT di AND NOT ca
UNION ALL SELECT c, 'frontier' FROM t WHERE ga AND NOT di AND NOT ca""")
def served(spark, d):
    ring = table(spark, d, "customer").selectExpr("c_custkey as c")
    return R.served_algebra(ring, ring.where("c % 3 = 0"), ring.where("c % 5 = 0"), ring.where("c % 7 = 0"))


@query("u04_edge_xor", "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def odd(spark, d):
    return R.edge_xor(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
