"""One query for each scalar function, over text and numbers derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.functions import scalars as S
from wardlight.plans.base import query, table

_PLACE = "CASE WHEN c_custkey % 5 = 0 THEN concat('Mt. ', c_mktsegment, ' village') WHEN c_custkey % 5 = 1 THEN concat('City of ', c_mktsegment, ' City') WHEN c_custkey % 5 = 2 THEN concat('United City of ', c_name) WHEN c_custkey % 5 = 3 THEN concat(c_name, ' CDP') ELSE concat(' mt ', c_mktsegment, ' town') END"
_NAME = "CASE WHEN c_custkey % 6 = 0 THEN concat('Alder', CAST(c_custkey AS VARCHAR(20)), ', Ann') WHEN c_custkey % 6 = 1 THEN 'Boyd, Nathaniel' WHEN c_custkey % 6 = 2 THEN 'Roy Williams, Jr.' WHEN c_custkey % 6 = 3 THEN 'O''Neil, Mary J.' WHEN c_custkey % 6 = 4 THEN concat(c_mktsegment, ' (Bud) Smith III') ELSE 'Nathaniel \"Nate\" Albert' END"
_PHONE = "CASE WHEN c_custkey % 4 = 0 THEN concat('(312) 555-', CAST(1000 + c_custkey % 9000 AS VARCHAR(20))) WHEN c_custkey % 4 = 1 THEN concat('1.708.555.', CAST(1000 + c_custkey % 9000 AS VARCHAR(20))) WHEN c_custkey % 4 = 2 THEN concat('555-', CAST(1000 + c_custkey % 9000 AS VARCHAR(20))) ELSE 'see hall' END"
_UNIT = "CASE WHEN p_partkey % 4 = 0 THEN concat(upper(p_type), ' III') WHEN p_partkey % 4 = 1 THEN concat(upper(replace(p_type, ' ', '-')), ' 12') WHEN p_partkey % 4 = 2 THEN concat('DIX ', upper(p_brand)) ELSE concat('700 S ', upper(p_name), ' HS 4TH') END"
_STREET = "CASE WHEN c_custkey % 5 = 0 THEN concat(CAST(c_custkey AS VARCHAR(20)), ' N. Main Street, Suite 4') WHEN c_custkey % 5 = 1 THEN concat('PO Box ', CAST(c_custkey AS VARCHAR(20))) WHEN c_custkey % 5 = 2 THEN concat('#', CAST(c_custkey AS VARCHAR(20)), 'b West Oak Avenue 2nd Floor') WHEN c_custkey % 5 = 3 THEN concat(CAST(c_custkey AS VARCHAR(20)), ' Court House Road') ELSE 'n/a' END"
_GRADES = "CASE WHEN p_size % 4 = 0 THEN 'PK, K, 1, 2, 3' WHEN p_size % 4 = 1 THEN '6, 7, 8' WHEN p_size % 4 = 2 THEN '1, 3, 5' ELSE concat('K, ', CAST(p_size AS VARCHAR(20))) END"

_FOLD = "regexp_replace(upper(regexp_replace(trim({c}), '^Mt\\.?(\\s|$)', 'Mount\\1', 'i')), '[^A-Z]', '', 'g')"
_ROMAN = "regexp_full_match(upper(p), 'X{0,3}(IX|IV|V?I{0,3})')"
_CAP = "upper(substr(p, 1, 1)) || lower(substr(p, 2))"


def _scalar(name: str, tab: str, key: str, given: str, make, sql: str) -> None:
    """given: an expression both engines read; sql: DuckDB's over column c."""
    spark_given = given.replace('\\"', '"')

    def run(spark, sf_dir):
        return table(spark, sf_dir, tab).select(key, F.expr(spark_given).alias("c")).select(key, make(F.col("c")).alias("out"))

    query(name, f"SELECT {key}, {sql} AS out FROM (SELECT {key}, {given.replace(chr(92) + chr(34), chr(34))} AS c FROM {tab})")(run)


_scalar("f01_norm_alnum", "customer", "c_custkey", _PLACE, S.norm_alnum, "regexp_replace(upper(c), '[^A-Z0-9]', '', 'g')")
_scalar("f02_fold_letters", "customer", "c_custkey", _PLACE, S.fold_letters, _FOLD.format(c="c"))
_scalar(
    "f03_norm_census_place", "customer", "c_custkey", _PLACE, S.norm_census_place,
    _FOLD.format(c="regexp_replace(trim(c), '\\s+(village|city|town|CDP)$', '', 'i')")
)
_scalar(
    "f04_norm_source_place", "customer", "c_custkey", _PLACE, S.norm_source_place,
    _FOLD.format(c="regexp_replace(trim(c), '^(united\\s+)?(village|city|town)\\s+of\\s+', '', 'i')")
)
_scalar(
    "f05_unit_title_case", "part", "p_partkey", _UNIT, S.unit_title_case,
    f"array_to_string(list_transform(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w <> ''), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]*') THEN p WHEN length(p) <= 4 AND {_ROMAN} THEN upper(p) ELSE {_CAP} END), '-')), ' ')"
)
_scalar(
    "f06_feed_title_case", "part", "p_partkey", _UNIT, S.feed_title_case,
    f"array_to_string(list_transform(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w <> ''), lambda p: CASE WHEN length(p) = 1 OR regexp_matches(p, '[0-9]') OR p IN {S.KEEP_CAPS} THEN p ELSE {_CAP} END), ' ')"
)
_scalar(
    "f07_grade_range", "part", "p_partkey", _GRADES, S.grade_range,
    "CASE c WHEN 'PK, K, 1, 2, 3' THEN 'PK–3' WHEN '6, 7, 8' THEN '6–8' WHEN 'K, 1' THEN 'K–1' ELSE c END"
)
_scalar(
    "f08_uninvert_name", "customer", "c_custkey", _NAME, S.uninvert_name,
    "CASE WHEN regexp_full_match(c, '[^,]+,[^,]+') AND lower(trim(replace(split_part(c, ',', 2), '.', ''))) NOT IN ('jr','sr') AND regexp_full_match(trim(split_part(c, ',', 1)), '[A-Za-z][A-Za-z .''-]*') THEN trim(split_part(c, ',', 2)) || ' ' || trim(split_part(c, ',', 1)) END"
)
_scalar(
    "f09_name_tokens", "customer", "c_custkey", _NAME, lambda c: F.array_join(S.name_tokens(c), "|"),
    "array_to_string(regexp_extract_all(lower(c), '[a-z]+'), '|')"
)
_PARTS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(c, '\"[^\"]*\"|\\([^)]*\\)', ' ', 'g'), '[.,]', ' ', 'g')), '\\s+'), lambda w: w <> '' AND w NOT IN ('jr','sr','ii','iii','iv','v','vi'))"
_scalar(
    "f10_name_parts", "customer", "c_custkey", _NAME, lambda c: F.concat_ws("/", S.name_parts(c)["first"], S.name_parts(c)["last"]),
    f"({_PARTS})[1] || '/' || ({_PARTS})[-1]"
)
_scalar(
    "f11_within_one_edit", "customer", "c_custkey", "c_name",
    lambda c: S.within_one_edit(c, F.concat(F.lit("Customer#"), F.lpad(F.pmod(F.col("c_custkey"), F.lit(40)).cast("string"), 9, "0"))),
    "levenshtein(c, 'Customer#' || lpad((c_custkey % 40)::VARCHAR, 9, '0')) <= 1"
)
_scalar(
    "f12_format_phone", "customer", "c_custkey", _PHONE, S.format_phone,
    "CASE WHEN length(regexp_replace(regexp_replace(c, '[^0-9]', '', 'g'), '^1([0-9]{10})$', '\\1')) = 10 THEN regexp_replace(regexp_replace(regexp_replace(c, '[^0-9]', '', 'g'), '^1([0-9]{10})$', '\\1'), '^(...)(...)(....)$', '\\1-\\2-\\3') ELSE c END"
)
_scalar(
    "f13_normalise_website", "pages", "page_id",
    "CASE WHEN page_id % 3 = 0 THEN replace(replace(url, 'https://', ''), 'http://', '') WHEN page_id % 3 = 1 THEN '  ' ELSE url END",
    S.normalise_website,
    "CASE WHEN trim(c) = '' THEN NULL WHEN regexp_matches(trim(c), '^https?://') THEN trim(c) ELSE 'https://' || trim(c) END"
)
_scalar(
    "f14_host_of", "pages", "page_id", "replace(upper(url), '://', '://me@')", S.host_of,
    "lower(regexp_extract(c, '^[A-Z]+://([^@/]*@)?([^/:?#]*)', 2))"
)
_scalar(
    "f15_slug", "customer", "c_custkey", _PLACE, lambda c: S.slug(c, {"City of BUILDING City": "building"}),
    "CASE c WHEN 'City of BUILDING City' THEN 'building' ELSE replace(replace(lower(c), '.', ''), ' ', '-') END"
)
_scalar(
    "f16_street_key", "customer", "c_custkey", _STREET, S.street_key,
    "CASE c_custkey % 5 WHEN 0 THEN c_custkey::VARCHAR || ' main st' WHEN 2 THEN c_custkey::VARCHAR || 'b ave oak' WHEN 3 THEN c_custkey::VARCHAR || ' ct house rd' END"
)
_scalar(
    "f17_city_key", "customer", "c_custkey",
    "concat(c_name, chr(10), c_mktsegment, '  Park , IL 60', CAST(c_custkey % 1000 AS VARCHAR(20)))", S.city_key,
    "lower(c_mktsegment_) || ' park'".replace("c_mktsegment_", "regexp_extract(c, '\\n(.*?)  Park', 1)")
)
query("f18_address_line", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_name || ', ' || c_mktsegment || ' IL ' || (60000 + c_custkey)::VARCHAR ELSE c_mktsegment || ' IL' END AS out FROM customer")(
    lambda spark, d: table(spark, d, "customer").select(
        "c_custkey",
        S.address_line(
            F.expr("CASE WHEN c_custkey % 3 = 2 THEN '' ELSE c_name END"), F.expr("CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END"), F.expr("CASE WHEN c_custkey % 3 <> 0 THEN 'IL' END"), F.expr(
                "CASE WHEN c_custkey % 3 <> 2 THEN CAST(60000 + c_custkey AS STRING) END"
            )
        ).alias("out"),
    )
)
_scalar(
    "f19_squash_space", "documents", "doc_id", "concat('  ', text, ' ')", S.squash_space,
    "nullif(trim(regexp_replace(c, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), '')"
)
_scalar("f20_fingerprint", "pages", "page_id", "html", S.fingerprint, "sha256(c)")
_scalar(
    "f21_election_year", "orders", "o_orderkey",
    "CASE WHEN o_orderkey % 3 = 0 THEN CAST(1990 + o_orderkey % 40 AS VARCHAR(20)) WHEN o_orderkey % 3 = 1 THEN concat(CAST(1990 + o_orderkey % 40 AS VARCHAR(20)), '-04-01T00:00:00') ELSE 'spring' END",
    S.election_year, "nullif(regexp_extract(trim(c), '^([0-9]{4})', 1), '')"
)
_scalar(
    "f22_iso_ts", "events", "event_id",
    "CASE WHEN event_id % 3 = 0 THEN '2025-03-04T05:06:07Z' WHEN event_id % 3 = 1 THEN concat('2025-03-04T05:06:', CAST(10 + event_id % 50 AS VARCHAR(20)), '.250+02:00') ELSE event_type END",
    lambda c: F.date_format(S.iso_ts(c), "yyyy-MM-dd HH:mm:ss"),
    "strftime(CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2025-03-04 05:06:07' WHEN event_id % 3 = 1 THEN ('2025-03-04 03:06:' || (10 + event_id % 50)::VARCHAR)::TIMESTAMP END, '%Y-%m-%d %H:%M:%S')"
)
_scalar(
    "f23_cron_days", "events", "event_id",
    "CASE WHEN event_id % 5 = 0 THEN '0 6 1 * *' WHEN event_id % 5 = 1 THEN '0 6 * * 1' WHEN event_id % 5 = 2 THEN '0 6 * * *' WHEN event_id % 5 = 3 THEN 'weekly' ELSE '' END",
    S.cron_days, "[31, 7, 1, 7, NULL][(event_id % 5 + 1)::INT]"
)
query("f24_age_days", "SELECT o_orderkey, datediff('day', o_orderdate::DATE, DATE '1998-08-02')::INT AS age, datediff('day', o_orderdate::DATE, DATE '1998-08-02') > 400 AS stale FROM orders")(
    lambda spark, d: table(spark, d, "orders").select(
        "o_orderkey", S.age_days(F.col("o_orderdate").cast("date"), F.lit("1998-08-02").cast("date")).alias("age"),
        S.is_stale(F.col("o_orderdate").cast("date"), F.lit("1998-08-02").cast("date")).alias("stale")
    )
)
_scalar(
    "f25_office_class", "customer", "c_custkey",
    "CASE WHEN c_custkey % 4 = 0 THEN ' Mayor' WHEN c_custkey % 4 = 1 THEN 'Trustee' WHEN c_custkey % 4 = 2 THEN 'City Clerk ' ELSE c_mktsegment END",
    S.office_class, "['head', 'board', 'officer', NULL][(c_custkey % 4 + 1)::INT]"
)
_scalar(
    "f26_district_number", "customer", "c_custkey",
    "CASE WHEN c_custkey % 3 = 0 THEN concat('District ', CAST(c_custkey AS VARCHAR(20))) WHEN c_custkey % 3 = 1 THEN 'At large' ELSE CAST(c_nationkey AS VARCHAR(20)) END",
    S.district_number, "CASE c_custkey % 3 WHEN 0 THEN c_custkey::VARCHAR WHEN 2 THEN c END"
)
query("f27_haversine", "WITH s AS (SELECT s_suppkey, 41.0 + (s_suppkey % 97)/100.0::DOUBLE AS a, -88.0 + (s_suppkey % 89)/100.0::DOUBLE AS b FROM supplier) SELECT s_suppkey, round(2*6371008.8*asin(sqrt(pow(sin(radians(41.88-a)/2),2)+cos(radians(a))*cos(radians(41.88))*pow(sin(radians(-87.63-b)/2),2))), 3) AS out FROM s")(
    lambda spark, d: table(spark, d, "supplier").select(
        "s_suppkey",
        F.round(
            S.haversine(41.0 + (F.col("s_suppkey") % 97) / 100.0, -88.0 + (F.col("s_suppkey") % 89) / 100.0, F.lit(41.88), F.lit(-87.63)), 3
        ).alias("out")
    )
)
_XY = "CAST(s_suppkey % 97 AS DOUBLE) / 10"
_scalar(
    "f28_planar_xy", "supplier", "s_suppkey", _XY,
    lambda c: F.round(S.planar_xy(c, c + 1, F.lit(41.5))["x"] + S.planar_xy(c, c + 1, F.lit(41.5))["y"], 4),
    "round(c*111320.0::DOUBLE*cos(radians(41.5)) + (c+1)*111320.0::DOUBLE, 4)"
)
_scalar(
    "f29_affine_xy", "supplier", "s_suppkey", _XY,
    lambda c: F.round(S.affine_xy(c, c + 2, 1.5, -0.5, 3, 0.25, 2, -1)["x"] * 1000 + S.affine_xy(c, c + 2, 1.5, -0.5, 3, 0.25, 2, -1)["y"], 6),
    "round((c*1.5::DOUBLE + (c+2)*-0.5::DOUBLE + 3)*1000 + c*0.25::DOUBLE + (c+2)*2 - 1, 6)"
)
_scalar(
    "f31_densify", "supplier", "s_suppkey", _XY,
    lambda c: F.size(S.densify(c, F.lit(0.0), c + 3, F.lit(4.0), 0.7)) * 1000 + F.round(
        F.aggregate(S.densify(c, F.lit(0.0), c + 3, F.lit(4.0), 0.7), F.lit(0.0), lambda a, p: a + p["x"]), 3
    ),
    "round(9*1000 + round(9*c + 13.5, 3), 3)"
)
_scalar(
    "f32_chord_deviation", "supplier", "s_suppkey", _XY,
    lambda c: F.round(
        S.chord_deviation(
            c, F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)
        ) + S.segment_foot(c, F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0))["dist"],
        6
    ),
    "round(abs(3*1 - c*4)/5 + sqrt(pow(c - 3*greatest(0, least(1, (c*3+4)/25)), 2) + pow(1 - 4*greatest(0, least(1, (c*3+4)/25)), 2)), 6)".replace(
        "abs(3*1 - c*4)", "abs(3*(0-1.0::DOUBLE) - (0-c)*4)"
    )
)
_scalar(
    "f34_legal_name", "customer", "c_custkey", _PLACE, S.legal_name,
    "CASE WHEN regexp_matches(c, '^(village|city|town)\\s+of\\s', 'i') THEN c WHEN regexp_matches(c, '\\S\\s+(village|city|town)$', 'i') THEN upper(substr(regexp_extract(c, '(?i)(village|city|town)$', 1), 1, 1)) || lower(substr(regexp_extract(c, '(?i)(village|city|town)$', 1), 2)) || ' of ' || regexp_extract(c, '(?i)^(.*\\S)\\s+(village|city|town)$', 1) ELSE c END"
)
query("f35_strip_exact_prefix", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type || ' ' || p_name END AS out FROM part")(
    lambda spark, d: table(spark, d, "part").select(
        "p_partkey",
        S.strip_exact_prefix(
            F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat(p_brand, ' - ', p_name) ELSE concat(p_type, ' ', p_name) END"), F.col("p_brand")
        ).alias("out")
    )
)
_scalar(
    "f36_is_personal_mailbox", "customer", "c_custkey",
    "CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '@Gmail.com') WHEN c_custkey % 3 = 1 THEN concat(c_name, '@hall.example.org') ELSE 'aol.com' END",
    S.is_personal_mailbox, "c_custkey % 3 = 0"
)
_scalar(
    "f37_split_ward", "customer", "c_custkey",
    "CASE WHEN c_custkey % 3 = 0 THEN concat('City of ', c_mktsegment, ', Ward ', CAST(c_custkey AS VARCHAR(20))) WHEN c_custkey % 3 = 1 THEN concat(c_mktsegment, ', ', CAST(c_custkey AS VARCHAR(20)), 'th ward') ELSE c_name END",
    lambda c: F.concat_ws("|", S.split_ward(c)["body"], S.split_ward(c)["ward"]),
    "CASE c_custkey % 3 WHEN 0 THEN 'City of ' || regexp_extract(c, 'of (.*),', 1) || '|Ward ' || c_custkey::VARCHAR WHEN 1 THEN split_part(c, ',', 1) || '|Ward ' || c_custkey::VARCHAR ELSE c END"
)
_scalar(
    "p04_informative_lines", "customer", "c_custkey",
    "concat(CASE WHEN c_custkey % 4 = 0 THEN '(217)    -' WHEN c_custkey % 4 = 1 THEN '(217) 555-1234' WHEN c_custkey % 4 = 2 THEN ', IL 62701' ELSE c_name END, '|', CASE WHEN c_custkey % 3 = 0 THEN 'Town, IL 62706' ELSE ' ' END)",
    lambda c: F.array_join(S.informative_lines(F.split(c, r"\|")), "|"),
    "CASE WHEN c_custkey % 4 IN (0, 2) THEN NULL WHEN c_custkey % 3 = 0 THEN c ELSE split_part(c, '|', 1) END"
)
