"""Quality gates: each returns findings (or verdict rows); a refresh is published only if no finding says FAIL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.scalars import MAILBOXES, fold_letters, host_of
from wardlight.operators.rosters import blank, enrich_people, field_coverage, without_two


def retention(old: DataFrame, new: DataFrame, fields: Sequence[str], accepted: DataFrame | None = None) -> DataFrame:
    """old and new records (file, grp, fields…) → findings (file, grp, field, rule, severity, was, now).

    A file fails when its records halve (from 3 on), when a field on 2 or more vanishes, or when one loses 3 or more and
    half; a group of 3 records or more fails when a field on 2 or more vanishes there, in files of up to 200 groups. A
    group that left the file is not judged. accepted (file, grp or null, field) turns a failure into OK-accepted.
    """

    def grown(keys: list[str]) -> DataFrame:
        a = field_coverage(old, keys, fields).withColumnsRenamed({"records": "old_records", "n": "was"})
        b = field_coverage(new, keys, fields).withColumnsRenamed({"records": "new_records", "n": "now"})
        return a.join(b, [*keys, "field"], "left")

    f = grown(["file"]).withColumns({"now": F.coalesce("now", F.lit(0)), "new_records": F.coalesce("new_records", F.lit(0))})
    lost = F.col("was") - F.col("now")
    rule = F.when((F.col("now") == 0) & (F.col("was") >= 2), "vanished").when((lost >= 3) & (F.col("now") <= F.col("was") * 0.5), "halved")
    by_field = f.select("file", F.lit(None).cast("string").alias("grp"), "field", rule.alias("rule"), "was", "now").where("rule is not null")
    records = f.groupBy("file").agg(F.max("old_records").alias("was"), F.max("new_records").alias("now")).where("was >= 3 and now < was * 0.5")
    by_record = records.select(
        "file", F.lit(None).cast("string").alias("grp"), F.lit(None).cast("string").alias("field"), F.lit("records").alias("rule"), "was",
        "now"
    )
    g = grown(["file", "grp"]).where("new_records is not null and old_records >= 3 and was >= 2 and now = 0")
    few = old.groupBy("file").agg(F.countDistinct("grp").alias("groups")).where("groups <= 200").select("file")
    by_group = g.join(few, "file", "left_semi").select("file", "grp", "field", F.lit("vanished").alias("rule"), "was", "now")
    out = by_field.unionByName(by_record).unionByName(by_group)
    if accepted is None:
        return out.withColumn("severity", F.lit("FAIL"))
    a = accepted.select(F.col("file").alias("_f"), F.col("grp").alias("_g"), F.col("field").alias("_d"), F.lit(True).alias("_ok")).distinct()
    met = out.join(
        a, (F.col("file") == F.col("_f")) & (F.col("field") == F.col("_d")) & (F.col("_g").isNull() | F.col("grp").eqNullSafe(F.col("_g"))),
        "left"
    )
    return met.groupBy("file", "grp", "field", "rule", "was", "now").agg(F.max("_ok").alias("ok")).withColumn(
        "severity", F.when(F.col("ok"), "OK-accepted").otherwise("FAIL")
    ).drop("ok")


def enough_compared(df: DataFrame, key: str, least: int = 40) -> DataFrame:
    """One finding row: a gate that compared fewer than `least` files refuses to pass."""
    return df.agg(F.countDistinct(key).alias("n")).select("n", F.when(F.col("n") < least, "FAIL").otherwise("OK").alias("severity"))


def carry_forward(new: DataFrame, shipped: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new plus shipped entries of missing keys, flagged carried; one row: n, carried, severity — FAIL from max(1, half) carried on)."""
    kept = shipped.join(new, key, "left_anti")
    out = new.withColumn("carried", F.lit(False)).unionByName(kept.withColumn("carried", F.lit(True)))
    s = out.agg(F.count("*").alias("n"), F.count_if("carried").alias("carried"))
    return out, s.withColumn(
        "severity", F.when((F.col("carried") > 0) & (F.col("carried") >= F.greatest(F.lit(1.0), F.col("n") / 2)), "FAIL").otherwise("OK")
    )


def preserve(fresh: DataFrame, shipped: DataFrame, failed: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fresh, shipped (source, place, …), failed (source), expected (source, place) → (fresh plus failed sources' shipped rows, findings (source, problem))."""
    f = failed.select("source").distinct()
    carried = shipped.join(f, "source", "left_semi")
    both = fresh.join(f, "source", "left_semi").select("source", F.lit("also supplied fresh").alias("problem")).distinct()
    none = f.join(carried, "source", "left_anti").select("source", F.lit("nothing to carry").alias("problem"))
    gone = expected.join(f, "source", "left_semi").join(
        carried.select("source", "place"), ["source", "place"], "left_anti"
    ).select("source", F.lit("expected place missing").alias("problem")).distinct()
    return fresh.unionByName(carried), both.unionByName(none).unionByName(gone)


def preserve_enrichment(fresh: DataFrame, shipped: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Re-applies a failed enriching source: shipped people's fields fill the fresh ones' empty fields."""
    return enrich_people(fresh, shipped, fields)


def floors(df: DataFrame, spec: Mapping[str, tuple[Column, int | None, int | None]]) -> DataFrame:
    """spec: name → (condition, least, most). One row a rule: name, n, severity."""
    counts = df.agg(*[F.count_if(c).alias(k) for k, (c, _, _) in spec.items()])
    rows = [
        F.struct(
            F.lit(k).alias("rule"), F.col(k).alias("n"),
            F.when(
                (F.col(k) < lo if lo is not None else F.lit(False)) | (F.col(k) > hi if hi is not None else F.lit(False)), "FAIL"
            ).otherwise("OK").alias("severity")
        ) for k,
        (_, lo, hi) in spec.items()
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def seats_per_district(df: DataFrame, seats: int) -> DataFrame:
    return df.groupBy("district").agg(F.count("*").alias("n")).where(F.col("n") != seats)


def drift(fresh: DataFrame, shipped: DataFrame) -> DataFrame:
    """Rows of one build that the other lacks; empty means equal."""
    return fresh.exceptAll(shipped).withColumn("side", F.lit("fresh")).unionByName(shipped.exceptAll(fresh).withColumn("side", F.lit("shipped")))


def watch(pages: DataFrame, recorded: DataFrame) -> DataFrame:
    """pages (url, html, links array), recorded (url, sha, link): gone / changed / link gone / same."""
    now = pages.select("url", F.sha2("html", 256).alias("now"), "links")
    met = recorded.join(now, "url", "left")
    return met.select(
        "url",
        F.when(F.col("now").isNull(), "gone").when(
            F.col("link").isNotNull() & ~F.array_contains("links", F.col("link")), "link gone"
        ).when(F.col("now") != F.col("sha"), "changed").otherwise("same").alias("state")
    )


def monotone_as_of(new: DataFrame, shipped: DataFrame, key: str) -> DataFrame:
    """Keys whose newest edition is older than the shipped one: FAIL."""
    a = new.groupBy(key).agg(F.max("as_of").alias("new_as_of")).join(shipped.groupBy(key).agg(F.max("as_of").alias("shipped_as_of")), key)
    return a.withColumn("severity", F.when(F.col("new_as_of") < F.col("shipped_as_of"), "FAIL").otherwise("OK"))


def validate_registry(gaps: DataFrame, layers: DataFrame, counties: DataFrame) -> DataFrame:
    """gaps (id, kind, layer, counties array, summary) → findings (id, problem)."""
    gaps = gaps.withColumn("_times", F.count("*").over(Window.partitionBy("id")))
    text = F.coalesce("summary", F.lit(""))
    rules = [
        (blank("id") | blank("summary"), "required"), (~F.col("kind").isin("no-source", "blocked", "data-quality"), "kind"), (F.length(text) > 240, "length"), (
            text.rlike(r"https?://|www\.|\b[a-z0-9-]+\.(com|org|gov|net)\b"), "address"
        ),
        (text.rlike(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"), "date"), (
            text.rlike(r"\b[A-Z]{5,}(\s+[A-Z]{4,}){2,}"), "shouting"
        ), (F.col("_times") > 1, "repeated id"),
    ]
    own = gaps.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for c, p in rules]))).alias("problem"))
    l = gaps.join(layers.select("layer"), "layer", "left_anti").select("id", F.lit("layer").alias("problem"))
    c = gaps.select("id", F.explode("counties").alias("county")).join(
        counties.select("county"), "county", "left_anti"
    ).select("id", F.lit("county").alias("problem")).distinct()
    return own.unionByName(l).unionByName(c)


def freshness(sources: DataFrame, probes: DataFrame, newest: DataFrame) -> DataFrame:
    """sources (series, url, expect_blocked), probes (url, state, final_url), newest (series, severity) → series, finding, severity."""
    met = sources.join(probes, "url", "left").join(newest.select("series", F.col("severity").alias("edition")), "series", "left")
    finding = F.when(
        F.col("expect_blocked") & (F.col("state") == "ok"), "reachable again"
    ).when(F.col("expect_blocked"), "blocked as expected").when(
        F.coalesce("state", F.lit("")) != "ok", "unreachable"
    ).when(F.col("final_url") != F.col("url"), "renamed").when(F.col("edition") == "WARN", "newer edition").otherwise("current")
    return met.select("series", finding.alias("finding")).withColumn(
        "severity",
        F.when(F.col("finding").isin("current", "blocked as expected"), "OK").when(F.col("finding") == "unreachable", "FAIL").otherwise("WARN")
    )


def dataset_ranges(counts: DataFrame, spec: DataFrame) -> DataFrame:
    """counts (dataset, n), spec (dataset, lo, hi): missing and out-of-range data sets fail."""
    met = spec.join(counts, "dataset", "left")
    return met.select(
        "dataset", "n",
        F.when(F.col("n").isNull(), "missing").when((F.col("n") < F.col("lo")) | (F.col("n") > F.col("hi")), "range").otherwise("ok").alias("finding")
    )


def exactly_one_list(files: DataFrame, lists: DataFrame) -> DataFrame:
    """files (file), lists (file, list): in no list, in several, or listed but unknown."""
    g = lists.groupBy("file").agg(F.count("*").alias("n"))
    a = files.join(g, "file", "left").where("n is null or n > 1").select(
        "file", F.when(F.col("n").isNull(), "unlisted").otherwise("several").alias("problem")
    )
    return a.unionByName(lists.join(files, "file", "left_anti").select("file", F.lit("unknown").alias("problem")).distinct())


def two_way_coverage(dispatch: DataFrame, ring: DataFrame) -> DataFrame:
    """dispatch (county, concept, loader), ring (county) → findings (county, problem)."""
    a = dispatch.join(ring, "county", "left_anti").select("county", F.lit("not in the ring").alias("problem")).distinct()
    b = ring.join(dispatch, "county", "left_anti").select("county", F.lit("does not dispatch").alias("problem"))
    c = dispatch.groupBy("county", "concept").count().where("count > 1").select("county", F.lit("repeated key").alias("problem")).distinct()
    e = dispatch.where(~F.startswith(F.col("loader"), F.col("concept"))).select("county", F.lit("foreign loader").alias("problem")).distinct()
    return a.unionByName(b).unionByName(c).unionByName(e)


def served_status(counties: DataFrame, dispatch: DataFrame, cards: DataFrame, gaps: DataFrame, ring: DataFrame | None = None) -> DataFrame:
    """Per county: dispatch / card only / judicial / frontier / unresearched, its layers, its gaps, and whether an absence is unexplained.

    ring: the counties that are served by declaration; one of them that neither dispatches nor has a card is judicial, and
    outside tells a county that is served but not in the ring. Without it no county is judicial or outside. A county named by
    dispatch, cards, gaps or the ring but not among the counties is not told.
    """
    d = dispatch.groupBy("county").agg(F.countDistinct("layer").alias("layers"))
    g = gaps.select(F.explode("counties").alias("county")).groupBy("county").agg(F.count("*").alias("gaps"))
    flag = lambda df, name: df.select("county").distinct().withColumn(name, F.lit(True))
    out = counties.join(d, "county", "left").join(flag(cards, "card"), "county", "left").join(g, "county", "left")
    out = out.withColumn("own", F.lit(False)) if ring is None else out.join(flag(ring, "own"), "county", "left")
    own = F.coalesce("own", F.lit(False))
    status = F.when(F.col("layers").isNotNull(), "dispatch").when(F.col("card"), "card only").when(own, "judicial").when(F.col("gaps").isNotNull(), "frontier").otherwise("unresearched")
    outside = F.lit(False) if ring is None else status.isin("dispatch", "card only") & ~own
    return out.select(
        "county", status.alias("status"), F.coalesce("layers", F.lit(0)).alias("layers"), F.coalesce("gaps", F.lit(0)).alias("gaps"),
        (status == "unresearched").alias("unexplained"), outside.alias("outside")
    )


def fleet_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(site, id, content) both: unlisted, phantom, or same id with other content."""
    e = expected.select("site", "id", F.sha2("content", 256).alias("a"))
    s = actual.select("site", "id", F.sha2("content", 256).alias("b"))
    met = e.join(s, ["site", "id"], "full_outer")
    return met.select(
        "site", "id",
        F.when(F.col("b").isNull(), "unlisted").when(F.col("a").isNull(), "phantom").when(F.col("a") != F.col("b"), "content").alias("drift")
    ).where("drift is not null")


def provenance(entries: DataFrame) -> DataFrame:
    """Entries (key, name, source_url, source_doc) without exactly one source, or whose key does not match their name."""
    one = blank("source_url") != blank("source_doc")
    same = fold_letters(F.col("key")) == fold_letters(F.col("name"))
    return entries.select("key", F.when(~one, "source").when(~same, "name").alias("problem")).where("problem is not null")


def closed_set(entries: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Members of the reference that the entries lack."""
    return reference.select(key).join(entries.select(key), key, "left_anti")


def link_findings(evidence: DataFrame, expected: DataFrame) -> DataFrame:
    """evidence (url, authored, state), expected (host): severity of each link; a published link is a WARN at most."""
    e = expected.select(F.col("host").alias("_h"), F.lit(True).alias("_e")).distinct()
    met = evidence.withColumn(
        "_host", F.coalesce(host_of(F.col("url")), F.col("url"))
    ).join(e, F.col("_host") == F.col("_h"), "left").withColumn("_e", F.coalesce("_e", F.lit(False)))
    s = F.col("state")
    raw = F.when(s == "ok", F.when(F.col("_e"), "WARN").otherwise("OK")).when(
        s == "blocked", F.when(F.col("_e") | ~F.col("authored"), "OK").otherwise("WARN")
    ).when(s.isin("gone", "hollow"), "FAIL").when(s.isin("rate-limited", "root-redirect"), "WARN").when(F.col("_e"), "OK").otherwise("WARN")
    return met.select("url", F.when((raw == "FAIL") & ~F.col("authored"), "WARN").otherwise(raw).alias("severity"))


def districted_seat_check(roster: DataFrame, coverage: DataFrame) -> DataFrame:
    """roster (body, seats array<string>): bodies with ward geometry but no seat with a district: WARN."""
    named = F.exists("seats", lambda s: s.isNotNull() & ~F.lower(s).rlike("at.large"))
    return roster.join(
        coverage.select("body").distinct(), "body", "left_semi"
    ).where(~F.coalesce(named, F.lit(False))).select("body", F.lit("WARN").alias("severity"))


def backfill_seats(roster: DataFrame, seats: DataFrame) -> DataFrame:
    """roster (district, members), seats (district, seats): seat counts stamped, vacancies, and FAIL where it is overfull. Idempotent."""
    own = roster.drop("seats", "vacancies", "severity") if "seats" in roster.columns else roster
    out = own.join(seats, "district", "left")
    return out.withColumns(
        {
            "vacancies": F.greatest(F.col("seats") - F.col("members"), F.lit(0)),
            "severity": F.when(F.col("members") > F.col("seats"), "FAIL").otherwise("OK")
        }
    )


def source_pin(meta: DataFrame, pins: DataFrame) -> DataFrame:
    met = pins.join(meta.withColumnsRenamed({"edited": "now_edited", "names": "now_names"}), "source", "left")
    return met.select(
        "source",
        F.when(F.col("now_edited").isNull(), "missing").when(
            F.col("now_edited") != F.col("edited"), "edited"
        ).when(F.col("now_names") != F.col("names"), "names").otherwise("same").alias("state")
    )


def switchboard(df: DataFrame) -> DataFrame:
    """(body, person, phone, hall): whose phone is the office line — one number for all of a body, for three people or more, or the hall's own."""
    w = Window.partitionBy("body")
    has = ~blank("phone")
    one = F.size(F.collect_set(F.when(has, F.col("phone"))).over(w)) == 1
    n = F.count(F.when(has, 1)).over(w)
    shared = F.count("*").over(Window.partitionBy("body", "phone"))
    return df.withColumn("office_line", has & ((one & (n > 1)) | (shared >= 3) | F.coalesce(F.col("phone") == F.col("hall"), F.lit(False))))


def privacy(
    df: DataFrame, key: str, fields: Sequence[str], forbidden: Sequence[str] = ("home_address", "home_phone", "ssn", "birthdate")
) -> DataFrame:
    """Findings (key, field, problem): forbidden fields, street addresses in free fields, personal mailboxes."""
    checks = [
        F.when(
            ~blank(F.col(f).cast("string")), F.struct(F.lit(f).alias("field"), F.lit("forbidden").alias("problem"))
        ) for f in forbidden if f in df.columns
    ]
    for f in fields:
        c = F.col(f)
        checks.append(
            F.when(
                c.rlike(r"(?i)^\s*[0-9]+\s+\S.*\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct)\b"),
                F.struct(F.lit(f).alias("field"), F.lit("street address").alias("problem"))
            )
        )
        checks.append(
            F.when(
                F.lower(F.substring_index(c, "@", -1)).isin(*MAILBOXES) & F.contains(c, F.lit("@")),
                F.struct(F.lit(f).alias("field"), F.lit("personal mailbox").alias("problem"))
            )
        )
    return df.select(key, F.explode(F.array_compact(F.array(*checks))).alias("f")).select(key, "f.field", "f.problem")


def seat_mailbox(df: DataFrame) -> DataFrame:
    """(id, district, email): district5@… must be district 5's; other patterns are off-pattern."""
    no = F.nullif(F.regexp_extract("email", r"(?i)^(?:district|ward|d)[-_.]?0*([0-9]+)@", 1), F.lit(""))
    return df.select("id", F.when(no.isNull(), "off pattern").when(no == F.col("district").cast("string"), "agrees").otherwise("FAIL").alias("state"))


def domain_typo(df: DataFrame) -> DataFrame:
    """Mail domains seen once within two edits of one seen three times or more: domain, near. Pairs have the domain less up to two characters in common."""
    d = df.select(F.lower(F.substring_index("email", "@", -1)).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))
    rare = d.where("n = 1").select("domain", F.explode(without_two(F.col("domain"))).alias("k"))
    known = d.where("n >= 3").select(F.col("domain").alias("near"), F.explode(without_two(F.col("domain"))).alias("k"))
    return rare.join(known, "k").where(F.levenshtein("domain", "near", 2) > 0).groupBy("domain").agg(F.min("near").alias("near"))


def verdict_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def severity_summary(findings: DataFrame, group: str) -> DataFrame:
    r = F.when(F.col("severity") == "FAIL", 0).when(F.col("severity") == "WARN", 1).otherwise(2)
    return findings.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "FAIL").alias("fails"),
        F.element_at(F.array(F.lit("FAIL"), F.lit("WARN"), F.lit("OK")), F.min(r) + 1).alias("worst")
    )
