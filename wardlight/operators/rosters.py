"""Rosters: who serves where. Matching is never a guess: an ambiguous match gives null and is counted."""

from __future__ import annotations

from collections.abc import Callable

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.scalars import HEADS, VACANT, fold_letters, name_parts, name_tokens, norm_alnum, norm_census_place, norm_source_place, office_class, within_one_edit
from wardlight.tables import written


def attach_roster(hits: DataFrame, roster: DataFrame, key: str) -> DataFrame:
    """Each hit with its district's roster columns, null where there is no officeholder."""
    return hits.join(roster, key, "left")


def blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c), F.lit("")) == ""


# Filters


def eligible(df: DataFrame, required: Sequence[str] = ("district", "name"), excluded: str | None = None, title: str | None = None) -> DataFrame:
    """Rows without error, with the required fields, whose name does not start with `excluded` and whose title holds `title`."""
    out = df.where("error is null") if "error" in df.columns else df
    for c in required:
        out = out.where(~blank(c))
    if excluded:
        out = out.where(~F.startswith(F.upper(F.col("name")), F.lit(excluded)))
    return out.where(F.contains(F.upper(F.col("title")), F.lit(title))) if title else out


def split_vacant(df: DataFrame, words: Sequence[str] = VACANT) -> tuple[DataFrame, DataFrame]:
    """(people, vacancies by district): a seat published as vacant is counted, never a person."""
    empty = F.lower(F.trim("name")).isin(*words)
    return df.where(~F.coalesce(empty, F.lit(False))), df.where(empty).groupBy("district").agg(F.count("*").alias("vacancies"))


def to_compact_json(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key and a JSON object of the non-empty fields only."""
    return df.select(key, F.to_json(F.struct(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in fields])).alias("json"))


def field_findings(df: DataFrame, key: str, required: Sequence[str], allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """One finding (key, field, problem) for each missing required field and each value outside its list."""
    checks = [F.when(blank(c), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("problem"))) for c in required]
    checks += [
        F.when(~blank(c) & ~F.col(c).isin(*v), F.struct(F.lit(c).alias("field"), F.lit("unknown").alias("problem"))) for c,
        v in allowed.items()
    ]
    return df.select(key, F.explode(F.array_compact(F.array(*checks))).alias("f")).select(key, "f.field", "f.problem")


def drop_head_duplicate(df: DataFrame) -> DataFrame:
    """Rows (body, name, office): a row of another office that names the body's full head is dropped; an acting head keeps both."""
    heads = df.where(
        F.lower("office").isin(*[h for h in HEADS if not h.startswith("acting")])
    ).select("body", F.col("name").alias("name"), F.lit(True).alias("_h")).distinct()
    other = df.join(heads, ["body", "name"], "left")
    return other.where(F.col("_h").isNull() | F.lower("office").isin(*HEADS)).drop("_h").select(*df.columns)


# Matching


def resolve_geoid(df: DataFrame, places: DataFrame, overrides: DataFrame) -> DataFrame:
    """df (id, county, place) × places (county, place, geoid) and overrides (county, place, geoid) → id, geoid, how.

    Override, then the county's own places, then the whole state if the name is unique there, else ambiguous or no match.
    """
    p = places.select("county", norm_census_place(F.col("place")).alias("k"), "geoid")
    near = p.groupBy("county", "k").agg(F.countDistinct("geoid").alias("n1"), F.min("geoid").alias("g1"))
    wide = p.groupBy("k").agg(F.countDistinct("geoid").alias("n2"), F.min("geoid").alias("g2"))
    o = overrides.select("county", norm_source_place(F.col("place")).alias("k"), F.col("geoid").alias("g0"))
    met = df.withColumn("k", norm_source_place(F.col("place"))).join(o, ["county", "k"], "left").join(near, ["county", "k"], "left").join(wide, "k", "left")
    how = F.when(F.col("g0").isNotNull(), "override").when(F.col("n1") == 1, "county").when(F.col("n1") > 1, "ambiguous").when(F.col("n2") == 1, "state").when(F.col("n2") > 1, "ambiguous").otherwise("no match")
    met = met.withColumn("how", how)
    return met.select(
        "id",
        F.when(F.col("how") == "override", F.col("g0")).when(F.col("how") == "county", F.col("g1")).when(F.col("how") == "state", F.col("g2")).alias("geoid"),
        "how"
    )


def _same_given(a: Column, b: Column) -> Column:
    """A given token equal, or one of three letters or more that begins the other."""
    fits = lambda x, y: (x == y) | ((F.length(x) >= 3) & (F.length(y) >= 3) & (F.startswith(x, y) | F.startswith(y, x)))
    return F.exists(a, lambda x: F.exists(b, lambda y: fits(x, y)))


def enrich_people(base: DataFrame, extra: DataFrame, fields: Sequence[str]) -> DataFrame:
    """base and extra (body, name, fields…): empty fields of base filled from the one matching person of extra; matched_by says how.

    The same person has the same surname and a given name in common; failing that a surname that one person of the body
    has. Two possible holders, or two people of extra for one holder, leave it alone. Nothing is added or overwritten.
    """
    t = lambda df: df.withColumn("_t", name_tokens(F.col("name"))).withColumns(
        {"_s": F.try_element_at("_t", F.lit(-1)), "_g": F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0)))}
    ).drop("_t")
    b = t(base).withColumn("_sole", F.count("*").over(Window.partitionBy("body", "_s")))
    e = t(extra).select("body", "_s", F.col("name").alias("_name"), F.col("_g").alias("_ge"), *[F.col(f).alias("_" + f) for f in fields])
    met = b.join(e, ["body", "_s"]).withColumn("_strong", _same_given(F.col("_g"), F.col("_ge")))
    w = Window.partitionBy("body", "_name")
    met = met.withColumn("_n", F.count_if("_strong").over(w))
    sure = met.where((F.col("_strong") & (F.col("_n") == 1)) | ((F.col("_n") == 0) & (F.col("_sole") == 1)))
    sure = sure.withColumn("_m", F.count("*").over(Window.partitionBy("body", "name"))).where("_m = 1")
    told = sure.select("body", "name", *["_" + f for f in fields], F.when(F.col("_strong"), "name").otherwise("surname").alias("matched_by"))
    out = base.join(told, ["body", "name"], "left")
    filled = {f: F.coalesce(F.when(blank(f), F.col("_" + f)), F.col(f)) for f in fields}
    return out.withColumns(filled).select(*base.columns, "matched_by")


def without_one(c: Column) -> Column:
    """The text and all texts with one character less: texts within one edit of each other have one in common."""
    shorter = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))),
        lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1, F.length(c)))
    )
    return F.array_distinct(F.concat(F.array(c), shorter))


def without_two(c: Column) -> Column:
    """The same for two characters and two edits."""
    return F.array_distinct(F.flatten(F.transform(without_one(c), without_one)))


def match_unique(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """names (id, block, name) × candidates (block, cid, name) → id, cid, n: surname within one edit; several are narrowed by the given name; null unless one is left.

    Distinct names of a block meet on the surname or the surname less one letter, so that pairs are tested only where
    surnames are near, and equal names of many people are one pair.
    """
    a = names.select("id", "block", name_parts(F.col("name")).alias("p")).select("id", "block", "p.first", "p.last")
    b = candidates.select("block", "cid", name_parts(F.col("name")).alias("q")).groupBy(
        "block", F.col("q.first").alias("g"), F.col("q.last").alias("l")
    ).agg(F.count("*").alias("c"), F.min("cid").alias("m"))
    keyed = lambda df, last: df.withColumn("k", F.explode(without_one(F.col(last))))
    own = a.where("last <> ''").select("block", "first", "last").distinct()
    pairs = keyed(own, "last").join(keyed(b, "l"), ["block", "k"]).where(within_one_edit(F.col("last"), F.col("l"))).drop("k").distinct()
    g, h = F.col("first"), F.col("g")
    close = (g == h) | F.startswith(g, h) | F.startswith(h, g) | (F.substring(g, 1, 1) == F.substring(h, 1, 1))
    n = pairs.groupBy("block", "first", "last").agg(
        F.sum("c").alias("n"), F.min("m").alias("one"), F.sum(F.when(close, F.col("c")).otherwise(0)).alias("k"),
        F.min(F.when(close, F.col("m"))).alias("two")
    )
    out = a.join(n, ["block", "first", "last"], "left")
    return out.select(
        "id", F.when(F.col("n") == 1, F.col("one")).when(F.col("k") == 1, F.col("two")).alias("cid"), F.coalesce("n", F.lit(0)).alias("n")
    )


def assign_role(members: DataFrame, officers: DataFrame) -> DataFrame:
    """Role set where letters-only names are equal and exactly one member is hit."""
    m = members.withColumn("_k", norm_alnum(F.col("name"))).withColumn("_n", F.count("*").over(Window.partitionBy("_k")))
    o = officers.groupBy(norm_alnum(F.col("name")).alias("_k")).agg(F.min("role").alias("role"), F.countDistinct("role").alias("_r"))
    out = m.join(o, "_k", "left")
    return out.withColumn("role", F.when((F.col("_n") == 1) & (F.col("_r") == 1), F.col("role"))).select(*members.columns, "role")


def match_two_way(page: DataFrame, certified: DataFrame) -> DataFrame:
    """page and certified (district, name, party) by (district, surname, initial), both ways: status same / party / page only / certified only."""
    key = lambda df, p: df.select(
        "district", name_parts(F.col("name"))["last"].alias("last"), F.substring(name_parts(F.col("name"))["first"], 1, 1).alias("initial"),
        F.col("name").alias(p + "name"), F.col("party").alias(p + "party")
    )
    both = key(page, "p_").join(key(certified, "c_"), ["district", "last", "initial"], "full_outer")
    status = F.when(F.col("c_name").isNull(), "page only").when(F.col("p_name").isNull(), "certified only").when(
        F.col("p_party").eqNullSafe(F.col("c_party")), "same"
    ).otherwise("party")
    return both.select("district", "last", "initial", status.alias("status"))


def corroborated_office(chairs: DataFrame, officers: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """chairs and officers (id, street_key, city_key, title): chairs whose place another office of a listed kind shares, and by which title."""
    o = officers.where(F.col("title").isin(*kinds) & F.col("street_key").isNotNull()).select(
        F.col("id").alias("oid"), "street_key", "city_key", F.col("title").alias("by")
    )
    met = chairs.where("street_key is not null").join(o, ["street_key", "city_key"]).where("oid <> id")
    return met.groupBy("id").agg(F.min("by").alias("confirmed_by"))


def reconcile_partition(composition: DataFrame, units: DataFrame) -> DataFrame:
    """Findings (problem, unit): claimed but absent, present but unclaimed, claimed twice; an empty result is a partition."""
    claimed = composition.groupBy(norm_alnum(F.col("unit")).alias("unit")).agg(F.countDistinct("district").alias("n"))
    present = units.select(norm_alnum(F.col("unit")).alias("unit")).distinct()
    a = claimed.join(present, "unit", "left_anti").select(F.lit("absent").alias("problem"), "unit")
    b = present.join(claimed, "unit", "left_anti").select(F.lit("unclaimed").alias("problem"), "unit")
    return a.unionByName(b).unionByName(claimed.where("n > 1").select(F.lit("twice").alias("problem"), "unit"))


def cross_directory(cards: DataFrame, directory: DataFrame) -> DataFrame:
    """By e-mail: agree / differs / missing / leftover, and whether a leftover's name stands on a card under another address."""
    c = cards.select(F.lower("email").alias("email"), F.col("name").alias("c_name"), F.col("office").alias("c_office"))
    d = directory.select(F.lower("email").alias("email"), F.col("name").alias("d_name"), F.col("office").alias("d_office"))
    names = cards.select(fold_letters(F.col("name")).alias("k")).distinct().withColumn("known", F.lit(True))
    both = c.join(d, "email", "full_outer").withColumn("k", fold_letters(F.col("d_name"))).join(names, "k", "left")
    same = (fold_letters(F.col("c_name")) == F.col("k")) & F.col("c_office").eqNullSafe(F.col("d_office"))
    status = F.when(
        F.col("c_name").isNull(), F.when(F.col("known"), "other address").otherwise("leftover")
    ).when(F.col("d_name").isNull(), "missing").when(same, "agree").otherwise("differs")
    return both.select("email", status.alias("status"))


def check_directory(statuses: DataFrame, max_drift: int) -> DataFrame:
    """What cross_directory gives → status, n, severity: a difference or a name under another address fails; those that only one side has are borne up to max_drift in all."""
    n = statuses.groupBy("status").agg(F.count("*").alias("n"))
    one_sided = F.col("status").isin("leftover", "missing")
    drift = F.sum(F.when(one_sided, F.col("n"))).over(Window.partitionBy(F.lit(0)))  # five statuses at most
    return n.select(
        "status", "n",
        F.when(F.col("status") == "agree", "OK").when(one_sided, F.when(drift > max_drift, "FAIL").otherwise("WARN")).otherwise("FAIL").alias("severity")
    )


def apply_aliases(df: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df (unit, …), aliases (source, target) → (renamed, findings): a rename, never a merge.

    An alias whose source is absent, whose target is taken, or that shares its source or target with another is refused.
    """
    have = df.select(F.col("unit").alias("u")).distinct()
    src, tgt = Window.partitionBy("source"), Window.partitionBy("target")
    a = aliases.withColumns({"ns": F.count("*").over(src), "nt": F.count("*").over(tgt)})
    a = a.join(have.withColumnsRenamed({"u": "source"}).withColumn("here", F.lit(True)), "source", "left").join(
        have.withColumnsRenamed({"u": "target"}).withColumn("taken", F.lit(True)), "target", "left"
    )
    why = F.when(F.col("here").isNull(), "absent").when(F.col("taken"), "taken").when((F.col("ns") > 1) | (F.col("nt") > 1), "shared")
    a = a.withColumn("problem", why)
    good = a.where("problem is null").select(F.col("source").alias("unit"), "target")
    renamed = df.join(good, "unit", "left").withColumn("unit", F.coalesce("target", "unit")).select(*df.columns)
    return renamed, a.where("problem is not null").select("source", "target", "problem")


def sole_numbered_aliases(units: DataFrame) -> DataFrame:
    """source, target: `Base 1` stands for `Base` where it is the only numbered variant and no bare name exists."""
    parts = units.select("unit", F.regexp_extract("unit", r"^(.*\S)\s+[0-9]+$", 1).alias("base"))
    sole = parts.where("base <> ''").groupBy("base").agg(F.count("*").alias("n"), F.min("unit").alias("source")).where("n = 1")
    return sole.join(units.select(F.col("unit").alias("base")), "base", "left_anti").select("source", F.col("base").alias("target"))


def blocklist(df: DataFrame, blocked: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """(df with listed values of field emptied, listed values no longer seen: to retire)."""
    b = blocked.select(F.col(field).alias("_b")).distinct()
    out = df.join(b, F.col(field) == F.col("_b"), "left").withColumn(field, F.when(F.col("_b").isNull(), F.col(field))).select(*df.columns)
    return out, blocked.join(df.select(field), field, "left_anti")


def link_evidence(citations: DataFrame, probes: DataFrame) -> DataFrame:
    """url → where it is cited (sorted), whether any citation is our own, and what the probe found."""
    e = citations.groupBy("url").agg(F.array_sort(F.collect_set("cited_at")).alias("cited_at"), F.bool_or("authored").alias("authored"))
    return e.join(probes.select("url", "state"), "url", "left")


def cross_check(names: DataFrame, rosters: DataFrame) -> DataFrame:
    """names (id, block, name) against rosters (block, cid, name, badge): agrees, differs or unchecked; a badge beats membership."""
    badge = match_unique(names, rosters.where("badge")).select("id", F.col("cid").alias("by_badge"))
    member = match_unique(names, rosters).select("id", F.col("cid").alias("by_name"))
    checked = rosters.groupBy("block").agg(F.bool_or("badge").alias("has_badge"))
    out = names.select("id", "block").join(badge, "id").join(member, "id").join(checked, "block", "left")
    verdict = F.when(F.col("has_badge").isNull(), "unchecked").when(
        F.col("has_badge"), F.when(F.col("by_badge").isNotNull(), "agrees").otherwise("differs")
    ).when(F.col("by_name").isNotNull(), "agrees").otherwise("unchecked")
    return out.select("id", verdict.alias("verdict"))


def invert_membership(committees: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """committees (committee, names array), members (name) → (member → sorted committees, findings of names on one side only)."""
    key = lambda c: F.concat_ws("/", name_parts(c)["last"], F.substring(name_parts(c)["first"], 1, 1))
    seats = committees.select("committee", F.explode("names").alias("n")).select("committee", "n", key(F.col("n")).alias("k"))
    own = members.select("name", key(F.col("name")).alias("k"))
    joined = own.join(seats, "k").groupBy("name").agg(F.array_sort(F.collect_set("committee")).alias("committees"))
    lost = seats.join(own, "k", "left_anti").select(F.lit("not on the board").alias("problem"), F.col("n").alias("name")).distinct()
    idle = own.join(seats, "k", "left_anti").select(F.lit("on no committee").alias("problem"), "name")
    return joined, lost.unionByName(idle)


def agreeing_contact(contact: DataFrame, holders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """contact and holders (district, name, …): (contacts whose holder both sources name, the rest as findings)."""
    h = holders.select("district", norm_alnum(F.col("name")).alias("_k")).distinct()
    c = contact.withColumn("_k", norm_alnum(F.col("name")))
    return c.join(h, ["district", "_k"], "left_semi").drop("_k"), c.join(h, ["district", "_k"], "left_anti").select("district", "name")


def compare_composition(published: DataFrame, shipped: DataFrame) -> DataFrame:
    """(district, base, part) both: a null part stands for all parts of its base. Differences: district, base, missing and surplus parts."""
    g = lambda df, n: df.groupBy("district", "base").agg(
        F.array_sort(F.collect_set("part")).alias(n), F.bool_or(F.col("part").isNull()).alias(n + "_all")
    )
    both = g(published, "p").join(g(shipped, "s"), ["district", "base"], "full_outer")
    none = F.array().cast("array<string>")
    p, s = F.coalesce("p", none), F.coalesce("s", none)
    out = both.select(
        "district", "base", F.array_except(p, s).alias("missing"), F.array_except(s, p).alias("surplus"),
        F.col("p").isNull().alias("only_shipped"), F.col("s").isNull().alias("only_published"),
        F.coalesce(F.col("p_all"), F.lit(False)).alias("pa"), F.coalesce(F.col("s_all"), F.lit(False)).alias("sa")
    )
    return out.where(
        "only_shipped or only_published or (not pa and not sa and (size(missing) > 0 or size(surplus) > 0))"
    ).select("district", "base", "missing", "surplus", "only_shipped", "only_published")


def replace_whole_body(officials: DataFrame, override: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(officials with overridden bodies' people replaced entirely, override bodies without base rows). Hall fields stay the base's."""
    bodies = officials.groupBy("body").agg(F.min("hall").alias("hall"))
    fresh = override.drop("hall").join(bodies, "body").select(*officials.columns)
    kept = officials.join(override.select("body").distinct(), "body", "left_anti")
    return kept.unionByName(fresh), override.select("body").distinct().join(bodies, "body", "left_anti")


# Aggregates


def population_rollup(units: DataFrame, composition: DataFrame, printed: DataFrame) -> DataFrame:
    """Population per district, the printed total, and whether they tie out."""
    got = composition.join(units.select("unit", "pop"), "unit").groupBy("district").agg(F.sum("pop").alias("pop"))
    return got.join(
        printed.select("district", F.col("pop").alias("printed")), "district", "full_outer"
    ).withColumn("ok", F.col("pop").eqNullSafe(F.col("printed")))


def balance(district_pop: DataFrame, seats: Column | None = None) -> DataFrame:
    """Deviation of each district from the ideal per seat, in percent."""
    s = seats if seats is not None else F.lit(1)
    ideal = district_pop.agg((F.sum("pop") / F.sum(s)).alias("_ideal"))
    return district_pop.join(F.broadcast(ideal)).withColumn(
        "deviation", 100 * (F.col("pop") / s / F.col("_ideal") - 1)
    ).drop("_ideal")  # one row by construction


def balance_summary(district_pop: DataFrame) -> DataFrame:
    return district_pop.agg(
        F.max("pop").alias("most"), F.min("pop").alias("least"), F.avg("pop").alias("ideal")
    ).withColumn("spread", 100 * (F.col("most") - F.col("least")) / F.col("ideal"))


def contact_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("members"), F.count_if(~blank("phone")).alias("with_phone"), F.count_if(~blank("email")).alias("with_email"),
        F.count_if(F.lower("role") == "chair").alias("chairs")
    )


def field_coverage(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per key and field: records, and those with a non-empty value."""
    rows = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (~blank(F.col(f).cast("string"))).alias("full")) for f in fields])).alias("f")
    )
    return rows.groupBy(*keys, "f.field").agg(F.count("*").alias("records"), F.count_if("f.full").alias("n"))


def nest_roster(df: DataFrame) -> DataFrame:
    """(district, name, office, seat) → one row a district: head, board and officers sorted, seats, vacancies; several heads give none and heads > 1."""
    c = office_class(F.col("office"))
    vacant = F.lower(F.trim("name")).isin(*VACANT)
    pick = lambda k: F.array_sort(
        F.collect_list(
            F.when(
                (c == k) & ~vacant,
                F.struct(F.coalesce(F.regexp_extract("seat", "([0-9]+)", 1).try_cast("int"), F.lit(999_999)).alias("no"), F.col("name").alias("name"))
            )
        )
    )
    out = df.groupBy("district").agg(
        F.count_if((c == "head") & ~vacant).alias("heads"), F.max(F.when((c == "head") & ~vacant, F.col("name"))).alias("head"),
        pick("board").alias("board"), pick("officer").alias("officers"), F.count_if(c == "board").alias("seats"),
        F.count_if(vacant).alias("vacancies")
    )
    names = lambda k: F.transform(k, lambda m: m["name"])
    return out.select(
        "district", "heads", F.when(F.col("heads") == 1, F.col("head")).alias("head"), names("board").alias("board"),
        names("officers").alias("officers"), "seats", "vacancies"
    )


def coverage_matrix(dispatch: DataFrame) -> DataFrame:
    """county → its layers, and how many."""
    return dispatch.groupBy("county").agg(F.array_sort(F.collect_set("layer")).alias("layers"), F.countDistinct("layer").alias("n"))


def layer_coverage(dispatch: DataFrame) -> DataFrame:
    """layer → its counties, and how many."""
    return dispatch.groupBy("layer").agg(F.array_sort(F.collect_set("county")).alias("counties"), F.countDistinct("county").alias("n"))


def distance_quality(df: DataFrame) -> DataFrame:
    """One row: share within 50, and the median of those under 100."""
    return df.agg(
        F.avg((F.col("dist") <= 50).cast("double")).alias("within"), F.median(F.when(F.col("dist") < 100, F.col("dist"))).alias("median"),
        F.count("*").alias("n")
    )


def distinct_locations(polling: DataFrame) -> DataFrame:
    """(place, address) with the units it serves; shared where there are several."""
    return polling.groupBy("place", "address").agg(F.countDistinct("unit").alias("units")).withColumn("shared", F.col("units") > 1)


def richness(head: Column, board: Column) -> Column:
    return F.when(F.coalesce(F.size(board), F.lit(0)) > 0, 2).when(head.isNotNull(), 1).otherwise(0)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def modal_value(df: DataFrame, group: str, col: str, holder: str, order: str, least: int = 2, refuse: Callable[[Column], Column] | None = None) -> DataFrame:
    """The most common value of a group on `least` rows and holders or more; ties by first seen, then by value; else null and a finding.

    refuse: tells values that must not be used, such as a residence. finding: `none` (no value), `few` (too few rows or
    holders) or `refused`; null where there is a value. order may be of any type that sorts.
    """
    v = df.where(~blank(col)).groupBy(group, col).agg(F.count("*").alias("n"), F.countDistinct(holder).alias("h"), F.min(order).alias("first"))
    best = v.groupBy(group).agg(F.min_by(F.struct(col, "n", "h"), F.struct((-F.col("n")).alias("n"), "first", col)).alias("b"))
    few = (F.col("b.n") < least) | (F.col("b.h") < least)
    bad = F.lit(False) if refuse is None else F.coalesce(refuse(F.col(f"b.{col}")), F.lit(False))
    finding = F.when(F.col("b").isNull(), "none").when(few, "few").when(bad, "refused")
    return df.select(group).distinct().join(best, group, "left").select(
        group, F.when(finding.isNull(), F.col(f"b.{col}")).alias(col), F.coalesce("b.n", F.lit(0)).alias("n"), finding.alias("finding")
    )


def contest_winner(candidates: DataFrame) -> DataFrame:
    """(district, candidate, votes text): the one with most votes; a tie or unread votes give no winner and a reason."""
    v = candidates.withColumn("v", F.regexp_replace("votes", ",", "").try_cast("long"))
    g = v.groupBy("district").agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("bad"), F.max("v").alias("top"),
        F.max_by("candidate", "v").alias("who")
    )
    tied = v.join(g.select("district", "top"), "district").where("v = top").groupBy("district").agg(F.count("*").alias("k"))
    out = g.join(tied, "district", "left")
    why = F.when((F.col("n") > 1) & (F.col("bad") > 0), "unread").when(F.col("k") > 1, "tie")
    lone = F.when(F.col("n") == 1, F.coalesce("who", "only"))
    one = candidates.groupBy("district").agg(F.min("candidate").alias("only"))
    return out.join(one, "district").withColumn("finding", why).select(
        "district", F.when(F.col("finding").isNull(), F.coalesce(lone, "who")).alias("winner"), "finding"
    )


def composition_from_results(rows: DataFrame) -> DataFrame:
    return rows.groupBy("district").agg(
        F.array_sort(F.collect_set("unit")).alias("units"), F.array_sort(F.collect_set("candidate")).alias("candidates")
    )


def unanimous(df: DataFrame, key: str, col: str) -> DataFrame:
    """The one value every row of a key carries; null if they differ or any is missing."""
    return df.groupBy(key).agg(F.when((F.countDistinct(col) == 1) & (F.count_if(F.col(col).isNull()) == 0), F.min(col)).alias(col))


# Windows


def current_term(legislators: DataFrame, kind: str) -> DataFrame:
    """(id, terms array<struct<start,type,…>>) → the last term of each person, if it is of the kind."""
    return legislators.withColumn("term", F.try_element_at("terms", F.lit(-1))).where(F.col("term.type") == kind).drop("terms")


def seat_holder(records: DataFrame) -> DataFrame:
    """(district, member_id, is_current, input_order): the first current row, else the highest member id."""
    w = Window.partitionBy("district").orderBy(F.desc("is_current"), F.when(F.col("is_current"), F.col("input_order")), F.desc("member_id"))
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pick_source(entries: DataFrame, overrides: DataFrame, precedence: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    """entries (geoid, county, richness), overrides (geoid, county, reason) → (one entry a geoid, stale overrides)."""
    o = overrides.where(~blank("reason")).select("geoid", F.col("county").alias("_oc"))
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in precedence.items() for x in kv])[F.col("county")], F.lit(len(precedence)))
    w = Window.partitionBy("geoid").orderBy(F.desc(F.col("county").eqNullSafe(F.col("_oc"))), F.desc("richness"), rank, "county")
    kept = entries.join(o, "geoid", "left").withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*entries.columns)
    return kept, overrides.join(entries, ["geoid", "county"], "left_anti")


def newest_edition(catalog: DataFrame, in_use: DataFrame) -> DataFrame:
    """catalog (series, id, name with a year), in_use (series, id) → newest id and year; WARN only if it is newer than the one in use and another."""
    y = catalog.withColumn("year", F.nullif(F.regexp_extract("name", r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")).where("year is not null")
    top = y.groupBy("series").agg(F.max_by(F.struct("id", "year"), F.struct("year", "id")).alias("n"))
    own = in_use.join(y.select("series", "id", F.col("year").alias("own_year")), ["series", "id"], "left")
    out = top.join(own, "series", "left")
    return out.select(
        "series", F.col("n.id").alias("newest"), F.col("n.year").alias("year"),
        F.when((F.col("n.year") > F.col("own_year")) & (F.col("n.id") != F.col("id")), "WARN").otherwise("OK").alias("severity")
    )


def first_claim(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def run_health(runs: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """runs (job, status, conclusion, created_at), jobs (job, cadence_days, state, created, code_at) → job, verdict, age. Of runs at one time a failed one is the latest."""
    passing = ["success", "cancelled", "skipped"]
    done = runs.where("status = 'completed'")
    g = done.groupBy("job").agg(
        F.max_by("conclusion", F.struct("created_at", (~F.coalesce("conclusion", F.lit("")).isin(passing)).alias("fails"))).alias("latest"), F.max("created_at").alias("latest_at"),
        F.max(F.when(F.col("conclusion") == "success", F.col("created_at"))).alias("ok_at")
    )
    j = jobs.join(g, "job", "left")
    days = lambda c: F.floor((F.unix_timestamp(now) - F.unix_timestamp(c)) / 86_400)
    cadence = F.coalesce("cadence_days", F.lit(7))
    age = days(F.col("ok_at"))
    young = F.coalesce(days(F.col("created")) <= cadence, F.lit(False))
    stale = age.isNull() | (age > cadence * 2 + 2)
    failing = ~F.coalesce(F.col("latest"), F.lit("")).isin(passing)
    verdict = (
        F.when(F.coalesce("state", F.lit("active")) != "active", "DISABLED").when(
            F.col("latest_at").isNull(), F.when(young, "NEW").otherwise("SILENT")
        )
        .when(
            failing, F.when(F.col("code_at") > F.col("latest_at"), "UNPROVEN").otherwise("FAILING")
        ).when(stale & young, "NEW").when(stale, "STALE").otherwise("OK")
    )
    return j.select("job", verdict.alias("verdict"), age.cast("long").alias("age"))


def top_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n of each group, and how many more there are."""
    w = Window.partitionBy(group)
    return df.withColumns(
        {"rank": F.row_number().over(w.orderBy(order)), "more": F.greatest(F.count("*").over(w) - n, F.lit(0))}
    ).where(F.col("rank") <= n)


def merge_continuations(rows: DataFrame) -> DataFrame:
    """(doc, page, key, …): a key repeated on the next page continues its entry; entry_no numbers the entries, repeated marks a repeat elsewhere."""
    w = Window.partitionBy("doc", "key").orderBy("page")
    gap = F.col("page") - F.lag("page").over(w)
    out = rows.withColumn("_new", F.when(gap.isNull() | (gap > 1), 1).otherwise(0))
    out = out.withColumn("entry_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_new").withColumn("repeated", F.col("entry_no") > 1)


def attach_to_header(lines: DataFrame, is_header: Column, value: Column) -> DataFrame:
    """(doc, line_no, …): every line with the value of the last header above it."""
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("header", F.last(F.when(is_header, value), ignorenulls=True).over(w))


# Orders and sets


def numeric_key_order(df: DataFrame, key: str) -> DataFrame:
    """key (text), at: the place of each distinct key by its number, equal numbers having one place; keys that are no number come first, as one.

    Numbers are sorted in ranges; a range's places begin after all numbers of the ranges before it, so that no task sorts
    everything. Only the ranges' sizes come to the driver.
    """
    keys = df.select(F.col(key).alias("key"), F.col(key).try_cast("decimal(38,9)").alias("no")).distinct()
    ranged = written(keys.select("no").distinct().repartitionByRange("no").withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    start = F.element_at(F.array(*map(F.lit, before)), F.col("part") + 1)
    places = ranged.select("no", (F.row_number().over(Window.partitionBy("part").orderBy("no")) + start).cast("int").alias("at"))
    return keys.join(places, keys.no.eqNullSafe(places.no)).select("key", "at")


def natural_seat_key(seat: Column, name: Column) -> Column:
    """Sort key: Ward 1 < 2 < 10, seats without a number last, then by name."""
    no = F.nullif(F.regexp_extract(seat, "([0-9]+)", 1), F.lit("")).cast("int")
    return F.struct(no.isNull().alias("unnumbered"), F.coalesce(no, F.lit(0)).alias("no"), F.coalesce(name, F.lit("")).alias("name"))


def role_rank_key(role: Column, name: Column) -> Column:
    r = F.lower(role)
    return F.struct(F.when(r == "chair", 0).when(r.startswith("vice"), 1).otherwise(2).alias("rank"), name.alias("name"))


def severity_rank(c: Column) -> Column:
    return F.when(c == "FAIL", 0).when(c == "WARN", 1).otherwise(2)


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is only in a (unlisted) and only in b (phantom), rows with their columns."""
    return a.exceptAll(b).withColumn("side", F.lit("unlisted")).unionByName(b.exceptAll(a).withColumn("side", F.lit("phantom")))


def overlay_union(layers: Mapping[str, DataFrame]) -> DataFrame:
    """All layers' features, each stamped with its source; columns a layer lacks are null."""
    out = None
    for name, df in layers.items():
        own = df.withColumn("source", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def served_algebra(ring: DataFrame, dispatch: DataFrame, card_only: DataFrame, gapped: DataFrame) -> DataFrame:
    """Each county (one column) of the ring as dispatch, card, judicial (neither) — and frontier: gapped counties not served."""
    served = dispatch.union(card_only).distinct()
    parts = [
        ("dispatch", ring.intersect(dispatch)), ("card", ring.intersect(card_only).subtract(dispatch)), ("judicial", ring.subtract(served)),
        ("frontier", gapped.subtract(served))
    ]
    out = None
    for name, df in parts:
        own = df.select("*", F.lit(name).alias("part"))
        out = own if out is None else out.union(own)
    return out


def edge_xor(df: DataFrame, *keys: str) -> DataFrame:
    """Keeps elements seen an odd number of times."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")
