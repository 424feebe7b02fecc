"""URL filters: host and path rules, carried over redirects and canonical links. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import cut, read
from wardlight.llm.components import connected_components

#: (verdict, host/path) in the order given by the caller's policy.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(?:utm_[a-z]+|fbclid|gclid|ref)"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits as struct(verdict, rule), or null. The rules are a short literal list, tried from the longest."""
    found = None
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rule_path))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"))
        found = F.when(fits, value) if found is None else F.when(fits, value).otherwise(found)
    return found if found is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def canonical_url(url: Column) -> Column:
    """The address that stands for a page's variants: no scheme, fragment or tracking parameter, and one closing slash."""
    host = host_of(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)")), "&")
    path = F.concat(F.regexp_replace(path_of(url), "/+$", ""), F.lit("/"))
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolved(target: Column, url: Column) -> Column:
    """The address that a link names on the page of url: whole, without its scheme, from the host's root, or beside the page; null for mailto: and the like."""
    t = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(t, r"(?s)^([^?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    whole = F.when(F.startswith(t, F.lit("/")), path).when(path == "", path_of(url)).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), path)
    )
    parts = F.slice(F.split(whole, "/"), 2, F.greatest(F.size(F.split(whole, "/")) - 1, F.lit(0)))
    step = lambda up, x: F.when(
        x == "..", F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0)))
    ).when(x == ".", up).otherwise(F.array_append(up, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    here = F.concat(
        root,
        F.when(whole == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, last).otherwise(F.lit("")))),
        F.substr(t, F.length(path) + 1, F.length(t))
    )
    scheme = F.regexp_extract(url, r"(?s)^(.*?):", 1)
    return F.when(F.contains(t, F.lit("://")), t).when(F.startswith(t, F.lit("//")), F.concat(scheme, F.lit(":"), t)).when(
        t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (t == "") | (root == ""), None
    ).otherwise(here)


def html_links(pages: DataFrame) -> DataFrame:
    """Alias edges (a, b) that pages state: rel=canonical links and meta refresh targets, resolved against the page's address."""
    tag = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
    fresh = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""
    html = F.lower("html")
    told = pages.where(F.contains(html, F.lit("canonical")) | F.contains(html, F.lit("refresh")))
    both = told.select("url", F.explode(F.array(F.regexp_extract("html", tag, 1), F.regexp_extract("html", fresh, 1))).alias("b"))
    return both.where("b <> ''").select(F.col("url").alias("a"), resolved(F.col("b"), F.col("url")).alias("b"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url[, html]) and optional redirects (a, b) → page_id, host, path, rule, verdict, alias_of.

    A page that a rule fits has that rule's verdict. For the others, addresses joined by redirects, canonical links or
    canonical forms are one class: a class with an address that a rule allows is allowed (explicit allow precedence),
    else one with an address that a rule blocks is blocked, else the page is allowed. alias_of is the class's least
    address, or null for an address without an alias.

    One row per input row, repeated rows included; a null or malformed url has an empty host and path, no rule and is
    allowed; urls of any length are taken whole; of rules that fit, the longest wins, of equally long ones the later in
    the alphabet. An empty table gives an empty one, and without html or redirects only canonical forms join addresses.
    Other columns of the input are ignored. Classes come from distributed star contraction over distinct addresses, so
    many pages that redirect to one address are combined before the shuffle.
    """
    html = "html" in pages.columns
    base = pages.select("page_id", "url", *["html"] * html)
    found = [redirects.select("a", "b")] if redirects is not None else []
    if html:
        found.append(html_links(base))
    # Every address that occurs, as a page's or as a target, is joined to its canonical form.
    every = reduce(DataFrame.unionByName, [base.select("url"), *(f.select(F.explode(F.array("a", "b")).alias("url")) for f in found)])
    edges = reduce(
        DataFrame.unionByName,
        [every.select(F.col("url").alias("a"), F.concat(F.lit("http://"), canonical_url(F.col("url"))).alias("b")), *found]
    )
    edges = edges.where("a is not null and b is not null").where(F.contains(F.col("a"), F.lit("://")))
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    classes = cut(connected_components(edges))
    ruled = classes.select(
        "component", F.explode(F.array(rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])).alias("told")
    ).where("told is not null")
    votes = ruled.groupBy("component").agg(F.min("told").alias("vote"))  # "allow" sorts before "block"
    voted = classes.join(votes, "component", "left").select(F.col("node").alias("url"), F.col("component").alias("alias_of"), "vote")
    out = base.select("page_id", "url").join(voted, "url", "left")
    out = out.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("own.verdict"), F.col("vote"), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "alias_of")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages")).drop("alias_of")


OP2_SQL = r"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url,''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url,''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
q AS (SELECT *, array_to_string(list_filter(string_split(regexp_extract(coalesce(url,''), '^[^?#]*\?([^#]*)', 1, 's'), '&'),
  lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|ref)(=|$)')), '&') AS kept FROM p),
n AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || '/' || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canon FROM q),
every AS (SELECT host, path, canon FROM n WHERE canon IS NOT NULL UNION ALL SELECT host, regexp_replace(path, '/+$', '') || '/', canon FROM n WHERE canon IS NOT NULL),
rules(verdict, rule) AS (VALUES ('allow','com/'), ('block','example.com/en/'), ('allow','www.example.com/en/'), ('block','net/es/'), ('block','net/fr/')),
r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM rules),
told AS (SELECT canon, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS vote FROM
  (SELECT canon, arg_max(r.verdict, length(rule)) AS v FROM every JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY canon, host, path) GROUP BY canon),
own AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS verdict FROM (SELECT DISTINCT host, path FROM n) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT n.page_id, n.host, n.path, own.rule, coalesce(own.verdict, told.vote, 'allow') AS verdict
FROM n LEFT JOIN own ON n.host = own.host AND n.path = own.path LEFT JOIN told ON n.canon = told.canon
"""
