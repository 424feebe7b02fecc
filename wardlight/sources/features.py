"""Readers and writers: feature collections, flat rings, placemarks, keyed and nested JSON, delimited references, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLLECTION = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
POLYGON = "array<array<array<double>>>"


def _ring(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def features_of(documents: DataFrame, layer: str, key: str) -> tuple[DataFrame, DataFrame]:
    """documents (text: one feature collection each) → (features layer, feature_id, props, polygons; rejects with the reason).

    Polygon and MultiPolygon alike become an array of polygons; a feature without geometry or rings is rejected, and so
    is a ring that is not closed.
    """
    f = documents.select(
        F.explode(F.from_json("text", COLLECTION)["features"]).alias("f")
    ).select("f.properties", "f.geometry.type", "f.geometry.coordinates")
    one = F.transform(F.from_json("coordinates", POLYGON), _ring)
    many = F.transform(F.from_json("coordinates", f"array<{POLYGON}>"), lambda p: F.transform(p, _ring))
    polygons = F.when(F.col("type") == "Polygon", F.array(one)).when(F.col("type") == "MultiPolygon", many)
    rows = f.select(
        F.lit(layer).alias("layer"), F.col("properties")[key].alias("feature_id"), F.col("properties").alias("props"),
        polygons.alias("polygons")
    )
    empty = F.col("polygons").isNull() | (F.size(F.flatten("polygons")) == 0)
    open_ = F.exists(F.flatten("polygons"), lambda r: (F.size(r) < 4) | (r[0] != F.element_at(r, -1)))
    why = F.when(empty, "no geometry").when(open_, "open ring").when(F.col("feature_id").isNull(), "no key")
    judged = rows.withColumn("reason", why)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("layer", "feature_id", "reason")


def read_features(spark: SparkSession, path: str, layer: str, key: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """features_of files; each file (or each line) is one document, and a folder of files is read in parallel."""
    return features_of(spark.read.text(path, wholetext=not lines).withColumnRenamed("value", "text"), layer, key)


def feature_collections(features: DataFrame, group: str, key: str = "feature_id", places: int = 6) -> DataFrame:
    """features → one document a group: rounded coordinates, features in key order, null properties left out."""
    near = lambda p: F.array(F.round(p["x"], places), F.round(p["y"], places))
    shape = F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, near)))
    props = [c for c in features.columns if c not in ("polygons", group)]
    f = F.struct(
        F.lit("Feature").alias("type"), F.struct(*props).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), shape.alias("coordinates")).alias("geometry")
    )
    rows = features.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), f.alias("f")))).alias("fs"))
    return rows.select(
        group,
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda x: x["f"]).alias("features"))).alias("text")
    )


def write_features(features: DataFrame, path: str, group: str, key: str = "feature_id", places: int = 6) -> DataFrame:
    """Writes one collection a group and line under path and returns the keys that do not read back as they were (none, if all is well).

    Keys and rounded coordinates are compared, and a feature with a ring that has fewer than three different vertices left
    after rounding is returned too.
    """
    feature_collections(features, group, key, places).select("text").write.mode("error").text(path)
    back, _ = read_features(features.sparkSession, path, "", key, lines=True)
    near = F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(F.round(v["x"], places).alias("x"), F.round(v["y"], places).alias("y")))))
    own = features.select(F.col(key).cast("string").alias(key), near.alias("polygons"))
    collapsed = own.where(F.exists(F.flatten("polygons"), lambda r: F.size(F.array_distinct(r)) < 3))
    lost = own.exceptAll(back.select(F.col("feature_id").alias(key), "polygons"))
    return lost.select(key).unionByName(collapsed.select(key)).distinct()


def read_large_features(spark: SparkSession, path: str, layer: str, key: str, begins: str = '{"type":"Feature",') -> tuple[DataFrame, DataFrame]:
    """read_features for collections too large for one task: features layer and rejects.

    The text is cut where a feature begins, which must be written as `begins` throughout and nowhere within a feature, so
    that a file is read in splits by as many tasks as its size asks for, and a task holds a feature at a time. What comes
    before the first feature is dropped; the last feature is followed by the list's
    end, after which no other list may come.
    """
    parts = spark.read.option("lineSep", begins).text(path).where(F.col("value").contains('"geometry"'))
    text = F.concat(F.lit(begins), "value")
    one = F.when(text.rlike(r",\s*$"), F.regexp_replace(text, r",\s*$", "")).otherwise(F.regexp_replace(text, r"\][^\]]*$", ""))  # the last one: the collection's end
    whole = F.concat(F.lit('{"features":['), one, F.lit("]}"))
    return features_of(parts.select(whole.alias("text")), layer, key)


def keyed_json(documents: DataFrame, entry: str) -> DataFrame:
    """documents (text: {key: entry}) → key and the entry's fields; entry is its DDL."""
    return documents.select(F.explode(F.from_json("text", f"map<string,struct<{entry}>>")).alias("key", "e")).select("key", "e.*")


def read_keyed_json(spark: SparkSession, path: str, entry: str) -> DataFrame:
    return keyed_json(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"), entry)


def keyed_documents(df: DataFrame, group: str, key: str) -> DataFrame:
    """Rows → one {key: entry} document a group, keys in order, null fields left out."""
    fields = [c for c in df.columns if c not in (group, key)]
    rows = df.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.to_json(F.struct(*fields)).alias("v")))).alias("es")
    )
    quoted = lambda k: F.regexp_replace(k, r'(["\\])', r"\\$1")
    return rows.select(
        group,
        F.concat(
            F.lit("{"), F.array_join(F.transform("es", lambda e: F.concat(F.lit('"'), quoted(e["k"]), F.lit('":'), e["v"])), ","),
            F.lit("}")
        ).alias("text")
    )


def walk_records(documents: DataFrame, depth: int = 5) -> DataFrame:
    """documents (text) → path, record (variant): every nested object that has a name; deeper nesting than `depth` raises.

    A document is parsed once; each step puts the members of objects and arrays beside the record they are in.
    """
    member = "array<struct<path:string,v:variant,open:boolean>>"
    rows = documents.select(F.array(F.struct(F.lit("$").alias("path"), F.parse_json("text").alias("v"), F.lit(True).alias("open"))).alias("r"))
    one = lambda path, v, open_: F.struct(path.alias("path"), v.alias("v"), open_.alias("open"))
    for _ in range(depth + 1):
        at = rows.select(F.explode("r").alias("r")).select("r.*")
        fields = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
        of_object = F.transform(fields, lambda e: one(F.concat(F.col("path"), F.lit("/"), e["key"]), e["value"], F.lit(True)))
        of_array = F.transform(
            F.try_variant_get("v", "$", "array<variant>"), lambda e,
            i: one(F.concat(F.col("path"), F.lit("/"), i.cast("string")), e, F.lit(True))
        )
        kind = F.schema_of_variant("v")
        inner = F.when(kind.startswith("OBJECT"), of_object).when(kind.startswith("ARRAY"), of_array).otherwise(F.array().cast(member))
        inner = F.filter(inner, lambda e: F.schema_of_variant(e["v"]).startswith("OBJECT") | F.schema_of_variant(e["v"]).startswith("ARRAY"))
        itself = F.array(one(F.col("path"), F.col("v"), F.lit(False)))
        rows = at.select(F.when(F.col("open"), F.concat(itself, inner)).otherwise(itself).alias("r"))
    found = rows.select(F.explode("r").alias("r")).select("r.*")
    found = found.withColumn("_deep", F.assert_true(~F.col("open"), F.lit("nested too deep"))).where("_deep is null")
    named = F.try_variant_get("v", "$.name", "string").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")
    return found.where(named).select("path", F.col("v").alias("record"))


def write_keyed_json(df: DataFrame, path: str, group: str, key: str) -> DataFrame:
    """Writes one {key: entry} document a group and line under path, keys in order, and returns the keys whose entry does not read back (none, if all is well)."""
    fields = [(c, t) for c, t in df.dtypes if c not in (group, key)]
    keyed_documents(df, group, key).select("text").write.mode("error").text(path)
    back = keyed_json(df.sparkSession.read.text(path).withColumnRenamed("value", "text"), ",".join(f"`{c}`:{t}" for c, t in fields))
    own = df.select(F.col(key).cast("string").alias("key"), *[c for c, _ in fields])
    return own.exceptAll(back.select("key", *[c for c, _ in fields])).select("key")


def read_delimited(spark: SparkSession, path: str, key: str, keep: Column | None = None, sep: str = "|") -> DataFrame:
    """A delimited reference table with a header; kept rows must have unique keys."""
    df = spark.read.csv(path, sep=sep, header=True)
    return unique_key(df if keep is None else df.where(keep), key)


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """df, failing when it runs if a key is repeated."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_u", F.assert_true(n == 1, F.concat(F.lit("repeated key "), F.col(key).cast("string")))).where("_u is null").drop("_u")


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Placemark files: folder, name, props and polygons (outer ring first).

    The text is cut at the ends of folders, so that a file is read in splits by as many tasks as its size asks for, and a
    task holds a folder at a time. Of nested folders the inner one's marks are told under the outer one's name.
    """
    poly = "struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>,innerBoundaryIs:array<struct<LinearRing:struct<coordinates:string>>>>"
    schema = f"name string, ExtendedData struct<Data:array<struct<_name:string,value:string>>>, Polygon {poly}"
    blocks = lambda c, tag: F.regexp_extract_all(c, F.lit(f"(?s)<{tag}[ >].*?</{tag}>"), F.lit(0))
    text = spark.read.option("lineSep", "</Folder>").text(path)
    folders = text.select(F.regexp_extract("value", r"(?s)<Folder[ >].*", 0).alias("f")).where("f <> ''")
    marks = folders.select(
        F.trim(F.regexp_extract("f", r"(?s)<name>(.*?)</name>", 1)).alias("folder"), F.explode(blocks("f", "Placemark")).alias("m")
    )
    p = marks.select("folder", F.from_xml("m", schema).alias("p"))
    ring = lambda text: F.transform(
        F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""),
        lambda t: F.struct(F.split(t, ",")[0].cast("double").alias("x"), F.split(t, ",")[1].cast("double").alias("y"))
    )
    outer = F.array(ring(F.col("p.Polygon.outerBoundaryIs.LinearRing.coordinates")))
    inner = F.transform(
        F.coalesce(F.col("p.Polygon.innerBoundaryIs"), F.array().cast("array<struct<LinearRing:struct<coordinates:string>>>")),
        lambda i: ring(i["LinearRing"]["coordinates"])
    )
    props = F.map_from_entries(F.transform(F.col("p.ExtendedData.Data"), lambda x: F.struct(x["_name"], x["value"])))
    return p.select("folder", F.col("p.name").alias("name"), props.alias("props"), F.array(F.concat(outer, inner)).alias("polygons"))


def normalise_flat_rings(rings: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """rings (feature_id, ring_no, ring) as flat lists give them → (features with nested polygons, rings dropped as noise).

    Rings with an area under `least` are noise. A ring in an odd number of larger ones is a hole of the smallest outer
    ring around it; every outer ring begins a polygon.
    """
    from wardlight.operators.geometry import nest_rings
    from wardlight.operators.spatial import classify

    nested = nest_rings(rings)
    noise, good = nested.where(F.col("area") < least), nested.where(F.col("area") >= least)
    outers = good.where("not hole").select(
        F.concat_ws("/", "feature_id", "ring_no").alias("k"), F.col("feature_id").alias("owner"), F.col("ring_no").alias("outer_no"),
        F.col("area").alias("outer_area"), F.array(F.array("ring")).alias("polygons")
    )
    probes = good.where("hole").select(
        F.struct("feature_id", "ring_no").alias("pid"), F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"),
        F.col("feature_id").alias("own"), "area"
    )
    homes = classify(probes, outers).where("own = owner and outer_area > area").groupBy("pid").agg(
        F.min_by("outer_no", "outer_area").alias("outer_no")
    )
    holes = good.where("hole").withColumn("pid", F.struct("feature_id", "ring_no")).join(homes, "pid").groupBy(
        "feature_id", F.col("outer_no").alias("home")
    ).agg(F.collect_list("ring").alias("hs"))
    o = good.where("not hole").select("feature_id", F.col("ring_no").alias("home"), "ring").join(holes, ["feature_id", "home"], "left")
    poly = F.concat(F.array("ring"), F.coalesce("hs", F.array().cast("array<array<struct<x:double,y:double>>>")))
    out = o.select(
        "feature_id", F.struct("home", poly.alias("p")).alias("hp")
    ).groupBy("feature_id").agg(F.array_sort(F.collect_list("hp")).alias("hps"))
    return out.select("feature_id", F.transform("hps", lambda h: h["p"]).alias("polygons")), noise.select("feature_id", "ring_no", "area")


def extract_links(pages: DataFrame, pattern: str = r'href="([^"]+)"') -> DataFrame:
    """pages (page_id, html) → page_id, links: distinct and sorted."""
    return pages.select("page_id", F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("links"))


def extract_table_rows(pages: DataFrame, header: str) -> DataFrame:
    """pages (page_id, html) → page_id, row_no, cells: the rows after the header of the table that has `header` in its first row."""
    tables = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("t"))
    rows = tables.select("page_id", F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)).alias("rs"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"\s+", " "))
    cells = F.transform("rs", lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), clean))
    found = rows.select("page_id", cells.alias("cs")).where(F.array_contains(F.try_element_at("cs", F.lit(1)), F.lit(header)))
    return found.select("page_id", F.posexplode("cs").alias("row_no", "cells")).where("row_no > 0")


def split_terminated(texts: DataFrame, labels: DataFrame, start: str, end: str, terminator: str) -> DataFrame:
    """texts (doc_id, text), labels (label) → doc_id, row_no, label, rest: the section between two markers cut at a terminator, each row with its longest known label."""
    section = F.regexp_extract("text", f"(?s){start}(.*?){end}", 1)
    rows = texts.select(
        "doc_id", F.posexplode(F.regexp_extract_all(section, F.lit(f"(?s)(.*?)(?:{terminator})"), F.lit(1))).alias("row_no", "row")
    ).withColumn("row", F.trim("row")).where("row <> ''")
    first = lambda c: F.lower(F.regexp_extract(c, r"^(\S+)", 1))
    met = rows.withColumn("_w", first(F.col("row"))).join(labels.select("label", first(F.col("label")).alias("_w")), "_w", "left").withColumn(
        "label", F.when(F.startswith(F.lower("row"), F.lower("label")), F.col("label"))
    )
    best = met.groupBy("doc_id", "row_no", "row").agg(F.max_by("label", F.coalesce(F.length("label"), F.lit(0))).alias("label"))
    return best.select(
        "doc_id", "row_no", "label",
        F.trim(F.when(F.col("label").isNull(), F.col("row")).otherwise(F.substr("row", F.length("label") + 1, F.length("row")))).alias("rest")
    )


def expand_grouped_labels(df: DataFrame, col: str) -> DataFrame:
    """`Base 2,3,5 & 6` → one row a number with the base's name, `Other 2` after an ampersand too; no number: the text as it is."""
    groups = F.regexp_extract_all(col, F.lit(r"([A-Za-z][A-Za-z.'’ ]*?)\s*([0-9]+(?:\s*(?:,|&|and)\s*[0-9]+)*)"), F.lit(0))
    each = F.flatten(
        F.transform(
            groups,
            lambda g: F.transform(
                F.regexp_extract_all(g, F.lit(r"([0-9]+)"), F.lit(1)),
                lambda n: F.concat_ws(" ", F.trim(F.regexp_extract(g, r"^([A-Za-z][A-Za-z.'’ ]*?)\s*[0-9]", 1)), n)
            )
        )
    )
    return df.withColumn("label", F.explode(F.when(F.size(each) > 0, each).otherwise(F.array(F.trim(col)))))

