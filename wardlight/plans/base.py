"""Registration of queries, table readers, and the deterministic fixtures that queries derive from the tables."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = re.sub(r"\bby\b", '"by"', sql)  # the edges' column; keywords are in capitals
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    env = spark.sparkContext.environment  # Python workers import this library too
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


POINTS_A_TASK = 1_250_000  # rows of lineitem


# Points: distinct (order, line) keys scattered over a box of 5 by 5.
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are dealt out by their count before they are made distinct, so that no task's table of keys grows with the input or with its split."""
    lines = table(spark, sf_dir, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // POINTS_A_TASK))
    own = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid")).repartition(tasks, "pid").distinct()
    return own.select(
        "pid", (F.pmod(F.col("pid") * 7919, F.lit(100003)) * F.lit(5.0) / 100003).alias("x"),
        (F.pmod(F.col("pid") * 104729, F.lit(99991)) * F.lit(5.0) / 99991).alias("y")
    )


POINTS = "pts AS (SELECT pid, ((pid*7919)%100003)*5.0::DOUBLE/100003 AS x, ((pid*104729)%99991)*5.0::DOUBLE/99991 AS y FROM (SELECT DISTINCT l_orderkey*8+l_linenumber AS pid FROM lineitem))"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("sid"), "s_nationkey", (F.pmod(k * 7919, F.lit(100003)) * F.lit(5.0) / 100003).alias("sx"),
        (F.pmod(k * 104729, F.lit(99991)) * F.lit(5.0) / 99991).alias("sy")
    )


SITES = "sites AS (SELECT s_suppkey AS sid, s_nationkey, ((s_suppkey*7919)%100003)*5.0::DOUBLE/100003 AS sx, ((s_suppkey*104729)%99991)*5.0::DOUBLE/99991 AS sy FROM supplier)"


# Unit polygons: one cell of a 5 by 5 tiling for each nation, its side midpoints pushed off their sides.
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_id, district, name, polygons: features in the shape of wardlight.sources.features."""
    i, j = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5).cast("int")
    side_v = lambda c: F.when(c.isin(0, 5), 0.0).otherwise((F.pmod(c * 3 + j * 5, F.lit(7)) - 3) / 10.0)
    side_h = lambda r: F.when(r.isin(0, 5), 0.0).otherwise((F.pmod(i * 5 + r * 3, F.lit(7)) - 3) / 10.0)
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(
        p(i, j), p(i + 0.5, j + side_h(j)), p(i + 1, j), p(i + 1 + side_v(i + 1), j + 0.5), p(i + 1, j + 1),
        p(i + 0.5, j + 1 + side_h(j + 1)), p(i, j + 1), p(i + side_v(i), j + 0.5), p(i, j)
    )
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("feature_id"), F.col("n_regionkey").alias("district"), F.col("n_name").alias("name"),
        F.array(F.array(ring)).alias("polygons")
    )


_H = "CASE WHEN {r} IN (0,5) THEN 0.0::DOUBLE ELSE ((i*5+({r})*3)%7-3)/10.0::DOUBLE END"
_V = "CASE WHEN {c} IN (0,5) THEN 0.0::DOUBLE ELSE ((({c})*3+j*5)%7-3)/10.0::DOUBLE END"
VERTS = f"""nat AS (SELECT n_nationkey AS feature_id, n_regionkey AS district, n_name AS name, n_nationkey%5 AS i, floor(n_nationkey/5)::INT AS j FROM nation),
verts AS (SELECT feature_id, district, name, s, CASE s WHEN 0 THEN i WHEN 1 THEN i+0.5 WHEN 2 THEN i+1 WHEN 3 THEN i+1+{_V.format(c='i+1')} WHEN 4 THEN i+1 WHEN 5 THEN i+0.5 WHEN 6 THEN i ELSE i+{_V.format(c='i')} END::DOUBLE AS x,
 CASE s WHEN 0 THEN j WHEN 1 THEN j+{_H.format(r='j')} WHEN 2 THEN j WHEN 3 THEN j+0.5 WHEN 4 THEN j+1 WHEN 5 THEN j+1+{_H.format(r='j+1')} WHEN 6 THEN j+1 ELSE j+0.5 END::DOUBLE AS y FROM nat, range(8) t(s))"""
EDGES = VERTS + """, edges AS (SELECT a.feature_id, a.district, a.name, a.s AS seq, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM verts a JOIN verts b ON a.feature_id = b.feature_id AND b.s = (a.s+1)%8)"""
HITS = EDGES + ", " + POINTS + """, hits AS (SELECT pid, feature_id, any_value(district) AS district, any_value(name) AS name FROM pts JOIN edges ON (ay > y) <> (by > y) AND x < (bx-ax)*(y-ay)/(by-ay)+ax GROUP BY pid, feature_id HAVING count(*)%2 = 1)"""
