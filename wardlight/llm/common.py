"""Helpers shared by the text operators: words, hashes, shared tables, batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
M64 = (1 << 64) - 1


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library wherever the session was started, and keeps a batch of long texts within their memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only where that is unset on a single machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared one: what cut() writes, and all that clear() deletes."""
    return f"{shared_dir(spark).rstrip('/')}/wardlight-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes every table that cut() wrote in this application; for its end, when no result is left to be computed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, so that a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it where df has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a key of each row (long), which is no column of df; written once, so that every reader sees the same keys."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def drop(df: DataFrame) -> None:
    """Deletes a table made by cut() that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of whole rows with about `limit` bytes of the text column.

    After each batch the memory that Arrow holds unused goes back, since a worker outlives its task.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = (np.cumsum(size) - size) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: word numbers, the distinct words, and row offsets. Null and blank texts have none."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), dtype=bool)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    encoded = flat.dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each distinct word, alike in every task."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in distinct.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(distinct))


def gram_hashes(hashes: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of hashes[i:i+k] for every i; the last k-1 entries are unused (0). Callers mask what crosses rows."""
    n = len(hashes)
    out = np.zeros(n, dtype=np.uint64)
    if n < k:
        return out
    back = pow(base, -1, 1 << 64)
    ups = np.full(n + 1, base, dtype=np.uint64)
    ups[0] = 1
    downs = np.full(n + 1, back, dtype=np.uint64)
    downs[0] = 1
    np.cumprod(ups, out=ups)
    np.cumprod(downs, out=downs)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * downs[:n], out=sums[1:])
    out[: n - k + 1] = mix((sums[k:] - sums[: n - k + 1]) * ups[k - 1 : n])
    return out


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each flattened element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... for each i, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each row; rows may be empty."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def spread(df: DataFrame, column: str) -> DataFrame:
    """Hash partitioning with sorted partitions, for operators that stream over groups."""
    return df.repartition(F.col(column)).sortWithinPartitions(column)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text of ASCII characters."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    turn = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce([4294967295] || {steps}, lambda a, x: {turn}), 4294967295)"
