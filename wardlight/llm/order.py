"""Positions in a sorted order, without a task that sorts or holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import cut


def ranked(df: DataFrame, by: list[str], group: list[str] | None = None) -> DataFrame:
    """df with rank (from 0) and size (long) of each row in its group, ordered by `by`, and group_no, a number of the group.

    Nulls come first; rows with equal `by` are put in some order, each with its own rank. The rows are range-partitioned by
    (group, by, a number of the row), so that no key fills a task, and written once. A partition's rows of one group are a
    piece; the pieces (partitions and groups together) are counted, summed along each group, and meet the rows by
    (piece), which is never larger than a partition. Columns named rank, size, group_no or _row are replaced.
    """
    group = group or []
    keys = [F.col(c).asc_nulls_first() for c in [*group, *by]]
    spread = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row")
    rows = cut(spread.withColumn("_row", F.monotonically_increasing_id()))  # now the partition's number and the place in it
    part = F.shiftrightunsigned("_row", 33)
    pieces = rows.groupBy(part.alias("_part"), *group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    told = pieces.select(
        F.col("_part"), *[F.col(c).alias(f"_of_{c}") for c in group], "_first", F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_n").over(own).alias("_size"), F.min("_first").over(own).alias("_group_no")
    )
    met = part == F.col("_part")
    for c in group:
        met = met & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    others = [c for c in df.columns if c not in ("rank", "size", "group_no", "_row")]
    return rows.join(told, met).select(
        *others, (F.col("_before") + F.col("_row") - F.col("_first")).alias("rank"), F.col("_size").alias("size"), F.col("_group_no").alias("group_no")
    )


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys (numbers), which may begin in one batch and end in another."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(k).to_numpy() for k in keys])
        edges = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(own[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
