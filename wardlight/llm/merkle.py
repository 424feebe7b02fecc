"""Merkle manifests: a root over all records, and for each record the witness that leads to it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import crc32_sql, cut, read
from wardlight.llm.order import ranked, runs

BLOCK_LEVELS = 12  # a block is an aligned subtree of at most 4,096 nodes
STEP = pa.struct([("sibling", pa.binary()), ("left", pa.bool_())])


def record_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values, each `-` if null, else its UTF-8 byte count, a colon and itself; numbers are decimal."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def _joined(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class OpenSubtrees:
    """Nodes appended from left to right: the open subtrees, largest first, and each appended node's witness so far.

    An append closes every subtree whose sibling it completes; a completion extends the witnesses of both sides' nodes by
    the digest of the other side. A witness is the list of (sibling, whether it is on the left), one for each level, and
    (None, False) where a node is alone in its run.
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, int, int]] = []  # level, digest, first node, node after the last
        self.witness: list[list[tuple[bytes | None, bool]]] = []

    def append(self, digest: bytes) -> None:
        at = len(self.witness)
        self.witness.append([])
        node = (0, digest, at, at + 1)
        while self.open and self.open[-1][0] == node[0]:
            node = self._completed(self.open.pop(), node)
        self.open.append(node)

    def _completed(self, left: tuple, right: tuple) -> tuple:
        for w in self.witness[left[2] : left[3]]:
            w.append((right[1], False))
        for w in self.witness[right[2] : right[3]]:
            w.append((left[1], True))
        return left[0] + 1, _joined(left[1], right[1]), left[2], right[3]

    def root(self, levels: int) -> bytes:
        """Closes what is open up to `levels` above the nodes; a subtree without a sibling goes up alone."""
        node = self.open.pop()
        while node[0] < levels:
            if self.open and self.open[-1][0] == node[0]:
                node = self._completed(self.open.pop(), node)
                continue
            for w in self.witness[node[2] : node[3]]:
                w.append((None, False))
            node = (node[0] + 1, _joined(node[1]), node[2], node[3])
        self.open = [node]
        return node[1]


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (…, group_no, rank, size, digest) → with block, witness within the block, and top: the block's root, on its first row."""

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["group_no", "block"]):
            tree = OpenSubtrees()
            for digest in run.column("digest").to_pylist():
                tree.append(digest)
            root = tree.root(min(levels, (run.column("size")[0].as_py() - 1).bit_length()))
            ends = np.cumsum([0, *map(len, tree.witness)])
            flat = [step for w in tree.witness for step in w]
            steps = pa.StructArray.from_arrays(
                [pa.array([s for s, _ in flat], pa.binary()), pa.array([left for _, left in flat], pa.bool_())], fields=list(STEP)
            )
            told = run.append_column("witness", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps))
            yield from told.append_column("top", pa.array([root, *[None] * (run.num_rows - 1)], pa.binary())).combine_chunks().to_batches()

    keyed = nodes.withColumn("block", F.shiftrightunsigned("rank", levels))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    return keyed.repartition("group_no", "block").sortWithinPartitions("group_no", "block", "rank").mapInArrow(
        append, f"{schema}, witness array<struct<sibling:binary,left:boolean>>, top binary"
    )


def witnesses(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """nodes (…, group_no, rank, size, digest binary) → with witness, from the node to its group's root, and root.

    The nodes of a group, in order of rank, are appended in aligned blocks of 2 ** levels, each within a task whatever the
    group's size; the blocks' roots are appended in turn, as nodes of the next round, until a group has one. A block's
    later witness extends those of all its nodes.
    """
    inner = cut(_blocks(nodes, levels))
    tops = inner.where("top is not null").select(
        "group_no", F.col("block").alias("rank"), F.expr(f"shiftright(size + {(1 << levels) - 1}, {levels})").alias("size"), F.col("top").alias("digest")
    )
    if tops.where("size > 1").isEmpty():  # each group is a block
        upper = tops.select("group_no", "rank", F.array().cast("array<struct<sibling:binary,left:boolean>>").alias("later"), F.col("digest").alias("root"))
    else:
        upper = witnesses(tops, levels).select("group_no", "rank", F.col("witness").alias("later"), "root")
    met = inner.drop("top").join(upper.withColumnRenamed("rank", "block"), ["group_no", "block"])
    return met.withColumn("witness", F.concat("witness", "later")).drop("later", "block")


def folded(digest: Column, witness: Column) -> Column:
    """The root that a digest (lowercase hex) and its witness lead to."""
    def up(now: Column, step: Column) -> Column:
        sibling = F.coalesce(F.lower(F.hex(step["sibling"])), F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(sibling, now)).otherwise(F.concat(now, sibling)).cast("binary"), 256)

    return F.aggregate(witness, digest, up)


def witness_digest(witness: Column) -> Column:
    """Lowercase hex SHA-256 of a witness's siblings, as hex text, from the leaf to the root."""
    told = F.transform(F.filter(witness, lambda s: s["sibling"].isNotNull()), lambda s: F.lower(F.hex(s["sibling"])))
    return F.sha2(F.array_join(told, "").cast("binary"), 256)


def manifest(leaves: DataFrame, by: list[str], group: str, levels: int = BLOCK_LEVELS) -> DataFrame:
    """leaves (leaf: lowercase hex, group, …) → with subroot, root and witness (from the leaf via its subroot to the root).

    A group's leaves ascend by `by` (nulls first; rows with equal `by`, by leaf), a lone leaf being its own subroot; the
    subroots ascend by group (null first, UTF-8 bytewise). A null group is a group. Repeated rows are leaves of their own;
    an empty table gives an empty one; columns named witness, root, subroot, rank, size, group_no, digest, block or top are
    replaced.

    Leaves are sorted once, without their texts, and meet their block by a balanced shuffle: no group or key fills a task.
    """
    own = [c for c in leaves.columns if c not in ("witness", "root", "subroot", "rank", "size", "group_no", "digest", "block", "top")]
    placed = ranked(leaves.select(*own), [*by, "leaf"], [group]).withColumn("digest", F.unhex("leaf"))
    inner = cut(witnesses(placed, levels))
    subroots = inner.where("rank = 0").select(F.col(group).alias("_group"), F.col("group_no").alias("_no"), F.col("root").alias("_subroot"))
    tops = witnesses(ranked(subroots.withColumn("digest", F.col("_subroot")), ["_group"]), levels)
    later = tops.select("_no", F.col("witness").alias("_later"), F.col("root").alias("_root"))
    size = F.shiftrightunsigned("rank", levels)  # a group of any size meets its subroot in parts
    parts = inner.groupBy("group_no", size.alias("_part")).agg(F.count("*").alias("_n")).join(later, F.col("group_no") == F.col("_no")).drop("_n", "_no")
    met = inner.withColumn("_part", size).join(parts, ["group_no", "_part"])
    hexed = lambda c: F.lower(F.hex(c))
    return met.select(*own, hexed("root").alias("subroot"), hexed("_root").alias("root"), F.concat("witness", "_later").alias("witness"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    told = lambda n: record_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select(
        "doc_id", "lang", told(F.col("n_chars")).alias("leaf"), F.when(tampered, told(F.try_add("n_chars", F.lit(1)))).alias("forged")
    )
    found = manifest(leaves, ["doc_id"], "lang")
    out = found.select(
        "doc_id", "leaf", "subroot", "root", witness_digest(F.col("witness")).alias("proof_sha256"),
        folded(F.coalesce("forged", "leaf"), F.col("witness")).alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_H = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_H.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT *, {crc32_sql('doc_id::VARCHAR')} AS crc FROM documents),
l AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf,
  CASE WHEN crc % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS forged FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
  dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM l),
t AS (SELECT tree, 0 AS level, pos, n, leaf AS h FROM r
  UNION ALL SELECT tree, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, level, pos // 2),
s AS (SELECT tree AS pos, h, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, h FROM s
  UNION ALL SELECT level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2),
steps AS (SELECT r.tree, r.pos, t.level, b.h AS sibling, b.pos < t.pos AS on_left FROM r JOIN t ON t.tree = r.tree AND t.pos = r.pos // (1 << t.level) AND t.n > 1
   LEFT JOIN t b ON b.tree = t.tree AND b.level = t.level AND b.pos = xor(t.pos, 1)
  UNION ALL SELECT r.tree, r.pos, 1000 + u.level, b.h, b.pos < u.pos FROM r JOIN u ON u.pos = r.tree // (1 << u.level) AND u.n > 1
   LEFT JOIN u b ON b.level = u.level AND b.pos = xor(u.pos, 1)),
w AS (SELECT tree, pos, list(coalesce(CASE WHEN on_left THEN sibling END, '') ORDER BY level) AS lefts,
  list(coalesce(CASE WHEN NOT on_left THEN sibling END, '') ORDER BY level) AS rights, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof FROM steps GROUP BY 1, 2),
f AS (SELECT tree, pos, forged AS h, 1 AS k, coalesce(lefts, []) AS lefts, coalesce(rights, []) AS rights FROM r LEFT JOIN w USING (tree, pos)
  UNION ALL SELECT tree, pos, sha256(lefts[k] || h || rights[k]), k + 1, lefts, rights FROM f WHERE k <= len(lefts))
SELECT r.doc_id, r.leaf, s.h AS subroot, top.h AS root, coalesce(w.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = top.h AS verified
FROM r JOIN s ON s.pos = r.tree CROSS JOIN (SELECT h FROM u WHERE n = 1) top LEFT JOIN w ON w.tree = r.tree AND w.pos = r.pos
 JOIN f ON f.tree = r.tree AND f.pos = r.pos AND f.k = len(f.lefts) + 1
"""
