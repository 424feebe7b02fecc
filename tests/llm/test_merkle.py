"""Merkle manifests against a plain tree."""

import hashlib

import pytest

from wardlight.llm import merkle as M


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def layers(nodes):
    """All levels of a tree, from its nodes to its root."""
    out = [nodes]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([sha("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return out


def path(levels, i):
    """(siblings or None, whether on the left) of node i."""
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append((level[j] if j < len(level) else None, j < i))
        i //= 2
    return out


def plain(rows):
    """rows (doc_id, source, lang, n_chars, text) → sorted result rows of the query, and the root."""
    leaf = lambda r: sha("".join(told(v) for v in r))
    first = lambda v: (v is not None, v)
    groups = {}
    for r in sorted(rows, key=lambda r: (first(r[2] if r[2] is None else r[2].encode()), first(r[0]), leaf(r))):
        groups.setdefault(r[2], []).append(r)
    trees = [layers([leaf(r) for r in g]) for g in groups.values()]
    top = layers([t[-1][0] for t in trees]) if trees else [[None]]
    return [(r, leaf(r), trees[k][-1][0], path(trees[k], i) + path(top, k)) for k, g in enumerate(groups.values()) for i, r in enumerate(g)], top[-1][0]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank string, witness int"


def rows_of(n):
    langs = ["en"] * 6 + [None, "de", "é", ""]
    rows = [(i // 2 if i % 5 else None, "s" * (i % 3) or None, langs[i % 10] if i < n - 1 else "zz", i % 7 or None, "x\ny" * (i % 4) if i % 6 else None) for i in range(n)]
    return rows + rows[:3] * 4  # repeated rows


@pytest.mark.parametrize("n,levels", [(0, 2), (1, 2), (2, 1), (9, 1), (41, 2), (70, 3), (70, 12)])
def test_against_a_plain_tree(spark, n, levels):
    from pyspark.sql import functions as F

    rows = rows_of(n) if n else []
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)
    leaves = docs.withColumn("leaf", M.record_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    found = M.manifest(leaves.repartition(5), ["doc_id"], "lang", levels)
    assert [c for c in found.columns if c not in leaves.columns] == ["subroot", "root"]  # rank and witness are replaced
    got = found.withColumn("proof", M.witness_digest(F.col("witness"))).withColumn("folded", M.folded(F.col("leaf"), F.col("witness"))).collect()
    want, root = plain(rows)
    assert sorted((r.leaf, r.subroot, r.proof) for r in got) == sorted((leaf, sub, sha("".join(s for s, _ in p if s))) for _, leaf, sub, p in want)
    assert all(r.root == root == r.folded for r in got)
    sides = lambda p: [(s and bytes.fromhex(s), left) for s, left in p]
    assert sorted(str([(s[0] and bytes(s[0]), s[1]) for s in r.witness]) for r in got) == sorted(str(sides(p)) for *_, p in want)


def test_a_changed_record_is_told(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "s", "en", i, f"text {i}") for i in range(37)], "doc_id long, source string, lang string, n_chars long, text string")
    leaves = docs.withColumn("leaf", M.record_digest(*[F.col(c) for c in docs.columns]))
    found = M.manifest(leaves, ["doc_id"], "lang", 2)
    forged = M.record_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    assert found.where(M.folded(F.col("leaf"), F.col("witness")) == F.col("root")).count() == 37
    assert found.where(M.folded(forged, F.col("witness")) == F.col("root")).count() == 0


def test_appends_extend_open_witnesses():
    """A witness grows only when a sibling is completed: after four appends the first node knows two levels, the fifth none."""
    tree = M.OpenSubtrees()
    for i in range(5):
        tree.append(hashlib.sha256(bytes([i])).digest())
    assert [len(w) for w in tree.witness] == [2, 2, 2, 2, 0] and [o[0] for o in tree.open] == [2, 0]
    tree.root(3)
    assert [len(w) for w in tree.witness] == [3] * 5 and tree.witness[4][:2] == [(None, False)] * 2


def test_query(spark, sf, duck):
    from conftest import same

    df = M.op11_merkle_manifest(spark, sf)
    assert same(df.collect(), df.columns, duck.sql(M.OP11_SQL))
