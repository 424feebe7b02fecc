"""Conversation repair against all edit scripts, with chunks so short that conversations cross many."""

import hashlib
import random
from functools import cache

import pytest

from wardlight.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = set(" \t\n\x0b\x0c\r")


def plain(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = [c for c in text if c not in BLANK]
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, last, inserted):
        """Least (cost, audit, lines) of what is left, after a row of that initial; at most three rows are inserted running."""
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        put = lambda cost, letter, line, rest: found.append((cost + rest[0], letter + rest[1], (line, *rest[2]) if line else rest[2]))
        new = {"u": "user", "a": "assistant"}
        if inserted < 3:
            for x in "ua":
                if (last, x) in legal:
                    put(3, "I", f"{new[x]}:", best(i, x, inserted + 1))
        if i < len(rows):
            _, role, text = rows[i]
            put(4, "D", None, best(i + 1, last, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if (last, role[:1]) in legal:
                    put(more, "K", f"{role}:{text}", best(i + 1, role[:1], 0))
                for x in "ua":
                    if (last, x) in legal:
                        put(3 + more, "R", f"{new[x]}:{text}", best(i + 1, x, 0))
        return min(found) if found else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(spark, rows):
    found = {r[0]: tuple(r)[1:] for r in R.summed(R.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()}
    groups = {}
    for conv, *r in rows:
        groups.setdefault(conv, []).append(tuple(r))
    assert found == {c: plain(g) for c, g in groups.items()}


def drawn(seed, n, roles, texts):
    rnd = random.Random(seed)
    return [(rnd.choice(texts) + str(rnd.randrange(9)) * rnd.randrange(2) + rnd.choice(["", ".", " "]), rnd.choice(roles)) for _ in range(n)]


@pytest.mark.parametrize("bits", [1, 12])
def test_against_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(R, "CHUNK_BITS", bits)
    rows = []
    for conv in range(40):
        for i, (text, role) in enumerate(drawn(conv, conv % 9, ["user", "assistant", "user", "assistant", "system", "tool", ""], ["Yes", "no!", "", "é?"])):
            rows.append((conv or None, None if conv % 7 == i else i // (1 + conv % 2), role if (conv + i) % 11 else None, text if (conv + i) % 13 else None))
    rows += [(100, i, ["user", "assistant"][i % 2], f"Well {i}.") for i in range(45)]  # nothing to repair
    rows += [(101, i, "tool", f"Well {i}.") for i in range(14)]  # every row gets another role, so that vectors never agree
    rows += [(102, 3, "user", "again")] * 20 + [(103, i, "user", " ") for i in range(11)]  # repeated and blank rows
    check(spark, rows)


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.summed(R.repair(none)).count() == 0
    more = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x", 7)], SCHEMA + ", chunk long, codes string, rank int")
    assert [tuple(r) for r in R.repair(more).collect()] == [(1, "K", "", "user", "user", "Hi."), (1, "I", "", None, "assistant", "")]


def test_speculation_is_mended():
    """From a wrong vector at the chunk's end its beginning is right, but for a constant, once rows have made them equal."""
    codes = bytes([0 + 4 * (1 + i % 2) for i in range(30)])
    right, wrong = (6, 6, 3, 0), R.FINAL
    assert R.start_costs(codes, right) == R.start_costs(codes, right, wrong, R.start_costs(codes, wrong)) == R.back(codes, right)[0]


def test_query(spark, sf, duck):
    from conftest import same

    df = R.op12_conversation_repair(spark, sf)
    assert same(df.collect(), df.columns, duck.sql(R.OP12_SQL))
