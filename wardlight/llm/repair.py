"""Repair of conversations: the cheapest edits that make the roles alternate, by a Viterbi search in chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import crc32_sql, cut, read
from wardlight.llm.order import ranked, runs

CHUNK_BITS = 12  # a chunk holds 4,096 rows, whichever conversations they belong to
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs; the last is added for a truncated row that stays

# States of `(s?(ua)+)?`: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row; 0 and 3 may end.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
OTHER = (2, 2, 3, 2)  # where an inserted or rerolled row leads: a user row, after a user row an assistant row
ROLE = {2: "user", 3: "assistant"}
FINAL = (0, 6, 3, 0)  # the cost of ending from each state, by inserted rows
TAIL = ("", "II", "I", "")

# A row's code: its fault (0 none, 1 truncated, 2 blank, 3 duplicate), 4 times its initial (see INITIALS), and 16 where a conversation begins.
INITIALS = "sua?"
FAULTS = ("", "truncated", "blank", "duplicate")
BEGINS = 16


@cache
def step_back(after: tuple, code: int) -> tuple[tuple, int]:
    """Costs to the end from each state before a row, given those after it: less their least, and that."""
    fault, initial = code & 3, INITIALS[code >> 2 & 3]
    cost = [DELETE + x for x in after]
    if fault < 2:
        stays = TRUNCATED * (fault == 1)
        for s in range(4):
            cost[s] = min(cost[s], stays + REROLE + after[OTHER[s]])
            to = NEXT[initial][s] if initial in NEXT else None
            if to is not None:
                cost[s] = min(cost[s], stays + KEEP + after[to])
    two, three = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    cost = [min(cost[0], INSERT + two), min(cost[1], INSERT + two), two, three]
    return tuple(x - min(cost) for x in cost), min(cost)


@cache
def edits_at(after: tuple, code: int, state: int) -> tuple[str, int]:
    """The letters of the cheapest edits up to and with a row, of several the ASCII-least, and the state after it."""
    before, least = step_back(after, code)
    fault, initial = code & 3, INITIALS[code >> 2 & 3]
    stays, letters = TRUNCATED * (fault == 1), ""
    while True:
        left = before[state] + least
        if DELETE + after[state] == left:
            return letters + "D", state
        if INSERT + before[OTHER[state]] == before[state]:
            letters, state = letters + "I", OTHER[state]
            continue
        to = NEXT[initial][state] if initial in NEXT else None
        if to is not None and stays + KEEP + after[to] == left:
            return letters + "K", to
        return letters + "R", OTHER[state]


def back(codes: bytes, end: tuple) -> list[tuple]:
    """The costs after each row of a chunk, given those after its last, and before all others the costs at its beginning."""
    out, now = [end], end
    for code in reversed(codes):
        now = step_back(now, code & 15)[0]
        out.append(now)
        if code & BEGINS:
            now = FINAL
            out[-1] = FINAL  # the row before ends a conversation
    out.reverse()
    return out


def start_costs(codes: bytes, end: tuple, was: tuple | None = None, known: tuple | None = None) -> tuple:
    """The costs at a chunk's beginning; where it was computed from `was` as `known`, only until both agree."""
    for code in reversed(codes):
        if end == was:
            return known
        end = FINAL if code & BEGINS else step_back(end, code & 15)[0]
        was = was and (FINAL if code & BEGINS else step_back(was, code & 15)[0])
    return end


def exits(codes: bytes, after: list[tuple]) -> list[int]:
    """The state after a chunk, for each state before it."""
    states = [0, 1, 2, 3]
    for i, code in enumerate(codes):
        states = [edits_at(after[i + 1], code & 15, s)[1] for s in ([0] if code & BEGINS else states)]
        if len(set(states)) == 1:
            states = states[:1]
    return states if len(states) == 4 else states * 4


def coded(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) → one row a chunk: chunk, codes (a byte a row), and the conversations in it with their sizes.

    The rows' order is by turn (null first), then role, then the text's SHA-256, so that equal rows are neighbours. Texts
    take no part in it.
    """
    told = F.rtrim("text", F.lit(BLANKS))
    initial = F.when(F.col("role") == "", 3).otherwise(F.pmod(F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)) - 1, F.lit(4)))
    fault = F.when(told == "", 2).when(~F.substring(told, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    keys = turns.select("conv_id", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("said"), fault.alias("fault"), initial.alias("initial"))
    rows = cut(ranked(keys, ["conv_id", "turn", "role", "said"]).select("conv_id", "role", "said", "fault", "initial", "rank"))
    firsts = rows.groupBy("conv_id", "role", "said").agg(F.min("rank").alias("rank")).select("rank", F.lit(True).alias("new"))
    begins = rows.groupBy("conv_id").agg(F.min("rank").alias("rank")).select("rank", F.lit(BEGINS).alias("begins"))
    marked = rows.join(firsts, "rank", "left").join(begins, "rank", "left")
    fault = F.when((F.col("fault") != 2) & F.col("new").isNull(), 3).otherwise(F.col("fault"))
    code = fault + 4 * F.col("initial") + F.coalesce("begins", F.lit(0))
    chunk = F.shiftrightunsigned("rank", CHUNK_BITS).alias("chunk")
    kind = dict(turns.dtypes)["conv_id"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["chunk"]):
            codes = run.column("code").to_numpy().astype("uint8")
            first = sorted({0, *(codes & BEGINS).nonzero()[0].tolist()})
            sizes = [b - a for a, b in zip(first, [*first[1:], len(codes)], strict=True)]
            convs = run.column("conv_id").combine_chunks().take(pa.array(first))
            yield pa.RecordBatch.from_arrays(
                [
                    run.column("chunk").combine_chunks().slice(0, 1), pa.array([codes.tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), convs), pa.array([sizes], pa.list_(pa.int32()))
                ],
                names=["chunk", "codes", "convs", "sizes"]
            )

    rows = marked.select(chunk, "rank", "conv_id", code.cast("int").alias("code")).repartition("chunk").sortWithinPartitions("chunk", "rank")
    return rows.mapInArrow(gather, f"chunk long, codes binary, convs array<{kind}>, sizes array<int>")


def _with(df: DataFrame, columns: dict[str, str], f) -> DataFrame:
    """df with further columns, whose values f gives for each row as a dict."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f(**r) for r in batch.to_pylist()]
            told = [pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names if c not in columns), *told], names=[*(c for c in names if c not in columns), *columns])

    schema = ", ".join([*(f"{n} {k}" for n, k in df.dtypes if n not in columns), *(f"{n} {k}" for n, k in columns.items())])
    return df.mapInArrow(run, schema)


def settled(chunks: DataFrame) -> DataFrame:
    """chunks (chunk, codes, …) → with at_end (the costs after its last row) and told (the same, null where a conversation ends there).

    Every chunk is first run from a speculative vector, as if a conversation ended with it. A pass gives each chunk the
    costs at the next one's beginning; where they differ from those that it was run from by more than a constant, it is
    run again, until both runs differ by a constant only. Passes go on until no chunk is given other costs. Vectors are
    kept less their least, so that those that differ by a constant are equal. A pass settles the last open chunk of each
    conversation at least; rows that keep or delete make vectors equal within a few rows, so that two passes are usual.
    """
    both = {"at_end": "array<int>", "at_start": "array<int>"}
    now = cut(_with(chunks, both, lambda codes, **_: (FINAL, start_costs(codes, FINAL))))
    while True:
        later = now.where(~F.col("begins")).select((F.col("chunk") - 1).alias("chunk"), F.col("at_start").alias("told"))
        met = now.join(later, "chunk", "left")
        if met.where("told <> at_end").isEmpty():
            return met

        def again(codes, at_end, at_start, told, **_):
            new = tuple(told or at_end)
            return new, start_costs(codes, new, tuple(at_end), tuple(at_start))

        now = cut(_with(met, both, again).drop("told"))


def entered(chunks: DataFrame) -> DataFrame:
    """chunks (chunk, begins, exits) → chunk, entry: the state before its first row.

    A chunk that no conversation crosses whole leads to one state from all; through those that a conversation fills, the
    exits are composed by doubling, so that the rounds grow with the logarithm of their number.
    """
    last = chunks.select((F.col("chunk") + 1).alias("chunk"), F.col("exits").alias("by"))
    now = cut(
        chunks.select("chunk", "begins").join(last, "chunk", "left").select(
            "chunk", (F.col("chunk") - 1).alias("ref"), "by",
            F.when(F.col("begins"), 0).when(F.array_min("by") == F.array_max("by"), F.col("by")[0]).alias("entry")
        )
    )
    while not now.where("entry is null").isEmpty():
        at = now.select(F.col("chunk").alias("ref"), F.col("ref").alias("_ref"), F.col("by").alias("_by"), F.col("entry").alias("_entry"))
        met = now.where("entry is null").join(at, "ref")
        more = met.select(
            "chunk", F.col("_ref").alias("ref"), F.transform("_by", lambda s: F.element_at("by", s + 1)).alias("by"),
            F.element_at("by", F.col("_entry") + 1).alias("entry")
        )
        now = cut(now.where("entry is not null").unionByName(more))
    return now.select("chunk", "entry")


def _traced(chunks: DataFrame) -> DataFrame:
    """chunks with at_end, told and entry → conv_id, chunk, edits (letters), faults (a digit a row): a conversation's part of a chunk."""
    kind = dict(chunks.dtypes)["convs"][len("array<") : -1]

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, convs = [], []
            for i, r in enumerate(batch.select(["chunk", "codes", "sizes", "at_end", "told", "entry"]).to_pylist()):
                codes, after, state, at = r["codes"], back(r["codes"], tuple(r["at_end"])), r["entry"], 0
                for k, size in enumerate(r["sizes"]):
                    letters = []
                    state = 0 if codes[at] & BEGINS else state
                    for j in range(at, at + size):
                        more, state = edits_at(after[j + 1], codes[j] & 15, state)
                        letters.append(more)
                    at += size
                    if k + 1 < len(r["sizes"]) or r["told"] is None:
                        letters.append(TAIL[state])
                    out.append((r["chunk"], "".join(letters), "".join(str(c & 3) for c in codes[at - size : at])))
                convs.append(batch.column("convs")[i].values)
            if out:
                chunk, edits, faults = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(convs), pa.array(chunk, pa.int64()), pa.array(edits), pa.array(faults)], names=["conv_id", "chunk", "edits", "faults"]
                )

    return chunks.mapInArrow(trace, f"conv_id {kind}, chunk long, edits string, faults string")


REPAIRED = "edit string, fault string, was string, role string, text string"


def repair(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) → one row an edit, in order within its partition: conv_id, edit, fault, was, role, text.

    edit: K (keep), R (give another role), D (delete) or I (insert); was: the row's role, null for I; role and text: what
    the conversation has there, null for D, an inserted text being empty. fault: '' or the row's first of blank, duplicate
    (role and text seen earlier) and truncated. The edits are the cheapest after which the roles' initials are
    `(s?(ua)+)?`, of several the ASCII-least. Blank and duplicate rows go; an empty role and one of another initial
    cannot stay. A null role or text counts as one space, a null conv_id is a conversation, null turns come first; rows
    with equal turn are ordered by role and the text's SHA-256. An empty table gives no rows; other columns are ignored.

    The search runs in chunks of rows, whatever conversation they belong to (see settled and entered), over a byte a row.
    Texts are shuffled once, by conversation, and streamed; of a conversation the task holds its edits' letters only.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    chunks = cut(coded(clean).withColumn("begins", F.shiftright(F.conv(F.hex(F.substring("codes", 1, 1)), 16, 10).cast("int"), 4) == 1))
    known = settled(chunks)
    leads = _with(known.select("chunk", "begins", "codes", "at_end"), {"exits": "array<int>"}, lambda codes, at_end, **_: (exits(codes, back(codes, tuple(at_end))),))
    pieces = _traced(known.join(entered(leads.select("chunk", "begins", "exits")), "chunk"))
    said = F.sha2(F.col("text").cast("binary"), 256)
    none = lambda kind: F.lit(None).cast(kind)
    both = pieces.select("conv_id", "chunk", "edits", "faults", none(dict(turns.dtypes)["turn"]).alias("turn"), none("string").alias("role"), none("string").alias("said"), none("string").alias("text")).unionByName(
        clean.select("conv_id", F.lit(1 << 62).alias("chunk"), none("string").alias("edits"), none("string").alias("faults"), "turn", "role", said.alias("said"), "text")
    )
    kind = dict(turns.dtypes)["conv_id"]
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "turn", "role", "said").select(
        "conv_id", "edits", "faults", "role", "text"
    ).mapInArrow(_applied, f"conv_id {kind}, {REPAIRED}")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's edits, then its rows in order → the edited rows."""
    now, parts, edits, faults, at, row, state = object(), [], "", "", 0, 0, 0
    for batch in batches:
        out, of = [], []
        for i, (conv, more, marks, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edits", "faults", "role", "text")), strict=True)):
            if conv != now:
                now, parts, at, row, state = conv, [], 0, 0, 0
            if more is not None:
                parts.append((more, marks))
                continue
            if parts:  # the conversation's first row: all its edits have come
                edits, faults = ("".join(x) for x in zip(*parts, strict=True))
                parts = []
            last = row + 1 == len(faults)
            while True:
                edit = edits[at]
                at += 1
                if edit == "D":
                    out.append(("D", FAULTS[int(faults[row])], role, None, None))
                elif edit == "K":
                    state = NEXT[role[0]][state]
                    out.append(("K", FAULTS[int(faults[row])], role, role, text))
                else:
                    state = OTHER[state]
                    out.append(("R", FAULTS[int(faults[row])], role, ROLE[state], text) if edit == "R" else ("I", "", None, ROLE[state], ""))
                of.append(i)
                row += edit != "I"
                if edit != "I" and not last or at == len(edits):
                    break
        if out:
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(pa.array(of)), *(pa.array(c, pa.string()) for c in zip(*out, strict=True))],
                names=["conv_id", "edit", "fault", "was", "role", "text"]
            )


LEGAL = {"su", "ua", "au"}


def summed(edits: DataFrame) -> DataFrame:
    """What repair() gives, in its order → one row a conversation: counts of faults and of illegal neighbours, cost, audit, digest."""
    names = ["blank", "duplicate", "truncated"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, ids, done, kind = object(), None, [], [], None

        def close():
            ids.append(now)
            done.append((*(own[n] for n in names), own["illegal"], own["cost"], "".join(own["audit"]), own["hash"].hexdigest()))

        def told():
            ints = [pa.array([d[i] for d in done], pa.int64()) for i in range(5)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), *ints, *(pa.array([d[i] for d in done], pa.string()) for i in (5, 6))],
                names=["conv_id", *names, "illegal", "cost", "audit", "repaired_sha256"]
            )

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, edit, fault, was, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "fault", "was", "role", "text")), strict=True):
                if conv != now or own is None:
                    if own:
                        close()
                    now, own = conv, dict.fromkeys([*names, "illegal", "cost"], 0) | {"audit": [], "hash": hashlib.sha256(), "last": None, "lines": 0}
                own["audit"].append(edit)
                if fault:
                    own[fault] += 1
                own["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
                if edit != "I":
                    own["illegal"] += own["last"] is not None and own["last"] + was[:1] not in LEGAL
                    own["last"] = was[:1]
                if edit != "D":
                    own["hash"].update(("\n" * (own["lines"] > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    own["lines"] += 1
            if len(done) >= 2000:
                yield told()
                ids, done = [], []
        if own:
            close()
        if done:
            yield told()

    return edits.mapInArrow(
        add, f"conv_id {dict(edits.dtypes)['conv_id']}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with faults by crc32 of `conv_id:turn`: dropped (turn_left null), emptied, unpunctuated, repeated, or said by the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    hurt = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return hurt.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "kind"
    )


def gaps(turn: Column) -> Column:
    """How many turns are missing between the least and the greatest, as an aggregate; nulls are ignored."""
    return F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = damaged(read(spark, sf_dir, "conversations"))
    all_ = hurt.groupBy("conv_id").agg(gaps(F.when(F.col("kind") != 0, F.col("turn"))).alias("gaps"))
    left = hurt.where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    found = summed(repair(left)).withColumnRenamed("conv_id", "_conv")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", F.col("gaps").cast("long").alias("gaps"), *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )


_STAY = "CASE WHEN fault = 1 THEN 3 ELSE 0 END"
_CELLS = ", ".join(
    f"CASE WHEN fault >= 2 THEN 4 + b[{s + 1}] ELSE least(4 + b[{s + 1}], {_STAY} + 3 + b[{OTHER[s] + 1}]"
    + "".join(f", CASE WHEN r = '{r}' THEN {_STAY} + b[{to[s] + 1}] ELSE 999999999 END" for r, to in NEXT.items() if to[s] is not None) + f") END AS x{s}"
    for s in range(4)
)
_KEPT = "CASE " + " ".join(f"WHEN r = '{r}' AND s = {s} THEN {to[s]}" for r, to in NEXT.items() for s in range(4) if to[s] is not None) + " END"
_OTHER = "CASE WHEN s = 2 THEN 3 ELSE 2 END"

OP12_SQL = f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src, range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
g AS (SELECT conv_id, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0)::BIGINT AS gaps FROM (SELECT conv_id, CASE WHEN k <> 0 THEN turn END AS t FROM src) GROUP BY 1),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d),
f AS (SELECT *, CASE WHEN t = '' THEN 2 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 3 WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
  left(role, 1) AS r, count(*) OVER (PARTITION BY c) AS n, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS pr FROM o),
b AS (SELECT DISTINCT c, n + 1 AS i, [0, 6, 3, 0]::BIGINT[] AS b FROM f
  UNION ALL SELECT c, i, [least(x0, 3 + two), least(x1, 3 + two), two, three]::BIGINT[] FROM (SELECT *, least(x2, 3 + x3) AS two, least(x3, 3 + x2) AS three
   FROM (SELECT f.c, f.i, {_CELLS} FROM b JOIN f ON f.c = b.c AND f.i = b.i - 1))),
w AS (SELECT b.c, b.i, b.b AS now, a.b AS after, f.fault, f.r, f.role, f.text FROM b LEFT JOIN b a ON a.c = b.c AND a.i = b.i + 1 LEFT JOIN f ON f.c = b.c AND f.i = b.i),
e AS (SELECT c, i, 0 AS s, '' AS audit, 0::BIGINT AS cost, []::VARCHAR[] AS lines FROM b WHERE i = 1
  UNION ALL SELECT c, CASE WHEN l = 'I' THEN i ELSE i + 1 END, s2, audit || l, cost + CASE l WHEN 'K' THEN 0 WHEN 'D' THEN 4 ELSE 3 END + CASE WHEN l IN ('K', 'R') THEN {_STAY} ELSE 0 END,
   CASE l WHEN 'D' THEN lines WHEN 'K' THEN lines || [role || ':' || text] ELSE lines || [CASE s2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE l WHEN 'R' THEN text ELSE '' END] END
   FROM (SELECT *, CASE l WHEN 'D' THEN s WHEN 'K' THEN {_KEPT} ELSE {_OTHER} END AS s2 FROM (SELECT e.*, fault, r, role, text,
    CASE WHEN 4 + after[s + 1] = now[s + 1] THEN 'D' WHEN 3 + now[{_OTHER} + 1] = now[s + 1] THEN 'I' WHEN {_STAY} + after[{_KEPT} + 1] = now[s + 1] AND fault < 2 THEN 'K' ELSE 'R' END AS l
    FROM e JOIN w ON w.c = e.c AND w.i = e.i WHERE after IS NOT NULL OR s IN (1, 2)))),
done AS (SELECT e.* FROM e JOIN w ON w.c = e.c AND w.i = e.i WHERE after IS NULL AND s IN (0, 3)),
q AS (SELECT c, any_value(conv_id) AS conv_id, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
  count(*) FILTER (pr IS NOT NULL AND pr || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT g.conv_id, gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM g LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN done USING (c)
"""
