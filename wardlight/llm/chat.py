"""Chat formatting: a state machine over roles and a declarative template with a loss flag for each segment."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import read


@dataclass(frozen=True)
class Turn:
    """How a role's turn is written, and whether its text bears loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """start: written before a conversation. turns: by role; at most one role has an empty `before` and is told by its `after`.
    other: for roles without a turn of their own, {} being the role's name. order: state → role → next state."""

    start: str = "<s>"
    turns: dict = field(
        default_factory=lambda: {"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("", "</s>", True)}
    )
    other: tuple = ("[ROLE]", "[/ROLE]", "[/TURN]")
    order: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"},
            "assistant": {"user": "user"}
        }
    )
    final: tuple = ("assistant",)

    def controls(self) -> list[str]:
        found = {self.start, *self.other, *(x for t in self.turns.values() for x in (t.before, t.after))}
        return sorted(found - {""}, key=lambda x: (-len(x), x))

    def escape(self, text: str) -> str:
        """A backslash before each control string and each backslash."""
        return re.sub("|".join(map(re.escape, ["\\", *self.controls()])), r"\\\g<0>", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) pieces of one turn; markers never bear loss."""
        turn = self.turns.get(role)
        if turn is None:
            a, b, c = self.other
            return [(a + self.escape(role) + b, False), (self.escape(text), False), (c, False)]
        return [(turn.before, False)] * bool(turn.before) + [(self.escape(text), turn.loss), (turn.after, False)]

    def parse(self, text: str) -> list[tuple[str, str]]:
        """(role, text) turns of a formatted conversation, from its characters alone."""
        heads = {t.before: (r, t.after) for r, t in self.turns.items() if t.before}
        tails = {t.after: r for r, t in self.turns.items() if not t.before}
        scan = re.compile("(?s)" + "|".join([r"\\.", *map(re.escape, self.controls())]))
        out, at, role, close, begun = [], 0, None, None, False
        for m in scan.finditer(text):
            mark = m.group()
            if mark[0] == "\\":
                continue
            if not begun:
                if mark != self.start or m.start():
                    raise ValueError("a conversation starts with its start marker")
                begun = True
            elif close is None and mark in heads:
                role, close = heads[mark]
            elif close is None and mark == self.other[0]:
                role, close = None, self.other[1]
            elif mark == close and mark == self.other[1]:
                role, close = self.unescape(text[at : m.start()]), self.other[2]
            elif mark == close or close is None and mark in tails:
                out.append((role if close else tails[mark], self.unescape(text[at : m.start()])))
                role, close = None, None
            else:
                raise ValueError(f"{mark} is out of place")
            at = m.end()
        if at != len(text):
            raise ValueError("text after the last turn")
        return out


SEGMENTS = "turn_no long, segment_no long, segment string, loss boolean, state string, valid boolean"


def format_chats(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) → one row per segment, in order within its partition.

    A conversation is its rows by turn; rows with equal turn are ordered by role and text, and repeated rows are turns
    of their own. A null text or role is empty. A role that the template does not know is written with its name.
    state is the machine's state after the turn, `error` from the first turn out of order on; valid, on a turn's rows,
    says whether the conversation could end there. Every conversation is written, valid or not, and reads back exactly.
    An empty table gives no rows; other columns are ignored. A null conv_id is a conversation of its own; ids may be of
    any type that sorts.

    One shuffle by conv_id; a task streams over its sorted rows and holds one record batch, so that a conversation of
    any length is written in bounded memory. Conversations are never split over tasks: their order is the result.
    """
    template = template or ChatTemplate()
    schema = pa.schema(
        [
            ("turn_no", pa.int64()), ("segment_no", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("state", pa.string()),
            ("valid", pa.bool_())
        ]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, turn_no, segment_no = object(), "start", 0, 0
        for batch in batches:
            rows, of = [], []
            for i, (conv, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)):
                if conv != now:
                    now, state, turn_no, segment_no = conv, "start", 0, 0
                    pieces = [(template.start, False)]
                else:
                    pieces = []
                state = template.order.get(state, {}).get(role, "error")
                for piece, loss in [*pieces, *template.segments(role, text)]:
                    rows.append((turn_no, segment_no, piece, loss, state, state in template.final))
                    of.append(i)
                    segment_no += 1
                turn_no += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv_id").take(pa.array(of)),
                        *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True))
                    ],
                    names=["conv_id", *schema.names]
                )

    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        write, f"conv_id {dict(turns.dtypes)['conv_id']}, {SEGMENTS}"
    )


def read_chats(segments: DataFrame, template: ChatTemplate | None = None, in_order: bool = False) -> DataFrame:
    """Segments → one row per conversation: what its formatted text and loss mask give back. A task holds one conversation at a time.

    Segments are those of format_chats, whose texts are not null; an empty table gives no rows, other columns are ignored,
    and a null conv_id is a conversation of its own. Conversations whose segments repeat, or do not read as turns by the
    template, raise.
    in_order: the rows come straight from format_chats; else they are dealt out and sorted by conv_id and segment_no.
    """
    template = template or ChatTemplate()
    out = pa.schema(
        [
            ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()), ("valid", pa.bool_())
        ]
    )

    def close(pieces, valid):
        text = "".join(p for p, _ in pieces)
        turns = template.parse(text)
        told = [template.unescape(p) for p, loss in pieces if loss]
        digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        return (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, told)), digest("".join(told)), len(text), valid)

    def told(ids, done, kind):
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), *(pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out, strict=True))],
            names=["conv_id", *out.names]
        )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, valid, ids, done, kind = object(), [], False, [], [], None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, piece, loss, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "valid")), strict=True):
                if conv != now:
                    if pieces:
                        ids.append(now)
                        done.append(close(pieces, valid))
                    now, pieces = conv, []
                pieces.append((piece, loss))
                valid = ok
            if len(done) >= 2000:
                yield told(ids, done, kind)
                ids, done = [], []
        if pieces:
            ids.append(now)
            done.append(close(pieces, valid))
        if done:
            yield told(ids, done, kind)

    if not in_order:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment_no")
    return segments.mapInArrow(
        check,
        f"conv_id {dict(segments.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read_chats(format_chats(turns.unionByName(own)), in_order=True).drop("valid")


OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, regexp_replace(text, '(\\|<</SYS>>|<<SYS>>|\[/INST\]|\[/ROLE\]|\[/TURN\]|\[INST\]|\[ROLE\]|</s>|<s>)', '\\\1', 'g') AS esc FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(esc) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 20 + length(role) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
