"""Benchmark decontamination: a generalised suffix automaton of the test items, walked by every training text."""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import cut, free_name, numbered, read, slices

#: Bytes of words: digits, letters, and everything outside ASCII; A-Z become a-z and the other bytes a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; every item is added from the root. Built once, then packed.

    step[s]: word → state; size[s]: the longest string of state s; link[s]: its suffix link. For windows of `width`
    words (or a whole shorter item) exact[s] has the windows of state s, up[s] the nearest such state on the link path.
    """

    def __init__(self, items: Sequence[tuple[str | None, list[bytes]]], width: int):
        self.width, self.words = width, {}
        self.step, self.link, self.size = [{}], [-1], [0]
        self.marks: dict[tuple[int, int], set[str]] = {}  # state and length of a window → its items
        paths = []
        for item, words in items:
            if words:
                ids = [self.words.setdefault(w, len(self.words)) for w in words]
                self._add(ids)
                paths.append((item, ids))
        for item, ids in paths:
            self._mark(item, ids)
        self._windows()

    def _add(self, ids: list[int]) -> None:
        step, link, size, last = self.step, self.link, self.size, 0
        for w in ids:
            if w in step[last]:
                q = step[last][w]
                if size[q] != size[last] + 1:
                    q = self._clone(last, w, q)
                last = q
                continue
            cur = len(step)
            step.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in step[p]:
                step[p][w] = cur
                p = link[p]
            if p != -1:
                q = step[p][w]
                link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.step)
        self.step.append(dict(self.step[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    def _mark(self, item: str | None, ids: list[int]) -> None:
        """Marks the states of the item's windows: those that hold a string of exactly the window's length."""
        width = min(self.width, len(ids))
        state = 0
        for i, w in enumerate(ids):
            state = self.step[state][w]
            if i + 1 < width:
                continue
            s = state
            while self.size[self.link[s]] >= width:
                s = self.link[s]
            self.marks.setdefault((s, width), set()).update(() if item is None else (item,))

    def _windows(self) -> None:
        by_state: dict[int, list[tuple[int, set]]] = {}
        for (s, width), items in self.marks.items():
            by_state.setdefault(s, []).append((width, items))
        #: exact[s]: windows that end at s, in the state that holds them, the shortest first; a match must be that long.
        self.exact = [tuple(sorted((w, tuple(sorted(i))) for w, i in by_state.get(s, ()))) for s in range(len(self.step))]
        order = sorted(range(len(self.step)), key=lambda s: self.size[s])
        self.up = [0] * len(self.step)  # the nearest state on the link path, itself included, with windows
        for s in order:
            self.up[s] = s if self.exact[s] else self.up[self.link[s]] if s else 0

    def packed(self) -> PackedAutomaton:
        begin, word, to = array("i", [0]), array("i"), array("i")
        for step in self.step:
            for w in sorted(step):
                word.append(w)
                to.append(step[w])
            begin.append(len(word))
        exact = {s: e for s, e in enumerate(self.exact) if e}
        return PackedAutomaton(self.words, self.step[0], begin, word, to, array("i", self.link), array("i", self.size), array("i", self.up), exact)


@dataclass
class PackedAutomaton:
    """The automaton as flat arrays: the transitions of state s are at begin[s] to begin[s + 1], sorted by word.

    About 8 bytes a transition and 16 a state, next to the dictionary of words; it is broadcast, and a worker holds one.
    """

    words: dict[bytes, int]
    root: dict[int, int]
    begin: array
    word: array
    to: array
    link: array
    size: array
    up: array
    exact: dict[int, tuple]

    def scan(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Word spans [a, b) of windows that occur in a text, the items they come from, and the longest match.

        ids: numbers of the text's words, -1 for a word of no item. The state's match length follows the text.
        """
        root, begin, word, to, link, size, up, exact = self.root, self.begin, self.word, self.to, self.link, self.size, self.up, self.exact
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = length = most = 0
        for i, w in enumerate(ids):
            if w < 0:
                state = length = 0
                continue
            while state:
                end = begin[state + 1]
                at = bisect_left(word, w, begin[state], end)
                if at < end and word[at] == w:
                    state, length = to[at], length + 1
                    break
                state = link[state]
                length = size[state]
            else:
                state = root.get(w, 0)
                length = 1 if state else 0
            if length > most:
                most = length
            s = up[state]
            while s:
                for width, owners in exact[s]:
                    if width <= length:
                        spans.append((i + 1 - width, i + 1))
                        items.update(owners)
                s = up[link[s]]
        return spans, items, most


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(items: DataFrame, max_bytes: int, width: int) -> Iterator[Broadcast]:
    """An automaton of each shard of the items, broadcast as bytes; a shard has max_bytes / 2 of text on average, or one longer item.

    The automata are built by the executors, a shard in a task, and written to the shared folder; their bytes come to the
    driver one after the other, which neither builds nor unpacks any.
    """
    own = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // max(1, max_bytes // 2)))
    send = items.sparkSession.sparkContext.broadcast

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def built() -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[0] is None, r[0] or "", r[1]))
            auto = SuffixAutomaton([(item, normal_words(text)) for item, text in rows], width).packed()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pickle.dumps(auto)], pa.binary())], names=["shard", "automaton"])

        for batch in batches:
            for shard, item, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "item_id", "text")), strict=True):
                if shard != now:
                    if rows:
                        yield built()
                    now, rows = shard, []
                rows.append((item, text))
        if rows:
            yield built()

    dealt = own.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    table = cut(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, automaton binary"))
    for part in range(parts):
        found = table.where(F.col("shard") == part).select("automaton").first()
        if found or not part:
            yield send(bytes(found[0]) if found else pickle.dumps(SuffixAutomaton([], width).packed()))


_LAST: list = []


def _unpacked(shared: Broadcast) -> PackedAutomaton:
    """A broadcast automaton, unpacked once a worker: it holds the last one only."""
    raw = shared.value
    if not _LAST or _LAST[0] is not raw:
        _LAST[:] = [raw, pickle.loads(raw)]
    return _LAST[1]


def contaminated_spans(docs: DataFrame, shared: Broadcast, key: str = "doc_id", hits_only: bool = False) -> DataFrame:
    """docs (key, text) → key, n_words, spans of words hit, items, longest_match by one shard: one row per document, or per document with a hit."""
    id_type = dict(docs.dtypes)[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _unpacked(shared)
        number = auto.words.get
        for batch in slices(batches, limit=4 << 20):
            n, spans, found, most = [], [], [], []
            for raw in pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist():
                words = raw.translate(TABLE).split()
                hits, who, longest = auto.scan([number(w, -1) for w in words])
                n.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in unite(hits)])
                found.append(sorted(who))
                most.append(longest)
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(found, pa.list_(pa.string())),
                    pa.array(most, pa.int64())
                ],
                names=[key, "n_words", "spans", "items", "longest_match"]
            )
            yield out.filter(pa.array([bool(x) for x in spans])) if hits_only else out

    return docs.select(key, "text").mapInArrow(
        scan, f"`{key}` {id_type}, n_words long, spans array<struct<a:long,b:long>>, items array<string>, longest_match long"
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, max_bytes: int = 8 << 20) -> DataFrame:
    """docs (doc_id, text) × items (item_id, text) → doc_id, n_words, spans of words hit, items, longest_match: one row per input row.

    Words are runs of ASCII letters and digits and of anything outside ASCII, A-Z lower-cased. A window is `width`
    consecutive words of an item, or the whole of a shorter item; a word inside an occurrence of a window is hit.
    A shard of items has max_bytes / 2 of text on average; its automaton is built once, in a task, and broadcast. More
    items give more shards, each a pass over the documents; the results of a row meet by a key of its own, so that they
    do not depend on the number of shards.

    Null and blank texts have no words and no hits; repeated rows and ids have a row each; items without words and an
    empty benchmark hit nothing, and no documents give no rows. Rows with one item_id and different texts count as one
    item; items without an id hit words, and are not among the items told. Ties cannot arise. Texts are never cut; other
    columns are not read.
    """
    shards = _shards(items, max_bytes, width)
    first, second = next(shards), next(shards, None)
    if second is None:
        return contaminated_spans(docs, first)
    rows = numbered(docs.select("doc_id", "text"))
    return rows.select("row", "doc_id").join(_row_spans(rows, [first, second], shards, "row"), "row").drop("row")


def _row_spans(rows: DataFrame, begun: list[Broadcast], shards: Iterator[Broadcast], key: str) -> DataFrame:
    """contaminated_spans of all shards together, by row: of all but the first shard only what is hit."""
    found = contaminated_spans(rows, begun[0], key)
    for shard in chain(begun[1:], shards):
        found = found.unionByName(contaminated_spans(rows, shard, key, hits_only=True))
    told = [
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest_match").alias("longest_match")
    ]
    return found.groupBy(key).agg(*told)


def hit_count(spans: Column) -> Column:
    """Words in the union of spans that may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, max_coverage: float = 0.5, max_bytes: int = 8 << 20) -> DataFrame:
    """docs with spans of test items of `width` words or more cut out; documents with more than max_coverage of their words hit are dropped.

    Documents without a hit are returned as they are, null and blank texts too; a cut leaves the characters between the
    remaining words. Each row is judged by its own text, whether its id is null or repeated, and alike for any number of
    shards (see contamination). Columns of docs are kept, whatever their names; n_chars, where there is one, follows the text.
    """
    schema, names = docs.schema, docs.columns
    shards = _shards(items, max_bytes, width)
    first, second = next(shards), next(shards, None)
    alone = second is None
    key, told = free_name(docs, "row"), free_name(docs, "spans")
    if not alone:  # a pass for each shard of items finds the spans, which then meet their documents
        rows = numbered(docs, key)
        spans = _row_spans(rows, [first, second], shards, key).select(key, F.col("spans").alias(told))
        docs = rows.join(spans.where(F.size(told) > 0), key, "left").select(*names, told)
    shared = first if alone else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _unpacked(shared) if alone else None
        for batch in slices(batches, limit=4 << 20):
            keep, texts, changed = [], [], False
            known = [None] * batch.num_rows if alone else batch.column(told).to_pylist()
            for raw, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), known, strict=True):
                plain = (raw or b"").translate(TABLE)
                words = plain.split()
                spans = unite(auto.scan([auto.words.get(w, -1) for w in words])[0] if alone else [(x["a"], x["b"]) for x in found or ()])
                hit = sum(b - a for a, b in spans)
                keep.append(not words or hit <= max_coverage * len(words))
                if hit and keep[-1]:
                    raw, changed = _without(raw, plain, words, spans), True
                texts.append(raw)
            batch = batch.select(names)
            if changed:
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.schema.field(at).type))
            yield batch.filter(pa.array(keep))

    out = docs.mapInArrow(clean, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def _without(raw: bytes, plain: bytes, words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    """raw without the bytes from the first to the last word of each span."""
    starts, at = [], 0
    for w in words:
        at = plain.index(w, at)
        starts.append(at)
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : starts[a]])
        last = starts[b - 1] + len(words[b - 1])
    return b"".join([*out, raw[last:]])


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = hit_count(F.col("spans"))
    ids = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"),
        (hit > 0).alias("contaminated")
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS k, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i+1:i+k], ' ') AS g FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, w, unnest(range(len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, i, dw.k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i+1:i+k], ' ') AS g FROM dw) dw JOIN win ON dw.k = win.k AND dw.g = win.g),
n AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_hit FROM (SELECT doc_id, i, unnest(range(k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
