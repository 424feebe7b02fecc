"""Substring dedup: recurring passages confirmed by content-chosen phrases and located by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import cut, drop, gram_hashes, ragged, read, row_of, row_sums, slices, word_hashes, words_of

WINDOW = 50
PHRASE = 8  # words of a phrase; any WINDOW words hold at least one phrase chosen by their content alone
PER_SALT = 500  # documents with one phrase that one group of a round takes
BUCKETS = 1_024  # of a phrase's window hashes at most, when the salts' winners meet
BLOCK = 4 << 20  # bytes of text that share one automaton
DIGITS = 32  # of an automaton's letters; a node's children are searched one by one, so they must be few


def sliding(values: np.ndarray, width: int, fold) -> np.ndarray:
    """fold over values[i:i+width] for every i with a whole window, in about log2(width) passes."""
    have, out = 1, values
    while 2 * have <= width:
        out, have = fold(out[:-have], out[have:]), 2 * have
    if have < width:
        out = fold(out[: len(values) - width + 1], out[width - have : width - have + len(values) - width + 1])
    return out


def window_phrases(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of WINDOW words within a row: its start, and the start of the least-hashed phrase in it (the first such)."""
    n = len(hashes)
    starts = np.arange(n)
    fits = starts + WINDOW <= offsets[1:][row_of(offsets)] if n else np.zeros(0, bool)
    if not fits.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_hashes(hashes, PHRASE)[: n - PHRASE + 1]
    span = WINDOW - PHRASE + 1
    low = sliding(grams, span, np.minimum)
    windows = starts[fits]
    least = low[windows]
    at = windows.copy()
    todo = np.arange(len(windows))
    for step in range(span):  # most windows share their predecessor's phrase
        hit = grams[windows[todo] + step] == least[todo]
        at[todo[hit]] = windows[todo[hit]] + step
        todo = todo[~hit]
        if not len(todo):
            break
    return windows, at


def _base(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, h: hash of text, text): words, digest of the word sequence, and the phrases chosen in its windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            words, distinct, offsets = words_of(batch.column("text"))
            hashes = word_hashes(distinct)[words]
            raw = distinct.cast(pa.binary()).to_pylist()
            at = words.tolist()
            digests = [
                hashlib.sha256(b" ".join([raw[i] for i in at[a:b]])).digest() for a,
                b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            ]
            _, chosen = window_phrases(hashes, offsets)
            chosen = np.unique(chosen)
            rows, grams = row_of(offsets)[chosen], gram_hashes(hashes, PHRASE)[chosen]
            order = np.lexsort((grams, rows))
            chosen, rows, grams = chosen[order], rows[order], grams[order]
            if len(chosen):  # a phrase once a row
                fresh = np.concatenate([[True], (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])])
                chosen, rows, grams = chosen[fresh], rows[fresh], grams[fresh]
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]).astype(np.int32)
            written = pa.array([b" ".join([raw[i] for i in at[p : p + PHRASE]]) for p in chosen.tolist()], pa.binary()).cast(pa.string())
            pairs = pa.StructArray.from_arrays([pa.array(grams.view(np.int64)), written], names=["phrase", "words"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("h"), batch.column("size"), pa.array(np.diff(offsets)),
                    pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pairs)
                ],
                names=["doc_id", "h", "size", "n_words", "digest", "phrases"]
            )

    id_type = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    return own.mapInArrow(scan, f"doc_id {id_type}, h long, size long, n_words long, digest binary, phrases array<struct<phrase:long,words:string>>")


class _Phrases:
    """An Aho-Corasick automaton over phrases of words, each word being a number of as many digits as are needed.

    First digits are letters of their own, so that matches begin at words.
    """

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self.told: dict[int, tuple[int, list[int]]] = {}
        self.automaton = None

    def add(self, phrase: int, salts: int, words: bytes) -> None:
        if phrase not in self.told:
            self.told[phrase] = salts, [self.codes.setdefault(w, len(self.codes)) for w in words.split(b" ")]

    def letters(self, numbers: np.ndarray) -> str:
        """A row of digits for each number, or of a letter of its own for -1."""
        own = np.empty((len(numbers), self.width), np.uint32)
        for k in range(self.width):
            own[:, k] = numbers // DIGITS ** (self.width - 1 - k) % DIGITS + 0x30 + DIGITS * (k == 0)
        own[numbers < 0] = 0x20
        return own.tobytes().decode("utf-32-le")

    def compile(self) -> None:
        import ahocorasick

        self.width = 1
        while DIGITS**self.width < len(self.codes):
            self.width += 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        each = PHRASE * self.width
        spelt = self.letters(np.array([x for _, words in self.told.values() for x in words], np.int64))
        for k in range(len(self.told)):
            self.automaton.add_word(spelt[k * each : (k + 1) * each], k)
        self.figures = np.array([(phrase, salts) for phrase, (salts, _) in self.told.items()], np.int64).reshape(-1, 2)
        self.told = {}
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, words: np.ndarray, distinct: list[bytes], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin in texts that are rows of word numbers, and which."""
        if not len(self.automaton):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.fromiter((self.codes.get(w, -1) for w in distinct), np.int64, len(distinct))
        text = self.letters(known[words])
        bounds = (offsets * self.width).tolist()
        hits = [
            (a + end + 1, k) for a, b in zip(bounds, bounds[1:], strict=False) if b - a >= self.width * WINDOW for end,
            k in self.automaton.iter(text[a:b])
        ]
        found = np.array(hits, np.int64).reshape(-1, 2)
        return found[:, 0] // self.width - PHRASE, found[:, 1]


def _occurrences(rows: DataFrame) -> DataFrame:
    """Blocks of rows (block, kind, doc_id, h, digest, phrase, salts, text) → places of confirmed phrases, found by an automaton for each block.

    kind 0: the documents to be searched (doc_id, h, digest); 1: the confirmed phrases (phrase, salts, text: its words)
    that some document of the block chose; 2: the documents' texts. A block's phrases are compiled into one automaton
    and all its documents stream through. Where a phrase lies, and in which documents, is known from the automaton's
    hits alone. Gives a row for each phrase of a document: phrase, salts, digest, doc_id, windows (hashes of the windows
    at the phrase's places whose chosen phrase is this one) and the starts of each; and for each document with a hit one
    row with its text (phrase null).
    """
    id_type = dict(rows.dtypes)["doc_id"]
    names = ["phrase", "salts", "digest", "doc_id", "windows", "starts", "text"]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, phrases, firsts = None, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                part, kind = batch.slice(lo, hi - lo), kinds[lo]
                if blocks[lo] != block:
                    block, phrases, firsts = blocks[lo], _Phrases(), {}
                if kind == 0:
                    firsts.update(
                        zip(
                            zip(part.column("doc_id").to_pylist(), part.column("h").to_pylist(), strict=True),
                            part.column("digest").to_pylist(), strict=True
                        )
                    )
                elif kind == 1:
                    for told in zip(
                        part.column("phrase").to_pylist(), part.column("salts").to_pylist(),
                        part.column("text").cast(pa.binary()).to_pylist(), strict=True
                    ):
                        phrases.add(*told)
                else:
                    if phrases.automaton is None:
                        phrases.compile()
                    digests = [firsts.pop(k, None) for k in zip(part.column("doc_id").to_pylist(), part.column("h").to_pylist(), strict=True)]
                    mine = np.flatnonzero([d is not None for d in digests])
                    taken = part.take(pa.array(mine)).set_column(
                        part.schema.get_field_index("digest"), "digest", pa.array([digests[i] for i in mine], pa.binary())
                    )
                    for own in slices(iter([taken]), limit=2 << 20):
                        yield from places(own, phrases)

    def places(own: pa.RecordBatch, phrases: _Phrases) -> Iterator[pa.RecordBatch]:
        words, distinct, offsets = words_of(own.column("text"))
        found, which = phrases.find(words, distinct.cast(pa.binary()).to_pylist(), offsets)
        if not len(found):
            return
        # Only the texts with a hit from here on.
        row = row_of(offsets)[found]
        rows_hit, place = np.unique(row, return_inverse=True)
        size = np.diff(offsets)[rows_hit]
        begin = offsets[:-1][rows_hit]
        offsets = np.concatenate([[0], np.cumsum(size)])
        used, words = np.unique(words[ragged(begin, size)], return_inverse=True)
        found, distinct = found - begin[place] + offsets[place], distinct.take(pa.array(used))
        windows, chosen = window_phrases(word_hashes(distinct)[words], offsets)
        sums = gram_hashes(word_hashes(distinct, 1)[words], WINDOW).view(np.int64)
        # Windows are in order and so are their chosen phrases: those of one place are a run.
        a, b = np.searchsorted(chosen, found), np.searchsorted(chosen, found, side="right")
        n = b - a
        at = windows[ragged(a, n)]
        if not len(at):
            return
        # A row for each phrase of a text: its windows, and the starts of each.
        row, which, w = np.repeat(place, n), np.repeat(which, n), sums[at]
        start = (at - offsets[row]).astype(np.int32)
        order = np.lexsort((start, w, which, row))
        row, which, w, start = row[order], which[order], w[order], start[order]
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (which[1:] != which[:-1])])
        other = fresh | np.concatenate([[True], w[1:] != w[:-1]])
        first, of_w = np.flatnonzero(fresh), np.flatnonzero(other)
        ends = pa.array(np.append(np.searchsorted(of_w, first), len(of_w)).astype(np.int32))
        each = pa.ListArray.from_arrays(pa.array(np.append(of_w, len(w)).astype(np.int32)), pa.array(start))
        lists = [pa.ListArray.from_arrays(ends, pa.array(w[of_w])), pa.ListArray.from_arrays(ends, each)]
        figures, of = phrases.figures[which[first]], pa.array(rows_hit[row[first]])
        kind, digest = own.column("doc_id").type, own.column("digest")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(figures[:, 0]), pa.array(figures[:, 1].astype(np.int32)), digest.take(of), own.column("doc_id").take(of), *lists,
                pa.nulls(len(of), pa.string())
            ],
            names=names
        )
        held = pa.array(rows_hit)
        n = len(held)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), digest.take(held), pa.nulls(n, kind), pa.nulls(n, lists[0].type),
                pa.nulls(n, lists[1].type), own.column("text").take(held).cast(pa.string())
            ],
            names=names
        )

    dealt = rows.repartition("block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(
        locate, f"phrase long, salts int, digest binary, doc_id {id_type}, windows array<long>, starts array<array<int>>, text string"
    )


def _contest(rows: DataFrame) -> DataFrame:
    """Within each (phrase, salt) the least doc_id of each window hash keeps the window; later ones lose it.

    rows are dealt by (phrase, salt) and sorted with doc_id (null last), so that the first row with a hash has the least
    doc_id: a task streams, holding the hashes of one phrase's windows. Gives phrase, bucket, digest, starts, kept: a row
    for each text that loses windows (kept null) and, for phrases with several salts, which have yet to meet, one row for
    each bucket of window hashes with all that the salt's texts keep there. So rows never outnumber texts much, however
    many windows they hold.
    """
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, least, kept = None, {}, {}
        kind = None

        def buckets() -> list[tuple]:
            return [(group[0], b, None, None, own) for b, own in sorted(kept.items())]

        for batch in batches:
            if not batch.num_rows:
                continue
            out, kind = [], batch.schema.field("doc_id").type
            for *g, d, text, windows, starts, salts in zip(
                *(batch.column(c).to_pylist() for c in ("phrase", "salt", "doc_id", "digest", "windows", "starts", "salts")), strict=True
            ):
                if g != group:
                    out += buckets()
                    group, least, kept = g, {}, {}
                lost = []
                for h, at in zip(windows, starts, strict=True):
                    if least.setdefault(h, d) != d:
                        lost += at
                    elif salts > 1:
                        kept.setdefault(h % min(8 * salts, BUCKETS), []).append({"w": h, "doc_id": d, "digest": text, "starts": at})
                if lost:
                    out.append((g[0], None, text, lost, None))
            if out:
                yield told(out, kind)
        if kept:
            yield told(buckets(), kind)

    def told(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        entry = pa.struct([("w", pa.int64()), ("doc_id", kind), ("digest", pa.binary()), ("starts", pa.list_(pa.int32()))])
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(entry)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["phrase", "bucket", "digest", "starts", "kept"]
        )

    own = rows.select("phrase", "salt", "doc_id", "digest", "windows", "starts", "salts")
    dealt = own.repartition("phrase", "salt").sortWithinPartitions("phrase", "salt", F.col("doc_id").asc_nulls_last(), "digest")
    entry = f"struct<w:long,doc_id:{id_type},digest:binary,starts:array<int>>"
    return dealt.mapInArrow(run, f"phrase long, bucket int, digest binary, starts array<int>, kept array<{entry}>")


def _rivals(kept: DataFrame) -> DataFrame:
    """What the salts of one phrase kept (phrase, bucket, kept) → digest, starts: the windows whose least doc_id is another salt's.

    A bucket has a share of the phrase's window hashes, and of each at most one doc_id a salt, so that no group grows with the phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            out = []
            for *g, own in zip(*(batch.column(c).to_pylist() for c in ("phrase", "bucket", "kept")), strict=True):
                if g != group:
                    out += lost(held)
                    group, held = g, []
                held += own
            if out:
                yield told(out)
        if out := lost(held):
            yield told(out)

    def lost(held: list[dict]) -> list[tuple]:
        least, gone = {}, {}
        order = lambda e: (e["doc_id"] is None, e["doc_id"])  # noqa: E731  null after all others
        for e in held:
            now = least.get(e["w"])
            if now is None or order(e) < now:
                least[e["w"]] = order(e)
        for e in held:
            if order(e) != least[e["w"]]:
                gone.setdefault(e["digest"], []).extend(e["starts"])
        return list(gone.items())

    def told(out: list[tuple]) -> pa.RecordBatch:
        digests, starts = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(starts, pa.list_(pa.int32()))], names=["digest", "starts"])

    dealt = kept.select("phrase", "bucket", "kept").repartition("phrase", "bucket").sortWithinPartitions("phrase", "bucket")
    return dealt.mapInArrow(run, "digest binary, starts array<int>")


def lost_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, h, text) → (base, reps, texts, lost).

    base: figures of each row. reps (digest, doc_id, h): the first document of each word sequence of a window or more.
    texts (digest, text): the texts of those that hold a recurring phrase. lost (digest, starts): the starts of the
    windows of WINDOW words in them whose sequence starts in a document with a smaller doc_id too.
    """
    base = cut(_base(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "h")).alias("least")
    reps = cut(
        base.where(F.col("n_words") >= WINDOW).groupBy("digest").agg(first, F.first("size").alias("size")).select(
            "digest", "least.doc_id", "least.h", "size"
        )
    )
    blocks = max(1, -(-(reps.agg(F.sum("size")).first()[0] or 0) // BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks)).cast("int").alias("block")
    chosen = base.where(F.col("n_words") >= WINDOW).select("digest", "doc_id", "h", F.inline("phrases"))
    # Confirmed: the phrase is chosen in two documents with different words. Only then are its words sent anywhere.
    text = F.xxhash64("digest")
    counts = chosen.groupBy("phrase").agg(F.min(text).alias("lo"), F.max(text).alias("hi"), F.count("*").alias("n")).where("lo < hi")
    held = cut(counts.select("phrase", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts")))
    same = (F.col("c.digest") == F.col("r.digest")) & F.col("c.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("c.h") == F.col("r.h"))
    wanted = chosen.join(held, "phrase").alias("c").join(reps.alias("r"), same, "left_semi").withColumnRenamed("words", "text").withColumn("block", block)
    id_type = dict(docs.dtypes)["doc_id"]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = reps.select(block, F.lit(0).alias("kind"), "doc_id", "h", "digest", none("long", "phrase"), none("int", "salts"), none("string", "text"))
    rows = rows.unionByName(
        wanted.select(
            "block", F.lit(1).alias("kind"), none(id_type, "doc_id"), none("long", "h"), none("binary", "digest"), "phrase", "salts", "text"
        )
    )
    whole = docs.where(F.octet_length("text") >= 2 * WINDOW - 1)  # fewer bytes have no window
    rows = rows.unionByName(
        whole.select(block, F.lit(2).alias("kind"), "doc_id", "h", none("binary", "digest"), none("long", "phrase"), none("int", "salts"), "text")
    )
    found = cut(_occurrences(rows))
    rows_of = cut(base.select("doc_id", "h", "n_words", "digest"))
    drop(base)  # with the phrases' words
    salted = found.where("phrase is not null").withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts").cast("long")).cast("int"))
    kept = cut(_contest(salted))
    once = kept.where("kept is null").select("digest", "starts")
    twice = _rivals(kept.where("kept is not null"))
    lost = once.unionByName(twice).groupBy("digest").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return rows_of, reps, found.where("phrase is null").select("digest", "text"), lost


def kept_words(docs: DataFrame, texts: bool = False) -> DataFrame:
    """docs (doc_id, text) → doc_id, n_words, n_removed, kept_sha256 (and kept_text): one row per input row.

    Words are runs without ASCII white space. A word is removed when a window of WINDOW words that covers it has a word
    sequence that also starts in a document with a smaller doc_id; windows are those of the input. Documents with the
    same words as one with a smaller doc_id lose all of them, if they have a window; only the first of them is searched.

    Each row is a document, also where its doc_id is repeated or null: rows with one doc_id take nothing from each other,
    and a null doc_id comes after all others. Repeated rows have the same result. Null and blank texts have no words; an
    empty table gives an empty one; texts of any length are searched whole; ties cannot arise, as the least doc_id keeps
    a passage; other columns are not read, so that their names do not matter. A phrase in very many documents is dealt
    over salted groups.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    base, reps, held, lost = lost_windows(docs)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            words, distinct, offsets = words_of(batch.column("text"))
            starts = batch.column("starts")
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(starts.offsets)))
            at = starts.flatten().to_numpy() + offsets[:-1][of]
            gone = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)
            keep = np.cumsum(gone[:-1]) == 0
            raw = distinct.cast(pa.binary()).to_pylist()
            left = [
                b" ".join([raw[i] for i in words[lo:hi][keep[lo:hi]].tolist()]) for lo,
                hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            ]
            digests = [hashlib.sha256(x).hexdigest() for x in left]
            kept = pa.array(left, pa.binary()).cast(pa.string()) if texts else pa.nulls(len(left), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(row_sums((~keep).astype(np.int64), offsets)), pa.array(digests), kept],
                names=["digest", "n_removed", "kept_sha256", "kept_text"]
            )

    part = held.join(lost.hint("shuffle_hash"), "digest").mapInArrow(remove, "digest binary, n_removed long, kept_sha256 string, kept_text string")
    # A row a distinct text, written, so that many copies of one text are dealt as a skewed join.
    told = cut(reps.select("digest", F.col("doc_id").alias("rep"), F.lit(True).alias("long")).join(part, "digest", "left"))
    out = base.select("doc_id", "h", "n_words", "digest").join(told, "digest", "left")
    copy = F.col("long").isNotNull() & ~F.col("rep").eqNullSafe(F.col("doc_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    cols = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, empty).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    ]
    if texts:
        whole = F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda x: x != ""), " ")
        same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))
        out = out.join(docs.select(F.col("doc_id").alias("i"), F.col("h").alias("k"), whole.alias("whole")).dropDuplicates(["i", "k"]), same)
        cols.append(F.when(copy, "").otherwise(F.coalesce("kept_text", "whole")).alias("kept_text"))
    return out.select(*cols)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_words(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(len(w) - 49)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i+1:i+50], ' ')) AS h FROM t),
x AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM h) WHERE m < doc_id),
r AS (SELECT DISTINCT doc_id, i + k AS p FROM x, range(50) s(k)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM r GROUP BY doc_id),
q AS (SELECT d.doc_id, w, unnest(range(len(w))) AS p FROM d JOIN n USING (doc_id)),
k AS (SELECT q.doc_id, string_agg(w[q.p+1], ' ' ORDER BY q.p) AS kept FROM q LEFT JOIN r ON q.doc_id = r.doc_id AND q.p = r.p WHERE r.p IS NULL GROUP BY q.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
