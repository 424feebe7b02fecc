"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import cut, free_name, numbered, ragged, read, row_of, row_sums, slices, words_of

ORDER = 4
EDGE = 32  # the code that stands for whatever is not a letter
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Which of the first 65,536 code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(65536)), bool, 65536))
    return _LETTERS[0]


def grams_of(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of the distinct words, lower-cased: packed codes (16 bits a character, the last character lowest), the word of each, and whether its last character is a letter.

    Contexts stop at the nearest edge: white space, the word's ends, and any character that is not a letter. The edge
    after a letter is predicted too. Letters beyond U+FFFF share one code.
    """
    lowered = pc.utf8_lower(distinct)
    text = "\n".join(lowered.to_pylist()) + "\n" if len(lowered) else ""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    word = np.cumsum(codes == 10) - (codes == 10)
    table = _letter_table()
    high = codes > 0xFFFF
    if high.any():
        alpha = np.fromiter((chr(c).isalpha() for c in codes[high].tolist()), bool, int(high.sum()))
        codes = codes.copy()
        codes[high] = np.where(alpha, 0xFFFF, EDGE)
        letter = table[np.where(high, 0, codes)] | (codes == 0xFFFF)
    else:
        letter = table[codes]
    c0 = np.where(letter, codes, EDGE).astype(np.uint64)
    gram, before = c0.copy(), c0
    for k in range(1, ORDER):
        prev = np.concatenate([np.full(min(k, len(c0)), EDGE, np.uint64), c0[:-k]]) if len(c0) > k else np.full(len(c0), EDGE, np.uint64)
        before = np.where(before == EDGE, np.uint64(EDGE), prev) if k > 1 else prev
        gram |= before << np.uint64(16 * k)
    told = letter | ((gram >> np.uint64(16)) & np.uint64(0xFFFF) != EDGE)
    return gram[told], word[told], letter[told]


@dataclass
class SparseTable:
    """Sorted keys, and for each the languages that have it with their values: a hash array in compressed rows."""

    keys: np.ndarray
    ends: np.ndarray
    langs: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, langs: np.ndarray, values: np.ndarray) -> SparseTable:
        order = np.lexsort((langs, keys))
        keys = keys[order]
        uniq, first = np.unique(keys, return_index=True)
        return cls(uniq, np.append(first, len(keys)), langs[order].astype(np.int16), values[order].astype(np.float32))

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in keys, language, value) of every entry whose key is asked for."""
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        asked = np.flatnonzero(self.keys[at] == keys)
        begin, size = self.ends[at[asked]], self.ends[at[asked] + 1] - self.ends[at[asked]]
        entry = ragged(begin, size)
        return np.repeat(asked, size), self.langs[entry], self.values[entry]


@dataclass
class LanguageModels:
    """Interpolated Kneser-Ney models of some languages, as sorted hash arrays.

    grams[k]: the log probability of each k-gram (packed codes) in each language that has it; gaps[k]: the log of the
    share that a context of k characters leaves to the next shorter one. unseen: log probability of a character that a
    language has never shown. An entry takes 6 bytes and a distinct key 16: 200 languages of 100,000 4-grams each (some
    27 million entries of all orders) take about 300 MB.
    """

    langs: list[int]
    grams: list[SparseTable]
    gaps: list[SparseTable]
    unseen: np.ndarray

    def score(self, gram: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last character after the others: one row a gram, one column a language."""
        uniq, back = np.unique(gram, return_inverse=True)
        out = np.zeros((len(uniq), len(self.langs)), np.float32)
        open_ = np.ones(out.shape, bool)
        for k in range(ORDER, 0, -1):
            left = np.flatnonzero(open_.any(axis=1))
            keys = uniq[left] & np.uint64((1 << (16 * k)) - 1)
            for table, closes in ((self.grams[k], True), (self.gaps[k - 1], False)) if k > 1 else ((self.grams[k], True),):
                at, lang, value = table.look_up(keys if closes else keys >> np.uint64(16))
                row = left[at]
                own = open_[row, lang]
                row, lang = row[own], lang[own]
                out[row, lang] += value[own]
                if closes:
                    open_[row, lang] = False
        out += np.where(open_, self.unseen[None, :], np.float32(0))
        return out[back]


@dataclass
class LanguageIdentifier:
    """Names of the languages, their models in broadcast parts of bounded size, and for each language the calibration of the cross-entropy."""

    names: list[str]
    parts: list[Broadcast]
    means: np.ndarray | None = None
    limits: np.ndarray | None = None

    def strange(self, entropy: np.ndarray, best: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Whether texts of that cross-entropy and length lie beyond the calibrated limit of their best language."""
        if self.means is None:
            return np.zeros(len(best), bool)
        return (entropy - self.means[best]) * np.sqrt(np.minimum(scored, 400)) > self.limits[best]


def kneser_ney(counts: DataFrame, n_langs: int) -> tuple[DataFrame, float, list[float]]:
    """Interpolated Kneser-Ney models from all counts of 4-grams (lang: a number, gram, n), computed on Spark.

    The highest order has counts, the lower ones numbers of distinct characters before; each order of a language has its
    discount n1 / (n1 + 2 n2), held between 0.1 and 0.95 (0.5 where nothing occurs once or twice), since with few kinds it
    says little: on the 0.1 scale it is 0.48 to 0.68 for two to four characters, and 0 to 0.14 for single ones, of which
    a language has 38 kinds and hardly one that is rare; 0 would leave nothing for a character never seen. The lowest order
    is interpolated with a uniform distribution over the characters seen and one more. Gives the table (k, context, lang,
    key, value) of logarithms, that of the uniform probability, and each language's log share of what it has not seen.
    Only figures of languages and orders come to the driver.
    """
    low = lambda c, k: F.col(c).bitwiseAND(F.lit((1 << (16 * k)) - 1).cast("long"))
    orders = {ORDER: counts.select("lang", "gram", F.col("n").cast("double").alias("n"))}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = cut(orders[k + 1].groupBy("lang", low("gram", k).alias("gram")).agg(F.count("*").cast("double").alias("n")))
    once = [
        t.groupBy("lang").agg(
            F.lit(k).alias("k"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"),
            F.sum("n").alias("total"), F.count("*").alias("kinds")
        ) for k,
        t in orders.items()
    ]
    discount = {k: [0.5] * n_langs for k in orders}
    unseen = [0.0] * n_langs
    alphabet = orders[1].select("gram").distinct().count() + 1
    for r in reduce(DataFrame.unionByName, once).collect():
        if r.n1 + r.n2:
            discount[r.k][r.lang] = min(max(r.n1 / max(r.n1 + 2 * r.n2, 1), 0.1), 0.95)
        if r.k == 1:
            unseen[r.lang] = float(np.log(discount[1][r.lang] * r.kinds / r.total / alphabet))
    found, below = [], None
    for k in range(1, ORDER + 1):
        own = F.element_at(F.array(*[F.lit(float(x)) for x in discount[k]]), F.col("lang") + 1)
        own_context = F.shiftrightunsigned("gram", 16)
        rows = orders[k].select("lang", "gram", "n", own_context.alias("context"), own.alias("d"))
        gaps = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.first("d") * F.count("*") / F.sum("n")).alias("gap"))
        rows = rows.join(gaps, ["lang", "context"])
        first = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        if k == 1:
            rows = rows.withColumn("p", first + F.col("gap") / alphabet)
        else:
            found.append(
                gaps.select(F.lit(k - 1).alias("k"), F.lit(True).alias("context"), "lang", F.col("context").alias("key"), F.log("gap").alias("value"))
            )
            rows = rows.withColumn("lower", low("gram", k - 1)).join(
                below.select("lang", F.col("gram").alias("lower"), F.col("p").alias("q")), ["lang", "lower"]
            ).withColumn("p", first + F.col("gap") * F.col("q"))
        below = cut(rows.select("lang", "gram", "p"))
        found.append(below.select(F.lit(k).alias("k"), F.lit(False).alias("context"), "lang", F.col("gram").alias("key"), F.log("p").alias("value")))
    return reduce(DataFrame.unionByName, found), float(np.log(1.0 / alphabet)), unseen


def in_parts(table: DataFrame, unseen: list[float], most: int) -> Iterator[LanguageModels]:
    """The models of all languages in parts of at most `most` entries, or of one larger language: one part after the other comes to the driver."""
    sizes = {r.lang: r.n for r in table.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    groups: list[list[int]] = []
    room = 0
    for lang in sorted(sizes):
        if not groups or room < sizes[lang]:
            groups.append([])
            room = most
        groups[-1].append(lang)
        room -= sizes[lang]
    for langs in groups:
        rows = table.where(F.col("lang").isin(langs)).toArrow()
        k, context, lang, key, value = (rows.column(c).to_numpy() for c in ("k", "context", "lang", "key", "value"))
        lang, key = np.searchsorted(np.array(langs), lang), key.view(np.uint64)
        of = lambda at: SparseTable.of(key[at], lang[at], value[at])  # noqa: E731, B023
        yield LanguageModels(
            langs, [of((k == i) & ~context) for i in range(ORDER + 1)], [of((k == i) & context) for i in range(ORDER)],
            np.array([unseen[x] for x in langs], np.float32)
        )


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs (text, lang) → lang, gram, n over all texts: counted within a task first, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches):
            coded = batch.column("lang").dictionary_encode()
            which = coded.indices.to_numpy()
            words, distinct, offsets = words_of(batch.column("text"))
            gram, word, _ = grams_of(distinct)
            of_word = np.repeat(which, np.diff(offsets))
            for l, lang in enumerate(coded.dictionary.to_pylist()):
                weight = np.bincount(words[of_word == l], minlength=len(distinct))[word]
                keys, sums = _summed(gram[weight > 0], weight[weight > 0])
                if lang in held:
                    keys, sums = _summed(np.concatenate([held[lang][0], keys]), np.concatenate([held[lang][1], sums]))
                held[lang] = keys, sums
        for lang, (keys, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(sums, pa.int64())],
                names=["lang", "gram", "n"]
            )

    return docs.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else np.zeros(0, np.int64)


def entropies(texts: pa.Array, models: LanguageModels, most: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length-normalised cross-entropy of each text by language (nats a character), characters scored, and letters.

    The distinct words are scored some at a time, so that there are about `most` figures at once however many languages.
    """
    words, distinct, offsets = words_of(texts)
    gram, word, letter = grams_of(distinct)
    v, n = len(distinct), len(models.langs)
    chars, letters = np.bincount(word, minlength=v), np.bincount(word[letter], minlength=v)
    scored = row_sums(chars[words], offsets)
    total = np.zeros((len(offsets) - 1, n))
    step = max(1, most // max(n, 1))
    cuts = sorted({0, v, *word[step::step].tolist()})  # a chunk has whole words
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        a, b = np.searchsorted(word, [lo, hi])
        scores = models.score(gram[a:b])
        one = len(cuts) == 2
        here = words if one else words[(words >= lo) & (words < hi)]
        row = None if one else row_of(offsets)[(words >= lo) & (words < hi)]
        for l in range(n):
            own = np.bincount(word[a:b] - lo, scores[:, l], minlength=hi - lo)[here - lo]
            total[:, l] += row_sums(own, offsets) if one else np.bincount(row, own, minlength=len(total))
    return -total / np.maximum(scored, 1)[:, None], scored, row_sums(letters[words], offsets)


def train(
    docs: DataFrame, calibration_docs: int = 2_000, quantile: float = 0.999, slack: float = 2.0, part: int = 16_000_000
) -> LanguageIdentifier | None:
    """Models from labelled docs (doc_id, text, lang); None where no document has a language and text.

    For each language about calibration_docs documents drawn by hash of doc_id, a fifth of all at most, are set aside to
    calibrate the rejection limit: how far a document's cross-entropy lies above the median, times the root of its
    length, at `quantile`, times `slack`. A language with fewer than 20 such documents has the limit of all languages
    together. The counts are of all other documents, and none is left out: discounts and continuation counts are of all
    counts. The models grow with the corpus; they are brought to the driver, broadcast and scored in parts of `part`
    entries (see in_parts), each part being a pass over the documents, so that the driver's memory does not grow with them.
    A document with a null doc_id is never set aside.
    """
    labelled = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    names = sorted(sizes)
    number = F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)]), F.col("lang"))
    share = F.element_at(F.array(*[F.lit(max(5, sizes[x] // calibration_docs)) for x in names]), number + 1)
    aside = F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), share) == 0)
    counts = cut(gram_counts(labelled.where(~aside)).select(number.alias("lang"), "gram", "n"))
    table, _, unseen = kneser_ney(counts, len(names))
    # A broadcast part lies in a file; the driver holds one part at a time, however many there are.
    send = docs.sparkSession.sparkContext.broadcast
    models = LanguageIdentifier(names, [send(p) for p in in_parts(cut(table), unseen, part)])
    if not models.parts:
        return None
    told = _scored(labelled.where(aside).select("doc_id", "text", "lang"), models, with_lang=True).where("letters > 0").toArrow()
    place = {x: i for i, x in enumerate(names)}
    which = np.array([place[x] for x in told.column("lang").to_pylist()], np.int64)
    h, size, best = told.column("entropy").to_numpy(), np.minimum(told.column("scored").to_numpy(), 400), told.column("best").to_numpy()
    models.means, models.limits = np.zeros(len(names)), np.full(len(names), np.inf)
    over = lambda own, mean: slack * max(np.quantile((h[own] - mean) * np.sqrt(size[own]), quantile), 1.0)
    right = which == best
    for l in range(len(names)):
        own = right & (which == l) if (right & (which == l)).sum() >= 20 else right
        if own.sum() >= 20:
            models.means[l] = np.median(h[own])
            models.limits[l] = over(own, models.means[l])
    return models


def _judged(batch: pa.RecordBatch, models: LanguageModels) -> list[np.ndarray]:
    """best (its number among all languages), its entropy, the sum of all languages' likelihoods as a multiple of its own, characters scored, letters."""
    h, scored, letters = entropies(batch.column("text"), models)
    best = h.argmin(axis=1)
    rows = np.arange(len(best))
    ratio = np.exp(-np.minimum((h - h[rows, best][:, None]) * np.minimum(scored, 200)[:, None], 700))
    return [np.array(models.langs)[best], h[rows, best], ratio.sum(axis=1), scored, letters]


def _scored(docs: DataFrame, models: LanguageIdentifier, with_lang: bool = False) -> DataFrame:
    """docs (doc_id, text[, lang]) → doc_id, best, entropy, confidence, scored, letters[, lang], over all parts of the models."""
    others = ["doc_id", *["lang"] * with_lang]
    several = len(models.parts) > 1
    if several:
        docs = numbered(docs.select(*others, "text"), "_row")
        others = ["_row", *others]
    kinds, out = dict(docs.dtypes), None
    for shared in models.parts:

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                best, entropy, likely, scored, letters = _judged(batch, shared.value)
                told = [pa.array(best, pa.int32()), pa.array(entropy), pa.array(likely), pa.array(scored, pa.int64()), pa.array(letters, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in others), *told], names=[*others, "best", "entropy", "likely", "scored", "letters"]
                )

        schema = ", ".join(f"{c} {kinds[c]}" for c in others)
        found = docs.select(*others, "text").mapInArrow(score, f"{schema}, best int, entropy double, likely double, scored long, letters long")
        out = found if out is None else out.unionByName(found)
    if several:  # the best of the parts, and the likelihoods of all as a multiple of its own
        each = F.struct("entropy", "best", "likely", F.least("scored", F.lit(200)).alias("length"))
        out = out.groupBy("_row").agg(
            F.array_sort(F.collect_list(each)).alias("e"), *[F.first(c).alias(c) for c in (*others[1:], "scored", "letters")]
        )
        least = F.col("e")[0]
        total = F.aggregate(
            "e", F.lit(0.0), lambda s, x: s + x["likely"] * F.exp(-F.least((x["entropy"] - least["entropy"]) * x["length"], F.lit(700.0)))
        )
        out = out.select(*others[1:], least["best"].alias("best"), least["entropy"].alias("entropy"), total.alias("likely"), "scored", "letters")
    return out.withColumn("confidence", 1 / F.col("likely")).drop("likely")


def _strange(models: LanguageIdentifier) -> Column:
    """LanguageIdentifier.strange as a column over entropy, best and scored."""
    if models.means is None:
        return F.lit(False)
    at = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("best") + 1)
    return (F.col("entropy") - at(models.means)) * F.sqrt(F.least("scored", F.lit(400))) > at(models.limits)


def identify(docs: DataFrame, models: LanguageIdentifier | None) -> DataFrame:
    """docs (doc_id, text) → doc_id, lang_pred, score, entropy, rejected: one row per input row.

    The language of lowest cross-entropy a character; score is its share among the languages, over at most 200
    characters. A text that is null or has no letter is `und` with score 0 and is rejected; a text whose cross-entropy
    exceeds its language's calibrated limit keeps its language and is rejected. Without models every text is `und`, and
    only those without a letter are rejected. Texts of any length are scored whole; ties go to the first language by
    name; repeated rows and ids have a row each; an empty table gives an empty one; other columns are not read.
    """
    if models is None:
        return docs.select(
            "doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"),
            (~_lettered()).alias("rejected")
        )
    found = _scored(docs.select("doc_id", "text"), models)
    names = F.array(*[F.lit(x) for x in models.names])
    blank = F.col("letters") == 0
    return found.select(
        "doc_id", F.when(blank, "und").otherwise(F.element_at(names, F.col("best") + 1)).alias("lang_pred"),
        F.when(blank, 0.0).otherwise(F.col("confidence")).alias("score"), F.when(~blank, F.col("entropy")).alias("entropy"),
        (blank | _strange(models)).alias("rejected")
    )


def _lettered() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def keep_identified(docs: DataFrame, models: LanguageIdentifier | None) -> DataFrame:
    """The rows of docs, in its columns, that identify() does not reject; each task scores and filters what it reads.

    Without models, so without a labelled document, only texts without a letter go. Rows are kept or dropped each by its
    own text, whether an id is null or repeated.
    """
    if models is None:
        return docs.where(_lettered())
    if len(models.parts) > 1:
        key = free_name(docs, "row")
        rows = numbered(docs, key)
        found = _scored(rows.select(F.col(key).alias("doc_id"), "text"), models).where((F.col("letters") > 0) & ~_strange(models))
        return rows.join(found.select(F.col("doc_id").alias(key)), key, "left_semi").select(*docs.columns)
    shared, limits = models.parts[0], LanguageIdentifier(models.names, [], models.means, models.limits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            best, entropy, _, scored, letters = _judged(batch, shared.value)
            yield batch.filter(pa.array((letters > 0) & ~limits.strange(entropy, best, scored)))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 by 3; a null id is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    models = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = identify(docs, models)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
