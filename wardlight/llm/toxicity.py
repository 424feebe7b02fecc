"""Toxicity: gradient-boosted trees over dense features of the whole text, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import cut, read, row_of, row_sums, slices, words_of

STEMS = (4, 5, 6)  # a word counts as itself and as its first letters
NEAR = 5  # words between a lexicon word and a second person
TRIM = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‚‘’…¡¿–—"
# Second-person words of four languages, and signs that stand for letters.
SECOND_PERSON = """you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos
 tú ti usted ustedes vosotros""".split()
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = [
    "word_density", "stem_density", "weight_density", "word_hits", "stem_hits", "greatest_weight", "hit_kinds", "masked_density", "masked_hits",
    "near_second_person", "near_hits", "second_person", "capitals", "capital_words", "exclamations", "questions", "marks", "mixed_words",
    "single_letters", "digits", "length", "word_length"
]


def _cores(distinct: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The words in lower case without marks at their ends, and the same with signs read as letters and marks within dropped."""
    lower = pc.utf8_lower(distinct)
    core = pc.utf8_trim(lower, characters=TRIM)
    plain = lower
    for sign, letter in SIGNS.items():
        plain = pc.replace_substring(plain, sign, letter)
    return core, pc.replace_substring_regex(plain, r"[^\p{L}\p{N}]+", "")


def _stems(core: pa.Array) -> list[pa.Array]:
    """The first letters of each word, followed by a sign that no word has, or null where the word is no longer."""
    size = pc.utf8_length(core)
    return [pc.if_else(pc.greater(size, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(core, 0, k), "~", ""), None) for k in STEMS]


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What may enter the lexicon: (row, unit number) once for each unit of a text, and the units: words of 3 letters or more, and stems."""
    words, distinct, offsets = words_of(texts)
    core, _ = _cores(distinct)
    found = [pc.if_else(pc.greater_equal(pc.utf8_length(core), 3), core, None), *_stems(core)]
    coded = pa.concat_arrays(found).dictionary_encode()
    of = coded.indices.fill_null(-1).to_numpy().reshape(len(found), -1) if len(core) else np.zeros((len(found), 0), np.int64)
    row = np.tile(row_of(offsets), len(found))
    unit = of[:, words].ravel().astype(np.int64)
    pair = np.unique(row[unit >= 0] * np.int64(1 << 32) + unit[unit >= 0])
    return pair >> 32, pair & ((1 << 32) - 1), coded.dictionary


@dataclass
class Lexicon:
    """Terms (words, and stems with ~) with their weights, the logarithm of an odds ratio."""

    terms: pa.Array
    weights: np.ndarray

    def weigh(self, words: pa.Array) -> np.ndarray:
        """The weight of each, 0 for what is no term."""
        if not len(self.terms) or not len(words):
            return np.zeros(len(words))
        at = pc.index_in(words, value_set=self.terms).fill_null(-1).to_numpy()
        return np.where(at >= 0, self.weights[at], 0.0)


def learn_lexicon(labelled: DataFrame, least: int = 5, share: float = 0.005, evidence: float = 20.0) -> Lexicon:
    """labelled (text, toxic 0/1) → the terms that toxic texts have more often: G-squared of `evidence` at least.

    Texts are counted, not occurrences. A term is in `least` toxic texts and in a `share` of them at least, so that there
    are at most (kinds of units of a toxic text on average) / share terms, however many texts: that bounds what is sent.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            toxic = batch.column("toxic").to_numpy().astype(bool)
            row, unit, names = units(batch.column("text"))
            bad, all_ = np.bincount(unit[toxic[row]], minlength=len(names)), np.bincount(unit, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(bad, pa.int64()), pa.array(all_ - bad, pa.int64())], names=["term", "a", "b"])

    t = labelled.agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")).first()
    if not t.bad or not t.good:
        return Lexicon(pa.array([], pa.string()), np.zeros(0))
    counts = labelled.select("text", "toxic").mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, n = F.col("a"), F.col("b"), t.bad + t.good
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    have = a + b
    g2 = 2 * (
        part(a, have * (t.bad / n)) + part(b, have * (t.good / n)) + part(t.bad - a, (n - have) * (t.bad / n)) + part(t.good - b, (n - have) * (t.good / n))
    )
    odds = F.log((a + 0.5) / (t.bad - a + 0.5)) - F.log((b + 0.5) / (t.good - b + 0.5))
    kept = counts.where((a >= max(least, share * t.bad)) & (a / t.bad > b / t.good)).where(g2 >= evidence).select("term", odds.alias("weight")).toArrow()
    return Lexicon(kept.column("term").combine_chunks(), kept.column("weight").to_numpy())


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row a text, in the order of FEATURES; a null or blank text has zeros only."""
    words, distinct, offsets = words_of(texts)
    n = np.diff(offsets)
    core, plain = _cores(distinct)
    number = lambda x: np.asarray(x.to_numpy(zero_copy_only=False), dtype=np.float64)
    whole = lexicon.weigh(core)
    stem = np.max([lexicon.weigh(s) for s in _stems(core)], axis=0) if len(core) else np.zeros(0)
    weight = np.maximum(whole, stem)
    unmasked = np.maximum(lexicon.weigh(plain), np.max([lexicon.weigh(s) for s in _stems(plain)], axis=0)) if len(core) else np.zeros(0)
    masked = (weight == 0) & (unmasked > 0)
    hit = (weight > 0) | masked
    second = number(pc.is_in(core, value_set=pa.array(SECOND_PERSON))) > 0
    size = number(pc.utf8_length(distinct))
    count = lambda pattern: number(pc.count_substring_regex(distinct, pattern))
    letters, capitals, digits, marks = count(r"\p{L}"), count(r"\p{Lu}"), count(r"\p{N}"), count(r"[^\p{L}\p{N}]")
    loud, asks = number(pc.count_substring(distinct, "!")), number(pc.count_substring(distinct, "?"))
    mixed = number(pc.match_substring_regex(distinct, r"\p{L}[^\p{L}'’\-]+\p{L}"))
    total = lambda x: row_sums(np.asarray(x, np.float64)[words], offsets)
    # hits with a second person at most NEAR words away in the same text
    place, row = np.arange(len(words)), row_of(offsets)
    seen = np.concatenate([[0], np.cumsum(second[words])])
    near = hit[words] & (seen[np.minimum(place + NEAR + 1, offsets[1:][row])] > seen[np.maximum(place - NEAR, offsets[:-1][row])])
    near = row_sums(near.astype(np.float64), offsets)
    greatest = np.zeros(len(n))
    np.maximum.at(greatest, row, np.maximum(weight, np.where(masked, unmasked, 0))[words])
    kinds = np.bincount(np.unique(row[hit[words]] * np.int64(1 << 32) + words[hit[words]]) >> 32, minlength=len(n))
    per_word, chars = np.maximum(n, 1), np.maximum(total(size), 1)
    words_hit, stems_hit, masks = total(whole > 0), total(stem > 0), total(masked)
    return np.column_stack(
        [
            words_hit / per_word, stems_hit / per_word, total(weight) / per_word, np.log1p(words_hit), np.log1p(stems_hit), greatest, np.log1p(kinds), masks / per_word,
            np.log1p(masks), near / per_word, np.log1p(near), total(second) / per_word, total(capitals) / np.maximum(total(letters), 1), total((capitals == letters) & (letters > 1)) / per_word,
            total(loud) / chars, total(asks) / chars, total(marks) / chars, total(mixed) / per_word, total((letters == 1) & (size == 1)) / per_word, total(digits) / chars,
            np.log1p(n), chars / per_word
        ]
    ) * (n > 0)[:, None]


def featured(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with x (array of features) in place of text; whole texts, in slices of bounded size."""
    others = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column("text"), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), lists], names=[*others, "x"])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in docs.dtypes if c != "text"), "x array<double>"])
    return docs.select(*others, "text").mapInArrow(run, schema)


@dataclass
class ToxicityModel:
    """Trees and their calibration; rate: the share of toxic texts among those learned from, the score where there are no trees."""

    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with x → with score (0 to 1) in its place: the calibrated probability, which tells equal ones apart by the trees' own (2 % of it)."""
        if self.trees is None:
            return rows.drop("x").withColumn("score", F.lit(self.rate))
        raw = self.trees.transform(rows.withColumn("features", array_to_vector("x"))).withColumn("margin", vector_to_array("rawPrediction")[1])
        own = vector_to_array("probability")[1]
        if self.calibration is None:
            return raw.select(*[c for c in rows.columns if c != "x"], own.alias("score"))
        told = self.calibration.transform(raw)
        calm = F.greatest(F.least(F.col("calibrated"), F.lit(1.0)), F.lit(0.0))
        return told.select(*[c for c in rows.columns if c != "x"], (calm * 0.98 + own * 0.02).alias("score"))


def _aside(doc_id: str) -> Column:
    """The fifth of the labelled texts that calibrates, and neither lexicon nor trees see."""
    return F.pmod(F.xxhash64(doc_id, F.lit(13)), F.lit(5)) == 0


def label_sample(labels: DataFrame, most: int = 200_000) -> DataFrame:
    """labels (doc_id, toxic) → one row a doc_id (toxic if any row says so), about `most` of them at most, drawn by hash."""
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    told = cut(told)
    n = told.count()
    return told if n <= most else told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = 200_000, trees: int = 30, depth: int = 4, rate: float = 0.2) -> tuple[ToxicityModel, Lexicon, DataFrame]:
    """docs (doc_id, text) and labels (doc_id, toxic) → the model, its lexicon, and the features of all docs (doc_id, x), which are computed once.

    The classifier is fitted on a sample of about `most` labelled ids (see label_sample; broadcast, 12 bytes an id), a
    fifth of which calibrates. Where one class is missing the score is the share of the toxic among the labelled, 0 where
    none is; where the fifth has one class only, the trees' probability is not calibrated. Null and repeated ids, null and
    empty texts and empty tables are taken as they are: a label holds for every row of its id, and none for a null id.
    """
    sample = F.broadcast(label_sample(labels, most))  # bounded by `most`
    own = docs.select("doc_id", "text")
    lexicon = learn_lexicon(own.where(~_aside("doc_id")).join(sample, "doc_id"))
    x = cut(featured(own, lexicon))
    known = cut(x.join(sample, "doc_id").withColumn("aside", _aside("doc_id")))
    n = {(r.aside, r.toxic): r.n for r in known.groupBy("aside", "toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    share = sum(k for (_, toxic), k in n.items() if toxic) / total if total else 0.0
    if not (n.get((False, 0)) and n.get((False, 1))):
        return ToxicityModel(None, None, share), lexicon, x
    rows = known.select("aside", F.col("toxic").cast("double").alias("toxic"), array_to_vector("x").alias("features"))
    gbt = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=3, seed=13).fit(rows.where("not aside"))
    found = None
    if n.get((True, 0)) and n.get((True, 1)):
        told = gbt.transform(rows.where("aside")).select("toxic", vector_to_array("rawPrediction")[1].alias("margin"))
        found = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="calibrated").fit(told)
    return ToxicityModel(gbt, found, share), lexicon, x


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model, _, x = train(docs, labels.where(~held_out("doc_id")).select("doc_id", "toxic"))
    return model.score(x).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
