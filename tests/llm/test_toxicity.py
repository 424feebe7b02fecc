"""Toxicity: features and lexicon against plain Python, held-out quality, odd inputs."""

import math
import random
import unicodedata

import numpy as np
import pyarrow as pa

from wardlight.llm import toxicity as T

LEXICON = T.Lexicon(pa.array(["idiot", "scum", "vequ~"]), np.array([3.0, 2.0, 1.5]))
TEXTS = [
    "You are an IDIOT! Scum, idiot.", None, "", " \n ", "an id.i.ot and 1d10t here", "vequaire vequ Vequta? " * 3, "a b c 12 é" * 5, "far " * 9 + "you " + "far " * 4 + "idiot",
    "far " * 9 + "you " + "far " * 5 + "idiot", "THE!! AND $$$ x***y"
]


def plain(text, weights):
    """The features of one text, word by word."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(T.FEATURES)
    kind = lambda c: unicodedata.category(c)[0]
    core = [w.lower().strip(T.TRIM) for w in words]
    plain_ = ["".join(c for c in "".join(T.SIGNS.get(c, c) for c in w.lower()) if kind(c) in "LN") for w in words]
    stems = lambda w: [w[:k] + "~" for k in T.STEMS if len(w) > k]
    at = lambda w: weights.get(w, 0)
    stem = lambda w: max([at(s) for s in stems(w)], default=0)
    weight = [max(at(w), stem(w)) for w in core]
    masked = [max(at(p), stem(p)) if not w else 0 for p, w in zip(plain_, weight, strict=True)]
    hit = [bool(w or m) for w, m in zip(weight, masked, strict=True)]
    second = [w in T.SECOND_PERSON for w in core]
    near = sum(h and any(second[max(0, i - T.NEAR) : i + T.NEAR + 1]) for i, h in enumerate(hit))
    n, chars, joined = len(words), sum(map(len, words)), "".join(words)
    letters = sum(c.isalpha() for c in joined)
    up = lambda w: sum(unicodedata.category(c) == "Lu" for c in w)
    low = lambda w: sum(kind(c) == "L" for c in w)
    inner = lambda w: [i for i, c in enumerate(w) if kind(c) == "L"]

    def mixed(w):
        own = inner(w)
        return any(b - a > 1 and all(c not in "'’-" for c in w[a + 1 : b]) for a, b in zip(own, own[1:], strict=False))

    word_hits, stem_hits, masks = sum(at(w) > 0 for w in core), sum(stem(w) > 0 for w in core), sum(m > 0 for m in masked)
    return [
        word_hits / n, stem_hits / n, sum(weight) / n, math.log1p(word_hits), math.log1p(stem_hits), max(map(max, zip(weight, masked, strict=True))),
        math.log1p(len({w for w, h in zip(words, hit, strict=True) if h})), masks / n, math.log1p(masks), near / n, math.log1p(near), sum(second) / n, up(joined) / max(letters, 1),
        sum(low(w) > 1 and up(w) == low(w) for w in words) / n, joined.count("!") / chars, joined.count("?") / chars, sum(kind(c) not in "LN" for c in joined) / chars,
        sum(map(mixed, words)) / n, sum(len(w) == 1 and low(w) == 1 for w in words) / n, sum(kind(c) == "N" for c in joined) / chars, math.log1p(n), chars / n
    ]


def test_features_against_plain_python():
    weights = dict(zip(LEXICON.terms.to_pylist(), LEXICON.weights, strict=True))
    got = T.features(pa.array(TEXTS), LEXICON)
    assert got.shape == (len(TEXTS), len(T.FEATURES))
    for row, text in zip(got, TEXTS, strict=True):
        np.testing.assert_allclose(row, plain(text, weights), err_msg=str(text))
    assert T.features(pa.array([], pa.string()), LEXICON).shape == (0, len(T.FEATURES))
    assert T.features(pa.array(["", None]), LEXICON).sum() == 0


def drawn(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = int(i % 5 == 0)
        words = ["w" + chr(97 + rnd.randrange(20)) * 3 for _ in range(rnd.randrange(5, 40))]
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["grobian", "Lump!", "vequ" + chr(97 + rnd.randrange(26)) * 4])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_lexicon_against_counts(spark):
    """Rare words of one stem are found by the stem; the weights are log odds ratios of texts, not of occurrences."""
    rows = drawn(1500)
    lexicon = T.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("text", "toxic").repartition(7))
    found = dict(zip(lexicon.terms.to_pylist(), lexicon.weights, strict=True))
    assert {"grobian", "lump", "vequ~"} <= set(found) and not any(t.startswith("w") for t in found)
    bad, good = sum(r[2] for r in rows), sum(1 - r[2] for r in rows)
    a = sum("grobian" in r[1] for r in rows)
    assert math.isclose(found["grobian"], math.log((a + 0.5) / (bad - a + 0.5)) - math.log(0.5 / (good + 0.5)))


def test_learns_and_masks(spark):
    rows = drawn(1500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "grobian wa", "y"), (7, None, "y"), (9001, "www gr.ob.ian www", "z"), (9002, "", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i < 1000] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model, _, x = T.train(docs, labels)
    found = model.score(x).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    toxic = {i: x for i, _, x in rows}
    later = [(toxic[r.doc_id], r.score >= 0.3) for r in found if r.doc_id is not None and 1000 <= r.doc_id < 1500]
    assert sum(a == b for a, b in later) / len(later) > 0.97
    odd = {r.doc_id: r.score for r in found if r.doc_id in (None, 9001, 9002)}
    assert odd[None] >= 0.3 > odd[9002]


def test_missing_classes_and_tables(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    for labels, want in ((none, 0.0), (one, 1.0)):
        model, _, x = T.train(docs, labels)
        assert {r.score for r in model.score(x).collect()} == {want}
    model, _, x = T.train(docs.limit(0), one)
    assert model.score(x).count() == 0


def test_label_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i // 2, i % 2) for i in range(8000)], "doc_id long, toxic int")
    assert T.label_sample(labels).count() == 4000 and T.label_sample(labels).where("toxic = 1").count() == 4000
    assert 300 < T.label_sample(labels, 400).count() < 500


def test_held_out_quality(spark):
    """The order of labels that were not learned from, on 4,000 labels; with the 400 of a tenth of it there are too few in each language."""
    import pandas as pd

    sf = "/root/testdata/sf0.1"
    df = T.op13_toxicity(spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    own = df[df.held_out].merge(labels, on="doc_id")
    rank = own.score.rank()
    bad = own.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert len(df) == 10000 and df.predicted.equals((df.score >= 0.3).astype("int32")) and auc > 0.98
