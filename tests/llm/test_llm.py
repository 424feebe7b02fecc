"""The text operators on small fixtures: nulls, blanks, repeats, clashing columns, and brute force."""

import datetime
import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from wardlight.llm import chat, components, decontaminate, jaccard, langid, packing, pii, quality, registry, substrings, urls

KEY = "a key of the tests"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, path string"


def docs(spark, texts, langs=None):
    return spark.createDataFrame(
        [(i, t, (langs or {}).get(i, "en"), "s", None if t is None else len(t), "r", "p") for i, t in enumerate(texts)], DOCS
    )


def words(n, seed=0, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


@pytest.mark.parametrize("name", [n for n in sorted(registry.ORACLE_SQL) if n != "op3_quality_rules"])
def test_against_sql(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    assert same(df.collect(), df.columns, duck.sql(registry.ORACLE_SQL[name]))


EDGE = [None, "", " \t\n", "a", "a b c", " ".join(words(30_000)), "same text here for all of us", "same text here for all of us"]


@pytest.mark.parametrize(
    "run",
    [
        jaccard.near_duplicates, quality.quality_rules, packing.pack_documents, packing.packed_matrices, lambda d: pii.pseudonymize(d, KEY),
        substrings.kept_words
    ],
    ids="op1 op3 op10 op4 op8 op9".split()
)
def test_edge_rows_and_empty_tables(run, spark):
    df = docs(spark, EDGE)
    assert run(df).count() >= (1 if run is packing.packed_matrices else len(EDGE))
    assert run(df.where("doc_id < 0")).count() == 0


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_jaccard_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 8)  # so that buckets split, pivots stand for sets, and groups are verified by their centres
    r = random.Random(5)
    base = [words(120, s, 5000) for s in range(4)]
    base += [base[0][:60] + base[1][60:], base[2][:108] + base[3][108:]]  # chains, and groups without a centre
    texts = []
    for k in range(90):
        w = list(base[k % 6])
        for _ in range(r.choice([0, 0, 1, 2, 4, 6])):
            w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        texts.append(" ".join(w))
    texts += [texts[0], None, "", "one two", "one two", "one  two"]
    sets = [
        frozenset(
            tuple(x) for x in ([w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w] if w else [])
        ) for w in ((t or "").split() for t in texts)
    ]
    n = len(texts)
    links = [[j for j in range(n) if j != i and jac(sets[i], sets[j]) >= 0.8] for i in range(n)]
    cls = list(range(n))
    for _ in range(n):
        cls = [min([cls[i], *(cls[j] for j in links[i])]) for i in range(n)]
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (cls[i], len(links[i])) for i in range(n)}


def test_ids_below_zero_are_told_apart(spark):
    w = words(120, 3, 5000)
    rows = [(-2, " ".join(w)), (-1, " ".join([*w, "x"])), (3, " ".join(["y", *w])), (4, "other words are here")]
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {-2: (-2, 2), -1: (-2, 2), 3: (-2, 2), 4: (4, 0)}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [
        (7, 7), (None, 3), (300, 301), (300, 301), *((i, i + 1) for i in range(400, 440))
    ]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(500):
        for u, v in edges:
            if u is not None and u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label


def test_url_aliases(spark):
    page = lambda i, url, html="": (i, url, html, "x")
    link = '<link href="http://bad.example.com/en/1" rel="canonical">'
    rows = [
        page(0, "http://bad.example.com/en/1"), page(1, "http://alias.org/a", link), page(2, "https://alias.org/a/?utm_source=x#top"), page(3, "http://clean.org/"), page(
            4, "http://www.example.com/en/x", '<META HTTP-EQUIV=refresh content="0; url=http://both.org/">'
        ),
        page(5, "http://both.org/", link), page(6, None), page(7, "no scheme"), page(8, "http://WWW.Example.com/en/x?q=1#f"), page(9, "http://clean.org/"), page(10, "http://redirected.org/r"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    red = spark.createDataFrame([("http://redirected.org/r", "http://bad.example.com/en/1"), (None, "x")], "a string, b string")
    got = {x.page_id: x for x in urls.judge_urls(pages, redirects=red).collect()}
    # Page 5 joins the blocked and the allowed address: the explicit allow has precedence in the class.
    assert {i: got[i].verdict for i in got} == {
        0: "block", 1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow"
    }
    alone = {x.page_id: x.verdict for x in urls.judge_urls(pages.where("page_id not in (4, 5)"), redirects=red).collect()}
    assert (alone[1], alone[2], alone[10], alone[3]) == ("block", "block", "block", "allow")
    assert (got[8].host, got[8].path, got[8].rule) == ("www.example.com", "/en/x", "www.example.com/en/")
    assert (got[6].host, got[6].path, got[7].host) == ("", "", "")


def test_links_are_resolved_and_targets_meet_by_their_canonical_forms(spark):
    told = {
        "https://h.org/x": "https://h.org/x", "//k.org/y": "http://k.org/y", "/a/b": "http://www.p.net/a/b", "c": "http://www.p.net/d/c", "../e/./f": "http://www.p.net/e/f", "?q=1&amp;r=2": "http://www.p.net/d/page?q=1&r=2",
        "mailto:a@b": None, "": None, "..": "http://www.p.net/", "g/": "http://www.p.net/d/g/",
    }
    got = spark.createDataFrame([(k,) for k in told], "t string").select(
        "t", urls.resolved(F.col("t"), F.lit("http://www.p.net/d/page#x")).alias("r")
    )
    assert {x.t: x.r for x in got.collect()} == told
    link = lambda href: f'<LINK REL=CANONICAL HREF="{href}">'
    rows = [
        (0, "http://a.org/1", link("https://bad.example.com/en/1")),
        (1, "http://b.org/2", '<meta HTTP-EQUIV="REFRESH" content="0; URL=//bad.example.com/en/1/#top">'),
        (2, "http://bad.example.com/q", link("/en/1")), (3, "http://c.org/", link("http://c.org/"))
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.verdict for x in urls.judge_urls(pages.where("page_id <> 2")).collect()} == {0: "block", 1: "block", 3: "allow"}
    assert {x.verdict for x in urls.judge_urls(pages).collect()} == {"allow"}  # page 2 is allowed by com/ and in the others' class
    assert {
        x.page_id: x.verdict for x in urls.judge_urls(pages, rules=[("block", "bad.example.com/en/")]).collect()
    } == {0: "block", 1: "block", 2: "block", 3: "allow"}
    assert urls.judge_urls(pages.where("page_id > 9")).count() == 0 and urls.judge_urls(pages.drop("html")).count() == 4


def naive_repeats(w):
    n, best = len(w), [0] * len(w)
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    return best


def test_suffix_array_repeats():
    r = random.Random(2)
    texts = [[r.choice("ab") for _ in range(40)], ["a"] * 150, [r.choice("abcdefgh") for _ in range(90)], [], ["x"]]
    number = {c: i for i, c in enumerate("abcdefghx")}
    flat = np.array([number[c] for t in texts for c in t])
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert quality.repeat_lengths(flat, rows).tolist() == [k for t in texts for k in naive_repeats(t)]


def test_quality_verdicts(spark):
    clean, loop = " ".join(words(300, 1, 9000)), " ".join(["the same ten words come again and again in here"] * 30)
    got = {x.doc_id: x for x in quality.quality_rules(docs(spark, [clean, loop, None, "a b\n a b\na b\n\n \nc"])).collect()}
    assert got[0].kept and not got[1].kept and got[2].base_failed and got[2].n_words == 0
    assert (got[3].n_dup_lines, got[3].n_words) == (1, 7)


def test_chat_round_trip(spark):
    t = chat.ChatTemplate()
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<<SYS>><</SYS>><", "", None, "[ROLE]x[/ROLE]", "  ü <<s>", "[/INST]\\"]
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", x, "z") for i, x in enumerate(hard)] + [
        (2, 0, "tool]\\", "x", "z"), (2, 0, None, "[/TURN]", "z"), (2, 5, "assistant", "y", "z"), (None, 0, "user", "n", "z"),
        (3, 0, "system", "s", "z"), (3, 1, "user", "u", "z"), (3, 2, "assistant", "a", "z"), (3, 2, "assistant", "a", "z")
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, loss string")
    seg = chat.format_chats(df)
    got = {x.conv_id: x for x in chat.read_chats(seg).collect()}
    for conv in (1, 2, None, 3):
        own = sorted(((n, r or "", x or "") for c, n, r, x, _ in turns if c == conv))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(x for _, r, x in own if r == "assistant").encode()).hexdigest()
    assert [got[k].valid for k in (1, 2, 3)] == [False, False, False]  # ends with a user, has unknown roles, repeats a turn
    assert t.parse("<s>" + "[INST]a[/INST]b</s>") == [("user", "a"), ("assistant", "b")]
    assert chat.format_chats(df.where("turn > 99")).count() == 0


def test_chats_with_ids_of_other_types(spark):
    df = spark.createDataFrame(
        [("c", 0, "user", "a"), ("c", 1, "assistant", "b"), (None, 0, "user", "x")], "conv_id string, turn long, role string, text string"
    )
    assert {
        x.conv_id: (x.n_turns, x.loss_chars, x.valid) for x in chat.read_chats(chat.format_chats(df)).collect()
    } == {"c": (2, 1, True), None: (1, 0, False)}


def test_decontamination_against_brute_force(spark):
    r = random.Random(8)
    items = [" ".join(words(n, 100 + i, 60)) for i, n in enumerate([25, 10, 4, 1, 12, 0, 30])] + [None]
    texts = []
    for k in range(60):
        w = words(80, k, 60)
        if k % 3 == 0:
            src = items[r.choice([0, 1, 2, 4, 6])].split()
            a = r.randrange(len(src))
            w[20:20] = src[a : a + 14]
        texts.append(" ".join(x.upper() if r.random() < 0.1 else x + r.choice(["", ".", "!? "]) for x in w))
    texts += [None, "", "é W1 é"]
    it = spark.createDataFrame([(i, t, "d") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    wins = {}
    for i, t in enumerate(items):
        w = [x.decode() for x in decontaminate.normal_words(t)]
        for a in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    want = {}
    for k, t in enumerate(texts):
        w = [x.decode() for x in decontaminate.normal_words(t)]
        hit, who = set(), set()
        for a in range(len(w)):
            for n in {len(x) for x in wins}:
                if tuple(w[a : a + n]) in wins and a + n <= len(w):
                    hit |= set(range(a, a + n))
                    who |= wins[tuple(w[a : a + n])]
        want[k] = (len(w), len(hit), sorted(who))
    for bytes_ in (1 << 20, 200):  # one shard, and several
        found = decontaminate.contamination(docs(spark, texts), it, max_bytes=bytes_)
        got = {x.doc_id: (x.n_words, x.n, list(x["items"])) for x in found.withColumn("n", decontaminate.hit_count(F.col("spans"))).collect()}
        assert got == want
    one = {x.doc_id: x.text for x in decontaminate.decontaminate(docs(spark, texts), it, max_coverage=0.9).collect()}
    many = {x.doc_id: x.text for x in decontaminate.decontaminate(docs(spark, texts), it, max_coverage=0.9, max_bytes=200).collect()}
    assert one == many and all(one[k] == texts[k] for k in one if not want[k][1]) and one[60] is None


@pytest.mark.parametrize("max_bytes", [1 << 20, 200])
def test_decontamination_of_null_and_repeated_ids(spark, max_bytes):
    passage, other = " ".join(words(30, 1, 4000)), " ".join(words(30, 2, 4000))
    items = spark.createDataFrame([(1, passage), (2, other)], "item_id long, text string")
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, a), (None, f"{b} {other} {a}"), (7, f"{a} {passage} {b}"), (7, f"{a} {passage} {b}"), (7, b), (7, f"{passage} {a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.text.split()) for x in decontaminate.decontaminate(df, items, max_bytes=max_bytes).collect()]
    want = [(k, t.replace(passage, "").replace(other, "").split()) for k, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    found = decontaminate.contamination(df, items, max_bytes=max_bytes).withColumn("n", decontaminate.hit_count(F.col("spans"))).collect()
    assert sorted(str((x.doc_id, x.n_words, x.n)) for x in found) == sorted(str((k, len(t.split()), 30 * ("w" in t))) for k, t in rows)


@pytest.mark.parametrize("max_bytes", [1 << 20, 200])
def test_decontamination_with_items_without_an_id_and_clashing_columns(spark, max_bytes):
    one, two = " ".join(words(30, 1, 4000)), " ".join(words(30, 2, 4000))
    items = spark.createDataFrame([(None, one), (None, two), ("b", two), ("b", two)], "item_id string, text string")
    rows = [(1, f"x {one} y z", 5, "s"), (2, f"x {two} y z", 6, "s"), (3, None, 7, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, spans string").withColumn("_spans", F.lit(1))
    got = {x.doc_id: (x.n_words, list(x["items"])) for x in decontaminate.contamination(df, items, max_bytes=max_bytes).collect()}
    assert got == {1: (33, []), 2: (33, ["b"]), 3: (0, [])}
    left = {
        x.doc_id: (x.text, x.row, x.spans, x._spans) for x in decontaminate.decontaminate(df, items, max_coverage=0.95, max_bytes=max_bytes).collect()
    }
    assert {k: ((v[0] or "").split(), *v[1:]) for k, v in left.items()} == {
        1: (["x", "y", "z"], 5, "s", 1), 2: (["x", "y", "z"], 6, "s", 1), 3: ([], 7, "s", 1)
    } and left[3][0] is None
    assert decontaminate.contamination(df.where("doc_id > 9"), items, max_bytes=max_bytes).count() == 0
    assert decontaminate.decontaminate(df, items.where("text is null"), max_bytes=max_bytes).count() == 3


def test_one_row_stays_of_near_duplicates_with_null_and_repeated_ids(spark, sf):
    import corpus_pipeline as cp

    one, two, three = (" ".join(words(120, s, 3000)) for s in (11, 12, 13))
    rows = [(None, one), (None, one), (5, two), (5, two), (5, three), (4, three + " x"), (None, None), (None, "two words"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((x.doc_id, x.text)) for x in cp.ngram_jaccard(spark, df, sf).collect())
    assert got == sorted(str(x) for x in [rows[0], rows[2], rows[5], *rows[6:]])
    told = sorted(str(tuple(x)) for x in jaccard.near_duplicates(df).select("doc_id", "class_id", "n_links").collect())
    assert told == sorted(map(str, [(None, None, 1)] * 2 + [(5, 5, 1)] * 2 + [(5, 4, 1), (4, 4, 1), (None, None, 0), (None, None, 0), (6, 6, 0)]))


def test_language_models(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    models = langid.train(d.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(d, models).join(d.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.95
    edge = {x.doc_id: x for x in langid.identify(docs(spark, [None, "", "12 !? 34", "the and of that"]), models).collect()}
    assert [edge[i].lang_pred for i in range(3)] == ["und"] * 3 and all(edge[i].rejected for i in range(3)) and edge[3].lang_pred == "en"
    # Probabilities of all known characters after a known context sum to 1, less what one unknown character is left.
    part = models.parts[0].value
    ctx = part.gaps[1].keys[part.gaps[1].keys != 32][0]
    last = part.grams[1].keys
    gram = (np.uint64(32) << np.uint64(48)) | (np.uint64(32) << np.uint64(32)) | (ctx << np.uint64(16)) | last
    assert (np.exp(part.score(gram)).sum(axis=0) <= 1.0001).all() and np.exp(part.score(gram)).sum(axis=0).max() > 0.99
    kept = langid.keep_identified(docs(spark, [None, "the and of that with this", "0 0"]), models).collect()
    assert [x.doc_id for x in kept] == [1]
    empty = d.where("doc_id < 0")
    assert langid.identify(empty, models).count() == langid.keep_identified(empty, models).count() == 0
    # Models in several parts give the same.
    parts = langid.train(d.where(~langid.held_out(F.col("doc_id"))), part=2_000)
    assert len(parts.parts) > 1
    show = lambda m: sorted((x.doc_id, x.lang_pred, round(x.score, 6), x.rejected) for x in langid.identify(d, m).collect())
    assert show(models) == show(parts)
    assert sorted(
        x.doc_id for x in langid.keep_identified(d, models).collect()
    ) == sorted(x.doc_id for x in langid.keep_identified(d, parts).collect())


def test_documents_without_labels_are_kept(spark):
    df = docs(spark, ["plain words", "漢字", "12 34", "", None, "ok"]).withColumn("lang", F.lit(None).cast("string"))
    models = langid.train(df)
    assert models is None
    assert sorted(x.doc_id for x in langid.keep_identified(df, models).collect()) == [0, 1, 5]
    got = {x.doc_id: x for x in langid.identify(df, models).collect()}
    assert {x.lang_pred for x in got.values()} == {"und"} and [got[i].rejected for i in range(6)] == [False, False, True, True, True, False]
    assert langid.train(df.where("doc_id < 0")) is None


def slow_kneser_ney(texts):
    """Interpolated Kneser-Ney probabilities of each language by dictionaries: texts by language → p(language, context, character)."""
    counts = {}
    for lang, own in texts.items():
        c = counts[lang] = [None, {}, {}, {}, {}]
        for t in own:
            for w in t.lower().split():
                marked = "".join(x if x.isalpha() else " " for x in w) + " "
                for i, x in enumerate(marked):
                    if x == " " and (i == 0 or marked[i - 1] == " "):
                        continue
                    before = marked[:i][-3:]
                    before = before[before.rfind(" ") + 1 :].rjust(3)
                    c[4][before + x] = c[4].get(before + x, 0) + 1
        for k in (3, 2, 1):
            for g in c[k + 1]:
                c[k][g[1:]] = c[k].get(g[1:], 0) + 1
    letters = len({g for c in counts.values() for g in c[1]}) + 1

    def p(lang, gram):
        k, table = len(gram), counts[lang][len(gram)]
        n1, n2 = (sum(v == n for v in table.values()) for n in (1, 2))
        d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.95) if n1 + n2 else 0.5
        after = [v for g, v in table.items() if g[:-1] == gram[:-1]]
        below = p(lang, gram[1:]) if k > 1 else 1 / letters
        return max(table.get(gram, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * below if after else below

    return p


def test_language_models_against_a_slow_version(spark):
    r = random.Random(6)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 7)))
    texts = {
        "aa": [" ".join(word("abcde") for _ in range(60)) for _ in range(6)],
        "bb": [" ".join(word("abxyé") for _ in range(40)) + " d'x 7a" for _ in range(4)], "cc": ["ab ab"]
    }
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own)]
    number = {x: i for i, x in enumerate(sorted(texts))}
    counts = langid.gram_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = counts.replace({k: str(v) for k, v in number.items()}, subset=["lang"]).withColumn("lang", F.col("lang").cast("int"))
    table, _, unseen = langid.kneser_ney(counts, 3)
    p = slow_kneser_ney(texts)
    for part in [*langid.in_parts(table, unseen, 10_000), *langid.in_parts(table, unseen, 300)]:
        grams = ["   a", "  ab", " abc", "abcd", "xyé ", "  é ", "edcb", "abab", "   z", "zzzz", "   7", "  b "]
        coded = np.array([sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(g)) for g in grams], np.uint64)
        got = np.exp(part.score(coded))
        for i, g in enumerate(grams):
            for j, l in enumerate(part.langs):
                # A context with a gap in it is one that begins after the gap.
                assert abs(got[i, j] - p(sorted(texts)[l], g)) < 1e-6, (g, l)


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def masked(df):
    return pii.pseudonymize(df, KEY)


def sha(n, *parts):
    return getattr(hashlib, f"sha{n}")("|".join(map(str, parts)).encode()).hexdigest()


def turned(text, other, kind, k, sign):
    """One half shifted by what the other half draws, or back."""
    out = []
    for i, c in enumerate(text):
        add = sign * int(sha(512, KEY, kind, k, other, len(text), i // 32)[i % 32 * 4 :][:4], 16)
        first, n = ("0", 10) if c in "0123456789" else ("a", 6 if kind == "hex" else 26) if "a" <= c <= "z" else ("A", 6 if kind == "hex" else 26) if "A" <= c <= "Z" else (None, 0)
        out.append(c if not n else chr(ord(first) + (ord(c) - ord(first) + add) % n))
    return "".join(out)


def feistel(text, kind, back=False):
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for k in range(7, -1, -1) if back else range(8):
        if k % 2 == 0:
            left = turned(left, right, kind, k, -1 if back else 1)
        else:
            right = turned(right, left, kind, k, -1 if back else 1)
    return left + right


def feistel_of(value, a, b, kind, back=False):
    left, right = divmod(value, b)
    for k in range(7, -1, -1) if back else range(8):
        add = lambda other: (-1 if back else 1) * int(sha(256, KEY, kind, k, other)[:8], 16)  # noqa: E731, B023
        if k % 2 == 0:
            left = (left + add(right)) % a
        else:
            right = (right + add(left)) % b
    return left * b + right


def ssn_place(s):
    a, g, n = map(int, s.split("-"))
    return ((a - (2 if a > 666 else 1)) * 99 + g - 1) * 9999 + n - 1


def national(n, back=False):
    first, many = ([v if x < "2" else w for x in (n[0], n[3])] for v, w in ((0, 200), (200, 800)))
    place = (int(n[:3]) - first[0]) * many[1] * 10_000 + (int(n[3:6]) - first[1]) * 10_000 + int(n[6:])
    rest, line = divmod(feistel_of(place, many[0], many[1] * 10_000, "phone", back), 10_000)
    return f"{rest // many[1] + first[0]:03}{rest % many[1] + first[1]:03}{line:04}"


def test_pseudonyms_and_their_inverse_in_plain_python(spark):
    r = random.Random(12)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    mails = [f"{''.join(r.choice('abcXYZ019') for _ in range(r.randint(1, 40)))}@h{digits(2)}.org" for _ in range(40)]
    hexes = ["token=" + "".join(r.choice("0123456789abcdef") for _ in range(r.randint(6, 70))) for _ in range(40)]
    ssns = [
        f"{a:03}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}" for a in [
            1, 665, 667, 899, *(r.choice([x for x in range(1, 900) if x != 666]) for _ in range(200))
        ]
    ]
    ips = [".".join(str(r.randint(0, 255)) for _ in range(4)) for _ in range(40)]
    phones = [
        f"({r.randint(0, 999):03}) {r.randint(0, 999):03}-{digits(4)}" for _ in range(100)
    ] + [f"+44 {digits(3)} {digits(3)} {digits(4)}" for _ in range(20)]
    dates = [f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2099)}" for _ in range(40)]
    values = mails + hexes + ssns + ips + phones + dates
    got = [x.text for x in masked(docs(spark, values)).orderBy("doc_id").collect()]
    place = lambda ip: sum(int(x) << k for x, k in zip(ip.split("."), (24, 16, 8, 0), strict=True))
    day = lambda d: (datetime.date(*map(int, reversed(d.split(".")))) - datetime.date(1900, 1, 1)).days
    plain = lambda t: "".join(c for c in t if c.isdigit())
    for v, g in zip(values, got, strict=True):
        if "@" in v:
            assert g == feistel(v[:-4], "email") + ".org" and feistel(g[:-4], "email", True) == v[:-4]
        elif v.startswith("token="):
            assert g == "token=" + feistel(v[6:], "hex") and feistel(g[6:], "hex", True) == v[6:]
        elif v in ssns:
            a, group, serial = map(int, g.split("-"))
            assert 1 <= a <= 899 and a != 666 and 1 <= group <= 99 and 1 <= serial <= 9999 and [len(x) for x in g.split("-")] == [3, 2, 4]
            assert ssn_place(g) == feistel_of(ssn_place(v), 898 * 99, 9999, "ssn") and feistel_of(
                ssn_place(g), 898 * 99, 9999, "ssn", True
            ) == ssn_place(v)
        elif v in ips:
            assert place(g) == feistel_of(place(v), 65536, 65536, "ip") and max(map(int, g.split("."))) < 256
        elif v in dates:
            assert day(g) == feistel_of(day(v), *pii.PARTS, "date") and (
                "0" in (v[0], v.split(".")[1][0]) or (min(map(len, v.split(".")[:2])) == 1) == all(
                    str(int(x)) == x for x in g.split(".")[:2]
                ) or min(map(int, g.split(".")[:2])) > 9
            )
        else:
            n, m = plain(v.removeprefix("+44")), plain(g.removeprefix("+44"))
            assert len(n) == len(m) and n != m
            if v[0] == "(":
                assert national(n) == m and national(m, True) == n and (g[0], g[4:6], g[9]) == ("(", ") ", "-")
            else:
                assert g.startswith("+44 ") and [len(x) for x in g.split()] == [3, 3, 3, 4]
    assert len(set(got)) == len(set(values))


def test_forms_stay_and_plain_numbers_are_left_alone(spark):
    texts = [
        "9.2.1984", "09.02.1984", "2/9/1984", "02/09/1984", "rows 100 200 3000", "rows 200 300 4000", "tel: 200 300 4000", "200-300-4000",
        "100-200-3000", "version 1.2.3 of a: b = c"
    ]
    got = [x.text for x in masked(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[4:6] == texts[4:6] and got[8:] == texts[8:] and got[6] == f"tel: {got[7].replace('-', ' ')}" and got[7] != texts[7]
    split = [[int(x) for x in g.replace("/", ".").split(".")] for g in got[:4]]
    assert got[0] == ".".join(map(str, split[0])) and got[2] == "/".join(map(str, split[2])) and len(got[1]) == len(got[3]) == 10
    assert split[0] == split[1] and split[2] == split[3] and split[0][:2] == split[2][:2][::-1]


def test_the_key_is_the_sessions_own(spark):
    spark.conf.unset(pii.KEY_SETTING)
    key = pii.session_key(spark)
    assert len(key) == 64 and pii.session_key(spark) == key
    df = docs(spark, ["a.b@c.org"])
    assert pii.pseudonymize(df, key).first().text != pii.pseudonymize(df, KEY).first().text
    spark.conf.unset(pii.KEY_SETTING)


def test_pseudonyms(spark):
    a = "card 4041894974608795, again 4041-8949-7460-8795; not 4041894974608796. Mail a.b@mail1.example.com at 10.0.0.1, born 1984-02-29 or 29.2.1984, never 1985-02-29. +1 (988) 555-2485 ssn 123-45-6789 000-12-3456 DE89370400440532013000 999.1.1.1"
    rows = masked(docs(spark, [a, "plain words only 12", "x " + a, None, ""])).orderBy("doc_id").collect()
    one, two = rows[0].text, rows[2].text
    assert two == "x " + one and rows[1].text == "plain words only 12" and rows[3].text is None and rows[4].text == "" and rows[0].n_chars == len(one)
    for gone in (
        "4041894974608795", "4041-8949-7460-8795", "a.b@", "10.0.0.1", "1984-02-29", "29.2.1984", "555-2485", "123-45-6789",
        "DE89370400440532013000"
    ):
        assert gone not in one
    for kept in ("4041894974608796", "1985-02-29", "000-12-3456", "999.1.1.1", ".com at "):
        assert kept in one
    c1, c2 = one.split("card ")[1][:16], one.split("again ")[1][:19]
    assert luhn(c1) and c1 == c2.replace("-", "")
    iban = one.split()[-2]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    d1, d2 = one.split("born ")[1][:10], one.split(" or ")[1][:10]
    assert d1 == "-".join(reversed(d2.split(".")))


def test_pseudonym_of_a_mail_address_without_a_digit(spark):
    texts = ["write to jane.doe@example.com", "room 7, jane.doe@example.com", "at @ noon", "no data"]
    got = [r.text for r in masked(docs(spark, texts)).orderBy("doc_id").collect()]
    assert "jane.doe" not in got[0] and got[0].split()[-1] == got[1].split()[-1] and got[2:] == texts[2:]


def test_pseudonyms_of_cards_and_ibans_beside_other_numbers(spark):
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    texts = [
        card, f"{card} 12/25", f"{card} 123", f"15 {card}", f"15 12 {card}", f"{'7 ' * 30}{card} end", f"{card} 123-45-6789",
        f"{card} 2024-01-15", iban, f"{iban} 2024", f"born 25/12/2024, {card}-1@x.org", "4111 1111 1111 1112 12/25", "31/31/2024"
    ]
    got = [r.text for r in masked(docs(spark, texts)).orderBy("doc_id").collect()]
    new, new_iban = got[0], got[8]
    assert luhn(new.replace(" ", "")) and new != card and new_iban != iban
    assert got[1:5] == [f"{new} 12/25", f"{new} 123", f"15 {new}", f"15 12 {new}"]
    assert card not in got[5] and got[5].endswith(" end") and got[9] == f"{new_iban} 2024"
    assert got[6].startswith(new) and "123-45-6789" not in got[6] and got[7].startswith(new) and "2024-01-15" not in got[7]
    assert "25/12/2024" not in got[10] and got[11:] == texts[11:]


def test_date_permutation_is_one_to_one(spark):
    n = spark.range(pii.DAYS).select(pii.feistel_number(F.lit(KEY), F.col("id"), *pii.PARTS, "date").alias("p"))
    got = n.agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(got) == (pii.DAYS, 0, pii.DAYS - 1) and datetime.date(1900, 1, 1) + datetime.timedelta(pii.DAYS - 1) == datetime.date(2099, 12, 31)


def test_substrings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PER_SALT", 2)  # so that the salts of a phrase have to meet
    r = random.Random(4)
    shared = [words(70, 500 + i, 3000) for i in range(3)]
    texts = []
    for k in range(40):
        w = words(60, k, 3000)
        s = shared[k % 3]
        a = r.randrange(0, 15)
        w[30:30] = s[a : a + r.choice([49, 50, 55, 70])]
        texts.append(" ".join(w))
    texts += [texts[3], " ".join(["a"] * 120), " ".join(["a"] * 60), None, "", " ".join(words(49, 1)), " ".join(words(49, 1))]
    seqs = [(t or "").split() for t in texts]
    first = {}
    for i, w in enumerate(seqs):
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)
    got = {x.doc_id: x for x in substrings.kept_words(docs(spark, texts), texts=True).collect()}
    for i, w in enumerate(seqs):
        gone = {p for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for p in range(a, a + 50)}
        left = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()), i


def windows_lost(rows, order):
    """Brute force: for each row (doc_id, text) the places of its words that an earlier doc_id's windows cover."""
    seqs = [(t or "").split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, seqs, strict=True):
        for a in range(len(w) - 49):
            k = tuple(w[a : a + 50])
            first[k] = min(first.get(k, order(d)), order(d))
    return [
        {p for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < order(d) for p in range(a, a + 50)} for (d, _),
        w in zip(rows, seqs, strict=True)
    ]


def test_substrings_with_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PER_SALT", 1)
    monkeypatch.setattr(substrings, "BLOCK", 2_000)  # so that there are many automata
    one, two = words(80, 901, 3000), words(90, 902, 3000)
    text = lambda *parts: " ".join(x for p in parts for x in p)
    rows = [
        (2, text(one, ["x"])), (2, text(["y"], one, two)), (2, text(one, ["x"])), (1, text(two)), (None, text(two, one)),
        (None, text(two, one)), (None, text(one)), (3, None), (None, ""), (4, text(one, ["x"]))
    ]
    order = lambda d: (d is None, d or 0)
    want = [(d, len((t or "").split()), len(gone)) for (d, t), gone in zip(rows, windows_lost(rows, order), strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("block", F.lit(1))
    got = [(x.doc_id, x.n_words, x.n_removed) for x in substrings.kept_words(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(g for _, _, g in want)


def test_the_automata_alone_locate_passages(spark, monkeypatch):
    shared = words(60, 903, 3000)
    df = docs(spark, [" ".join(["a", *shared]), " ".join([*shared, "b"])])
    assert [x.n_removed for x in substrings.kept_words(df).orderBy("doc_id").collect()] == [0, 60]
    found = substrings._occurrences
    monkeypatch.setattr(substrings, "_occurrences", lambda rows: found(rows.where("kind <> 1")))  # automata without phrases
    assert [x.n_removed for x in substrings.kept_words(df).orderBy("doc_id").collect()] == [0, 0]


def test_repeated_rows(spark):
    long_text = " ".join(words(120, 7, 3000))
    df = docs(spark, [long_text, "b " + long_text, long_text + " c"])
    twice = df.unionByName(df.where("doc_id < 2"))
    got = sorted((x.doc_id, x.n_removed) for x in substrings.kept_words(twice).collect())
    assert got == [(0, 0), (0, 0), (1, 120), (1, 120), (2, 120)]
    links = sorted((x.doc_id, x.class_id, x.n_links) for x in jaccard.near_duplicates(twice).collect())
    assert links == [(0, 0, 4), (0, 0, 4), (1, 0, 4), (1, 0, 4), (2, 0, 4)]


def ids_of(texts, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


TEXTS = [
    "It's İstanbul ẞtraße ΟΔΟΣ x́é don't<|endoftext|> hi", None, "", "a b  c 12½ ³ <b>&amp;", " ".join(words(9000, 3)), "漢字 と かな x y",
    *[" ".join(words(n, n)) for n in range(1, 60)]
]


def test_packed_pieces(spark):
    want = ids_of(TEXTS)
    rows = packing.pack_documents(docs(spark, TEXTS), capacity=256).collect()
    seqs = {}
    for x in rows:
        own = want[x.doc_id][x.start : x.start + x.length]
        assert len(own) == x.length and x.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 256
    assert sum(x.length for x in rows) == sum(map(len, want))


def test_packed_matrices_read_back(spark):
    want = ids_of(TEXTS)
    back = {}
    for x in packing.packed_matrices(docs(spark, TEXTS), capacity=256).collect():
        ids, pos = np.frombuffer(x.input_ids, "<u2"), np.frombuffer(x.position_ids, "<u2")
        assert len(ids) == len(pos) == x.cu_seqlens[-1] <= 256
        for k, (a, b) in enumerate(zip(x.cu_seqlens, x.cu_seqlens[1:], strict=False)):
            assert pos[a:b].tolist() == list(range(b - a)) and x.starts[k] == x.pieces[k] * 256
            back[x.doc_ids[k], x.pieces[k]] = ids[a:b].tolist()
    for i, own in enumerate(want):
        assert [y for k in sorted(p for d, p in back if d == i) for y in back[i, k]] == own


def test_pieces_with_clashing_columns_and_equal_rows(spark):
    rows = [(None, 60, 7, "g")] * 40 + [(5, 40, 7, "g")] * 40 + [(6, 100, 7, "g")]
    df = spark.createDataFrame(rows, "doc_id long, length long, offset long, group_no string")
    got = packing.pack_pieces(df, capacity=100, per_group=20).collect()
    assert len(got) == 81 and got[0].group_no == "g"
    seqs = {}
    for x in got:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert all(sum(n for _, n in v) <= 100 and min(v)[0] == 0 for v in seqs.values()) and 41 <= len(seqs) <= 60
    df = docs(spark, ["a b c", "d"]).withColumn("doc_id", F.col("doc_id").cast("decimal(9,2)"))
    assert sorted(str(i) for x in packing.packed_matrices(df).collect() for i in x.doc_ids) == ["0.00", "1.00"]


def quadratic_best_fit(lengths, cap):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in range(len(rooms)) if rooms[r] >= n]
        if fit:
            rooms[min(fit, key=lambda r: rooms[r])] -= n
        else:
            rooms.append(cap - n)
    return sorted(rooms)


def test_best_fit_decreasing_against_a_quadratic_version():
    for seed in range(60):
        r = random.Random(seed)
        lengths = [r.randint(1, 100) for _ in range(r.randint(0, 150))]
        bins = packing.best_fit_decreasing(lengths, 100)
        assert sorted(100 - sum(lengths[i] for i in b) for b in bins) == quadratic_best_fit(lengths, 100)


def fewest(lengths, cap):
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                place(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, cap - lengths[i]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_sets():
    for seed in range(40):
        r = random.Random(seed)
        lengths = [r.randint(5, 60) for _ in range(r.randint(1, 12))]
        bins = packing.bin_completion(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) == fewest(lengths, 100), (seed, lengths)
    assert packing.bin_completion([], 100) == [] and packing.best_fit_decreasing([], 10) == []


def test_best_fit_decreasing_takes_the_least_room():
    assert packing.best_fit_decreasing([6, 7, 3, 4], 10) == [[1, 2], [0, 3]]


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    text = " ".join(words(200, 1, 9000)).replace("w", "the ")
    extra = spark.createDataFrame(
        [
            (10_001, "!!! 123 ###", "en", "x", 11), (10_002, text + " " + bench + " the and", "en", "x", 1),
            (10_003, text + " " + bench + " the and", "en", "x", 1), (10_004, None, None, None, None)
        ],
        d.schema
    )
    now, columns = d.unionByName(extra), set(d.columns)
    for name, stage in cp.STAGES:
        before = now
        now = stage(spark, before, sf).persist()
        kept = {x.doc_id for x in now.select("doc_id").collect()}
        if name != "best_fit_packing":
            assert set(now.columns) == columns and now.schema == before.schema
        if name == "language_id":
            assert not kept & {10_001, 10_004} and len(kept) >= 0.98 * d.count()
        if name == "ngram_jaccard_join":
            assert 10_003 not in kept
        if name == "benchmark_decontamination" and 10_002 in kept:
            assert bench not in now.where("doc_id = 10002").first().text
    assert now.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_stages_on_empty_tables_nulls_and_clashing_columns(spark, sf):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{sf}/documents.parquet").withColumns(
        {"row": F.lit(1), "spans": F.lit("s"), "found": F.lit("f"), "offset": F.lit(2), "digest": F.lit("d")}
    )
    odd = d.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(
        d.limit(2).withColumn("text", F.lit(None).cast("string"))
    ).unionByName(d.limit(2).withColumn("text", F.lit(" ")))
    some = d.where("doc_id < 60").unionByName(odd).unionByName(d.where("doc_id < 5"))
    for name, stage in cp.STAGES:
        out = stage(spark, some.where("doc_id < 0"), sf)
        assert out.count() == 0, name
        out = stage(spark, some, sf)
        n = out.count()
        if name == "best_fit_packing":
            assert n >= some.count()
        else:
            assert out.dtypes == some.dtypes and n > 50, name
        if name in ("pii", "benchmark_decontamination"):
            assert out.where("doc_id is null").count() == 3 and out.where("text is null").count() == 2
        if name == "ngram_jaccard_join":
            assert n < some.count() and out.where("doc_id < 5 and trim(text) <> ''").groupBy("doc_id").count().where("count > 1").count() == 0


def test_salts_meet_in_rows_of_many_windows(spark, monkeypatch):
    """One passage in 120 contexts: what its salts keep is listed, not a row for each of a text's windows."""
    monkeypatch.setattr(substrings, "PER_SALT", 40)
    shared, contest, seen = words(55, 904, 3000), substrings._contest, []
    monkeypatch.setattr(substrings, "_contest", lambda rows: seen.append((rows.count(), (out := contest(rows)).count())) or out)
    rows = [(i, " ".join([*words(45, 2 * i, 3000), *shared, *words(45, 2 * i + 1, 3000)])) for i in range(120)]
    want = [len(gone) for gone in windows_lost(rows, lambda d: d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [x.n_removed for x in substrings.kept_words(df).orderBy("doc_id").collect()] == want and sum(want) >= 119 * 55
    (of, made), = seen
    assert made <= 3 * of
