"""Quality rules: repetition from suffix arrays over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import ragged, read, row_of, row_sums, slices, words_of


def suffix_array(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of many rows at once and the longest common prefix (in words) of each suffix with the one before it.

    A suffix ends with its row, and suffixes of different rows are never neighbours in one interval: the row number
    leads the order. Prefix doubling keeps only the suffixes that are still tied, so that rows without long repeats
    are done after one or two rounds.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = rows * (int(words.max()) + 2) + words + 1
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first place of its class
    ends = np.searchsorted(rows, rows, side="right")
    width = 1
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [n]]))
        tied = first[size > 1]
        if not len(tied):
            break
        places = ragged(tied, size[size > 1])
        at = order[places]
        ahead = at + width
        follow = np.where(ahead < ends[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[at]
        by = np.lexsort((follow, group))
        at, follow, group = at[by], follow[by], group[by]
        order[places] = at
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        new[places] = fresh
        rank[at] = places[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        width *= 2
    # Longest common prefixes: compare with the neighbour, word by word, dropping the pairs that have ended.
    lcp = np.zeros(n, np.int64)
    live = np.arange(1, n)
    a, b = order[:-1], order[1:]
    live = live[rows[a] == rows[b]]
    step = 0
    while len(live):
        a, b = order[live - 1] + step, order[live] + step
        inside = (a < ends[order[live - 1]]) & (b < ends[order[live]])
        same = np.zeros(len(live), bool)
        same[inside] = words[a[inside]] == words[b[inside]]
        live = live[same]
        step += 1
        lcp[live] = step
        if step == 64 and len(live):
            _finish(words, rows, order, rank, ends, lcp)
            break
    return order, lcp


def _finish(words: np.ndarray, rows: np.ndarray, order: np.ndarray, rank: np.ndarray, ends: np.ndarray, lcp: np.ndarray) -> None:
    """Kasai's scan for the suffixes of rows with prefixes of 64 words or more: linear in their words."""
    long_rows = np.unique(rows[order[lcp >= 64]])
    w, place = words, rank
    for row in long_rows.tolist():
        lo = int(np.searchsorted(rows, row))
        hi = int(ends[lo])
        seq, spots = w[lo:hi].tolist(), place[lo:hi].tolist()
        base, size = min(spots), hi - lo
        starts = (order[base : base + size] - lo).tolist()
        found, h = [0] * size, 0
        for i in range(size):
            at = spots[i] - base
            if at:
                j = starts[at - 1]
                most = size - max(i, j)
                while h < most and seq[i + h] == seq[j + h]:
                    h += 1
                found[at] = h
                h = max(h - 1, 0)
            else:
                h = 0
        lcp[base : base + size] = found


def repeat_lengths(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each word, the longest repeated substring that starts there: the maximal interval it belongs to."""
    order, lcp = suffix_array(words, rows)
    out = np.zeros(len(words), np.int64)
    if len(words):
        out[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    return out


def covered_words(longest: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Words of each row in the union of its repeated substrings of `least` words or more."""
    starts = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + longest[starts], -1)
    return row_sums((np.cumsum(change[:-1]) > 0).astype(np.int64), offsets)


def quality_rules(
    docs: DataFrame, least: int = 10, max_covered: float = 0.6, max_repeat: int = 400, max_repeat_share: float = 0.5, min_words: int = 50,
    max_repeat_words_pct: int = 50
) -> DataFrame:
    """docs (doc_id, text) → one row per input row with repetition figures and the verdict.

    For each text a suffix array over its words gives the longest repeated substring at each word. The spans of
    repeated substrings of `least` words or more are united: covered_words. A text fails when they cover more than
    max_covered of it, or when its longest repeat has more than max_repeat words or over max_repeat_share of the text.
    base_failed: fewer than min_words words, or more than max_repeat_words_pct percent of the words are in 3-word
    windows found twice or more.

    Each text is judged on its own, so nothing is shuffled and repeated rows give repeated results. Null and blank
    texts have no words: all figures are 0 and base_failed is true. Very long texts are held one at a time. Columns of
    the input other than doc_id and text are ignored; an empty table gives an empty one; ties cannot arise, as figures
    are of all repeats together.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            words, _, offsets = words_of(batch.column("text"))
            n = np.diff(offsets)
            longest = repeat_lengths(words, row_of(offsets))
            top = np.zeros(len(n), np.int64)
            if len(words):
                np.maximum.at(top, row_of(offsets), longest)
            triples = covered_words(np.where(longest >= 3, longest, 0), offsets, 3)
            covered = covered_words(longest, offsets, least)
            bad = (covered > max_covered * n) | (top > max_repeat) | ((top >= least) & (top > max_repeat_share * n))
            failed = (n < min_words) | (100 * triples > max_repeat_words_pct * n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n), batch.column("word_chars"), batch.column("n_symbols"), batch.column("n_dup_lines"),
                    pa.array(triples), pa.array(failed), pa.array(~failed & ~bad), pa.array(covered), pa.array(top)
                ],
                names=[
                    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words",
                    "longest_repeat"
                ],
            )

    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "doc_id",
        "text",
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.when(F.contains(text, F.lit("\n")), F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long").alias("n_dup_lines"),
    )
    id_type = dict(docs.dtypes)["doc_id"]
    return counted.mapInArrow(
        judge,
        f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).drop("longest_repeat")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, w, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(coalesce(text,''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, n_words, unnest(w) AS w, unnest(range(n_words)) AS i FROM b),
g AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g3 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r3 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g3) AS c FROM g WHERE g3 IS NOT NULL) WHERE c > 1),
c3 AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM r3, range(3) t(k) GROUP BY doc_id),
t AS (SELECT doc_id, unnest(range(n_words - 9)) AS i, w FROM b WHERE n_words >= 10),
r10 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(w[i+1:i+10], ' '))) AS c FROM t) WHERE c > 1),
c10 AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM r10, range(10) t(k) GROUP BY doc_id),
m AS (SELECT doc_id, w, n_words, least(400, greatest(9, floor(0.5 * n_words)::BIGINT)) + 1 AS m FROM b WHERE n_words >= 10),
x AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, m.w[i+1:i+m] AS s FROM m JOIN r10 USING (doc_id) WHERE i + m <= n_words) GROUP BY doc_id, md5(array_to_string(s, ' ')) HAVING count(*) > 1)
SELECT b.doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c3.n, 0)::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(c3.n, 0) > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(c3.n, 0) > 50 * n_words) AND NOT (coalesce(c10.n, 0) > 0.6 * n_words OR x.doc_id IS NOT NULL) AS kept, coalesce(c10.n, 0)::BIGINT AS covered_words
FROM b LEFT JOIN c3 ON b.doc_id = c3.doc_id LEFT JOIN c10 ON b.doc_id = c10.doc_id LEFT JOIN x ON b.doc_id = x.doc_id
"""
