"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import cut, free_name, numbered, read, ready
from wardlight.llm.decontaminate import decontaminate
from wardlight.llm.jaccard import near_duplicate_rows
from wardlight.llm.langid import keep_identified, train
from wardlight.llm.packing import pack_documents
from wardlight.llm.pii import pseudonymize, session_key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models are trained on the documents that state a language; documents that identification rejects go.

    Those are null and blank texts, texts without a letter, and texts unlike any language. Where no document states a
    language, only the texts without a letter go. Rows with null or repeated ids are judged each by its own text; columns
    of any name are kept; an empty table stays empty; texts are scored whole; ties go to the first language by name.
    """
    ready(spark)
    return keep_identified(docs, train(docs.select("doc_id", "text", "lang")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, that with the least doc_id; rows are told apart by a key of their own.

    Of equal ids, and of repeated rows, the first row stays; a null id comes after all others. Null and blank texts are
    linked to nothing and stay. Columns of any name are kept; an empty table stays empty; texts are compared whole.
    """
    ready(spark)
    key = free_name(docs, "row")
    rows = numbered(docs, key)
    judged = near_duplicate_rows(rows.select(F.col(key).alias("row"), "doc_id", "text"))
    first = judged.where("first").select(F.col("row").alias(key))
    return rows.join(first.hint("shuffle_hash"), key, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that are mostly such passages go.

    Each row is judged by its own text, whether its id is null or repeated; null and blank texts stay as they are, and
    where there is no item, or no document, nothing changes. Columns of any name are kept; texts are read whole.
    """
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format, by the session's key (see pii.session_key).

    Every row stays; null texts stay null; repeated rows stay alike; columns of any name are kept; texts are read whole.
    """
    ready(spark)
    return pseudonymize(docs, session_key(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and its place there.

    A null or blank text is its end id alone; rows with null or repeated ids are packed each on its own; other columns
    are not read; an empty table gives an empty one; texts are read whole, and only those longer than a sequence are cut.
    """
    ready(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: Language models and pseudonyms cannot be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's result is a table that the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
