"""python tests/llm/recall_of_jaccard.py DIR: recall of op1 against brute force over whole sets.

The queries are the rows whose doc_id is divisible by 100, compared with all rows of DIR/documents.parquet by an index of
their shingles. A link is found if both rows are of one class and the query's count of links is what brute force counts.
"""

import os
import re
import sys
import tempfile
from collections import Counter, defaultdict

import pyarrow.dataset as ds

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def main(path):
    from pyspark.sql import SparkSession

    from wardlight.llm.jaccard import op1_ngram_jaccard_join

    conf = {
        "spark.master": "local[8]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.local.dir": tempfile.mkdtemp(prefix="spark-"), "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-"),
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    told = {r.doc_id: (r.class_id, r.n_links) for r in op1_ngram_jaccard_join(spark, path).collect()}
    spark.stop()
    rows = ds.dataset(f"{path}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    queries, index = {}, defaultdict(list)
    for k, text in zip(rows["doc_id"], rows["text"], strict=True):
        if k % 100 == 0:
            queries[k] = shingles(text)
            for s in queries[k]:
                index[s].append(k)
    links = []
    for k, text in zip(rows["doc_id"], rows["text"], strict=True):
        own = shingles(text)
        for q, common in Counter(q for s in own if s in index for q in index[s]).items():
            if q != k and 5 * common >= 4 * (len(own) + len(queries[q]) - common):
                links.append((q, k))
    count = Counter(q for q, _ in links)
    found = sum(told[q][0] == told[k][0] for q, k in links)
    wrong = sum(told[q][1] != count[q] for q in queries)
    print(f"{len(queries)} queries, {len(links)} links, {found} within one class (recall {found / max(len(links), 1):.4f}), {wrong} queries with another count")


if __name__ == "__main__":
    main(sys.argv[1])
