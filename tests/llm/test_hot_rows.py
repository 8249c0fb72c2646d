"""One row repeated very often, and very long texts, where rows meet in chunks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetloom.llm import frames, lm, simhash, substring_dedup, warc

N = 100_000


def equal_rows(spark, text, parts=32):
    return spark.range(N).repartition(parts).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).cast("string").alias("text"))


@pytest.mark.parametrize("text", [None, "one two three four"])
def test_no_group_has_more_than_its_share(spark, text):
    docs = equal_rows(spark, text)
    total = frames.text_bytes(docs, "text")
    assert total == N * (frames.ROW_BYTES + len(text or ""))
    groups = docs.groupBy(frames.spread(F.col("doc_id"), F.col("text"), 64).alias("chunk")).count().toPandas()["count"]
    assert groups.sum() == N and groups.max() <= N // 32 * 5  # 32 partitions, of which a few fall together


def test_operators_on_equal_rows(spark, monkeypatch):
    for module, name in ((substring_dedup, "CHUNK_BYTES"), (lm, "CHUNK_BYTES"), (warc, "SHARD_BYTES")):
        monkeypatch.setattr(module, name, 200_000)
    words = " ".join(f"w{i}" for i in range(15))
    docs = equal_rows(spark, words, 16).unionByName(spark.createDataFrame([(3, words + " tail")], "doc_id long, text string"))
    done = substring_dedup.dedup_substrings(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r["count"]) for r in done) == [(-1, 15, 15, N), (3, 16, 0, 1)]
    scored = lm.score(docs.limit(N // 4)).groupBy("doc_id", "n_tokens", "n_known").count().collect()
    assert sum(r["count"] for r in scored) == N // 4 and all(r.n_tokens in (16, 17) for r in scored)
    pages = docs.limit(N // 4).repartition(16).select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert warc.write(pages).count() > 4


def test_very_long_texts(spark):
    rng = np.random.default_rng(1)
    word = np.array([f"w{i}" for i in range(3000)])
    long = " ".join(word[rng.integers(0, 3000, 500_000)])  # about 3 MB
    part = " ".join(long.split()[1000:1040])
    docs = spark.createDataFrame([(1, long), (2, "x " + part + " y"), (3, long + " end"), (4, "short text")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == {1: (500_000, 0), 2: (42, 40), 3: (500_001, 500_000), 4: (2, 0)}
    scored = {r.doc_id: r for r in lm.score(docs).collect()}
    assert scored[1].n_tokens == 500_001 and np.isfinite(scored[1].score) and scored[1].score > scored[1].base_score
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert near[3] == near[1] == 1 and near[4] == 4
    assert hashlib.sha256(long.encode()).hexdigest() == docs.filter("doc_id = 1").select(F.sha2("text", 256)).first()[0]
