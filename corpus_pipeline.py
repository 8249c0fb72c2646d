"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.llm import frames, langid, packing, quality, simhash, substring_dedup
from vetloom.session import ship

#: The stages' models and sorts have no SQL form.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language, go."""
    ship(spark)
    return langid.identify(docs).filter("not rejected").select(*docs.columns)


def rated_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are unlikely to be of the highest grade (good and not toxic) go."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels, quality.graded(labels)))
    return scored.filter(F.col("tail_probability") >= quality.KEEP).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    ship(spark)
    return simhash.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start in an earlier document go; the document stays, and a text without such words stays byte for byte."""
    ship(spark)
    done = substring_dedup.dedup_substrings(docs, cut=True)
    new = {"text": F.col("cut_text"), "n_chars": F.char_length("cut_text").cast("long")}
    return done.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("quality classifier", rated_quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", passages),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs all stages over ``documents``; each result is written as Parquet to the shared folder and read again, and deleted when the next one is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = frames.new_table(spark)
        docs = frames.stored(stage(spark, docs, sf_dir), path)
        if before:
            frames.delete(spark, before)
        before = path
    packed_ = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written when it returns
    frames.delete(spark, before)
    return packed_
