"""One query for each corpus operator over its whole table.

Each gets its rows through the operator and derives the digest columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, frames, kdtree, langid, lexical, lm, media, oracles, packing, quality, runs, simhash, substring_dedup, warc, windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substring_dedup.dedup_substrings(docs)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = media.store(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = media.load(images)
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "width",
        "height",
        "tensor",
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit(docs, labels, quality.graded(labels)))
    return scored.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= quality.KEEP).alias("keep"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(_table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    both = bpe.decode(encoded, path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{frames.shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    saved = warc.save(warc.write(_table(spark, sf_dir, "pages")), f"{folder}/gzip")
    files = warc.normalise(saved, f"{folder}/records")
    frames.delete(spark, f"{folder}/gzip")
    rows = warc.read(files, payloads=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: What op12's contract counts as a word.
_WORD = r"[^\x20\x09-\x0D]+"


def _with_repeats(docs: DataFrame) -> DataFrame:
    """The documents, of which op12's contract lets a tenth repeat a part of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    some = docs.filter(h % 10 == 0).select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    some = some.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    once = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    often = F.slice(F.flatten(F.array_repeat(once, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    told = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), often), " ")
    rest = docs.filter((h % 10 != 0) | h.isNull()).select("doc_id", "text")
    return rest.unionByName(some.select("doc_id", F.when(F.col("n") > 0, told).otherwise(F.col("text")).alias("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_with_repeats(_table(spark, sf_dir, "documents")))
    longest = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    rows = found.withColumn("longest", longest)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"longest.{c}").alias(c) for c in runs.RUN.names],
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_windows(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_media": op2_media,
    "op3_quality": op3_quality,
    "op4_top_k": op4_top_k,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_bpe": op7_bpe,
    "op8_lm_scores": op8_lm_scores,
    "op9_simhash": op9_simhash,
    "op10_warc": op10_warc,
    "op11_lexical_search": op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_window_packing": op13_window_packing,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op4_top_k": oracles.OP4,
    "op10_warc": oracles.OP10,
    "op11_lexical_search": oracles.OP11,
    "op12_periodic_runs": oracles.OP12,
}
