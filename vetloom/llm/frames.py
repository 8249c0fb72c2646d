"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.session import checkpointed, shared_folder  # noqa: F401  the operators take both from here

#: What a row counts beside its text, so that many empty texts are many bytes, too.
ROW_BYTES = 16


def new_table(spark: SparkSession) -> str:
    """A path of its own in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The frame, written as a Parquet table to the path (a new one if none) and read from there."""
    path = path or new_table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing needs any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes what this application's operators have left in the shared folder; frames that read it are lost."""
    for name in ("tables", "warc"):
        delete(spark, f"{shared_folder(spark)}/{name}")


def text_bytes(df: DataFrame, column: str) -> int:
    """The UTF-8 bytes of all values of a column, and some for each row: one number, from a scan of that column."""
    return int(df.agg(F.sum(ROW_BYTES + F.coalesce(F.octet_length(F.col(column)), F.lit(0))).alias("n")).first()["n"] or 0)


def parts(total: int, each: int) -> int:
    """How many parts of ``each`` hold ``total``, one at least."""
    return max(1, math.ceil(total / each))


def tasks(spark: SparkSession, total: int, each: int) -> int:
    """How many tasks share ``total`` bytes so that each has about ``each``, and no fewer than the session's shuffles have."""
    return max(parts(total, each), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(key: Column, n: int) -> Column:
    """A number from 0 to ``n - 1``, spread by a hash of ``key``."""
    return F.pmod(F.xxhash64(key), F.lit(n))


def spread(id_: Column, text: Column, n: int) -> Column:
    """A number from 0 to ``n - 1`` by a row's id, text and partition.

    The partition spreads a row that is repeated very often.  It is the same
    each time that the rows are read, as from files, or computed behind a
    shuffle; where it may not be, write them first.
    """
    return dealt(F.struct(id_, F.xxhash64(text), F.spark_partition_id()), n)


def others(df: DataFrame, *without: str) -> Column:
    """All columns but those named, as one struct, so that they travel under names of their own."""
    names = [c for c in df.columns if c not in without]
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).cast("int").alias("_none"))
