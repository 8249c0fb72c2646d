"""Uploaded files, and recognisers as plug-ins.

A recogniser is a function of a file's bytes and its lower-case suffix.  It
gives a list of pages, each a list of (box, text, confidence) with boxes of
four (x, y) points, and raises what it cannot read.  It is made once in each
worker, by a factory, so that a model is loaded there and never sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.schemas import TOKENS, TRUTH
from vetloom.session import checkpointed

from . import listing

#: Suffixes of files that are taken (fixed values).
SUFFIXES = (".png", ".jpg", ".jpeg", ".pdf")

NO_BYTES = "File has no bytes"

Recogniser = Callable[[bytes, str], list[list[tuple]]]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def told(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed files (path, length): those taken (path, length, suffix), and those refused (path, message)."""
    named = listed.select("path", "length", suffix(F.col("path")).alias("suffix"))
    fine = F.col("suffix").isin(*SUFFIXES)
    message = F.when(~fine, F.concat(F.lit("Unsupported file type: "), "suffix")).otherwise(NO_BYTES)
    return named.filter(fine & (F.col("length") > 0)), named.filter(~fine | (F.col("length") == 0)).select("path", message.alias("message"))


def uploads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every file below a folder: those taken (path, length, suffix, content), and those refused (path, message), files of no bytes among them."""
    taken, refused = told(listing.listed(spark, folder))
    return listing.contents(taken), refused


def recognised_rows(files: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """Tokens of all files, a row without a page for each that has none, and a row with a message for each that could not be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = factory()
        columns = [*TOKENS.names, "message"]
        for frame in frames:
            for path, kind_, content in zip(frame["path"], frame["suffix"], frame["content"], strict=True):
                try:
                    pages = recognise(bytes(content), kind_)
                    rows = [(path, p, i, [{"x": float(x), "y": float(y)} for x, y in box], text, float(conf), None) for p, page in enumerate(pages, 1) for i, (box, text, conf) in enumerate(page)]
                    rows = rows or [(path, None, None, None, None, None, None)]
                except Exception as error:  # a file that cannot be read is a result of its own
                    rows = [(path, None, None, None, None, None, str(error))]
                yield pd.DataFrame(rows, columns=columns)

    schema = TOKENS.fromJson(TOKENS.jsonValue()).add("message", "string")
    return files.select("path", "suffix", "content").mapInPandas(run, schema)


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens, and (doc_id, message) of the files that could not be read."""
    return rows.filter("message is null").drop("message"), rows.filter("message is not null").select("doc_id", "message")


def recognised(files: DataFrame, factory: Callable[[], Recogniser]) -> tuple[DataFrame, DataFrame]:
    """Tokens of all files, and (doc_id, message) of those that could not be read, from one pass over them."""
    return told_apart(checkpointed(recognised_rows(files, factory)))


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """A table of tokens that a recogniser has written."""
    return spark.read.schema(TOKENS).parquet(path)


def labelled_apart(spark: SparkSession, path: str, doc_type: str) -> tuple[DataFrame, DataFrame]:
    """A labelled table (JSON files that hold an array of objects each), and (path, record) of what cannot be read.

    An object that does not fit the schema is a record of its own; a file that is
    no JSON is one as a whole.
    """
    kind = TRUTH[doc_type]
    rows = spark.read.schema(kind.fromJson(kind.jsonValue()).add("_record", "string")).option("multiLine", "true").option("columnNameOfCorruptRecord", "_record").json(path)
    told = checkpointed(rows.select(*kind.names, "_record", F.col("_metadata.file_path").alias("_path")))
    return told.filter("_record is null").select(*kind.names), told.filter("_record is not null").select(F.col("_path").alias("path"), F.col("_record").alias("record"))


def labelled(spark: SparkSession, path: str, doc_type: str) -> DataFrame:
    """The labelled table alone."""
    return labelled_apart(spark, path, doc_type)[0]
