"""Extraction from files as they arrive.

Each micro-batch is recognised and extracted whole: a file is one document, so
no state is kept between batches.  A batch writes a folder of its own
(``batch=<id>``) and replaces it when it is run again.

Files of another kind, or of no bytes, are results with a message, too.  They
start a batch like any other, but Spark's reader gives no row for some of them,
so each batch lists the folder and tells of those that no batch before it has
told of; which these are is kept beside the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vetloom.operators import extract
from vetloom.session import checkpointed, exists
from vetloom.sources import files, listing


def extract_files(spark: SparkSession, folder: str, factory: Callable[[], files.Recogniser], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream from the files of a folder to a Parquet table of extraction results."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    known = f"{checkpoint.rstrip('/')}/refused"

    def refused(batch: int) -> DataFrame:
        """The refused files that earlier batches have not told of, written as those of this one."""
        _, now = files.told(listing.listed(spark, folder))
        before = spark.read.schema("path string, batch long").parquet(known).filter(F.col("batch") < batch).select("path") if exists(spark, known) else spark.createDataFrame([], "path string")
        new = checkpointed(now.join(before, "path", "left_anti"))
        new.select("path").write.mode("overwrite").parquet(f"{known}/batch={batch}")
        return new.select(F.col("path").alias("doc_id"), "message")

    def each(frame: DataFrame, batch: int) -> None:
        taken = frame.select("path", files.suffix(F.col("path")).alias("suffix"), "content").filter(F.col("suffix").isin(*files.SUFFIXES))
        rows = checkpointed(files.recognised_rows(taken, factory))  # a recogniser is dear: it sees each file once
        tokens, failures = files.told_apart(rows)
        extract.results(tokens, failures.unionByName(refused(batch))).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
