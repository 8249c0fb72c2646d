"""Listing and reading of folders in tasks, with every file that is there.

Spark's file readers pass over files of no bytes and over names that begin with
``_`` or ``.``.  An upload must not vanish so, and is listed here: folders are
rows, and each task lists its own, level by level.  A folder is listed by one
task; its files are dealt anew before they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.session import checkpointed

#: Bytes of files that a task reads, about, and those that are handed on at once.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Files that a task reads, about, and those of a folder that are handed on at once.
TASK_FILES, BATCH_FILES = 8192, 8192


def _at(uri: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in each folder; a file that stands for itself is in its own."""
    from pyarrow import fs

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            system, root = _at(uri)
            (mine,) = system.get_file_info([root])
            found = system.get_file_info(fs.FileSelector(root)) if mine.type == fs.FileType.Directory else [mine] if mine.type == fs.FileType.File else []
            for start in range(0, len(found), BATCH_FILES):
                some = found[start : start + BATCH_FILES]
                paths = [uri.rstrip("/") + x.path[len(root.rstrip("/")) :] for x in some]
                folder = [x.type == fs.FileType.Directory for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([x.size or 0 for x in some], pa.int64()), pa.array(folder, pa.bool_())], ["path", "length", "folder"])


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of every file below a folder, or of the file if it is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    level, done = spark.createDataFrame([(root,)], "path string"), None
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    while True:
        found = checkpointed(level.mapInArrow(_lists, "path string, length long, folder boolean"))
        files = found.filter("not folder").drop("folder")
        done = files if done is None else done.unionByName(files)
        folders = found.filter("folder").select("path")
        if not (n := folders.count()):
            return done
        # the number is told: a few folders are few bytes, and would else be put together, however many files they have
        level = folders.repartition(min(n, most))


def contents(files: DataFrame) -> DataFrame:
    """Adds ``content``, the bytes of each file (columns path, length and others)."""
    names = files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, blobs = 0, 0, []
            for i, uri in enumerate(batch.column("path").to_pylist()):
                system, path = _at(uri)
                with system.open_input_stream(path) as file:
                    blobs.append(file.read())
                size += len(blobs[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(blobs)).columns, pa.array(blobs, pa.binary())], [*names, "content"])
                    start, size, blobs = i + 1, 0, []

    total = files.agg(F.sum("length").alias("bytes"), F.count("*").alias("files")).first()
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total["bytes"] or 0) // TASK_BYTES), -(-total["files"] // TASK_FILES))
    return files.repartition(tasks, "path").mapInArrow(read, files.schema.fromJson(files.schema.jsonValue()).add("content", "binary"))
