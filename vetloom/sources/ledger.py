"""Answers of another system, written as they come, so that nobody is asked twice.

A task that pushes vendors writes its answers in blocks of JSON lines below the
ledger's folder, one file a block, which appears whole or not at all.  Another
attempt at the task reads what earlier ones have written before it sends
anything, and a push that is started again reads all of it.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.session import exists

SCHEMA = "id string, success boolean, error_code string, message string, vendor_id string, erp_reference string"
#: Answers that say nothing about a vendor, so that another push asks again (fixed values).
PASSING = ("CONNECTION_ERROR", "AUTHENTICATION_ERROR", "INTERNAL_ERROR", "TIMEOUT")


class Answer(NamedTuple):
    success: bool
    error_code: str
    message: str
    vendor_id: str | None = None
    erp_reference: str | None = None


class Ledger:
    """The blocks of one task of a push."""

    def __init__(self, folder: str, part: str, attempt: int) -> None:
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        self.root, self.attempt, self.block = f"{root}/{part}", attempt, 0
        self.fs.create_dir(self.root, recursive=True)
        self.open: list[str] = []

    def told(self) -> dict[str, Answer]:
        """What earlier attempts were told."""
        from pyarrow import fs

        found = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.root)):
            if info.base_name.endswith(".json"):
                with self.fs.open_input_stream(info.path) as lines:
                    for row in map(json.loads, lines.read().splitlines()):
                        id_ = row.pop("id")
                        found[id_] = Answer(**row)
        return found

    def add(self, id_: str, answer: Answer) -> None:
        self.open.append(json.dumps({"id": id_, **answer._asdict()}))

    def flush(self) -> None:
        """Writes the open answers as a block."""
        if self.open:
            name = f"{self.root}/{self.attempt}-{self.block}"
            with self.fs.open_output_stream(f"{name}.part") as out:
                out.write(("\n".join(self.open) + "\n").encode())
            self.fs.move(f"{name}.part", f"{name}.json")
            self.open, self.block = [], self.block + 1


def earlier(spark: SparkSession, folder: str) -> DataFrame | None:
    """The answers of earlier pushes with this ledger that settle a vendor, one for each id; null if there are none."""
    if not exists(spark, folder):
        return None
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return rows.filter(~F.col("error_code").isin(*PASSING)).dropDuplicates(["id"])
