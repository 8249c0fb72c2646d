"""Another system that vendors are pushed to, as a plug-in.

A client is made once for each task, by a factory, so that its connection lives
where it is used.  It has

* ``health_check()``: whether the system can be reached;
* ``check_duplicate(vendor)``: whether it has a vendor with one of these keys;
* ``create_vendor(vendor)``: an :class:`Answer`.

A vendor is a dictionary with the columns of ``schemas.VENDORS``.

Vendors that share a PAN, a GSTIN or an account number must reach the system in
the order of their arrival, while all others may go at once.  So they are pushed
in waves:

* whoever comes first for all of its keys, and whoever has none or is invalid,
  depends on nobody;
* whoever shares a key with a vendor that was created is refused at any time, so
  the many vendors of one key need no order among themselves;
* after :data:`admission.ROUNDS` such waves connected components of shared keys
  are what is left; each of at most :data:`admission.GROUP` vendors goes to one
  task, which sends in the order of arrival.  Larger ones take more waves.

Tasks can run again after an executor was lost.  With a ledger (a folder that all
executors reach) answers are written down in blocks of ``flush``, and another
attempt, or a push that is started again, does not send what was answered.  What
was sent since the last block is sent again: ``create_vendor`` must give the same
answer to the same ``arrival_seq``, and ``check_duplicate`` must not count it.
Speculative tasks would send side by side, so leave them off.

Contract: vendors with the same ``arrival_seq`` come in any one order.  Repeated
rows are vendors each.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetloom.operators import admission, vendors
from vetloom.operators.admission import DUPLICATE, NO_CONNECTION
from vetloom.schemas import VENDORS
from vetloom.session import checkpointed, stored

from . import ledger as L
from .ledger import Answer

#: What a system can answer (fixed values).
CODES = ("SUCCESS", "VALIDATION_ERROR", "DUPLICATE_VENDOR", "CONNECTION_ERROR", "AUTHENTICATION_ERROR", "PERMISSION_DENIED", "INTERNAL_ERROR", "TIMEOUT")
_ANSWER = "success boolean, error_code string, message string, vendor_id string, erp_reference string"


class Client(Protocol):
    def health_check(self) -> bool: ...

    def check_duplicate(self, vendor: dict) -> bool: ...

    def create_vendor(self, vendor: dict) -> Answer: ...


def _keys(vendor: dict) -> list[str]:
    """The keys that a vendor would hold, as ``admission.keys`` gives them."""
    bank = vendor["bank_details"]
    found = ("pan:", (vendor["pan"] or "").upper()), ("gstin:", (vendor["gstin"] or "").upper()), ("account:", (bank["account_number"] if bank else None) or "")
    return [tag + text for tag, text in found if text]


class FolderClient:
    """A system that takes vendors as files: a JSON document for each, and for each key one that names its holder."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))

    def _path(self, kind: str, name: str) -> str:
        digest = hashlib.sha256(name.encode()).hexdigest()
        return f"{kind}/{digest[:2]}/{digest}"

    def write(self, name: str, text: str) -> None:
        """Writes a file of the folder."""
        path = f"{self.root}/{name}"
        try:
            out = self.fs.open_output_stream(path)
        except FileNotFoundError:  # the first file of a folder
            self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            out = self.fs.open_output_stream(path)
        with out:
            out.write(text.encode())

    def health_check(self) -> bool:
        return True

    def check_duplicate(self, vendor: dict) -> bool:
        for key in _keys(vendor):
            try:
                with self.fs.open_input_stream(f"{self.root}/{self._path('keys', key)}") as file:
                    if file.read().decode() != str(vendor["arrival_seq"]):
                        return True
            except FileNotFoundError:
                pass
        return False

    def create_vendor(self, vendor: dict) -> Answer:
        number = hashlib.sha256(str(vendor["arrival_seq"]).encode()).hexdigest().upper()
        self.write(self._path("vendors", str(vendor["arrival_seq"])), json.dumps(vendor, default=str))
        for key in _keys(vendor):
            self.write(self._path("keys", key), str(vendor["arrival_seq"]))
        return Answer(True, "SUCCESS", f"Vendor '{vendor['vendor_name']}' created successfully", f"VND-{number[:8]}", f"TXN-{number[8:16]}")


def _ask(client: Client, vendor: dict, errors: str | None) -> Answer:
    if errors:
        return Answer(False, "VALIDATION_ERROR", f"Validation failed: {errors}")
    try:
        if client.check_duplicate(vendor):
            return Answer(False, "DUPLICATE_VENDOR", DUPLICATE)
        return client.create_vendor(vendor)
    except Exception as error:  # one vendor's failure is a result of its own
        return Answer(False, "INTERNAL_ERROR", str(error))


def _sender(factory: Callable[[], Client], folder: str | None, wave: str, flush: int):
    """Vendors in the order in which they are sent become answers."""

    kinds = pa.schema([("_row", pa.int64()), ("success", pa.bool_()), *((n, pa.string()) for n in Answer._fields[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        book = L.Ledger(folder, f"{wave}/{context.partitionId()}", context.attemptNumber()) if folder else None
        told = book.told() if book else {}
        client, up = None, False
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                at, id_, errors = row.pop("_row"), row.pop("_vendor"), row.pop("_errors")
                if (answer := told.get(id_)) is None:
                    if client is None:
                        client = factory()
                        up = client.health_check()
                    answer = _ask(client, row, errors) if up else Answer(False, "CONNECTION_ERROR", NO_CONNECTION)
                    if book:
                        book.add(id_, answer)
                        if len(book.open) >= flush:
                            book.flush()
                rows.append({"_row": at, **answer._asdict()})
            yield pa.RecordBatch.from_pylist(rows, kinds)
        if book:
            book.flush()

    return run


def push(arrivals: DataFrame, factory: Callable[[], Client], ledger: str | None = None, rounds: int = admission.ROUNDS, group: int = admission.GROUP, flush: int = 100) -> DataFrame:
    """(arrival_seq, success, error_code, message, vendor_id, erp_reference) of each vendor; invalid ones are not sent, and an exception is an INTERNAL_ERROR."""
    spark, names, run = arrivals.sparkSession, VENDORS.fieldNames(), uuid.uuid4().hex
    keys = F.when(F.size(vendors.errors()) == 0, admission.keys()).otherwise(F.array().cast("array<string>"))
    rows = checkpointed(arrivals.select(*names, F.array_join(vendors.errors(), "; ").alias("_errors"), keys.alias("keys"), admission.digest().alias("_digest")).withColumn("_row", F.monotonically_increasing_id()))
    # repeated rows are told apart by their number
    rows = rows.withColumn("_vendor", F.concat_ws("-", "_digest", F.row_number().over(Window.partitionBy("_digest").orderBy("_row"))))
    open_ = rows = checkpointed(rows.drop("_digest"))
    done = None

    def settled(answers: DataFrame) -> None:
        nonlocal done
        done = answers if done is None else done.unionByName(answers)

    def refused(waiting: DataFrame, answers: DataFrame) -> DataFrame:
        """Those of the waiting that share a key with a vendor that was created."""
        held = rows.join(answers.filter("success"), "_row", "left_semi").select(F.explode("keys").alias("key")).distinct()
        return checkpointed(waiting.select("_row", F.explode("keys").alias("key")).join(held, "key", "left_semi").select("_row").distinct())

    def sent(wave: DataFrame, number: int) -> DataFrame:
        """Sends a wave of (_row, _group): rows of a group in one task, in the order of arrival."""
        dealt = rows.join(wave, "_row").repartition("_group").sortWithinPartitions("arrival_seq", "_row")
        answers = dealt.select(*names, "_row", "_vendor", "_errors").mapInArrow(_sender(factory, ledger, f"{run}/{number}", flush), f"_row long, {_ANSWER}")
        return stored(answers)  # written once: a frame that is computed again would send again

    late = spark.createDataFrame([], "_row long")
    if ledger and (before := L.earlier(spark, ledger)) is not None:
        known = checkpointed(rows.select("_row", "_vendor").join(before, F.col("_vendor") == F.col("id")).drop("_vendor", "id"))
        settled(known)
        open_ = checkpointed(rows.join(known, "_row", "left_anti"))
        late = refused(open_, known)
    free, number = open_.filter(F.size("keys") == 0).select("_row"), 0
    open_ = checkpointed(open_.filter(F.size("keys") > 0).join(late, "_row", "left_anti").select(F.col("arrival_seq").alias("a"), F.col("_row").alias("b"), "keys"))
    late = late.unionByName(free)
    while not (late.isEmpty() and open_.isEmpty()):
        wave = late.select("_row", F.col("_row").alias("_group"))
        if number >= rounds:
            grouped = checkpointed(admission.grouped(open_))
            sized = grouped.groupBy("root").agg(F.count("*").alias("n"))
            small = grouped.join(sized.filter(F.col("n") <= group), "root", "left_semi").select(F.col("b").alias("_row"), F.col("root.b").alias("_group"))
            wave, open_ = checkpointed(wave.unionByName(small)), checkpointed(grouped.join(sized.filter(F.col("n") > group), "root", "left_semi").select("a", "b", "keys"))
        first = checkpointed(admission.firsts(open_).select(F.col("b").alias("_row")))
        answers = sent(wave.unionByName(first.select("_row", F.col("_row").alias("_group"))), number)
        settled(answers)
        waiting = open_.withColumnRenamed("b", "_row").join(first, "_row", "left_anti")
        late = refused(waiting, answers)
        open_ = checkpointed(waiting.join(late, "_row", "left_anti").select("a", F.col("_row").alias("b"), "keys"))
        number += 1
    if done is None:
        done = spark.createDataFrame([], f"_row long, {_ANSWER}")
    return rows.select("_row", "arrival_seq").join(done, "_row").drop("_row")
