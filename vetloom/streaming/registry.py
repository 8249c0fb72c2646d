"""The registry of vendors as tables that a stream of vendors feeds.

Duplicates last forever, so there is no watermark: each micro-batch is judged
against all admitted vendors, in the order of ``arrival_seq`` within it.  What a
batch or a lookup reads does not grow with the registry:

* a batch writes the vendors that it admits to a folder of its own
  (``fresh/batch=<id>``), so that a batch that is run again after a failure
  replaces what it wrote, and never meets it;
* :data:`FAN` such folders are merged into a segment, and as many segments of
  one level into one of the next, so that a vendor is written again only a
  logarithmic number of times.  A segment has two tables in :data:`BUCKETS`
  buckets: vendors by a hash of their id, and keys (PAN, GSTIN, account) with
  the vendor that holds each, by a hash of the key.  Within a bucket rows are
  sorted, so that statistics also skip row groups;
* which segments there are stands in a manifest.  Each version is a file of its
  own that appears whole, and folders that the last two do not name are deleted:
  a merge that fails leaves what was valid, and readers of the version before
  still find theirs;
* a batch reads only the buckets of its own keys, and a lookup those of what is
  looked up: at most BUCKETS numbers are collected for that.

A registry has one writer and any number of readers.

Contract: a vendor id is the width that is asked for (32 bits of a digest), so
that two vendors may share one; ``get`` and ``lookup`` give all that fit.  The
batch numbers of a registry grow; one that has been merged cannot run again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vetloom.operators import admission
from vetloom.schemas import REGISTRY
from vetloom.session import checkpointed

#: Folders that are merged into one, and buckets of a segment.
FAN, BUCKETS = 8, 256
_KEYS = "key string, vendor_id string, arrival_seq long"


@dataclass(frozen=True)
class Segment:
    """Merged batches ``first`` to ``last``."""

    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"{self.level}-{self.first}-{self.last}"


def _bucket(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def held_keys(vendors: DataFrame) -> DataFrame:
    """(key, vendor_id, arrival_seq) of the registry's rows."""
    bank = F.struct(F.col("bank_account").alias("account_number"))
    return vendors.select("pan", "gstin", bank.alias("bank_details"), "vendor_id", "arrival_seq").select(F.explode(admission.keys()).alias("key"), "vendor_id", "arrival_seq")


class Registry:
    """Admitted vendors below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, rules: admission.Rules = admission.Rules(), fan: int = FAN, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.rules, self.fan, self.buckets = spark, folder.rstrip("/"), rules, fan, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- folders and the manifest

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json")]

    def _segments(self, version: int | None = None) -> list[Segment]:
        """The segments that a version of the manifest names, the last one if none is given."""
        version = max(self._versions(), default=0) if version is None else version
        if not version:
            return []
        file = self._fs.open(self._path(f"{self.folder}/manifest/{version:09d}.json"))
        told = json.loads(bytes(file.readAllBytes()))
        file.close()
        self.buckets = told["buckets"]
        return [Segment(*s) for s in told["segments"]]

    def _commit(self, segments: list[Segment]) -> None:
        version = max(self._versions(), default=0) + 1
        path = self._path(f"{self.folder}/manifest/{version:09d}.part")
        out = self._fs.create(path, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "segments": [[s.level, s.first, s.last] for s in segments]}).encode()))
        out.close()
        if not self._fs.rename(path, self._path(f"{self.folder}/manifest/{version:09d}.json")):
            raise OSError(f"version {version} of the manifest is there already: a registry has one writer")

    def _fresh(self, segments: list[Segment]) -> list[int]:
        """The batches that no segment holds."""
        merged = max((s.last for s in segments), default=-1)
        return [n for n in sorted(int(x.removeprefix("batch=")) for x in self._names("fresh") if x.startswith("batch=")) if n > merged]

    # --- reading

    def _read(self, paths: list[str], schema: object, base: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{base}").parquet(*[f"{self.folder}/{base}/{p}" for p in paths])

    def _table(self, table: str, segments: list[Segment], buckets: Column | None) -> DataFrame:
        """The rows of the segments' table, in some buckets if given."""
        schema = REGISTRY if table == "vendors" else self.spark.createDataFrame([], _KEYS).schema
        if not segments:
            return self.spark.createDataFrame([], schema)
        told = schema.fromJson(schema.jsonValue()).add("segment", "string").add("bucket", "integer")
        rows = self._read([f"segment={s.name}" for s in segments], told, table)
        return (rows if buckets is None else rows.filter(buckets)).drop("segment", "bucket")

    def _new(self, without: int | None = None, segments: list[Segment] | None = None) -> DataFrame:
        """The vendors of batches that are not merged yet."""
        batches = [n for n in self._fresh(self._segments() if segments is None else segments) if n != without]
        if not batches:
            return self.spark.createDataFrame([], REGISTRY)
        return self._read([f"batch={n}" for n in batches], REGISTRY.fromJson(REGISTRY.jsonValue()).add("batch", "long"), "fresh").drop("batch")

    def all(self) -> DataFrame:
        """All admitted vendors; sort by arrival_seq for the order of admission."""
        segments = self._segments()
        return self._table("vendors", segments, None).unionByName(self._new(segments=segments))

    def count(self) -> DataFrame:
        return self.all().agg(F.count("*").alias("count"))

    def get(self, vendor_id: str) -> DataFrame:
        """The vendor of an id: one row, or none.  One bucket is read."""
        segments = self._segments()
        rows = self._table("vendors", segments, F.col("bucket") == _bucket(F.lit(vendor_id), self.buckets)).unionByName(self._new(segments=segments))
        return rows.filter(F.col("vendor_id") == vendor_id)

    def _among(self, wanted: DataFrame, column: str) -> Column:
        """Whether a bucket is one of those that the values need: at most ``buckets`` numbers."""
        numbers = [r[0] for r in wanted.select(_bucket(F.col(column), self.buckets)).distinct().collect()]
        return F.col("bucket").isin(numbers)

    def _holders(self, wanted: DataFrame, segments: list[Segment], without: int | None = None) -> DataFrame:
        """(key, vendor_id, arrival_seq) of the wanted keys that somebody holds; ``wanted`` has distinct keys."""
        keys = self._table("keys", segments, self._among(wanted, "key")).unionByName(held_keys(self._new(without, segments)))
        return keys.join(wanted.select("key"), "key", "left_semi")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """``key`` and the vendor that holds it, for those of the wanted keys (column ``key``, as ``admission.keys`` gives them) that are held."""
        segments = self._segments()
        found = checkpointed(self._holders(checkpointed(wanted.select("key").distinct()), segments))
        rows = self._table("vendors", segments, self._among(found, "vendor_id")).unionByName(self._new(segments=segments))
        return found.join(rows, ["vendor_id", "arrival_seq"]).select("key", *REGISTRY.names)

    # --- writing

    def clear(self) -> None:
        """Forgets all vendors."""
        self._fs.delete(self._path(self.folder), True)

    def admit(self, vendors: DataFrame, batch: int) -> DataFrame:
        """Judges a batch and writes those admitted; gives all outcomes."""
        segments = self._segments()
        if any(batch <= s.last for s in segments):
            raise ValueError(f"batch {batch} has been merged and cannot run again")
        wanted = checkpointed(vendors.select(F.explode(admission.keys()).alias("key")).distinct())
        held = checkpointed(self._holders(wanted, segments, without=batch).select("key"))
        judged = checkpointed(admission.outcomes(vendors, self.rules, held=held))
        rows = admission.registered(judged).select(*[F.col(f.name).cast(f.dataType) for f in REGISTRY])
        rows.write.mode("overwrite").parquet(f"{self.folder}/fresh/batch={batch}")
        self.merge(before=batch)
        return judged

    def merge(self, before: int | None = None, least: int | None = None) -> None:
        """Merges the batches before one (all if none is given) where there are ``least`` of them (``fan`` if none is given), and then segments of one level while there are that many."""
        segments, least = self._segments(), least or self.fan
        batches = [n for n in self._fresh(segments) if before is None or n < before]
        if len(batches) < least:
            return
        new = Segment(1, batches[0], batches[-1])
        fresh = self._read([f"batch={n}" for n in batches], REGISTRY.fromJson(REGISTRY.jsonValue()).add("batch", "long"), "fresh").drop("batch")
        self._write(new, fresh, held_keys(fresh))
        segments = [*segments, new]
        while len(last := [s for s in segments if s.level == segments[-1].level]) >= self.fan:
            new = Segment(last[0].level + 1, last[0].first, last[-1].last)
            self._write(new, self._table("vendors", last, None), self._table("keys", last, None))
            segments = [*segments[: -len(last)], new]
        self._commit(segments)
        self._sweep()

    def _write(self, segment: Segment, vendors: DataFrame, keys: DataFrame) -> None:
        for table, rows, column in (("vendors", vendors, "vendor_id"), ("keys", keys, "key")):
            dealt = rows.withColumn("bucket", _bucket(F.col(column), self.buckets)).repartition("bucket").sortWithinPartitions("bucket", column)
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{table}/segment={segment.name}")

    def _sweep(self) -> None:
        """Deletes folders that neither of the last two versions needs."""
        versions = self._versions()
        kept = [self._segments(v) for v in versions[-2:]]
        names = {f"segment={s.name}" for some in kept for s in some}
        merged = max((s.last for s in kept[0]), default=-1) if len(kept) > 1 else -1
        gone = [f"{t}/{n}" for t in ("vendors", "keys") for n in self._names(t) if n not in names]
        gone += [f"fresh/{n}" for n in self._names("fresh") if int(n.removeprefix("batch=")) <= merged]
        gone += [f"manifest/{v:09d}.json" for v in versions[:-2]]
        for name in gone:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def feed(self, vendors: DataFrame, checkpoint: str, outcomes_folder: str | None = None, **trigger) -> StreamingQuery:
        """Starts the stream; outcomes of each batch go to a folder of their own, if one is given."""

        def each(frame: DataFrame, batch: int) -> None:
            judged = self.admit(frame, batch)
            if outcomes_folder:
                judged.write.mode("overwrite").parquet(f"{outcomes_folder}/batch={batch}")

        return vendors.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
