"""The keyed registry: buckets that are read, merges, and batches that run again."""

import re

import pytest
from pyspark.sql import functions as F

from tests.test_operators import vendor
from vetloom.operators import admission
from vetloom.schemas import VENDORS
from vetloom.streaming.registry import Registry


def batch(first, n=40):
    return [vendor(i, f"Vendor {i}", pan=f"AAAAA{i % 150:04d}A", account=f"{i:012d}") for i in range(first, first + n)]


def filled(spark, folder, batches=4, fan=2, buckets=16):
    registry = Registry(spark, folder, fan=fan, buckets=buckets)
    for n in range(batches):
        registry.admit(spark.createDataFrame(batch(40 * n), VENDORS), n)
    return registry


def files_read(frame):
    """Files that the scans of a frame's plan have selected, after partition pruning."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan), plan
    return frame.select(F.input_file_name().alias("file")).distinct().count()


def test_merged_batches_give_the_same_registry(spark, tmp_path):
    registry = filled(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([r for n in range(4) for r in batch(40 * n)], VENDORS)
    want = {r.arrival_seq for r in admission.outcomes(rows).filter("success").collect()}
    assert {r.arrival_seq for r in registry.all().collect()} == want and registry.count().first()["count"] == len(want) == 150
    assert [(s.level, s.first, s.last) for s in registry._segments()] == [(1, 0, 1)]
    registry.merge(least=1)
    assert [(s.level, s.first, s.last) for s in registry._segments()] == [(2, 0, 3)]
    assert {r.arrival_seq for r in registry.all().collect()} == want
    again = Registry(spark, str(tmp_path / "r"))  # the number of buckets stands in the manifest
    assert again.get(registry.all().first().vendor_id).count() == 1 and again.buckets == 16
    with pytest.raises(ValueError, match="merged"):
        again.admit(spark.createDataFrame(batch(0), VENDORS), 2)
    told = again.admit(spark.createDataFrame([vendor(999, "Late", pan="aaaaa0003a"), vendor(1000, "New", pan="BBBBB0003A")], VENDORS), 4)
    assert sorted((r.arrival_seq, r.success) for r in told.collect()) == [(999, False), (1000, True)]


def test_a_batch_that_runs_again_after_a_merge_that_failed(spark, tmp_path, monkeypatch):
    registry = filled(spark, str(tmp_path / "r"), batches=2)
    monkeypatch.setattr(Registry, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        registry.admit(spark.createDataFrame(batch(110), VENDORS), 2)
    monkeypatch.undo()
    assert registry._segments() == [] and registry.count().first()["count"] == 120
    registry.admit(spark.createDataFrame(batch(110), VENDORS), 2)
    assert [s.last for s in registry._segments()] == [1] and registry.count().first()["count"] == 120


def test_lookups_read_their_own_buckets(spark, tmp_path):
    registry = filled(spark, str(tmp_path / "r"))
    registry.merge(least=1)
    (segment,) = registry._segments()
    assert len(set((tmp_path / "r").glob(f"keys/segment={segment.name}/bucket=*/*.parquet"))) == 16
    wanted = spark.createDataFrame([("pan:AAAAA0003A",), ("account:000000000007",), ("pan:NOBODY",)], "key string")
    got = registry.lookup(wanted)
    assert sorted((r.key, r.arrival_seq, r.vendor_name) for r in got.collect()) == [("account:000000000007", 7, "Vendor 7"), ("pan:AAAAA0003A", 3, "Vendor 3")]
    segments = registry._segments()
    assert files_read(registry._holders(wanted, segments)) <= 3
    one = registry.get(got.first().vendor_id)
    assert files_read(one) == 1 and one.first().vendor_id == got.first().vendor_id
    assert registry.lookup(wanted.limit(0)).count() == 0


def test_an_empty_registry(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r"))
    assert registry.all().count() == registry.get("x").count() == registry.lookup(spark.createDataFrame([("k",)], "key string")).count() == 0
    registry.merge()
    assert registry.admit(spark.createDataFrame([], VENDORS), 0).count() == 0 and registry.count().first()["count"] == 0
