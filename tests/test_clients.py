"""Pushing to another system: order, hot keys, tasks that fail, and pushes that are started again."""

import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from tests.test_operators import vendor
from vetloom.operators import admission
from vetloom.schemas import VENDORS
from vetloom.sources import clients


class Counting(clients.FolderClient):
    """Notes each vendor that is sent, and once, after some, ends its process."""

    def __init__(self, folder, dies_after=None):
        super().__init__(folder)
        self.folder, self.left = Path(folder), dies_after
        self.folder.mkdir(parents=True, exist_ok=True)

    def check_duplicate(self, vendor):
        with open(self.folder / "sent", "a") as out:
            out.write(f"{vendor['arrival_seq']}\n")
        if self.left is not None and not (self.folder / "died").exists():
            self.left -= 1
            if self.left < 0:
                (self.folder / "died").touch()
                os._exit(1)
        return super().check_duplicate(vendor)


def arrivals(n, seed=1):
    rng = random.Random(seed)
    key = lambda tag, of: None if rng.random() < 0.3 else tag.format(rng.randrange(of))
    rows = [vendor(i, f"Vendor {i}", pan=key("AAAAA{:04d}A", n // 3), gstin="BAD" if i % 17 == 0 else key("27ABCDE{:04d}F1Z5", n // 2), account=key("{:012d}", n // 2)) for i in range(n)]
    rows += [vendor(n + i, f"Hot {i}", account="555555555555") for i in range(n // 3)]  # a third of all share one account
    rng.shuffle(rows)
    return rows


def told(frame):
    return sorted((r.arrival_seq, r.success, r.error_code, r.message) for r in frame.collect())


@pytest.mark.parametrize("rounds, group", [(2, 10_000), (0, 10_000), (1, 2)])
def test_same_as_one_by_one(spark, tmp_path, rounds, group):
    rows = spark.createDataFrame(arrivals(120), VENDORS)
    got = clients.push(rows, lambda: Counting(str(tmp_path / "system")), rounds=rounds, group=group)
    assert told(got) == told(admission.outcomes(rows))
    sent = Counter((tmp_path / "system/sent").read_text().split())
    assert max(sent.values()) == 1  # reading the answers again sends nothing
    got.count()
    assert sum(sent.values()) == len((tmp_path / "system/sent").read_text().split())


def test_repeated_rows_and_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([vendor(1, "Twice", pan="AAAAA1111A")] * 2 + [vendor(2, "None")] * 2, VENDORS)
    one_by_one = sorted(r.error_code for r in admission.outcomes(rows).collect())
    assert sorted(r.error_code for r in clients.push(rows, lambda: Counting(str(tmp_path / "a"))).collect())[1:] == one_by_one[1:]
    assert clients.push(rows.limit(0), lambda: Counting(str(tmp_path / "b")), str(tmp_path / "ledger")).count() == 0


def test_a_push_that_is_started_again(spark, tmp_path):
    rows, folder, ledger = spark.createDataFrame(arrivals(120, 2), VENDORS), str(tmp_path / "system"), str(tmp_path / "ledger")
    with pytest.raises(Exception, match="(?i)python worker|crashed|exited"):
        clients.push(rows, lambda: Counting(folder, dies_after=12), ledger, flush=4)
    before = set((tmp_path / "system/sent").read_text().split())
    got = clients.push(rows, lambda: Counting(folder), ledger, flush=4)
    assert told(got) == told(admission.outcomes(rows))
    sent = Counter((tmp_path / "system/sent").read_text().split())
    again = {v for v, n in sent.items() if n > 1}
    assert again <= before and len(again) <= 4 * 5  # at most an open block of each task


def test_a_task_that_fails_once(tmp_path):
    """In a session of its own, which lets a task try again."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parent.parent)!r})
from pyspark.sql import SparkSession
from tests.test_clients import Counting, arrivals, told
from vetloom.operators import admission
from vetloom.schemas import VENDORS
from vetloom.session import ship
from vetloom.sources import clients
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "check")!r}).config("spark.sql.warehouse.dir", {str(tmp_path / "warehouse")!r}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
rows = ship(spark).createDataFrame(arrivals(90, 3), VENDORS)
got = clients.push(rows, lambda: Counting({str(tmp_path / "system")!r}, dies_after=10), {str(tmp_path / "ledger")!r}, flush=3)
assert told(got) == told(admission.outcomes(rows))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "system/died").exists()
    sent = Counter((tmp_path / "system/sent").read_text().split())
    assert 1 <= sum(n - 1 for n in sent.values()) <= 3 * 2
