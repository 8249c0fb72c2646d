"""Exchange of packed blobs between many senders and many receivers.

Senders and receivers are numbered from 0.  With a row for each pair that meet,
rows would grow with the square of the input and become ever smaller.  So from
:data:`DIRECT` receivers on there are two hops: a sender's blobs for a range of
receivers travel in one row, and a relay regroups those of a block of senders
by receiver.  With C senders and R receivers that makes about ``C * sqrt(R) + R
* sqrt(C)`` rows, and a relay holds about as much as a sender sends.  The second
hop moves every blob once more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

DIRECT = 1 << 14
SENT = "_range long, _from long, _to array<long>, _blobs array<binary>"
GOT = "_to long, _from array<long>, _blobs array<binary>"


def _side(n: int) -> int:
    return math.isqrt(max(0, n - 1)) + 1


def width(receivers: int) -> int:
    """Receivers of one range."""
    return 1 if receivers <= DIRECT else _side(receivers)


def _lists(key: np.ndarray, values: pa.Array, blobs: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Distinct keys (which come in order), and for each its values and blobs."""
    edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    offsets = pa.array(np.append(edges, len(key)).astype(np.int32))
    return key[edges], pa.ListArray.from_arrays(offsets, values), pa.ListArray.from_arrays(offsets, blobs)


def sent(sender: int, to: list[int], blobs: list[bytes], width_: int) -> pa.Table:
    """What a sender sends: a blob for each of some receivers, which come in order."""
    receivers = np.array(to, np.int64)
    ranges, numbers, lists = _lists(receivers // width_, pa.array(receivers), A.blobs(blobs))
    return pa.table({"_range": ranges, "_from": np.full(len(ranges), sender, np.int64), "_to": numbers, "_blobs": lists})


def flat(table: pa.Table, column: str) -> tuple[np.ndarray, list[bytes]]:
    """Numbers and blobs of all rows, one behind the other."""
    numbers = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in table[column].chunks)])
    return numbers, [b for c in table["_blobs"].chunks for b in c.flatten().to_pylist()]


def _relay(table: pa.Table) -> pa.Table:
    lists = table["_to"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    to = lists.flatten().to_numpy()
    sender = np.repeat(table["_from"].to_numpy(), np.diff(lists.offsets.to_numpy()))
    blobs = pa.concat_arrays([c.flatten() for c in table["_blobs"].chunks])
    order = np.lexsort((sender, to))
    receivers, numbers, some = _lists(to[order], pa.array(sender[order]), blobs.take(pa.array(order)))
    return pa.table({"_to": receivers, "_from": numbers, "_blobs": some})


def exchange(rows: DataFrame, senders: int, receivers: int, tasks: int) -> DataFrame:
    """Rows as :func:`sent` gives them, with the same width, become rows (GOT) that each hold blobs for one receiver."""
    if width(receivers) == 1:
        return rows.select(F.get("_to", F.lit(0)).alias("_to"), F.array("_from").alias("_from"), "_blobs")
    block = F.floor(F.col("_from") / _side(senders)).alias("_block")
    dealt = rows.select("_range", block, "_from", "_to", "_blobs").repartition(tasks, "_range", "_block")
    return dealt.groupBy("_range", "_block").applyInArrow(_relay, GOT)
