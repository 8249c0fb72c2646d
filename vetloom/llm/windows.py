"""Packing of token sequences into full windows, with hardly any padding.

A document's tokens are its ids and then the id ``end``.  Documents of at least
``capacity`` tokens are first cut into full windows, which are final where they
are read; what is left of them, and all shorter documents, are packed whole:

* best-fit decreasing: a segment tree over remaining capacities finds the open
  window with the tightest room for a piece;
* windows that end with room are few.  The fullest of them are filled up with
  tokens of the emptiest, whole pieces first, and one cut closes each.  So a
  partition has full windows, and less than ``capacity`` tokens that are left;
* those go to the next round, dealt to as many partitions as they fill, until
  one partition holds all.  What it has left is cut at powers of two, which need
  no padding.

A round leaves a few pieces of each partition of :data:`PER_PARTITION`, so there
are few rounds, and only the first moves the corpus: as ids of two bytes where
the vocabulary allows.  Pieces are dealt by row number, so neither repeated
rows nor a hot id or length meet in one task.

Contract: null text counts as empty and makes a piece of one token.  Repeated
rows, also of one id, are packed each.  An empty table gives an empty result.
``sequence_id`` is unique to a sequence, but the numbers have gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import frames, tokens

PER_PARTITION = 8192
#: Rounds and windows in a sequence's number.
_ROUNDS, _WINDOWS = 16, 1 << 24
_STEP = 1 << 21
PIECE = "_id long, start long, length long, ids_crc32 long, doc_tokens long, _ids binary"
_NAMES = ["_id", "start", "length", "ids_crc32", "doc_tokens"]
_ID = np.dtype("<u4")


def token_rows(docs: DataFrame, path: str, capacity: int, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each full window of a document, without ids, and one for the rest of it, with its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.by_tokenizer(path)
        last = np.array([end], _ID).tobytes()
        for batch in batches:
            for a, b in A.text_steps(batch.column(1), _STEP):
                rows = []
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                for key, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), encode(texts), strict=True):
                    ids += last
                    n = len(ids) // 4
                    full = n - n % capacity
                    rows += [(key, at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, None) for at in range(0, full, capacity)]
                    if n > full:
                        rest = np.frombuffer(ids, _ID, n - full, 4 * full)
                        rows.append((key, full, n - full, zlib.crc32(rest), n, A.narrow(rest).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 5, pa.binary()), strict=True)], [*_NAMES, "_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(A.tidy(cut), PIECE)


class Rooms:
    """Open windows by their room: a segment tree with a leaf for each room, and a node set where a leaf below it has a window."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, there: bool) -> None:
        at = self.size + room
        while at and self.some[at] != there:
            self.some[at] = there
            at >>= 1
            there = there or (at > 0 and (self.some[2 * at] or self.some[2 * at + 1]))

    def put(self, window: int, room: int) -> None:
        self.open[room].append(window)
        self._mark(room, True)

    def take(self, least: int) -> tuple[int, int] | None:
        """An open window with the smallest room of at least ``least``, and that room; it is open no more."""
        at = self.size + least
        while not self.some[at]:
            while at & 1:  # a right child: go on beside its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at + (not self.some[2 * at])
        room = at - self.size
        window = self.open[room].pop()
        if not self.open[room]:
            self._mark(room, False)
        return window, room


def best_fit(lengths: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Best-fit decreasing: the pieces of each window, and the room left there."""
    rooms = Rooms(capacity)
    held: list[list[int]] = []
    room: list[int] = []
    for i in np.argsort(-np.array(lengths, np.int64), kind="stable").tolist():
        window, left = rooms.take(lengths[i]) or (len(held), capacity)
        if window == len(held):
            held.append([])
            room.append(capacity)
        held[window].append(i)
        room[window] = left - lengths[i]
        rooms.put(window, room[window])
    return held, room


Span = tuple[int, int, int]


def filled(held: list[list[int]], room: list[int], lengths: list[int], capacity: int) -> tuple[list[list[Span]], list[Span]]:
    """Full windows of (piece, from, to), and what is left: less than one window."""
    windows = [[(i, 0, lengths[i]) for i in pieces] for pieces in held]
    full = [w for w, r in zip(windows, room, strict=True) if not r]
    open_ = sorted((r, at) for at, r in enumerate(room) if r)
    low, high = 0, len(open_) - 1
    donor = sorted(windows[open_[high][1]], key=lambda s: s[2] - s[1]) if open_ else []
    while low < high:
        gap, at = open_[low]
        window = windows[at]
        while gap and low < high:
            # the largest piece that fits, or else a part of the smallest
            fits = [k for k, s in enumerate(donor) if s[2] - s[1] <= gap]
            if fits:
                moved = donor.pop(fits[-1])
            else:
                i, a, b = donor[0]
                moved, donor[0] = (i, a, a + gap), (i, a + gap, b)
            window.append(moved)
            gap -= moved[2] - moved[1]
            if not donor:
                high -= 1
                donor = sorted(windows[open_[high][1]], key=lambda s: s[2] - s[1]) if high > low else []
        if gap:  # all donors are used up, and this window is the last
            return full, window
        full.append(window)
        low += 1
    return full, donor


def at_powers_of_two(spans: list[Span]) -> list[list[Span]]:
    """Windows whose lengths are powers of two, the largest first."""
    out, spans = [], list(spans)
    total = sum(b - a for _, a, b in spans)
    while total:
        size = gap = 1 << total.bit_length() - 1
        window = []
        while gap:
            i, a, b = spans.pop(0)
            window.append((i, a, min(b, a + gap)))
            gap -= window[-1][2] - a
            if window[-1][2] < b:
                spans.insert(0, (i, window[-1][2], b))
        out.append(window)
        total -= size
    return out


def _packer(capacity: int, round_: int, last: bool):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        ids_, start, length, crc, total = (table[c].to_pylist() for c in _NAMES)
        blob = table["_ids"].to_pylist()
        windows, left = filled(*best_fit(length, capacity), length, capacity)
        rows = []

        def add(span: Span, sequence: int | None, offset: int | None) -> None:
            i, a, b = span
            whole = b - a == length[i]
            ids = None
            if not whole or sequence is None:
                width = len(blob[i]) // length[i]
                ids = np.frombuffer(blob[i], f"<u{width}", b - a, width * a)
            sum_ = crc[i] if whole else zlib.crc32(ids.astype(_ID))
            rows.append((ids_[i], start[i] + a, b - a, sum_, total[i], ids.tobytes() if sequence is None else None, sequence, offset))

        for number, window in enumerate([*windows, *(at_powers_of_two(left) if last else [])]):
            offset = 0
            for span in window:
                add(span, ((key[0].as_py() * _WINDOWS + number) * _ROUNDS + round_) * 2, offset)
                offset += span[2] - span[1]
        for span in [] if last else left:
            add(span, None, None)
        kinds = (*[pa.int64()] * 5, pa.binary(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip([*_NAMES, "_ids", "sequence_id", "offset"], zip(*rows, strict=True), kinds, strict=True)})

    return lambda key, table: A.tidy_group(lambda t: pack(key, t))(table)


def pack_windows(docs: DataFrame, path: str, capacity: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", per_partition: int = PER_PARTITION) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    rows = frames.stored(token_rows(docs, path, capacity, end, id_col, text_col)).withColumn("_n", F.monotonically_increasing_id())
    done = rows.filter(F.col("length") == capacity).select(*_NAMES, (F.col("_n") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool, round_, last = rows.filter(F.col("length") < capacity), 0, False
    while not last:
        n_parts = frames.parts(pool.count(), per_partition)
        last = n_parts == 1
        part = frames.dealt(F.struct(F.lit(round_), "_n"), n_parts)
        packed = pool.withColumn("_part", part).groupBy("_part").applyInArrow(_packer(capacity, round_, last), f"{PIECE}, sequence_id long, offset long")
        packed = frames.stored(packed)
        done = done.unionByName(packed.filter("sequence_id is not null").drop("_ids"))
        pool = packed.filter("sequence_id is null").drop("sequence_id", "offset").withColumn("_n", F.monotonically_increasing_id())
        round_ += 1
    return done.withColumnRenamed("_id", id_col)
