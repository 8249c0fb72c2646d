"""Bound-certified best-fit packing of token sequences.

A document's tokens are its ids and then the id 0.  Longer documents than
``capacity`` are cut into pieces of that length, of which the first may be
shorter.  Pieces are packed in partitions of about :data:`PER_PARTITION`:

* best-fit decreasing packs a partition's pieces;
* dual-feasible functions give a lower bound on its number of bins.  A
  partition whose bins equal the bound is certified: its bins are final, but
  for the least filled one;
* a partition with a gap gives up its least filled bins, :data:`RELEASE` times
  as many as the gap.  These pieces and the loose bins of certified partitions
  are exchanged: dealt anew, into as many partitions as they fill, they are
  packed again, until they fill one partition or for :data:`ROUNDS` rounds.

Every partition of every round has its bound, also the last, and each piece
tells the bins and the bound of the partition in which it became final.  A bin
that does not travel is final, so no piece is ever dropped.  Where sizes leave
a gap that exchanging does not close, the last round's bins stay uncertified.

Contract: null text counts as empty and makes a piece of one token.  Repeated
rows, also of one id, are packed each.  An empty table gives an empty result.
``sequence_id`` is unique to a sequence, but the numbers have gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import frames, tokens

PER_PARTITION = 8192
#: Bins that travel for each bin over the bound, and rounds.
RELEASE, ROUNDS = 8, 6
#: Rounds and bins in a sequence's number.
_ROUNDS, _BINS = 16, 1 << 24
_STEP = 1 << 21
PIECE = "_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece, with the checksum of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.by_tokenizer(path)
        names = ["_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and size < _STEP:
                    size += len(texts[stop])
                    stop += 1
                rows = []
                for key, ids in zip(keys[start:stop], encode(texts[start:stop]), strict=True):
                    ids += bytes(4)
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    rows += [(key, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)
                start = stop

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(A.tidy(cut), PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that the pieces need at least, by two families of dual-feasible functions.

    ``u`` rounds pieces over ``capacity - e`` up to a whole bin and drops those
    under ``e``; ``f`` rounds ``(k + 1) * length / capacity`` down, over ``k``.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    number, total = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    best = max(-(-int(total[-1]) // capacity), int(np.max(large + -(-middle // capacity), initial=0)))
    for k in range(1, 21):
        whole = (k + 1) * size % capacity == 0
        # in units of 1 / (k * capacity), so that all is exact
        value = np.where(whole, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each piece, and the room left in each bin."""
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r is set if a bin has room r
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = there >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                there ^= 1 << left
        else:
            left, b = capacity, len(room)
            room.append(capacity)
        bins[i], left = b, left - n
        room[b] = left
        free[left].append(b)
        there |= 1 << left
    return bins, np.array(room, np.int64)


def _packer(capacity: int, round_: int, last: bool):
    def pack(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["_id", "piece", "start", "ids_crc32", "_n"], kind="stable", ignore_index=True)
        lengths = pieces["length"].to_numpy(np.int64)
        bins, room = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        moves = np.zeros(len(room), bool)
        if not last:
            by_room = np.argsort(-room, kind="stable")[: 1 + RELEASE * (len(room) - bound)]
            moves[by_room[room[by_room] > 0]] = True
        order = np.argsort(bins, kind="stable")
        run = np.cumsum(lengths[order]) - lengths[order]
        first = np.searchsorted(bins[order], np.arange(len(room)))
        offset = np.empty(len(lengths), np.int64)
        offset[order] = run - run[first][bins[order]]
        pieces["sequence_id"] = (int(key[0]) * _BINS + bins) * _ROUNDS + round_
        pieces["offset"] = offset
        pieces["bins"], pieces["bound"] = len(room), bound
        pieces["_moves"] = moves[bins]
        return pieces.drop(columns=["_part", "_n"])

    return pack


def pack_sequences(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", per_partition: int = PER_PARTITION) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id and offset, and its partition's bins and bound."""
    pool = frames.checkpointed(token_pieces(docs, path, capacity, id_col, text_col))
    names = ["_id", "piece", "start", "length", "ids_crc32"]
    kind = f"{PIECE}, sequence_id long, offset long, bins long, bound long, _moves boolean"
    done: DataFrame | None = None
    for round_ in range(ROUNDS):
        n_parts = frames.parts(pool.count(), per_partition)
        last = n_parts == 1 or round_ == ROUNDS - 1
        # the rows are written, so their numbers stay; they spread rows that are all the same
        numbered = pool.withColumn("_n", F.monotonically_increasing_id())
        part = frames.dealt(F.struct(F.lit(round_), "_n", *names), n_parts)
        packed = frames.checkpointed(numbered.withColumn("_part", part).groupBy("_part").applyInPandas(_packer(capacity, round_, last), kind))
        final = packed.filter(~F.col("_moves")).drop("_moves")
        done = final if done is None else done.unionByName(final)
        if last:
            break
        pool = packed.filter("_moves").select(*names)
    return done.withColumnRenamed("_id", id_col)
