"""Byte-level BPE: overlapping chunk encoding, and decoding of raw bytes.

Texts of at most ``chunk`` characters are encoded where they are read.  A
longer one is cut into chunks of that length which overlap by ``overlap``
characters, and the chunks are pre-tokenised in parallel.  A chunk's first
pre-tokens may be wrong, because it starts anywhere.  From the first boundary
that two neighbours share in their overlap on, both give the same pre-tokens,
so the text is stitched there, and the pieces between the stitches are encoded
in parallel.  Where one pre-token covers an overlap, it is a run of letters,
digits, signs or white space, and such a run ends at the same place wherever
one starts in it: the neighbour's boundaries are true, and the open pre-token
goes on.  Where an overlap has boundaries but none is shared, or the pattern is
another one, the neighbour is pre-tokenised again from the last true boundary.
So the ids are always those of the whole text.

Contract: null text counts as empty and has no ids.  Repeated rows, also of
one id, each get their result.  Other columns are not carried.  Decoding null
gives null, and an id outside the vocabulary is an error.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Characters of a chunk and of the overlap behind it.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: An overlap from which a pre-token that covers it is longer than any fixed word of the pattern.
RUN = 4
#: Characters of the texts that are encoded together, about.
STEP = 1 << 21
_KEY = ["_id", "_hash", "_size"]


def boundaries(text: str, pattern: str) -> list[int]:
    """Where the pre-tokens of a text end.  Python's ``\\s`` also has \\x1c to \\x1f, which is not white space to the encoder."""
    import regex

    return [m.end() for m in regex.finditer(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), text)]


def _sure(b: list[int], text: str) -> list[int]:
    """The boundaries to stitch at.

    The text's end may have cut the last two.  Behind white space the pattern
    looks ahead, so a piece must not end there.
    """
    return [0, *(x for x in b[1:-2] if not text[x - 1].isspace())]


def _steps(texts: list[str]) -> Iterator[slice]:
    """Slices of texts of about STEP characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= STEP:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _encoder(path: str, pattern: str):
    """Replaces the last column, a text, by its ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = tokens.by_ranks(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for part in _steps(texts):
                ids = to_ids(texts[part])
                rest = [c.slice(part.start, part.stop - part.start) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.binary())], [*batch.schema.names[:-1], "ids"])

    return encode


def _cutter(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row.pop("_text")
                starts = range(0, len(text), chunk)
                for some in (starts[i : i + 64] for i in range(0, len(starts), 64)):
                    yield pa.RecordBatch.from_pylist([row | {"_n": s // chunk, "_text": text[s : s + chunk + overlap]} for s in some], _schema(batch))

    return cut


def _schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([*((k, batch.schema.field(k).type) for k in _KEY), ("_n", pa.int64()), ("_text", pa.string())])


def _pretokeniser(pattern: str, chunk: int, overlap: int):
    """Adds the boundaries in both overlaps of a chunk, the last one before the right one, and whether a run covers that."""

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, last, covered = [], [], [], []
            for text in batch.column("_text").to_pylist():
                b = [0, *boundaries(text, pattern)]
                sure = _sure(b, text)
                left.append(b[: bisect_right(b, overlap)])
                right.append([x - chunk for x in sure[bisect_left(sure, chunk) :]])
                last.append(sure[bisect_right(sure, chunk) - 1])
                covered.append(_covered(b, chunk, len(text), pattern))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, lists), pa.array(right, lists), pa.array(last, pa.int32()), pa.array(covered, pa.bool_())], [*batch.schema.names, "_left", "_right", "_last", "_covered"])

    return pretokenise


def _covered(b: list[int], start: int, stop: int, pattern: str) -> bool:
    """Whether one pre-token, a run, covers the characters from ``start`` to ``stop``."""
    return pattern == tokens.BYTE_LEVEL and stop >= start + RUN and bisect_left(b, stop) == bisect_left(b, start)


def _true_ends(text: str, end: int, pattern: str) -> tuple[list[int], int, bool]:
    """Boundaries to stitch at from ``end`` on, counted from there, the last one up to it, and whether a run covers all behind it."""
    b = [0, *boundaries(text, pattern)]
    sure = _sure(b, text)
    return [x - end for x in sure[bisect_left(sure, end) :]], sure[bisect_right(sure, end) - 1], _covered(b, end, len(text), pattern)


def stitch(chunks: Iterator[tuple[str, list[int], list[int], int, bool]], pattern: str, chunk: int) -> Iterator[str]:
    """The pieces of one text from its chunks: (text, boundaries in its left and right overlap, last before the right one, whether a run covers that)."""
    held: list[str] = []  # the open piece before text[start:]
    text, start, end, right, last, covered = "", 0, 0, [], 0, False
    for n, (following, left, its_right, its_last, its_covered) in enumerate(chunks):
        # held and text[start:] begin at a true boundary, and the following chunk at text[end].
        mine = set(left)
        shared = next((x for x in right if end + x >= start and x in mine), None)
        if n == 0 or shared is not None:
            if n:
                yield "".join([*held, text[start : end + shared]])
            held, text, start, right, last, covered = [], following, shared or 0, its_right, its_last, its_covered
            end = min(chunk, len(following))
            continue
        if (stop := max(start, last)) > start:
            yield "".join([*held, text[start:stop]])
            held = []
        if covered:
            held.append(text[stop:end])
            text, start, right, last, covered = following, 0, its_right, its_last, its_covered
            end = min(chunk, len(following))
        else:
            open_ = "".join([*held, text[stop:end]])
            held, text, start = [], open_ + following, 0
            end = len(open_) + min(chunk, len(following))
            right, last, covered = _true_ends(text, end, pattern)
    if held or text[start:]:
        yield "".join([*held, text[start:]])


def _stitcher(pattern: str, chunk: int):
    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for key, group in groupby(rows, key=lambda r: tuple(r[k] for k in _KEY)):
            copies = 0

            def once(group=group) -> Iterator[tuple]:
                nonlocal copies
                for n, same in groupby(group, key=lambda r: r["_n"]):
                    row = next(same)
                    several = 1 + sum(1 for _ in same)
                    copies = several if n == 0 else copies
                    yield row["_text"], row["_left"], row["_right"], row["_last"], row["_covered"]

            for n, piece in enumerate(stitch(once(), pattern, chunk)):
                yield pa.RecordBatch.from_pylist([dict(zip(_KEY, key, strict=True)) | {"_n": n, "_copies": copies, "_text": piece}], pa.schema([("_id", pa.int64()), ("_hash", pa.int64()), ("_size", pa.int64()), ("_n", pa.int64()), ("_copies", pa.int64()), ("_text", pa.string())]))

    return stitched


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of whole texts from those of their pieces, which come in order."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, group in groupby(rows, key=lambda r: tuple(r[k] for k in _KEY)):
        pieces = list(group)
        ids = b"".join(r["ids"] for r in pieces)
        for _ in range(pieces[0]["_copies"]):
            yield pa.RecordBatch.from_pylist([{"_id": key[0], "ids": ids}], pa.schema([("_id", pa.int64()), ("ids", pa.binary())]))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The id column and ``ids``: little-endian unsigned 32-bit integers."""
    if not 1 <= overlap <= chunk:
        raise ValueError("overlap must be from 1 to chunk")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    size = F.char_length("_text").cast("long")
    short = rows.filter(size <= chunk).mapInArrow(_encoder(path, pattern), "_id long, ids binary")
    key = "_id long, _hash long, _size long"
    cut = rows.filter(size > chunk).select("_id", F.xxhash64("_text").alias("_hash"), size.alias("_size"), "_text").mapInArrow(_cutter(chunk, overlap), f"{key}, _n long, _text string")
    marked = cut.repartition(*_KEY, "_n").mapInArrow(_pretokeniser(pattern, chunk, overlap), f"{key}, _n long, _text string, _left array<int>, _right array<int>, _last int, _covered boolean")
    pieces = marked.repartition(*_KEY).sortWithinPartitions(*_KEY, "_n").mapInArrow(_stitcher(pattern, chunk), f"{key}, _n long, _copies long, _text string")
    encoded = pieces.repartition(*_KEY, "_n").mapInArrow(_encoder(path, pattern), f"{key}, _n long, _copies long, ids binary")
    long = encoded.repartition(*_KEY).sortWithinPartitions(*_KEY, "_n").mapInArrow(_joined, "_id long, ids binary")
    return short.unionByName(long).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for, one behind the other, whether or not they are valid UTF-8."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {i: t for t, i in tokens.ranks(path).items()}
        table = [by_id.get(i) for i in range(max(by_id) + 1)]
        for batch in batches:
            ids = batch.column(ids_col)
            size = 256
            for at in range(0, batch.num_rows, size):
                some = ids.slice(at, size).to_pylist()
                out = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in some]
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*batch.schema.names, out_col])

    return encoded.mapInArrow(decoded, encoded.drop(out_col).schema.add(out_col, "binary"))
