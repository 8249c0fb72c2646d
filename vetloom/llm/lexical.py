"""Ranked lexical search: every document is scored for each item of a query table.

Terms are the maximal parts of letters and digits, where every character outside
ASCII counts as one, with A-Z in lower case.  With N documents that have a term,
L terms in them, n in one of them and df documents that hold a term, an item's
score of a document is the sum over the item's terms, repeats included, of

    w * ((1e9 * tf) div (1000 * tf + 8 * m)),   w = floor(1000 * ln((2N + 2) / (2df + 1))),
    m = 25 + (75 * n * N) div L

* Items are cut into blocks of about :data:`BLOCK_BYTES` of distinct terms; a
  block's vocabulary is what tasks are sent.
* One pass over the documents keeps a row for each that has a term: its number
  of terms, and the numbers and frequencies of those of the vocabulary.  N, L
  and df are aggregations of that table.
* The rows are sorted by document id across the cluster and traversed in
  windows of fixed width in ids, wide enough for :data:`CELLS` documents on
  average; where ids are denser a window is traversed in parts of that many.
  In a window postings are turned to lists by term with their scores.  For each
  item the lists of its terms are added into one array of the window's size,
  and the terms' bit sets are united to the set of occupied cells.  These alone
  are harvested into the item's heap and made zero again.
* A task gives the best ``k`` documents of each item, and a window over the
  items picks from these.

Documents are sorted by (id, row number), so repeated ids are split between
tasks, and no term's postings are ever gathered: a term that every document
holds has its list in each window apart.  All is whole numbers but ``w``.

Contract: null or empty texts have no terms and are no documents.  Rows of one
document id are documents each, and among equal scores a null id comes last.
Rows of one item id are one item, with the terms of all; null is an id of its
own.  Items without a term, or with none that scores, have no rows.  An item's
distinct terms are held whole in a task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from . import frames

CELLS = 1 << 15
BLOCK_BYTES = 1 << 24
#: Postings that one task scores.
POSTINGS = 1 << 23
_STEP = 1 << 21
_PART_OF_TERM = np.ones(256, bool)
_PART_OF_TERM[:128] = [chr(b).isalnum() for b in range(128)]
POSTED = "_id long, _n long, _terms array<int>, _tfs array<int>"


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, one behind the other, and for each text its first term's number (one more at the end)."""
    data, offsets = A.text_buffer(column)
    mine = _PART_OF_TERM[data]
    begins = mine.copy()
    begins[1:] &= ~mine[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    begins[edge] = mine[edge]
    at = np.flatnonzero(begins)
    kept = np.append(0, np.cumsum(mine))
    first = np.searchsorted(at, offsets)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(kept[at], kept[-1])), pa.py_buffer(A.LOWER[data[mine]])])
    return words, first


class Block(NamedTuple):
    """Items ``i`` with terms ``term[edges[i]:edges[i + 1]]``, each ``times`` times, by numbers in ``vocabulary``."""

    vocabulary: list[bytes]
    items: list[int | None]
    edges: np.ndarray
    term: np.ndarray
    times: np.ndarray


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_item, _term, _times) of all items."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in A.text_steps(batch.column(1), _STEP):
                words, first = terms(batch.column(1).slice(a, b - a))
                of = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), np.diff(first))))
                yield pa.RecordBatch.from_arrays([of, words.cast(pa.binary())], ["_item", "_term"])

    rows = items.select(F.col(id_col).cast("long").alias("_item"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(A.tidy(split), "_item long, _term binary").groupBy("_item", "_term").agg(F.count("*").alias("_times"))


def _block(rows: DataFrame) -> Block:
    table = rows.toArrow()
    words = table["_term"].combine_chunks().dictionary_encode() if len(table) else pa.array([], pa.binary()).dictionary_encode()
    items = table["_item"].combine_chunks()
    items = (items if len(table) else pa.array([], pa.int64())).dictionary_encode(null_encoding="encode")
    number = items.indices.to_numpy()
    order = np.argsort(number, kind="stable")
    edges = np.append(0, np.cumsum(np.bincount(number, minlength=len(items.dictionary))))
    return Block(words.dictionary.to_pylist(), items.dictionary.to_pylist(), edges, words.indices.to_numpy()[order], table["_times"].to_numpy()[order])


def postings(docs: DataFrame, block, id_col: str, text_col: str) -> DataFrame:
    """A row for each document that has a term: its number of terms, and those of the block's vocabulary with their frequencies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(block.value.vocabulary, pa.large_binary())
        for batch in batches:
            for a, b in A.text_steps(batch.column(1), _STEP):
                words, first = terms(batch.column(1).slice(a, b - a))
                n = np.diff(first)
                number = pc.fill_null(pc.index_in(words, known), -1).to_numpy()
                hit = number >= 0
                key, tf = np.unique(np.repeat(np.arange(b - a), n)[hit] * len(known) + number[hit], return_counts=True)
                doc, term = np.divmod(key, max(1, len(known)))
                edges = np.append(0, np.cumsum(np.bincount(doc, minlength=b - a))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))) for x in (term, tf)]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), *lists], ["_id", "_n", "_terms", "_tfs"])
                yield rows.filter(pa.array(n > 0))

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(A.tidy(count), POSTED)


class _Cells(NamedTuple):
    """Documents of one window, or of a part of it."""

    ids: list[int | None]
    n: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def _cells(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[_Cells]:
    """Documents that come in order of their ids, in windows of ``width`` ids, and no more than ``most`` at once."""
    wait: list[pa.RecordBatch] = []
    at, held = None, 0

    def joined() -> _Cells:
        rows = pa.Table.from_batches(wait).combine_chunks()
        size = pc.list_value_length(rows["_terms"]).to_numpy()
        lists = [pc.list_flatten(rows[c]).to_numpy() for c in ("_terms", "_tfs")]
        return _Cells(rows["_id"].to_pylist(), rows["_n"].to_numpy(), np.repeat(np.arange(len(size)), size), *lists)

    for batch in batches:
        ids = batch.column(0)
        window = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, ids.fill_null(0).to_numpy() // width)
        cuts = [0, *(np.flatnonzero(np.diff(window)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if wait and window[a] != at:
                yield joined()
                wait, held = [], 0
            while a < b:
                at, stop = window[a], min(b, a + most - held)
                wait.append(batch.slice(a, stop - a))
                held, a = held + stop - a, stop
                if held == most:
                    yield joined()
                    wait, held = [], 0
    if wait:
        yield joined()


class _Lists(NamedTuple):
    """The postings of one window by term: ``doc[edges[s]:edges[s + 1]]`` in slot ``s``, and bit sets of the long lists."""

    slot: np.ndarray
    edges: np.ndarray
    doc: np.ndarray
    part: np.ndarray
    row: np.ndarray
    bits: np.ndarray


def _lists(cells: _Cells, weight: np.ndarray, m: np.ndarray) -> _Lists:
    order = np.argsort(cells.term, kind="stable")
    term, doc, tf = cells.term[order], cells.doc[order], cells.tf[order].astype(np.int64)
    part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    there, first = np.unique(term, return_index=True)
    edges = np.append(first, len(term))
    slot = np.full(len(weight), -1)
    slot[there] = np.arange(len(there))
    # a bit set is no larger than a list of that length
    long = np.flatnonzero(np.diff(edges) * 8 >= len(cells.ids))
    row = np.full(len(there), -1)
    row[long] = np.arange(len(long))
    bits = np.zeros((len(long), -(-len(cells.ids) // 8)), np.uint8)
    for r, s in enumerate(long.tolist()):
        mark = np.zeros(len(cells.ids), bool)
        mark[doc[edges[s] : edges[s + 1]]] = True
        bits[r] = np.packbits(mark)
    return _Lists(slot, edges, doc, part, row, bits)


def _add(lists: _Lists, slots: np.ndarray, times: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Adds an item's terms to the cells, and gives the cells that they occupy."""
    rows = lists.row[slots]
    long = rows >= 0
    occupied = np.bitwise_or.reduce(lists.bits[rows[long]], axis=0)
    for s, n in zip(slots[long].tolist(), times[long].tolist(), strict=True):
        at = slice(lists.edges[s], lists.edges[s + 1])
        score[lists.doc[at]] += lists.part[at] if n == 1 else n * lists.part[at]  # a list has a document once
    size = np.diff(lists.edges)[slots[~long]]
    at = A.concat_ranges(lists.edges[slots[~long]], size)
    doc = lists.doc[at]
    np.add.at(score, doc, lists.part[at] * np.repeat(times[~long], size))
    np.bitwise_or.at(occupied, doc >> 3, (128 >> (doc & 7)).astype(np.uint8))
    return np.flatnonzero(np.unpackbits(occupied))


def _scorer(block, weight: np.ndarray, docs: int, total: int, width: int, most: int, k: int):
    def m(n: np.ndarray) -> np.ndarray:
        if int(n.max(initial=0)) * 75 * docs >= 1 << 63:
            n = n.astype(object)
        return (25 + n * (75 * docs) // total).astype(np.int64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        heaps: list[list[tuple]] = [[] for _ in b.items]
        score = np.zeros(most, np.int64)
        for cells in _cells(batches, width, most):
            lists = _lists(cells, weight, m(cells.n))
            for i, heap in enumerate(heaps):
                mine = slice(b.edges[i], b.edges[i + 1])
                slots = lists.slot[b.term[mine]]
                found = slots >= 0
                cell = _add(lists, slots[found], b.times[mine][found], score)
                _harvest(heap, cell, score[cell], cells.ids, k)
                score[cell] = 0
        rows = [(b.items[i], -minus if has else None, s) for i, heap in enumerate(heaps) for s, has, minus in heap]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_item", "_id", "score"])

    return best


def _harvest(heap: list[tuple], cell: np.ndarray, got: np.ndarray, ids: list[int | None], k: int) -> None:
    """Puts the best cells into a heap of (score, has an id, minus id): its least entry goes first."""
    floor = max(1, heap[0][0] if len(heap) == k else 1)
    if len(got) > k:
        floor = max(floor, int(np.partition(got, len(got) - k)[len(got) - k]))
    keep = got >= floor
    for c, s in zip(cell[keep].tolist(), got[keep].tolist(), strict=True):
        entry = (s, ids[c] is not None, -(ids[c] or 0))
        if len(heap) < k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def _ranked(docs: DataFrame, rows: DataFrame, k: int, names: tuple[str, str, str]) -> DataFrame:
    spark = docs.sparkSession
    item_col, id_col, text_col = names
    found = _block(rows)
    block = spark.sparkContext.broadcast(found)
    posted = frames.stored(postings(docs, block, id_col, text_col))
    stats = posted.agg(F.count("*").alias("n"), F.sum("_n").alias("total"), F.min("_id").alias("low"), F.max("_id").alias("high"), F.sum(F.size("_terms")).alias("postings")).first()
    n = stats["n"]
    df = np.zeros(len(found.vocabulary), np.int64)
    counts = posted.select(F.explode("_terms").alias("t")).groupBy("t").count().toPandas()
    df[counts["t"].to_numpy(np.int64)] = counts["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    low, high = stats["low"] or 0, stats["high"] or 0
    width = min(1 << 62, -(-(high - low + 1) * CELLS // max(1, n)))
    score = _scorer(block, weight, n, stats["total"] or 1, width, CELLS, k)
    tasks = frames.tasks(spark, stats["postings"] or 0, POSTINGS)
    order = [F.col("_id").asc_nulls_last(), F.col("_row")]
    rows = posted.filter(F.size("_terms") > 0).withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    tops = dealt.select("_id", "_n", "_terms", "_tfs").mapInArrow(A.tidy(score), "_item long, _id long, score long")
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last()))
    return tops.select(F.col("_item").alias(item_col), rank.alias("rank"), F.col("_id").alias(id_col), "score").filter(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item id, rank, document id, score): the ``k`` best documents of each item, equal scores by ascending id."""
    words = frames.stored(item_terms(items, item_col, text_col))
    size = words.agg(F.sum(16 + F.octet_length("_term")).alias("n")).first()["n"] or 0
    blocks = frames.parts(size, BLOCK_BYTES)
    done = None
    for i in range(blocks):
        ranked = _ranked(docs, words.filter(frames.dealt(F.col("_item"), blocks) == i), k, (item_col, id_col, text_col))
        done = ranked if done is None else done.unionByName(ranked)
    return done
