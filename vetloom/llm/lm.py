"""Language-model scores by deleted interpolation.

Tokens are lower-cased words and an end for each text.  A text's score is the
sum of ``log10(l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1))`` over its
tokens, where ``v`` is the token before.  The weights depend on the bucket of
``c(v)`` (its power of two).

1. Texts are dealt into chunks.  Each chunk sends its distinct words and word
   pairs, as sorted hashes (64 and 48 bits) with their counts, to buckets by
   range (see :mod:`vetloom.llm.exchange`).
2. Buckets add up the counts over all chunks and answer each chunk's keys.
3. A tenth of the training texts is the held-out part: their tokens are looked
   up in the counts without that tenth.  Expectation-maximisation learns the
   weights from a histogram of these (both estimates, by bucket of ``c(v)``),
   which has a bounded number of cells whatever the input.
4. Each chunk scores its texts with all training counts.

A chunk counts a key once, so a frequent word is one row of each chunk.

Contract: null text counts as empty and has the end as its only token.  Rows
with a null id are scored but not learned from.  Repeated rows are learned from
each time and each get a row.  Other columns are not carried.  Without training
texts the model is uniform.  Keys with equal hashes would share a count: at a
billion distinct words that is expected once in thirty corpora, and at a
billion distinct word pairs for four in a million of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import exchange, frames

CHUNK_BYTES = 8 << 20
#: Text for which there is one bucket.
BUCKET_BYTES = 4 << 20
#: Bytes that the tasks of a shuffle get, about: of texts, so that few chunks meet in a task, and of keys.
TEXT_TASK, TASK_BYTES = 4 << 20, 16 << 20
ADD = 0.1
#: Bits of a word pair's hash; they make up most of what is shuffled.
PAIR_BITS = 48
#: Of ids' checksums modulo FOLDS: that of texts left out of the training, and that of the held-out part of it.
FOLDS, LEFT_OUT, DELETED = 10, 0, 1
#: Buckets of context counts, and cells of the histogram for each estimate (cell 0: zero).
LEVELS, CELLS = 40, 48
ROUNDS = 60
_START, _END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFD1B2A3D)
_PAIR, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Grams:
    """Tokens of a chunk, text by text; ``word`` numbers ``words`` (-1: the end), ``pair`` numbers ``pairs``."""

    words: np.ndarray
    pairs: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    text: np.ndarray
    first: np.ndarray


def grams(column: pa.ChunkedArray) -> Grams:
    norm, starts, ends, edge = A.normal_words(column)
    hashes = A.span_hashes(A.LOWER[norm], starts, ends)
    words, word = np.unique(hashes, return_inverse=True)
    n = np.diff(edge)
    size = n + 1
    first = np.cumsum(size) - size
    tokens = np.full(int(size.sum()), _END)
    place = A.concat_ranges(first, n)
    tokens[place] = hashes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first] = _START
    number = np.full(len(tokens), -1)
    number[place] = word
    pairs, pair = np.unique(A.mix(before * _PAIR + tokens * _NEXT) >> np.uint64(64 - PAIR_BITS), return_inverse=True)
    return Grams(words, pairs, number, pair, np.repeat(np.arange(len(n)), size), first)


def _bounds(buckets: int, bits: int) -> np.ndarray:
    return np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)


def _deltas(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, byte by byte, which compresses well."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).ravel()


def _keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the texts of each chunk in a batch, as packed texts take half the shuffle that plain ones do."""
    for batch in batches:
        chunk = batch.column(0).to_numpy()
        order = np.argsort(chunk, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(chunk[order], prepend=-1)), len(order))
        sorted_ = batch.take(pa.array(order))
        keys, blobs = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some = sorted_.slice(a, b - a)
            data, offsets = A.text_buffer(some.column(3))
            known = some.column(1).is_valid().to_numpy(zero_copy_only=False)
            ids = some.column(1).fill_null(0).to_numpy()
            keys.append(int(chunk[order[a]]))
            blobs.append(A.pack(ids, known, some.column(2).to_numpy().astype(np.int8), offsets, data))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), A.blobs(blobs)], ["_chunk", "_texts"])


def _texts(table: pa.Table) -> tuple[pa.Array, np.ndarray, pa.ChunkedArray]:
    """Ids, folds and texts of a chunk, in the order of its packed parts."""
    parts = [A.unpack(x) for x in table["_texts"].to_pylist()]
    ids, known, fold = (np.concatenate([p[i] for p in parts]) for i in range(3))
    texts = [pa.Array.from_buffers(pa.large_binary(), len(p[3]) - 1, [None, pa.py_buffer(p[3].tobytes()), pa.py_buffer(p[4].tobytes())]) for p in parts]
    return pa.array(ids, mask=~known), fold, pa.chunked_array(texts, pa.large_binary())


def _emitter(buckets: int):
    """For each kind of key and bucket: keys, and their counts in training texts and in the held-out part."""
    width = exchange.width(2 * buckets)

    def emit(table: pa.Table) -> pa.Table:
        _, fold, texts = _texts(table)
        g = grams(texts)
        learn, deleted = ((fold != LEFT_OUT) & (fold >= 0))[g.text], (fold == DELETED)[g.text]
        inner = g.word >= 0
        rows = []
        for kind, bits, keys, number, used in ((0, 64, g.words, g.word, inner), (1, PAIR_BITS, g.pairs, g.pair, np.ones(len(inner), bool))):
            counts = [np.bincount(number[used & which], minlength=len(keys)) for which in (learn, deleted)]
            edges = np.append(np.searchsorted(keys, _bounds(buckets, bits)), len(keys))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                some = slice(edges[b], edges[b + 1])
                rows.append((2 * b + kind, A.pack(_deltas(keys[some]), *(A.narrow(c[some]) for c in counts))))
        rows.sort(key=lambda r: r[0])
        return exchange.sent(table["_chunk"][0].as_py(), [r[0] for r in rows], [r[1] for r in rows], width)

    return emit


_ANSWER = f"{exchange.SENT}, _distinct long, _tokens long, _deleted long"


def _resolver(n_deleted: int, chunks: int):
    """Answers all chunks' keys; a row of range -1 tells how many distinct words and tokens the training texts have."""
    width = exchange.width(chunks)

    def resolve(table: pa.Table) -> pa.Table:
        bucket = table["_to"][0].as_py()
        senders, blobs = exchange.flat(table, "_from")
        parts = [A.unpack(x) for x in blobs]
        keys = np.concatenate([_keys(p[0]) for p in parts])
        distinct, number = np.unique(keys, return_inverse=True)
        total, deleted = (np.bincount(number, np.concatenate([p[i] for p in parts]), len(distinct)).astype(np.int64) for i in (1, 2))
        out, at = {}, 0
        for chunk, part in zip(senders.tolist(), parts, strict=True):
            mine = number[at : at + len(part[1])]
            out[chunk] = A.pack(*(A.narrow(c[mine]) for c in ((total, deleted) if chunk < n_deleted else (total,))))
            at += len(mine)
        to = sorted(out)
        told = exchange.sent(bucket, to, [out[c] for c in to], width)
        words = bucket % 2 == 0
        sums = [int((total > 0).sum()), int(total.sum()), int(deleted.sum())] if words else [0, 0, 0]
        none = pa.nulls(told.num_rows, pa.int64())
        for name in ("_distinct", "_tokens", "_deleted"):
            told = told.append_column(name, none)
        last = pa.Table.from_pylist([{"_range": -1, "_from": bucket, "_distinct": sums[0], "_tokens": sums[1], "_deleted": sums[2]}], told.schema)
        return pa.concat_tables([told, last])

    return resolve


def _answers(table: pa.Table, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the chunk's words and pairs."""
    buckets, blobs = exchange.flat(table, "_from")
    by_bucket = dict(zip(buckets.tolist(), blobs, strict=True))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(A.unpack(by_bucket[b])[part].astype(np.int64) for b in sorted(by_bucket) if b % 2 == kind)]) for kind in (0, 1))


def _estimates(g: Grams, words: np.ndarray, pairs: np.ndarray, texts: int, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Count of each token and of the one before it, and the estimates from pairs and from words."""
    count = np.where(g.word >= 0, np.append(words, 0)[g.word], texts)
    before = np.empty_like(count)
    before[1:] = count[:-1]
    before[g.first] = texts
    pair = pairs[g.pair]
    return count, before, np.divide(pair, before, out=np.zeros(len(pair)), where=before > 0), count / max(1, tokens)


def _level(before: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(before.astype(np.float64))[1], LEVELS - 1)


def _cell(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip(CELLS - 1 + 2 * np.floor(np.log2(np.maximum(p, 1e-300))), 1, CELLS - 1), 0).astype(np.int64)


def _collector(texts: int, tokens: int):
    """The histogram of a chunk's tokens, with the mean estimates of each cell."""

    def collect(docs: pa.Table, answers: pa.Table) -> pa.Table:
        g = grams(_texts(docs)[2])
        (words, pairs), (words_d, pairs_d) = _answers(answers, 0), _answers(answers, 1)
        _, before, p2, p1 = _estimates(g, words - words_d, pairs - pairs_d, texts, tokens)
        cells, number = np.unique((_level(before) * CELLS + _cell(p2)) * CELLS + _cell(p1), return_inverse=True)
        sums = [np.bincount(number, x, len(cells)) for x in (np.ones(len(p1)), p2, p1)]
        return pa.table({"cell": cells, "n": sums[0], "s2": sums[1], "s1": sums[2]})

    return collect


def weights(cells: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, rounds: int = ROUNDS) -> np.ndarray:
    """For each level the weights of pair, word and uniform estimate, by expectation-maximisation."""
    out = np.tile([0.0, 0.5, 0.5], (LEVELS, 1))
    level = cells // (CELLS * CELLS)
    for at in np.unique(level):
        mine = level == at
        p = np.stack([p2[mine], p1[mine], np.full(int(mine.sum()), p0)], axis=1)
        w = np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            share = p * w
            share *= (n[mine] / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) / n[mine].sum()
        out[at] = w
    known = np.unique(level)
    if len(known):  # a level without held-out tokens takes the nearest one's weights
        for at in np.setdiff1d(np.arange(LEVELS), known):
            out[at] = out[known[np.argmin(np.abs(known - at))]]
    # some of each, so that no token of another text has probability zero
    return 0.9999 * out + 0.0001 / 3


def _scorer(lambdas: np.ndarray, texts: int, tokens: int, distinct: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, fold, column = _texts(docs)
        g = grams(column)
        count, before, p2, p1 = _estimates(g, *_answers(answers, 0), texts, tokens)
        base = np.log10((count + ADD) / (tokens + ADD * (distinct + 1)))
        w = lambdas[_level(before)]
        own = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (distinct + 1))
        n = len(g.first)
        sums = [np.bincount(g.text, x, n) for x in (np.ones(len(base)), count > 0, base, own)]
        return pa.table({"_id": ids, "held_out": fold == LEFT_OUT, "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64), "train_tokens": np.full(n, tokens, np.int64), "base_score": sums[2], "score": sums[3]})

    return score


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    total = frames.text_bytes(docs, text_col)
    id_ = F.col(id_col).cast("long")
    fold = F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(-1)).cast("int")
    learned = docs.filter(fold.between(1, FOLDS - 1)).agg(F.count("*").alias("n"), F.count_if(fold == DELETED).alias("deleted")).first()
    n_deleted, n_other, buckets = frames.parts(total, FOLDS * CHUNK_BYTES), frames.parts(total, CHUNK_BYTES), frames.parts(total, BUCKET_BYTES)
    text = F.col(text_col)
    chunk = F.when(fold == DELETED, frames.spread(id_, text, n_deleted)).otherwise(n_deleted + frames.spread(id_, text, n_other))
    rows = docs.select(chunk.alias("_chunk"), id_.alias("_id"), fold.alias("_fold"), F.col(text_col).cast("string").alias("_text")).mapInArrow(A.tidy(_dealt), "_chunk long, _texts binary")
    chunks, spark = n_deleted + n_other, docs.sparkSession
    few, many = frames.tasks(spark, total, TEXT_TASK), frames.tasks(spark, 2 * total, TASK_BYTES)
    rows = rows.repartition(few, "_chunk")
    packed = rows.groupBy("_chunk").applyInArrow(A.tidy_group(_emitter(buckets)), exchange.SENT)
    answers = frames.checkpointed(exchange.exchange(packed, chunks, 2 * buckets, many).repartition(many, "_to").groupBy("_to").applyInArrow(A.tidy_group(_resolver(n_deleted, chunks)), _ANSWER))
    sums = answers.filter("_range = -1").agg(F.sum("_distinct"), F.sum("_tokens"), F.sum("_deleted")).first()
    distinct, tokens, deleted = (int(x or 0) for x in sums)
    texts = learned["n"]
    distinct, tokens = distinct + (texts > 0), tokens + texts
    without = texts - learned["deleted"], tokens - deleted - learned["deleted"]
    told = exchange.exchange(answers.filter("_range >= 0").select("_range", "_from", "_to", "_blobs"), 2 * buckets, chunks, few).repartition(few, "_to")
    seen = rows.filter(F.col("_chunk") < n_deleted).groupBy("_chunk").cogroup(told.filter(F.col("_to") < n_deleted).groupBy("_to"))
    cells = seen.applyInArrow(A.tidy_groups(_collector(*without)), "cell long, n double, s2 double, s1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).toPandas()
    n = cells["n"].to_numpy(float)
    lambdas = weights(cells["cell"].to_numpy(np.int64), n, cells["s2"].to_numpy(float) / n, cells["s1"].to_numpy(float) / n, 1 / (distinct + 1))
    kind = "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    done = rows.groupBy("_chunk").cogroup(told.groupBy("_to")).applyInArrow(A.tidy_groups(_scorer(lambdas, texts, tokens, distinct)), kind)
    return done.withColumnRenamed("_id", id_col)
