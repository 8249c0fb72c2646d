"""Exact removal of repeated passages by super-k-mers.

A window is ``window`` consecutive words of one document.  A word goes when a
window covers it whose word sequence also starts in a document with a smaller
id.

1. Documents are dealt into chunks of about :data:`CHUNK_BYTES` of text.  In a
   chunk, each window's *minimiser* is the smallest hash among its runs of
   ``minimiser`` words.  Consecutive windows with one minimiser form a
   super-k-mer: one packed string of words that stands for all of them.
   Equal super-k-mers of a chunk travel once, with their smallest id.
2. The strings go to the bucket of their minimiser (see
   :mod:`vetloom.llm.exchange`), where sorting brings equal windows together.  Equal hashes are only taken as equal after their bytes
   were compared.  The bucket tells each chunk which windows start in a
   document with a smaller id.
3. The chunk repeats its split, which is deterministic, and marks the words.

Minimisers that would fill a bucket (more than :data:`HEAVY` occurrences,
counted over all texts) come last in the order of minimisers, so they lead a
super-k-mer only where all runs of a window are that frequent.  Such windows
travel one by one to the bucket of their own hash, so one frequent line or word
pair is spread over all buckets.  The list is at most ``2 * HEAVY_LIST`` long
because of its threshold, and each part of the counting pass reports no more
than that, whatever the input.

Contract: null or empty text has no words and is kept.  Rows with a null id
come after all other ids.  Rows of one id never remove each other's words.  All
columns but the text are kept; input columns named like an output column are
replaced.  An empty table gives an empty result.

``kept_text`` is the words that stay, joined by one space.  On request there is
``cut_text`` too: the text itself, without the removed words and the whitespace
behind each; where nothing is removed, the text byte for byte (null is null).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from . import exchange, frames

#: Bytes of text in a chunk, and of packed strings in a bucket, about.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
#: Packed strings hold about this many times the text.
EXPANSION = 3
#: Occurrences from which a minimiser counts as heavy, and the length that their list is held to.
HEAVY = 1 << 16
HEAVY_LIST = 1 << 20
#: Runs that a task of the counting pass gathers before it reports, and keys that it holds before it adds them up.
COUNT_PART, HELD = 1 << 24, 1 << 22
#: Bytes that the tasks of a shuffle get, about: of texts, so that few chunks meet in a task, and of packed strings.
TEXT_TASK, TASK_BYTES = 4 << 20, 16 << 20
LAST = np.iinfo(np.int64).max


@dataclass
class Split:
    """The super-k-mers of a chunk; ``order`` is by bucket, and ``first`` indexes it by distinct string."""

    norm: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc_first: np.ndarray
    windows: np.ndarray
    length: np.ndarray
    group: np.ndarray
    later: np.ndarray
    rep_start: np.ndarray
    rep_windows: np.ndarray
    rep_id: np.ndarray
    rep_bucket: np.ndarray


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    return A.gram_hashes(words, n) >> A.U64(1)


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def split(ids: np.ndarray, column: pa.ChunkedArray, window: int, minimiser: int, heavy: np.ndarray, buckets: int) -> Split:
    """Splits the texts, which are in the order of their ids, into super-k-mers."""
    norm, starts, ends, doc_first = A.normal_words(column)
    words = A.span_hashes(norm, starts, ends)
    counts = np.maximum(0, np.diff(doc_first) - window + 1)
    windows = A.concat_ranges(doc_first[:-1], counts)
    docs = np.repeat(np.arange(len(ids)), counts)
    runs = _runs(words, minimiser)
    runs |= _is_in(runs, heavy).astype(A.U64) << A.U64(63)
    least = A.sliding_min(runs, window - minimiser + 1)[windows] if len(windows) else np.zeros(0, A.U64)
    alone = (least >> A.U64(63)).astype(bool)
    opens = np.ones(len(windows), bool)
    opens[1:] = (least[1:] != least[:-1]) | (docs[1:] != docs[:-1]) | alone[1:]
    at = np.flatnonzero(opens)
    length = np.diff(np.append(at, len(windows)))
    start, doc = windows[at], docs[at]
    content = A.run_hashes(words, start, length + window - 1) if len(at) else np.zeros(0, A.U64)
    bucket = (np.where(alone[at], content, A.mix(least[at])) % A.U64(buckets)).astype(np.int64)
    from_byte = starts[start] if len(at) else at
    n_bytes = (ends[start + length + window - 2] - from_byte) if len(at) else at

    order = np.lexsort((content, bucket))  # stable, so the smallest id of a string comes first
    fresh = np.ones(len(order), bool)
    fresh[1:] = (content[order][1:] != content[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
    number = np.cumsum(fresh) - 1
    rep = order[fresh]
    mine, its = order[~fresh], rep[number[~fresh]]
    same_size = n_bytes[mine] == n_bytes[its]
    if not (same_size.all() and A.ranges_equal(norm, from_byte[mine], from_byte[its], n_bytes[mine]).all()):
        # Two strings share a hash: order by the strings themselves.
        text = norm.tobytes()
        strings = [text[a : a + n] for a, n in zip(from_byte.tolist(), n_bytes.tolist(), strict=True)]
        order = np.array(sorted(range(len(strings)), key=lambda i: (bucket[i], strings[i], i)))
        fresh = np.array([i == 0 or strings[order[i]] != strings[order[i - 1]] for i in range(len(order))])
        number = np.cumsum(fresh) - 1
        rep = order[fresh]
    group = np.empty(len(order), np.int64)
    group[order] = number
    rep_id = ids[doc[rep]]
    return Split(norm, starts, ends, doc_first, windows, length, group, ids[doc] > rep_id[group], start[rep], length[rep], rep_id, bucket[rep])


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    ids = pc.fill_null(table["_id"].combine_chunks(), int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    return table.take(pa.array(order)), ids[order]


def _emitter(window: int, minimiser: int, heavy, buckets: int):
    width = exchange.width(buckets)

    def emit(table: pa.Table) -> pa.Table:
        chunk = table["_chunk"][0].as_py()
        table, ids = _sorted(table)
        s = split(ids, table["_text"], window, minimiser, heavy.value, buckets)
        text = s.norm.tobytes()
        edges = np.searchsorted(s.rep_bucket, np.arange(buckets + 1))
        from_byte = s.starts[s.rep_start] if len(s.rep_start) else s.rep_start
        to_byte = s.ends[s.rep_start + s.rep_windows + window - 2] + 1 if len(s.rep_start) else s.rep_start
        keys, out = [], []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            i, j = edges[b], edges[b + 1]
            packed = b"".join([text[p:q] for p, q in zip(from_byte[i:j].tolist(), to_byte[i:j].tolist(), strict=True)])
            keys.append(b)
            out.append(A.pack(np.frombuffer(packed, np.uint8), s.rep_windows[i:j].astype(np.uint32), s.rep_id[i:j]))
        return exchange.sent(chunk, keys, out, width)

    return emit


def earlier_windows(data: np.ndarray, n_windows: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """For each window of the packed strings, whether an equal window has a smaller id."""
    ends = np.flatnonzero(data == 0x20)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    n_words = n_windows.astype(np.int64) + window - 1
    first = np.cumsum(n_words) - n_words
    at = A.concat_ranges(first, n_windows)
    mine = np.repeat(ids, n_windows)
    keys = A.gram_hashes(A.span_hashes(data, starts, ends), window)[at]
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    number = np.cumsum(fresh) - 1
    lead, rest = order[fresh][number[~fresh]], order[~fresh]
    from_byte, n_bytes = starts[at], ends[at + window - 1] - starts[at]
    same = n_bytes[rest] == n_bytes[lead]
    same[same] = A.ranges_equal(data, from_byte[rest[same]], from_byte[lead[same]], n_bytes[rest[same]])
    least = np.minimum.reduceat(mine[order], np.flatnonzero(fresh)) if len(order) else mine
    out = np.empty(len(at), bool)
    out[order] = least[number] < mine[order]
    for key in np.unique(keys[rest[~same]]):  # windows that share a hash but not their words
        members = np.flatnonzero(keys == key)
        strings = [data[from_byte[i] : from_byte[i] + n_bytes[i]].tobytes() for i in members.tolist()]
        best: dict[bytes, int] = {}
        for string, i in zip(strings, members.tolist(), strict=True):
            best[string] = min(best.get(string, LAST), int(mine[i]))
        out[members] = [best[string] < mine[i] for string, i in zip(strings, members.tolist(), strict=True)]
    return out


def _resolver(window: int, chunks: int):
    width = exchange.width(chunks)

    def resolve(table: pa.Table) -> pa.Table:
        senders, blobs = exchange.flat(table, "_from")
        parts = [A.unpack(x) for x in blobs]
        data, n_windows, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
        flags = earlier_windows(data, n_windows.astype(np.int64), ids, window)
        out, at = {}, 0
        for chunk, part in zip(senders.tolist(), parts, strict=True):
            n = int(part[1].astype(np.int64).sum())
            if len(hits := np.flatnonzero(flags[at : at + n])):
                out[chunk] = A.pack(np.diff(hits, prepend=0).astype(np.uint32))
            at += n
        to = sorted(out)
        return exchange.sent(table["_to"][0].as_py(), to, [out[c] for c in to], width)

    return resolve


def cut_out(text: bytes, removed: np.ndarray) -> bytes:
    """The text without the words that are marked, each with the whitespace behind it."""
    solid = ~A.SPACE[np.frombuffer(text, np.uint8)]
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    edges = np.append(starts, len(text)).tolist()
    # the edges of what stays: each run of words that stay, the first with the whitespace before it
    turns = np.flatnonzero(np.diff(removed, prepend=True, append=True)).tolist()
    stays = [text[edges[a] : edges[b]] for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return text[: edges[0]] + b"".join(stays)


def _marker(window: int, minimiser: int, heavy, buckets: int, cut: bool = False):
    def mark(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, ids = _sorted(docs)
        s = split(ids, docs["_text"], window, minimiser, heavy.value, buckets)
        before = np.cumsum(s.rep_windows) - s.rep_windows
        flags = np.zeros(int(s.rep_windows.sum()), bool)
        for bucket, blob in zip(*exchange.flat(answers, "_from"), strict=True):
            flags[before[np.searchsorted(s.rep_bucket, bucket)] + np.cumsum(A.unpack(blob)[0].astype(np.int64))] = True
        gone = np.repeat(s.later, s.length)
        if len(gone):
            gone |= flags[A.concat_ranges(before[s.group], s.length)]
        n = len(s.starts)
        from_word = s.windows[gone]
        cover = np.bincount(from_word, minlength=n + 1) - np.bincount(from_word + window, minlength=n + 1)
        removed = np.cumsum(cover)[:n] > 0
        total = np.zeros(n + 1, np.int64)
        np.cumsum(removed, out=total[1:])
        size = np.where(removed, 0, s.ends - s.starts + 1)
        kept = s.norm[np.repeat(~removed, s.ends - s.starts + 1)].tobytes()
        byte = np.zeros(n + 1, np.int64)
        np.cumsum(size, out=byte[1:])
        edges = byte[s.doc_first]
        texts = [kept[a : max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        n_removed = np.diff(total[s.doc_first])
        out = {"_row": docs["_row"], "n_words": np.diff(s.doc_first), "n_removed": n_removed, "kept_text": A.blobs(texts).cast(pa.string())}
        if cut:
            some = np.flatnonzero(n_removed)
            shorter = [cut_out(docs["_text"][i].as_py().encode(), removed[s.doc_first[i] : s.doc_first[i + 1]]) for i in some.tolist()]
            out["cut_text"] = pc.replace_with_mask(docs["_text"].combine_chunks(), pa.array(n_removed > 0), A.blobs(shorter).cast(pa.string()))
        return pa.table(out)

    return mark


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(number, np.concatenate(counts), len(distinct)).astype(np.int64)


def _counter(minimiser: int, threshold: float):
    """Reports, for each part of the runs that a task has seen, those that may be heavy over all."""

    def report(keys: list[np.ndarray], counts: list[np.ndarray], n: int) -> pa.RecordBatch:
        key, count = _added(keys, counts)
        often = count >= threshold * n
        return pa.record_batch({"_run": key[often].view(np.int64), "_n": count[often]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, n, held = [], [], 0, 0
        for batch in batches:
            step = 0
            data, offsets = A.text_buffer(batch.column(0))
            while step < batch.num_rows:
                stop = max(step + 1, int(np.searchsorted(offsets, offsets[step] + CHUNK_BYTES // 2)))
                norm, starts, ends, doc_first = A.normal_words(pa.chunked_array([batch.column(0).slice(step, stop - step)]))
                runs = _runs(A.span_hashes(norm, starts, ends), minimiser)
                inside = A.concat_ranges(doc_first[:-1], np.maximum(0, np.diff(doc_first) - minimiser + 1))
                key, count_ = np.unique(runs[inside] if len(runs) else runs, return_counts=True)
                keys.append(key)
                counts.append(count_)
                n, held = n + len(inside), held + len(key)
                if n >= COUNT_PART:
                    yield report(keys, counts, n)
                    keys, counts, n, held = [], [], 0, 0
                elif held >= HELD:
                    key, count_ = _added(keys, counts)
                    keys, counts, held = [key], [count_], len(key) // 2
                step = stop
        if n:
            yield report(keys, counts, n)

    return count


def heavy_runs(docs: DataFrame, text_col: str, minimiser: int, total_bytes: int, heavy: int = HEAVY) -> np.ndarray:
    """The runs of words with more than ``heavy`` occurrences, sorted; a list of bounded length.

    Each part of ``p`` runs reports those with at least ``heavy / 2 * p / all``
    occurrences, of which there are at most ``2 * all / heavy``.  A run has
    fewer than ``heavy / 2`` occurrences in all the parts that leave it out, so
    each heavy run is reported at least ``heavy / 2`` times; again at most ``2 *
    all / heavy`` runs can be.  As ``heavy`` is at least ``all / HEAVY_LIST``, a
    full part has ``COUNT_PART / HEAVY_LIST / 2`` occurrences of each run that
    it reports, at any size of the input.
    """
    most = max(1, total_bytes // 2)
    heavy = max(heavy, most // HEAVY_LIST)
    seen = docs.select(F.col(text_col)).mapInArrow(A.tidy(_counter(minimiser, heavy / 2 / most)), "_run long, _n long")
    rows = seen.groupBy("_run").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= heavy / 2).select("_run")
    return np.sort(rows.toPandas()["_run"].to_numpy(np.int64).astype(A.U64))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, minimiser: int = 3, heavy: int = HEAVY, cut: bool = False) -> DataFrame:
    """All columns but the text, then ``n_words``, ``n_removed`` and ``kept_text``, and ``cut_text`` if ``cut``."""
    if not 1 <= minimiser <= window:
        raise ValueError("minimiser must be from 1 to window")
    spark = docs.sparkSession
    total = frames.text_bytes(docs, text_col)
    chunks, buckets = frames.parts(total, CHUNK_BYTES), frames.parts(EXPANSION * total, BUCKET_BYTES)
    often = spark.sparkContext.broadcast(heavy_runs(docs, text_col, minimiser, total, heavy))
    new = ["n_words", "n_removed", "kept_text", *(["cut_text"] if cut else [])]
    row = frames.others(docs, text_col, *new)
    id_ = F.col(id_col).cast("long")
    chunked = docs.select(frames.spread(id_, F.col(text_col), chunks).alias("_chunk"), id_.alias("_id"), F.col(text_col).cast("string").alias("_text"), row.alias("_row"))
    few, many = frames.tasks(spark, total, TEXT_TASK), frames.tasks(spark, EXPANSION * total, TASK_BYTES)
    chunked = chunked.repartition(few, "_chunk")
    packed = chunked.groupBy("_chunk").applyInArrow(A.tidy_group(_emitter(window, minimiser, often, buckets)), exchange.SENT)
    answers = exchange.exchange(packed, chunks, buckets, many).repartition(many, "_to").groupBy("_to").applyInArrow(A.tidy_group(_resolver(window, chunks)), exchange.SENT)
    told = exchange.exchange(answers, buckets, chunks, few).repartition(few, "_to")
    kind = T.StructType([T.StructField("_row", chunked.schema["_row"].dataType), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")), *(T.StructField(n, T.StringType()) for n in new[2:])])
    done = chunked.groupBy("_chunk").cogroup(told.groupBy("_to")).applyInArrow(A.tidy_groups(_marker(window, minimiser, often, buckets, cut)), kind)
    names = [c for c in docs.columns if c not in (text_col, *new)]
    return done.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], *new)
