"""SimHash near-duplicates: a self-join of binary tries, then components.

A fingerprint has 64 bits; a bit is set if it is in over half the XXH64 values
(seed 42) of the text's shingles of ``words`` words, repeats included.  Texts
link where their fingerprints differ in at most ``budget`` bits.

1. Equal fingerprints become one.  From here on only fingerprints travel.
2. Of ``budget + s`` blocks of bits, two linked fingerprints share ``s``.  For
   each choice of ``s`` blocks the fingerprints' bits are put in an order in
   which these lead, and sorted by range: each partition holds a part of the
   trie of that order.  More fingerprints take a larger ``s``, so that about
   :data:`PER_LEAD` share the leading bits at any size.
3. Below each value of the leading bits, pairs of trie nodes are traversed
   together.  Each step adds the bit in which two children differ, and a pair
   is pruned when that exceeds the budget.  Leaves are compared outright.
4. A value with many fingerprints, or one at a partition's edge, is cut into
   chunks.  Pairs of these whose common leading bits differ by more than the
   budget are pruned before any fingerprint moves; the others are traversed in
   tasks of their own.
5. A task reports a star for each component of what it has seen, not pairs:
   two nodes whose fingerprints are all in one component already are pruned.
   Alternating stars join these components over all tasks.

That finds every link within a few bits.  Texts with a similarity (Jaccard, of
five-word shingles) of 0.8 differ in about a seventh of their bits, more than
blocks can serve.  For these there are *wide* fingerprints of 256 bits and a
budget of 44.  Here the tries' orders lead with bits drawn at random, so many
that about :data:`PER_PROBE` fingerprints share their values, and there are so
many orders that a pair :data:`FAR` bits apart, which is at the edge of 0.8,
meets in one with a probability of :data:`RECALL`; nearer ones almost surely do.
Steps 3 to 5 are the same; the traversal adds up differing bits of the order,
and leaves compare all bits.  The number of orders grows slowly, with about the
fourth root of the number of fingerprints.

Contract: null or blank text has the fingerprint zero.  ``component_id`` is the
smallest id that is not null among the rows reachable, null if there is none.
Repeated rows each get a row.  Other columns are not carried.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import frames, graph

BITS = 64
SEED = 42
#: Bytes of text taken at a time, and shingles whose bits are counted at a time.
STEP_BYTES, STEP_SHINGLES = 4 << 20, 1 << 17
#: Fingerprints of a chunk, and pairs up to which two nodes are compared outright.
CHUNK, LEAF = 4096, 64
#: Pairs of small nodes that are compared at a time.
STEP_NODES = 1 << 14
#: Fingerprints under one value of the leading bits, about, from which on more blocks are taken.
PER_LEAD = 16_384
TASK_BYTES = 8 << 20
#: Wide fingerprints: the bits, the budget, and how tries are probed for it.
WIDE, WIDE_BUDGET = 256, 44
PER_PROBE, FAR, RECALL = 16, 40, 0.95
#: Neighbours in sorted order that are linked first, so that dense regions are pruned early.
NEAR = 4
SALTS = 16
_SIGN = np.uint64(1 << 63)


def text_fingerprints(column: pa.Array, words: int) -> np.ndarray:
    """The fingerprint of each text."""
    norm, starts, ends, first = A.normal_words(column)
    text = A.LOWER[norm].tobytes()
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(1, n_words - words + 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    begin = A.concat_ranges(first[:-1], n)
    last = begin + np.minimum(n_words, words)[doc] - 1
    ones = np.zeros((len(n), BITS), np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(begin), STEP_SHINGLES):
        some = slice(at, at + STEP_SHINGLES)
        spans = zip(starts[begin[some]].tolist(), ends[last[some]].tolist(), strict=True)
        values = np.frombuffer(b"".join([digest(text[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
        docs = doc[some]
        edge = np.flatnonzero(np.diff(docs, prepend=-1))
        ones[docs[edge]] += np.add.reduceat(np.unpackbits(values, axis=1), edge, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def wide_fingerprints(column: pa.Array, words: int, bits: int = WIDE) -> np.ndarray:
    """The wide fingerprint of each text, as rows of 64-bit parts; a shingle's hash is made from those of its words."""
    norm, starts, ends, first = A.normal_words(column)
    hashes = A.span_hashes(A.LOWER[norm], starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(1, n_words - words + 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    shingles = A.run_hashes(hashes, A.concat_ranges(first[:-1], n), np.minimum(n_words, words)[doc])
    salts = np.arange(1, bits // BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros((len(n), bits), np.int64)
    step = STEP_SHINGLES * BITS // bits
    for at in range(0, len(shingles), step):
        values = np.stack([A.mix(shingles[at : at + step] + salt) for salt in salts], axis=1)
        docs = doc[at : at + step]
        edge = np.flatnonzero(np.diff(docs, prepend=-1))
        ones[docs[edge]] += np.add.reduceat(np.unpackbits(values.view(np.uint8), axis=1), edge, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1).view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = BITS) -> DataFrame:
    """The id column and ``fp``: 64 bits as a long, more as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in A.text_steps(batch.column(1), STEP_BYTES):
                column = batch.column(1).slice(a, b - a)
                fp = pa.array(text_fingerprints(column, words).view(np.int64)) if bits == BITS else _bytes(wide_fingerprints(column, words, bits))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), fp], ["_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(A.tidy(run), f"_id long, fp {'long' if bits == BITS else 'binary'}").withColumnRenamed("_id", id_col)


def _bytes(parts: np.ndarray) -> pa.Array:
    """Rows of 64-bit parts as byte strings of one length."""
    size = 8 * parts.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer((np.arange(len(parts) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(parts))])


def _parts(column: pa.Array) -> np.ndarray:
    data, offsets = A.text_buffer(column)
    return np.ascontiguousarray(data).view(np.uint64).reshape(len(offsets) - 1, -1)


@dataclass(frozen=True)
class Order:
    """An order of the bits: segments (offset and width) one behind the other, and how many bits lead."""

    segments: tuple[tuple[int, int], ...]
    lead: int

    def key(self) -> Column:
        """The fingerprint in this order."""
        at, out = 0, F.lit(0).cast("long")
        for offset, width in self.segments:
            bits = F.shiftrightunsigned("fp", BITS - offset - width).bitwiseAND(F.lit((1 << width) - 1))
            out = out.bitwiseOR(F.shiftleft(bits, BITS - at - width))
            at += width
        return out

    def back(self, keys: np.ndarray) -> np.ndarray:
        """The fingerprints of keys in this order, as longs."""
        at, out = 0, np.zeros(len(keys), np.uint64)
        for offset, width in self.segments:
            bits = (keys >> np.uint64(BITS - at - width)) & np.uint64((1 << width) - 1)
            out |= bits << np.uint64(BITS - offset - width)
            at += width
        return out.view(np.int64)


def orders(budget: int, shared: int) -> list[Order]:
    """One for each choice of ``shared`` of ``budget + shared`` blocks."""
    n = budget + shared
    edges = [BITS * i // n for i in range(n + 1)]
    out = []
    for lead in itertools.combinations(range(n), shared):
        segments: list[tuple[int, int]] = []
        for block in [*lead, *(i for i in range(n) if i not in lead)]:
            offset, width = edges[block], edges[block + 1] - edges[block]
            if segments and sum(segments[-1]) == offset and segments[-1][1] + width < BITS:
                offset, width = segments[-1][0], segments.pop()[1] + width
            segments.append((offset, width))
        out.append(Order(tuple(segments), sum(edges[i + 1] - edges[i] for i in lead)))
    return out


def shared_blocks(n: int, budget: int, per_lead: int = PER_LEAD) -> int:
    """How many blocks lead, so that about ``per_lead`` of ``n`` fingerprints share a value of them."""
    return next((s for s in range(1, 4) if n >> min(o.lead for o in orders(budget, s)) <= per_lead), 4)


@dataclass(frozen=True)
class Probe:
    """An order of a wide fingerprint: the bits that make its trie key, and how many of them lead."""

    bits: tuple[int, ...]
    lead: int


def probes(n: int, bits: int = WIDE, per_probe: int = PER_PROBE) -> list[Probe]:
    """Orders for ``n`` wide fingerprints."""
    lead = min(48, max(1, math.ceil(math.log2(max(2, n / per_probe)))))
    several = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - FAR / bits) ** lead))
    rng = np.random.default_rng(SEED)
    return [Probe(tuple(rng.permutation(bits)[:BITS].tolist()), lead) for _ in range(several)]


@dataclass
class Part:
    """Sorted trie keys of one order, the names of their fingerprints, and all their bits (64 in a column)."""

    keys: np.ndarray
    ids: np.ndarray
    full: np.ndarray

    def close(self, i: np.ndarray, j: np.ndarray, budget: int) -> np.ndarray:
        if self.full.shape[1] == 1:
            return np.bitwise_count(self.keys[i] ^ self.keys[j]) <= budget
        return np.bitwise_count(self.full[i] ^ self.full[j]).sum(axis=1) <= budget

    def cut(self, a: int, b: int) -> bytes:
        """The members a to b - 1, packed; :func:`unpacked` reads them."""
        arrays = [self.keys, self.ids, self.full] if self.full.shape[1] > 1 else [self.keys]
        return b"".join(x[a:b].tobytes() for x in arrays)


def unpacked(data: list[bytes], order: Order | Probe) -> Part:
    """The members of some packed ranges, one behind the other."""
    if isinstance(order, Order):
        keys = np.concatenate([np.frombuffer(d, np.uint64) for d in data])
        return Part(keys, order.back(keys), keys[:, None])
    wide = WIDE // BITS
    sizes = [len(d) // (16 + 8 * wide) for d in data]
    whole = zip(data, sizes, strict=True)
    keys, ids, full = zip(*[(np.frombuffer(d, np.uint64, n), np.frombuffer(d, np.int64, n, 8 * n), np.frombuffer(d, np.uint64, n * wide, 16 * n)) for d, n in whole], strict=True)
    return Part(np.concatenate(keys), np.concatenate(ids), np.concatenate(full).reshape(-1, wide))


def _leaves(part: Part, la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the members of small nodes."""
    links = [(np.zeros(0, np.int64),) * 2]
    for at in range(0, len(la), STEP_NODES):
        a, b = la[at : at + STEP_NODES], ha[at : at + STEP_NODES]
        first, width = lb[at : at + STEP_NODES], (hb - lb)[at : at + STEP_NODES]
        i = A.concat_ranges(a, b - a)
        pair = np.repeat(np.arange(len(a)), b - a)
        j = A.concat_ranges(first[pair], width[pair])
        i = np.repeat(i, width[pair])
        ok = i < j
        i, j = i[ok], j[ok]
        ok = part.close(i, j, budget)
        links.append((i[ok], j[ok]))
    return tuple(np.concatenate(x) for x in zip(*links, strict=True))


def trie_links(part: Part, pairs: tuple[np.ndarray, ...], depth: int, budget: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join components, from pairs of nodes (ranges ``la:ha`` and ``lb:hb`` of the sorted keys)."""
    la, ha, lb, hb = pairs
    used = np.zeros(len(la), np.int64)
    from_, to = [], []
    changes = np.cumsum(np.diff(labels, prepend=labels[:1]) != 0)
    while len(la):
        same = (labels[la] == labels[lb]) & (changes[ha - 1] == changes[la]) & (changes[hb - 1] == changes[lb])
        small = (ha - la) * (hb - lb) <= LEAF
        leaf = small & ~same
        i, j = _leaves(part, la[leaf], ha[leaf], lb[leaf], hb[leaf], budget)
        from_.append(i)
        to.append(j)
        go = ~small & ~same
        la, ha, lb, hb, used = (x[go] for x in (la, ha, lb, hb, used))
        if not len(la):
            break
        if depth < BITS:
            ones = np.zeros(len(part.keys) + 1, np.int64)
            np.cumsum((part.keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1), out=ones[1:])
            ma, mb = ha - (ones[ha] - ones[la]), hb - (ones[hb] - ones[lb])
        else:  # equal keys of wide fingerprints: halves, which tell nothing of differing bits
            ma, mb = (la + ha) // 2, (lb + hb) // 2
        differ = int(depth < BITS)
        own = la == lb
        children = [(la, ma, lb, mb, used), (ma, ha, mb, hb, used), (la, ma, mb, hb, used + differ)]
        other = ~own
        children.append((ma[other], ha[other], lb[other], mb[other], used[other] + differ))
        la, ha, lb, hb, used = (np.concatenate(c) for c in zip(*children, strict=True))
        keep = (ha > la) & (hb > lb) & (used <= budget)
        la, ha, lb, hb, used = (x[keep] for x in (la, ha, lb, hb, used))
        depth += 1
    return np.concatenate(from_ or [np.zeros(0, np.int64)]), np.concatenate(to or [np.zeros(0, np.int64)])


def _stars(part: Part, pairs: tuple[np.ndarray, ...], lead: int, budget: int) -> pa.RecordBatch:
    """A link from each member of a component to its smallest fingerprint."""
    n = len(part.keys)
    near = [(np.arange(n - s), np.arange(s, n)) for s in range(1, min(NEAR, n - 1) + 1)]
    i, j = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (np.zeros(0, np.int64),) * 2
    ok = part.close(i, j, budget)
    i, j = i[ok], j[ok]
    labels = graph.local_components(n, i, j)
    more = trie_links(part, pairs, lead, budget, labels)
    labels = graph.local_components(n, np.concatenate([i, more[0]]), np.concatenate([j, more[1]]))
    by = np.lexsort((part.ids, labels))
    first = np.maximum.accumulate(np.where(np.diff(labels[by], prepend=-1) != 0, np.arange(n), 0)) if n else by
    u, v = part.ids[by], part.ids[by[first]] if n else part.ids
    return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])


def _sorted_parts(batches: Iterator[pa.RecordBatch], all_: list[Order] | list[Probe]) -> Iterator[tuple[int, Part]]:
    """For each order in a partition, its keys in order."""
    wide = isinstance(all_[0], Probe)
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), *((b.column(2).to_numpy(), _parts(b.column(3))) if wide else ())) for b in batches if b.num_rows]
    if parts:
        number, key, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
        for b in np.unique(number).tolist():
            mine = np.flatnonzero(number == b)
            keys = key[mine].view(np.uint64) ^ _SIGN
            if wide:
                order = np.argsort(keys, kind="stable")
                yield b, Part(keys[order], more[0][mine][order], more[1][mine][order])
            else:
                keys.sort()
                yield b, Part(keys, all_[b].back(keys), keys[:, None])


def _ranges(keys: np.ndarray, width: int) -> np.ndarray:
    """Where each value of the leading bits starts, and the end."""
    lead = keys >> np.uint64(BITS - width)
    return np.append(np.flatnonzero(np.diff(lead, prepend=~lead[:1]) != 0), len(keys))


def _within(all_: list[Order] | list[Probe], budget: int, chunk: int):
    """Links within the chunks of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part in _sorted_parts(batches, all_):
            edges = _ranges(part.keys, all_[b].lead)
            sizes = np.diff(edges)
            n = -(-sizes // chunk)
            start = np.repeat(edges[:-1], n) + chunk * A.concat_ranges(np.zeros(len(n), np.int64), n)
            stop = np.minimum(start + chunk, np.repeat(edges[1:], n))
            yield _stars(part, (start, stop, start, stop), all_[b].lead, budget)

    return run


_CHUNK = {"b": pa.int32(), "lead": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "common": pa.int32(), "part": pa.int64(), "keys": pa.binary()}


def _chunks(all_: list[Order] | list[Probe], chunk: int):
    """The chunks of values that are cut, or that may go on in the next partition, and how many leading bits all of a chunk share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part in _sorted_parts(batches, all_):
            keys, width, rows = part.keys, all_[b].lead, []
            edges = _ranges(keys, width)
            for i in {0, len(edges) - 2, *np.flatnonzero(np.diff(edges) > chunk).tolist()}:
                for at in range(edges[i], edges[i + 1], chunk):
                    end = min(at + chunk, edges[i + 1])
                    low, high = keys[at], keys[end - 1]
                    common = BITS - int(low ^ high).bit_length()
                    # keys of wide fingerprints repeat, so a chunk's number tells it apart
                    number = int(A.mix(part.ids[at : at + 1].view(np.uint64)).view(np.int64)[0])
                    rows.append((b, int(low >> np.uint64(BITS - width)), int((low ^ _SIGN).view(np.int64)), int((high ^ _SIGN).view(np.int64)), common, number, part.cut(at, end)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNK.values(), strict=True)], list(_CHUNK))

    return run


def chunk_pairs(chunks: DataFrame, budget: int) -> DataFrame:
    """(b, part, part2): pairs of chunks with the same leading bits whose common bits differ by the budget at most.  No keys travel."""
    heads = chunks.select("b", "lead", "lo", "common", "part")
    left = heads.withColumn("salt", frames.dealt(F.col("part"), SALTS))
    right = heads.select("b", "lead", F.col("lo").alias("lo2"), F.col("common").alias("common2"), F.col("part").alias("part2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    differ = F.bit_count(F.expr("shiftrightunsigned(lo ^ lo2, 64 - least(common, common2))"))
    before = F.struct("lo", "part") < F.struct(F.col("lo2").alias("lo"), F.col("part2").alias("part"))
    return left.join(right, ["b", "lead", "salt"]).filter(before).filter(differ <= budget).select("b", "part", "part2")


def _between(all_: list[Order] | list[Probe], budget: int):
    """Links between the two chunks of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                order = all_[row["b"]]
                one, both = unpacked([row["keys"]], order), unpacked([row["keys"], row["keys2"]], order)
                at, end = np.array([len(one.keys)]), np.array([len(both.keys)])
                yield _stars(both, (np.array([0]), at, at, end), order.lead, budget)

    return run


def _edges(keyed: DataFrame, all_: list[Order] | list[Probe], budget: int, chunk: int, n: int, size: int) -> DataFrame:
    """Links from the tries of keyed fingerprints: order ``b``, key ``k`` and, of wide ones, their name and bits."""
    spark = keyed.sparkSession
    tries = frames.checkpointed(keyed.repartitionByRange(frames.tasks(spark, size * n * len(all_), TASK_BYTES), "b", "k"))
    within = tries.mapInArrow(A.tidy(_within(all_, budget, chunk)), "u long, v long")
    chunks = frames.stored(tries.mapInArrow(_chunks(all_, chunk), "b int, lead long, lo long, hi long, common int, part long, keys binary"))
    pairs = frames.stored(chunk_pairs(chunks, budget))
    tasks = frames.tasks(spark, 2 * size * chunk * pairs.count(), 4 * TASK_BYTES)
    full = pairs.join(chunks.select("b", "part", "keys"), ["b", "part"]).join(chunks.select("b", F.col("part").alias("part2"), F.col("keys").alias("keys2")), ["b", "part2"])
    between = full.repartition(tasks, F.xxhash64("b", "part", "part2")).select("b", "keys", "keys2").mapInArrow(A.tidy(_between(all_, budget)), "u long, v long")
    return within.unionByName(between)


def trie_edges(fps: DataFrame, budget: int, chunk: int = CHUNK, per_lead: int = PER_LEAD) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) with the components that all pairs within the budget have."""
    n = fps.count()
    all_ = orders(budget, shared_blocks(n, budget, per_lead))
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("b"), o.key().bitwiseXOR(F.lit(-(1 << 63))).alias("k")) for i, o in enumerate(all_)])).alias("x")).select("x.b", "x.k")
    return _edges(keyed, all_, budget, chunk, n, 12)


def _probed(all_: list[Probe]):
    """A row for each wide fingerprint and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(_parts(batch.column(1)).view(np.uint8), axis=1)
            for b, probe in enumerate(all_):
                keys = np.packbits(np.ascontiguousarray(bits[:, probe.bits]), axis=1).view(">u8").ravel().astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b, np.int32)), pa.array((keys ^ _SIGN).view(np.int64)), *batch.columns], ["b", "k", "node", "fp"])

    return run


def wide_edges(fps: DataFrame, budget: int = WIDE_BUDGET, chunk: int = CHUNK, per_probe: int = PER_PROBE) -> DataFrame:
    """Links (u, v) between the names of distinct wide fingerprints (columns node and fp)."""
    n = fps.count()
    all_ = probes(n, WIDE, per_probe)
    keyed = fps.select("node", "fp").mapInArrow(_probed(all_), "b int, k long, node long, fp binary")
    return _edges(keyed, all_, budget, chunk, n, 20 + WIDE // 8)


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, budget: int, bits: int) -> DataFrame:
    """(_id, fp, root, component_id) of each row: ``root`` names the component, and ``component_id`` is the smallest id there."""
    if bits not in (BITS, WIDE):
        raise ValueError("bits must be 64 or 256")
    rows = frames.checkpointed(fingerprints(docs, id_col, text_col, words, bits).withColumnRenamed(id_col, "_id"))
    node = F.col("fp") if bits == BITS else F.xxhash64("fp")
    distinct = frames.checkpointed(rows.groupBy("fp").agg(F.min("_id").alias("least")).withColumn("node", node))
    roots = graph.components(trie_edges(distinct, budget) if bits == BITS else wide_edges(distinct, budget))
    rooted = distinct.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    # written first, so that the join's sides are plain shuffles, of which a large component's part can be split
    least = frames.checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return rows.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, budget: int = 4, bits: int = BITS) -> DataFrame:
    """The id column, ``fingerprint`` (hexadecimal digits) and ``component_id``.  ``bits`` is 64, or 256 for wide fingerprints."""
    done = _components(docs, id_col, text_col, words, budget, bits)
    return done.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), bits // 4, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, budget: int = WIDE_BUDGET, bits: int = WIDE) -> DataFrame:
    """One row of each component: that with the smallest id, and of several with that id any one.

    So rows that share an id but not a component stay, each for its own; to tell
    them apart, the rows of repeated ids are fingerprinted again.  Rows with a
    null id stay.
    """
    found = frames.checkpointed(_components(docs, id_col, text_col, words, budget, bits))
    ids = frames.checkpointed(found.groupBy("_id").agg(F.count("*").alias("_n"), F.bool_or(F.col("_id") == F.col("component_id")).alias("_first")).filter("_first"))
    once, often = (ids.filter(n).select(F.col("_id").alias(id_col)) for n in ("_n = 1", "_n > 1"))
    stay = docs.join(once, id_col, "left_semi").select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
    if often.isEmpty():
        return stay
    again = frames.stored(docs.join(often, id_col, "left_semi").select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_at"), F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_id")))
    firsts = found.filter("_id = component_id").select("_id", "fp", "root").distinct()
    kept = again.select("_at", "_id").join(fingerprints(again, "_at", "_text", words, bits), "_at").join(firsts, ["_id", "fp"]).groupBy("root").agg(F.min("_at").alias("_at"))
    return stay.unionByName(again.join(kept, "_at", "left_semi").select("_row.*"))
