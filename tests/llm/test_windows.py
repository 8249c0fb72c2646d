"""Full windows: every id in one piece, no padding, few cuts."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vetloom.llm import queries, windows

FILE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, offset string"
TEXTS = ["", "Hello there, it's 12 o'clock.\n\n  x", "ÄÖ ñ 日本語 🙂    z", "<|endoftext|> a", "word " * 5000, "\t\t a  b   c    ", "é" * 300, "a b c d e f g " * 30]


def check(rows, got, capacity, end=1):
    """Pieces give back every document; sequences are gapless and full, or powers of two. Returns the lengths of those that are not full, and the number of cuts."""
    tokenizer = Tokenizer.from_file(FILE)
    encoded = [np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4") for _, text, *_ in rows]
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    for (id_, *_), ids in zip(rows, encoded, strict=True):
        want[id_, len(ids)].append(ids)
    assert want.keys() == pieces.keys()
    for key, copies in want.items():
        # copies of one row may be cut at different places: each id is covered once for each of them
        cover = np.zeros(key[1], int)
        for start, length, crc in pieces[key]:
            assert any(crc == zlib.crc32(ids[start : start + length].tobytes()) for ids in copies)
            cover[start : start + length] += 1
        assert (cover == len(copies)).all()
    short = []
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
        short += [at] if at < capacity else []
    return sorted(short), len(got) - sum(-(-len(ids) // capacity) for ids in encoded)


def most_cuts(docs, capacity):
    """A cut closes each window that has room, and the last rest has one for each power of two."""
    lengths = [r.length for r in windows.token_rows(docs, FILE, capacity, 1).collect() if r.length < capacity]
    return np.count_nonzero(windows.best_fit(lengths, capacity)[1]) + capacity.bit_length()


@pytest.mark.parametrize("per_partition", [10, 8192])
def test_pack_windows(spark, per_partition):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, None, "x", "y"), (None, "no id", "x", "y"), (1, TEXTS[1], "x", "y")]
    rows += [(100 + i, "word " * (i * i % 90), "x", "y") for i in range(150)]
    got = windows.pack_windows(spark.createDataFrame(rows, SCHEMA), FILE, capacity=64, per_partition=per_partition)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    got = got.collect()
    short, cuts = check(rows, got, 64)
    assert len(set(short)) == len(short) <= 6  # one rest below 64, at its powers of two
    if per_partition > len(rows):
        assert cuts <= most_cuts(spark.createDataFrame(rows, SCHEMA), 64)


def test_repeated_rows_are_spread(spark):
    rows = [(None, "one two three", "x", "y")] * 300 + [(i, "word " * (20 + i % 9), "x", "y") for i in range(200)]
    got = windows.pack_windows(spark.createDataFrame(rows, SCHEMA), FILE, capacity=64, per_partition=50).collect()
    short, _ = check(rows, got, 64)
    assert len(set(short)) == len(short)
    assert len({r.sequence_id // 2 // windows._ROUNDS // windows._WINDOWS for r in got}) >= 8


def test_best_fit_is_the_tightest():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 500).tolist()
    held, room = windows.best_fit(lengths, 100)
    free, want = [], []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in free if r >= n]
        left = min(fits) if fits else 100
        if fits:
            free.remove(left)
        free.append(left - n)
        want.append(left - n)
    assert sorted(room) == sorted(free)
    assert sorted(i for w in held for i in w) == list(range(500))
    assert all(sum(lengths[i] for i in w) + r == 100 for w, r in zip(held, room, strict=True))


def test_filled_windows_and_powers():
    lengths = [70, 70, 70, 30, 5]
    full, left = windows.filled(*windows.best_fit(lengths, 100), lengths, 100)
    assert all(sum(b - a for _, a, b in w) == 100 for w in full)
    assert sum(b - a for _, a, b in left) == sum(lengths) % 100
    spans = [*left, *(s for w in full for s in w)]
    for i, n in enumerate(lengths):
        mine = sorted((a, b) for k, a, b in spans if k == i)
        assert mine[0][0] == 0 and mine[-1][1] == n and all(x[1] == y[0] for x, y in zip(mine, mine[1:], strict=False))
    assert [sum(b - a for _, a, b in w) for w in windows.at_powers_of_two([(0, 0, 7), (1, 3, 9)])] == [8, 4, 1]


def test_empty(spark):
    assert windows.pack_windows(spark.createDataFrame([], SCHEMA), FILE).count() == 0


def test_query(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    short, cuts = check(rows, queries.op13_window_packing(spark, small_dir).collect(), 2048)
    assert len(set(short)) == len(short)
    assert cuts <= most_cuts(docs, 2048)
