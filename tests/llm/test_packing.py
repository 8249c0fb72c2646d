"""Token pieces against the tokenizer's own library, and packing against its bound."""

import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vetloom.llm import packing, tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello there, it's 12 o'clock.\n\n  x", "ÄÖ ñ 日本語 🙂    z", "<|endoftext|> a", "word " * 5000, "\t\t a  b   c    ", "'S 're", "é" * 300]
SCHEMA = "doc_id long, text string, piece string, offset string"


def test_file_ranks_give_the_tokenizers_ids():
    tokenizer = Tokenizer.from_file(FILE)
    texts = [*TEXTS, "a" + " \n" * tokens.RUN + "b", "\n" * tokens.RUN + "<|endoftext|>" + "\t" * tokens.RUN, "x" + "\u3000" * tokens.RUN + "\x1c 1"]
    for text, ids in zip(texts, tokens.by_tokenizer(FILE)(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert tokens.file_ranks(public_tokenizers.path("word_bpe_49k.json")) is None


def test_runs_that_the_library_cannot_match(spark):
    n = 5_000_000
    docs = spark.createDataFrame([(1, "a" + " " * n + "b", "x", "y")], SCHEMA)
    got = packing.pack_sequences(docs, FILE).collect()
    ids = [64, *[220] * (n - 1), 275, 0]
    assert sum(r.length for r in got) == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in got)


def test_long_white_space_takes_linear_time():
    encode, tokenizer = tokens.by_tokenizer(FILE), Tokenizer.from_file(FILE)
    encode(["a"])
    for n in (10_000, 40_000, tokens.RUN - 1):
        text = ("ab c" + " " * n) * (5_000_000 // n)
        start = time.monotonic()
        (ids,) = encode([text])
        assert time.monotonic() - start < 30  # a second or two; quadratic time takes minutes
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, got, capacity):
    tokenizer = Tokenizer.from_file(FILE)
    expected = []
    for id_, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        n = len(ids) // 4
        edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
        expected += [(id_, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((e[0] or -1, *e[1:]) for e in expected)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_sequences(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, None, "x", "y"), (None, "no id", "x", "y"), (1, TEXTS[1], "x", "y")]
    got = packing.pack_sequences(spark.createDataFrame(rows, SCHEMA), FILE, capacity=64, per_partition=20).collect()
    n = check(rows, got, 64)
    assert n <= packing.lower_bound(np.array([r.length for r in got]), 64) + 2
    assert {r.sequence_id % packing._ROUNDS for r in got} >= {0, 1}  # bins of an exchange, too
    assert all(r.bound <= r.bins for r in got)


def test_hot_rows_are_spread_and_gaps_exchanged(spark):
    rows = [(None, "one two three", "x", "y")] * 300 + [(i, "word " * (20 + i % 9), "x", "y") for i in range(200)]
    got = packing.pack_sequences(spark.createDataFrame(rows, SCHEMA), FILE, capacity=64, per_partition=50).collect()
    n = check(rows, got, 64)
    lengths = np.array([r.length for r in got])
    assert n <= 1.05 * len(packing.best_fit(lengths, 64)[1]) + 1
    assert max(r.bins for r in got) < n / 2


def test_bound_and_best_fit():
    lengths = np.array([6, 6, 6, 4, 4, 4, 9, 1])
    bins, room = packing.best_fit(lengths, 10)
    assert len(room) == packing.lower_bound(lengths, 10) == 4
    assert packing.lower_bound(np.array([6] * 5), 10) == 5
    assert sorted(np.bincount(bins, lengths).tolist()) == [10, 10, 10, 10]


def test_empty(spark):
    assert packing.pack_sequences(spark.createDataFrame([], SCHEMA), FILE).count() == 0
