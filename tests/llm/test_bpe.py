"""Byte-level BPE against the rank library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from vetloom.llm import bpe, tokens

FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LONG = ["a b  c\n\n d  e's 12 ñé 日本 " * 60, "x" * 700, " " * 500 + "y", "\t\n " * 300, "ab\x1ccd \x85 " * 90]
SCHEMA = "doc_id long, text string, ids string"


def test_encode_decode(spark):
    library = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=tokens.ranks(FILE), special_tokens={})
    rows = [(i, t, "clash") for i, t in enumerate(["", "short one", None, *LONG, LONG[0]])] + [(3, LONG[0], "again"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for chunk, overlap in ((64, 16), (1 << 15, 1 << 10)):
        got = bpe.decode(bpe.encode(docs, FILE, PATTERN, chunk=chunk, overlap=overlap), FILE).collect()
        want = sorted((i if i is not None else -1, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
        assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_runs_that_the_library_cannot_match(spark):
    n = 5_000_000
    got = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in bpe.encode(spark.createDataFrame([(1, "a" + " " * n + "b", ""), (2, "b" * n, "")], SCHEMA), FILE, PATTERN).collect()}
    assert got[1].tolist() == [64, *[220] * (n - 1), 275]
    table = {i: t for t, i in tokens.ranks(FILE).items()}
    assert b"".join(table[i] for i in got[2].tolist()) == b"b" * n


def test_long_white_space(spark):
    texts = [("ab c" + " " * n) * (5_000_000 // n) for n in (10_000, 40_000, tokens.RUN - 1)]
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA), FILE, PATTERN).collect()}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokens.ranks(FILE), special_tokens={})
    for i, text in enumerate(texts):
        assert got[i] == np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_stitching_of_random_texts():
    rng = random.Random(3)
    parts = ["'s", "'re", "'ll", " it's"]
    encode = tokens.by_ranks(FILE, PATTERN)
    for _ in range(400):
        text = "".join(rng.choice([rng.choice("ab1'! \n\té日\u3000\x1c\x85") * rng.randint(1, 40), rng.choice(parts)]) for _ in range(rng.randint(1, 60)))
        for chunk, overlap in ((8, 4), (16, 8), (5, 2), (32, 32)):
            batch = pa.record_batch({"_text": pa.array([text[s : s + chunk + overlap] for s in range(0, len(text), chunk)])})
            rows = next(bpe._pretokeniser(PATTERN, chunk, overlap)(iter([batch]))).to_pylist()
            pieces = list(bpe.stitch((tuple(r[c] for c in ("_text", "_left", "_right", "_last", "_covered")) for r in rows), PATTERN, chunk))
            assert "".join(pieces) == text and b"".join(encode(pieces)) == encode([text])[0]


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), FILE, PATTERN).count() == 0
