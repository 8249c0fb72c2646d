"""Language-model scores against plain counting, and on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vetloom.llm import lm

SCHEMA = "doc_id long, text string, score string"


def words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").split()


def plain(rows):
    """Base scores, and pair and word estimates' pieces, from dictionaries."""
    train = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    count, pairs = Counter(), Counter()
    for _, t in train:
        tokens = ["<s>", *words(t), "</s>"]
        count.update(tokens[1:])
        pairs.update(zip(tokens, tokens[1:], strict=False))
    total, distinct = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        tokens = [*words(t), "</s>"]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), sum(count[w] > 0 for w in tokens), total, base))
    return out, count, pairs, len(train)


@pytest.mark.parametrize("direct", [1 << 14, 1])
def test_scores(spark, monkeypatch, direct):
    monkeypatch.setattr(lm.exchange, "DIRECT", direct)
    rng = np.random.default_rng(0)
    follow = rng.integers(0, 40, (40, 3))
    rows = []
    for i in range(400):
        w, out = int(rng.integers(40)), []
        for _ in range(int(rng.integers(1, 60))):
            out.append(f"W{w}")
            w = int(follow[w, rng.integers(3)])
        rows.append((i, " ".join(out)))
    rows += [(400, None), (401, ""), (402, "\t new-word \n"), (5, "again again"), (None, "no id")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 8000)
    got = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in lm.score(df).collect()}
    want, *_ = plain(rows)
    assert len(got) == len(set((w[0], w[2], round(w[5], 6)) for w in want))
    for i, held, n, known, total, base in want:
        r = got[i, n, round(base, 6)]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, known, total)
        assert r.base_score == pytest.approx(base) and r.score <= 1e-9
    held = [r for r in got.values() if r.held_out and r.n_tokens > 3]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)  # nearer to zero: pairs tell a lot here


def plain_scores(rows):
    """Deleted interpolation token by token: counts without the held-out tenth, expectation-maximisation by level, then all training counts."""
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in rows if i is not None}
    train = [(i, ["<s>", *words(t), "</s>"]) for i, t in rows if fold.get(i, 0) != 0]

    def counted(some):
        count, pairs = Counter(), Counter()
        for _, tokens in some:
            count.update(tokens)
            pairs.update(zip(tokens, tokens[1:], strict=False))
        return count, pairs, sum(count.values()) - count["<s>"]

    def parts(model, v, w):
        count, pairs, total = model
        return pairs[v, w] / count[v] if count[v] else 0.0, (count[w] / total if total else 0.0), math.frexp(count[v])[1]

    whole, without = counted(train), counted([x for x in train if fold[x[0]] != 1])
    p0 = 1 / (len(whole[0]) - 1 + 1)  # the start is no word
    seen = {}
    for i, tokens in train:
        if fold[i] == 1:
            for v, w in zip(tokens, tokens[1:], strict=False):
                p2, p1, level = parts(without, v, w)
                seen.setdefault(level, []).append((p2, p1, p0))
    lambdas = {}
    for level, p in seen.items():
        p, w = np.array(p), np.array([0.4, 0.4, 0.2])
        for _ in range(lm.ROUNDS):
            share = p * w
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        lambdas[level] = 0.9999 * w + 0.0001 / 3
    out = []
    for i, t in rows:
        tokens, total = ["<s>", *words(t), "</s>"], 0.0
        for v, w in zip(tokens, tokens[1:], strict=False):
            p2, p1, level = parts(whole, v, w)
            nearest = min(lambdas, key=lambda x: (abs(x - level), x))
            total += math.log10(float(lambdas[nearest] @ [p2, p1, p0]))
        out.append(total)
    return out


def test_scores_against_token_by_token_interpolation(spark, small_dir, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 30_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), want in zip(rows, plain_scores(rows), strict=True):
        assert got[i] == pytest.approx(want, rel=0.01)  # the operator's weights come from a histogram


def test_counts_beyond_32_bits():
    large = 3 << 32
    keys = np.array([5, 9], np.uint64)
    one = lm.A.pack(lm._deltas(keys), lm.A.narrow(np.array([large, 1])), lm.A.narrow(np.array([large, 0])))
    table = pa.table({"_to": [0, 0], "_from": [[0], [7]], "_blobs": pa.array([[one], [one]], pa.list_(pa.binary()))})
    out = lm._resolver(1, 8)(table).to_pylist()
    assert [x.tolist() for x in lm.A.unpack(out[0]["_blobs"][0])] == [[2 * large, 2], [2 * large, 0]]
    assert [x.tolist() for x in lm.A.unpack(out[1]["_blobs"][0])] == [[2 * large, 2]]
    assert (out[2]["_distinct"], out[2]["_tokens"], out[2]["_deleted"]) == (2, 2 * large + 2, 2 * large)


def test_weights_find_a_mixture():
    rng = np.random.default_rng(1)
    p2, p1 = rng.random(400), rng.random(400)
    n = 1000 * (0.7 * p2 + 0.2 * p1 + 0.1 * 0.01)
    found = lm.weights(np.full(400, 3 * lm.CELLS**2), n, p2, p1, 0.01, rounds=400)
    assert found.sum(axis=1) == pytest.approx(1) and found[3][0] > found[3][1]


def test_empty_and_no_training(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    row = lm.score(spark.createDataFrame([(None, "a b", "")], SCHEMA)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
