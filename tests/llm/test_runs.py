"""Periodic runs against all pairs of words, one lag after the other."""

import random

import numpy as np
import pytest

from vetloom.llm import runs

SCHEMA = "doc_id long, text string, runs string, note string"


def plain(words):
    """All runs by definition: for each lag the maximal stretches, a stretch counts for its smallest lag."""
    found = {}
    for lag in range(1, len(words) // runs.TIMES + 1):
        i, last = 0, len(words) - lag
        while i < last:
            j = i
            while j < last and words[j] == words[j + lag]:
                j += 1
            length = j - i + lag
            if j > i and length >= max(runs.LEAST, runs.TIMES * lag):
                found.setdefault((i, length), lag)
            i = j + 1
    return sorted((start, length, lag) for (start, length), lag in found.items())


def collapsed(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed):
    rng = random.Random(seed)
    out = ["", None, "one", " \t\n ", "a a a a a", "a a a a a a", "ab " * 50, "日本 ñ " * 9 + "x", "a b " * 3 + "a b c " * 4, "x " * 3000, ("a " * 7 + "b ") * 40, "q r s t " * 4]
    for _ in range(60):
        words = rng.choices("abcdefgh" if rng.random() < 0.5 else ["the", *map(str, range(50))], k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at, period = rng.randint(0, len(words)), rng.randint(1, 9)
            words[at:at] = (rng.choices("abcz", k=period) * 9)[: rng.randint(period, 7 * period)]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_runs(spark, seed):
    rows = [(i, t, "clash", "y") for i, t in enumerate(texts(seed))] + [(0, "a " * 9, "clash", "y"), (None, "a " * 9, "clash", "z")]
    got = runs.periodic_runs(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "note", "n_words", "runs", "collapsed_text"]
    want = []
    for id_, text, _, note in rows:
        words = (text or "").split()
        found = plain(words)
        want.append((str(id_), note, len(words), found, collapsed(words, found)))
    assert sorted((str(r.doc_id), r.note, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in got.collect()) == sorted(want)


def test_transform_and_differences_count_the_same():
    rng = np.random.default_rng(5)
    for n in (8, 100, 3000):
        code = np.minimum(rng.geometric(0.2, n), 12)
        lags = n // runs.TIMES
        places = [np.flatnonzero(code == c) for c in np.unique(code)]
        want = [int((code[:-lag] == code[lag:]).sum()) for lag in range(1, lags + 1)]
        assert runs._by_transform(places, n, lags).tolist() == want
        assert runs.lag_counts(code, np.array([0, n]))[0].tolist() == want


def test_long_text_with_a_run_and_of_one_word():
    rng = np.random.default_rng(6)
    code = np.concatenate([np.minimum(rng.zipf(1.3, 200_000), 5000), np.tile(rng.integers(6000, 7000, 1500), 5)[:6400]])
    first = np.array([0, len(code)])
    assert runs.runs_of(code, runs.lag_counts(code, first)[0])[-1] == (200_000, 6400, 1500)
    same = np.zeros(400_000, np.int64)
    assert runs.runs_of(same, runs.lag_counts(same, np.array([0, len(same)]))[0]) == [(0, len(same), 1)]


def test_many_texts_in_steps(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts(9))]
    got = runs.periodic_runs(spark.createDataFrame(rows, SCHEMA), step=500).collect()
    assert [tuple(map(tuple, r.runs)) for r in sorted(got, key=lambda r: r.doc_id)] == [tuple(plain((t or "").split())) for _, t, *_ in rows]


def test_empty(spark):
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
