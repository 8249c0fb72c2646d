"""The ordinal model: recovery of known weights, held-out ratings, and the rules of the contract."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vetloom.llm import quality

SCHEMA = "doc_id long, text string, expected_grade string"


def test_features_are_those_of_each_text_alone():
    texts = ["The the cat CAT!! dog&&& 12", "", None, "É É\tx", "!! !!"]
    text, place, value = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        _, p, v = quality.features(pa.array([t], pa.string()))
        mine = text == i
        a, b = (np.array(sorted(zip(*x, strict=True))).reshape(-1, 2) for x in ((p, v), (place[mine], value[mine])))
        assert a == pytest.approx(b)


def plain_features(text):
    """The features by their description, in plain Python: lower-cased words, beginnings, endings, and shares."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    distinct, shares = set(), Counter()
    was = None
    for w in words:
        raw = w.encode()
        stop = max((i + 1 for i, b in enumerate(raw) if b >= 128 or chr(b).isalnum()), default=0)
        core, tail = raw[:stop], raw[stop:]
        distinct |= {("word", core.lower()), ("start", core.lower()[: quality.PREFIX])}
        letters = [b for b in core if b >= 128 or chr(b).isalnum()]
        if tail:
            distinct.add(("tail", tail))
            shares["tail", tail] += 1
        shares["capitals"] += len(letters) > 1 and all(b >= 128 or chr(b).isupper() for b in letters) and chr(core[0]).isupper() and core[0] < 128
        shares["again"] += raw == was
        was = raw
    return len(distinct), sorted(n / len(words) * 4 for n in shares.values() if n)


def test_features_against_plain_words():
    rng = random.Random(4)
    pieces = ["The", "the", "CAT", "cat!!", "É", "ÉT", "A", "A1", "--", "x.y,", "NO!", "no&&&", "\x85z", "日本"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) + rng.choice(["", "\n", " \t"]) for _ in range(300)]
    text, _, value = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        n, shares = plain_features(t)
        mine = value[text == i]
        ones = int((mine == 1.0).sum()) - sum(x == 1.0 for x in shares)
        assert ones == n, t
        assert sorted([*mine[mine != 1.0], *[1.0] * sum(x == 1.0 for x in shares)]) == pytest.approx(shares), t


def test_sample_is_bounded_and_never_empty(spark):
    docs = spark.createDataFrame([(i, ("good " if i % 2 else "bad ") * (i % 7 + 1), "x") for i in range(200)] + [(5, "good", "x")] * 50, SCHEMA)
    ratings = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    for sample, most in ((20, 10_000), (200, 60), (1, 1)):
        model = quality.fit(docs, ratings, quality.graded(ratings), sample=sample, most=most)
        got = quality.score(docs, model).collect()
        assert len(got) == 250
        if most > 1:
            assert all((r.tail_probability > 0.5) == r.text.startswith("good") for r in got)


def test_thresholds_are_ordered_and_grades_follow():
    rng = np.random.default_rng(0)
    n = 600
    text = np.repeat(np.arange(n), 3)
    place = rng.integers(0, 30, 3 * n)
    truth = np.linspace(-3, 3, 30)
    score = np.bincount(text, truth[place], n)
    grade = np.digitize(score + rng.logistic(0, 0.3, n), [-2, 2])
    model = quality.fit_arrays(text, place, np.ones(3 * n), grade)
    assert model.thresholds[0] < model.thresholds[1]
    assert np.corrcoef(model.weights[:30], truth)[0, 1] > 0.95
    above = model.grades(np.bincount(text, model.weights[place], n))
    assert (above[:, 0] >= above[:, 1]).all() and np.mean(np.rint(above.sum(axis=1)) == grade) > 0.85


def test_held_out_ratings(spark):
    folder = "/root/testdata/sf0.1"  # 4,000 ratings; the smaller tables have fewer than a model needs
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.filter("doc_id % 4 <> 0"), quality.graded(labels))
    got = quality.score(docs.select("doc_id", "text"), model).join(labels.filter("doc_id % 4 = 0").withColumn("grade", quality.graded(labels)), "doc_id").collect()
    clean = [r.tail_probability >= quality.KEEP for r in got if r.grade == 2]
    other = [r.tail_probability >= quality.KEEP for r in got if r.grade < 2]
    assert np.mean(clean) > 0.97 and np.mean(other) < 0.2


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "clash"), (2, "", "x"), (3, "word " * 100_000, "x"), (None, "no id", "x"), (3, "again", "x")], SCHEMA)
    ratings = spark.createDataFrame([(2, 1, 0), (3, None, None), (None, 1, 1), (3, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, ratings, quality.graded(ratings))).collect()
    assert len(got) == 5 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    none = ratings.filter(F.lit(False))
    got = quality.score(docs, quality.fit(docs, none, quality.graded(none))).collect()
    assert all(r.expected_grade == 0 for r in got)
    assert quality.score(docs.filter("false"), quality.fit(docs, ratings, quality.graded(ratings))).count() == 0
