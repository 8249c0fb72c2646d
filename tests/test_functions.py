"""Expressions against the plain model and worked examples."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tests import model
from vetloom.functions import confidence, similarity, text
from vetloom.functions import identifiers as ids

GOOD = ["11LYWGN1982UXZM", "27ABCDE1234F1Z0", "27XYZAB5678C1Z6"]


def of(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def noisy_gstins(n=400):
    rng = random.Random(4)
    out = []
    for _ in range(n):
        body = f"{rng.randint(1, 37):02d}" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=5)) + f"{rng.randint(0, 9999):04d}" + rng.choice("ABCDOQZ") + rng.choice(model.BASE36[1:]) + "Z"
        word = list(body + model.check_character(body))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(15)
            word[i] = rng.choice({"0": "OQD", "O": "0Q", "1": "IL", "5": "S", "8": "B", "2": "Z", "7": "ZT", "6": "G", "4": "A", "Z": "27S", "Q": "O0", "S": "5"}.get(word[i], word[i]))
        word = "".join(word)
        out.append(rng.choice([word, word, word[1:], word[:-1], word + "X"]))
    return out


def test_checksum(spark):
    assert [model.check_character(g) for g in GOOD] == ["M", "0", "6"]
    assert of(spark, [*GOOD, "27ABCDE1234F1Z5", "short", None, "27ABCDE1234F1Zé"], ids.has_checksum) == [True] * 3 + [False] * 4


def test_gstin_repairs_match_the_model(spark):
    words = [*noisy_gstins(), "I1LYWGNI98ZUX2M", "I1LYWGNI98ZUXAM", "", "ZZZ"]
    assert of(spark, words, ids.repair_gstin) == [model.repair_gstin(w) for w in words]
    assert of(spark, ["I1LYWGNI98ZUX2M", "I1LYWGNI98ZUXAM"], ids.repair_gstin) == ["11LYWGN1982UXZM", None]


def test_variants_match_the_model(spark):
    words = [w for w in noisy_gstins(120) if len(w) == 15]
    assert of(spark, words, ids.variants) == [list(model.variants(w)) for w in words]


def test_with_checksum(spark):
    assert of(spark, ["27ABCDE1234F1Z5", "27ABCDE1234F1Z", "27ABCDE1234F", "27abcde1234f1z5", None], ids.with_checksum) == ["27ABCDE1234F1Z0"] * 2 + [None] * 3


def test_pan_and_ifsc(spark):
    assert of(spark, ["A8CDE12E4F", "48CDEI2O4F", "ABCDE12345", "ABCDE1234", None], ids.repair_pan) == [None, "ABCDE1204F", "ABCDE1234S", None, None]
    assert of(spark, ["HDFCO00I234", "5BINU0O1234", "HDFCX001234", "HDFC000123"], ids.repair_ifsc) == ["HDFC000I234", "SBIN0001234", None, None]


def test_confidence(spark):
    row = spark.range(1).select(*[confidence.exact(c) for c in (0.5, 0.85, 0.9, 1.0)], *[confidence.repaired(c) for c in (0.5, 0.97, 1.0)]).first()
    assert tuple(row) == (0.9, 0.9279999999999999, 0.948, 0.988, 0.91, 0.91, 0.925)


def test_text(spark):
    assert of(spark, [" \tgsOilbz \n", None], text.ocr_normal) == ["6501182", ""]
    assert of(spark, ["on 31-12/2020, 1/1/2020", "none"], text.find_date) == ["31-12/2020", None]
    assert of(spark, ["a b c", "A  B", "c", ""], lambda v: text.relaxed_match(F.lit("A b C"), v)) == [True, False, False, False]
    assert of(spark, ["a:b: c ", ":", "no"], lambda v: text.after(v, ":")) == ["b: c", "", "no"]
    assert of(spark, ["abc", "ab", ""], lambda v: text.windows(v, 2, F.length(v) - 1)) == [["ab", "bc"], ["ab"], []]
    assert of(spark, ["b,a,c"], lambda v: text.first(F.split(v, ","), lambda x: x < "b")) == ["a"]


def test_similarity(spark):
    rng = random.Random(7)
    words = ["NAMF", "1FSC", "AC", "AN", "PAM", "", "GSTlN", "日本語", "É"] + ["".join(rng.choices("NAMEGSTIPOF", k=rng.randint(1, 8))) for _ in range(200)]
    pairs = [(w, k) for w in words for k in ("NAME", "IFSC", "A/C", "PAN", "GSTIN", "日本", "")] + [("".join(rng.choices("ABC ", k=rng.randint(0, 12))), "".join(rng.choices("ABC ", k=rng.randint(0, 12)))) for _ in range(800)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for r in frame.select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("ratio"), similarity.similar(F.col("a"), F.col("b"), 0.75).alias("near")).collect():
        want = difflib.SequenceMatcher(None, r.a, r.b).ratio()
        assert (r.ratio, r.near) == (want, want >= 0.75)
    near = similarity.near_keywords(["NAME", "PAN"])
    rows = spark.createDataFrame([(["Your Namf: x", None, "PAM"],)], "lines array<string>")
    assert rows.select(near(F.col("lines")).alias("x")).first().x == [["NAME"], [], []]
    snap = similarity.closest(["Regular", "Composition"])
    assert of(spark, ["Regulor", "composition", "zzz", None], snap) == ["Regular", "Composition", None, None]


@pytest.mark.parametrize("cutoff", [0.6, 0.75, 0.9, 1.0])
def test_similar_pairs(spark, cutoff):
    rng = random.Random(cutoff)
    words = lambda n: ["".join(rng.choices("ABCD é", k=rng.randint(0, 9))) for _ in range(n)]
    one, two = [*words(150), None, "same"], [*words(150), None, "same"]
    got = similarity.similar_pairs(spark.createDataFrame([(w, 1) for w in one + one[:9]], "word string, ratio int"), spark.createDataFrame([(w,) for w in two], "other string"), cutoff)
    want = {(a, b, x) for a in one if a for b in two if b and (x := difflib.SequenceMatcher(None, a, b).ratio()) >= cutoff}
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("few", [0, 1000])
def test_similar_pairs_of_few_and_many_words(spark, few, monkeypatch):
    rng = random.Random(few)
    kept = similarity.checkpointed
    plans = []
    monkeypatch.setattr(similarity, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    keys = ["NAME", "AAAA", "ÄÖ\u0394\u03b4", "a", "!A", "REGISTRATION", "\U0001f600\U0001f601B"]
    words = ["".join(rng.choices([*rng.choice(keys), "A", "a", "\u0394"], k=rng.randint(1, 9))) for _ in range(300)] + keys
    keys += [f"NAMED{i}" for i in range(9)]
    got = similarity.similar_pairs(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(k,) for k in keys], "other string"), 0.7, few)
    assert sorted(map(tuple, got.collect())) == sorted({(w, k, x) for w in words for k in keys if (x := difflib.SequenceMatcher(None, w, k, autojunk=False).ratio()) >= 0.7})
    # a word is tried with few others without substrings that move; the loop runs for each pair once, after it is dealt out
    assert ("BroadcastNestedLoopJoin" if few else "SortMergeJoin") in plans[-1] and ("Generate explode" in plans[-1]) == (not few) and "instr(" not in plans[-1]


@pytest.mark.parametrize("empty", ["", None])
def test_empty_text(spark, empty):
    assert of(spark, [empty], lambda v: text.find(v, "[A-Z]")) == [None]
    assert of(spark, [empty], text.normal) == [""]


def test_near_keywords_of_many_pages(spark):
    rng = random.Random(11)
    keys = ["NAME", "A/C", "IFSC", "GSTIN", "GST", "ACCOUNT", "REGISTRATION"]
    word = lambda: "".join(rng.choice([rng.choice(keys), *rng.choices("NAMEGSTIC09é", k=3)]) for _ in range(rng.randint(0, 3)))
    pages = [[" ".join(word() for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 5))] for _ in range(300)]
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else p) for i, p in enumerate(pages)], "i int, lines array<string>").repartition(2)
    looked = rows.select("i", similarity.near_keywords(keys)(F.col("lines")).alias("x"), F.transform("lines", similarity.words).alias("w"))
    assert "ArrowEvalPython" in looked._jdf.queryExecution().executedPlan().toString()  # by batch, so that a word is compared once
    for r in looked.collect():
        assert (r.x is None) == (r.i % 7 == 0)
        for found, parts in zip(r.x or [], r.w or [], strict=True):
            assert found == sorted({k for k in keys for w in parts if difflib.SequenceMatcher(None, w, k).ratio() >= 0.75})
