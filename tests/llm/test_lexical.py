"""Ranked search against scores of every document, one by one."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from vetloom.llm import lexical

DOCS, ITEMS = "doc_id long, text string, rank string, score string, lang string", "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    held = [(id_, Counter(t)) for id_, text, *_ in docs if (t := split(text))]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for id_, text, *_ in items:
        asked.setdefault(id_, []).extend(split(text))
    out = []
    for item, words in asked.items():
        found = []
        for id_, c in held:
            m = 25 + 75 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if score > 0:
                found.append((-score, id_ is None, id_ or 0, id_))
        out += [(item, r, id_, -s) for r, (s, _, _, id_) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, spread):
    rng = random.Random(seed)
    words = ["the", "The", "ñandú", "日本", "x1", "A", "b-c", "İ", *(f"w{i}" for i in range(60))]
    docs = [(rng.randrange(300) * spread, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.choice([1, 5, 40, 200]))), "a", "b", "c") for _ in range(250)]
    docs += [docs[0]] * 4 + [(None, docs[1][1], "a", "b", "c")] * 3 + [(5, None, "a", "b", "c"), (6, "", "a", "b", "c"), (7, " .,;", "a", "b", "c"), (-9, "the " * 30_000, "a", "b", "c")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30))), "d") for i in range(12)]
    items += [items[0], (3, "the w1 w1 w1", "d"), (None, "no item w3", "d"), (50, None, "d"), (51, "...", "d"), (52, "absent", "d")]
    return docs, items


@pytest.mark.parametrize("cells, blocks, spread", [(1 << 15, 1 << 24, 1), (16, 1 << 24, 1), (16, 300, 10**15)])
def test_rank(spark, monkeypatch, cells, blocks, spread):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", blocks)
    docs, items = corpus(cells, spread)
    got = lexical.rank(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 7)


def test_terms_of_texts_beside_each_other():
    words, first = lexical.terms(pa.array(["ab", "Cd e", None, "", ".", "ñ1_x", "z"]))
    assert words.to_pylist() == [b"ab", b"cd", b"e", "ñ1".encode(), b"x", b"z"]
    assert first.tolist() == [0, 1, 3, 3, 3, 3, 5, 6]


def test_empty(spark):
    docs, items = corpus(1, 1)
    none = spark.createDataFrame([], DOCS)
    assert lexical.rank(none, spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical.rank(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0
