"""Substring dedup against windows in a dictionary."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from vetloom.llm import exchange, substring_dedup

SCHEMA = "doc_id long, text string, n_words string, kept_text string, note string"


def plain(rows, window):
    least = {}
    words = [(i, (t or "").split()) for i, t, *_ in rows]
    for i, w in words:
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            least[key] = min(least.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - window + 1):
            if least[tuple(w[a : a + window])] < (float("inf") if i is None else i):
                gone.update(range(a, a + window))
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["ñandú", "日本"]
    passage = rng.choices(vocabulary, k=30)
    rows = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        if i % 7 == 0:
            w += ["the"] * 25  # all windows alike
        rows.append((rng.randrange(10_000), rng.choice([" ", "\n", " \t "]).join(w), "a", "b", "c"))
    rows += [(rows[0][0], rows[0][1], "a", "b", "again"), (None, rows[0][1], "a", "b", "no id"), (7, None, "a", "b", "c"), (8, "  ", "a", "b", "c"), (9, "one two", "a", "b", "c"), (20_000, " ".join(passage), "a", "b", "c")]
    return rows


@pytest.mark.parametrize("direct", [1 << 14, 1])  # one hop and two
@pytest.mark.parametrize("heavy", [4, 1 << 16])
@pytest.mark.parametrize("window", [5, 13])
def test_windows(spark, monkeypatch, heavy, window, direct):
    monkeypatch.setattr(exchange, "DIRECT", direct)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 4000)
    rows = corpus(window)
    done = substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), window=window, heavy=heavy)
    assert done.columns == ["doc_id", "note", "n_words", "n_removed", "kept_text"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in done.collect()) == plain(rows, window)


def test_reports_of_the_counting_pass_are_bounded(monkeypatch):
    """At a pretended 100 TB, where the threshold of a part is as low as it gets."""
    monkeypatch.setattr(substring_dedup, "COUNT_PART", 16_000)
    monkeypatch.setattr(substring_dedup, "HELD", 3000)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 8000)
    heavy_list = 1000
    rng = random.Random(1)
    texts = [" ".join([*rng.choices("abcdefghijklmnopqrstuvwxyz", k=70), *"xyz" * 10]) for _ in range(800)]
    most = 100 << 40
    seen = list(substring_dedup._counter(3, most / heavy_list / 2 / most)(iter([pa.record_batch({"t": pa.array(texts)})])))
    assert len(seen) == 5
    words = [t.split() for t in texts]
    count = Counter(tuple(w[a : a + 3]) for w in words for a in range(len(w) - 2))
    for batch in seen[:-1]:
        assert batch.num_rows <= 2 * heavy_list and min(batch["_n"].to_pylist()) >= 8  # of 2 * 16,000 / 1000 / 4
    top = sorted(count.values())[-3:]
    found = Counter()
    for batch in seen:
        found.update(dict(zip(batch["_run"].to_pylist(), batch["_n"].to_pylist(), strict=True)))
    assert sorted(found.values())[-3:] == top


def test_relay_regroups_every_blob():
    rng = random.Random(2)
    sent = {(s, r): f"{s}-{r}".encode() for s in range(7) for r in range(20) if rng.random() < 0.6}
    for width in (1, 5):
        tables = [exchange.sent(s, [r for r in range(20) if (s, r) in sent], [sent[s, r] for r in range(20) if (s, r) in sent], width) for s in range(7)]
        rows = pa.concat_tables(tables)
        assert all(len({r // width for r in x["_to"]}) == 1 for x in rows.to_pylist())
        got = exchange._relay(rows).to_pylist()
        assert {(s, x["_to"]): b for x in got for s, b in zip(x["_from"], x["_blobs"], strict=True)} == sent and len(got) == 20


def test_empty(spark):
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("chunk", [2000, 8 << 20])
def test_cut_text_keeps_the_layout(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    rows = [(i, f"\n {t}\t\n" if t and i and i % 2 else t, *rest) for i, t, *rest in corpus(3)]
    done = substring_dedup.dedup_substrings(spark.createDataFrame([(i, t, t) for i, t, *_ in rows], "doc_id long, text string, before string"), cut=True).collect()
    assert len(done) == len(rows) and {r.n_removed > 0 for r in done} == {True, False}
    for r in done:
        if r.n_removed == 0:
            assert r.cut_text == r.before
        else:
            assert " ".join(r.cut_text.split()) == r.kept_text and len(r.cut_text) < len(r.before)


def test_cut_out():
    text = "  one\n\ntwo  ñandú\tfour \n".encode()
    for gone, want in (((0,), "  two  ñandú\tfour \n"), ((1, 2), "  one\n\nfour \n"), ((3,), "  one\n\ntwo  ñandú\t"), ((0, 1, 2, 3), "  "), ((0, 2), "  two  four \n")):
        assert substring_dedup.cut_out(text, np.isin(np.arange(4), gone)).decode() == want


def test_stage_leaves_clean_texts_alone(spark, small_dir):
    text = "A  first\nline.\n\n\tAnd\ta second.\n"
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, "s", len(text)), (2, f"x\n{passage}\n", "s", 0), (3, f"y\n\n{passage}\n\nz\tend\n", "s", 0), (4, None, "s", None)]
    got = corpus_pipeline.passages(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), small_dir)
    assert got.columns == ["doc_id", "text", "source", "n_chars"]
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: (text, len(text)), 2: (rows[1][1], len(rows[1][1])), 3: ("y\n\nz\tend\n", 9), 4: (None, None)}
