"""SimHash against all pairs of a small table."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from vetloom.llm import graph, simhash

SCHEMA = "doc_id long, text string, fingerprint string"


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    n = len(fps)
    i, j = np.triu_indices(n, 1)
    keys = np.array(fps, np.uint64)
    ok = np.bitwise_count(keys[i] ^ keys[j]) <= 4
    return graph.local_components(n, i[ok], j[ok])


def test_fingerprints():
    texts = ["a B c d e f g", "", None, "one", "Two words", " a\tb  c\nd e", "x " * 50, "ÄB äb ñ"]
    assert simhash.text_fingerprints(pa.array(texts), 4).tolist() == [slow_fingerprint(t) for t in texts]


def test_dense_tries_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    for _ in range(8):
        flips = np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
        keys = np.unique(np.concatenate([keys, keys[:60] ^ flips, keys[:60] ^ np.roll(flips, 1) ^ flips]))
    fps = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long").repartition(3)
    at = {k: i for i, k in enumerate(keys.view(np.int64).tolist())}
    for chunk, per_lead in ((4, 1 << 20), (4096, 1 << 20), (4, 0), (2, 1e-9)):  # the smaller chunks cut every value of the leading bits; 0 takes more blocks
        edges = simhash.trie_edges(fps, 4, chunk=chunk, per_lead=per_lead).collect()
        got = graph.local_components(len(keys), np.array([at[e.u] for e in edges]), np.array([at[e.v] for e in edges]))
        assert got.tolist() == slow_components(keys.tolist()).tolist()


def test_orders_of_bits(spark):
    rng = np.random.default_rng(5)
    fps = [0, -1, *rng.integers(-(1 << 63), 1 << 63, 20).tolist()]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for shared, n, lead in ((1, 5, 12), (2, 15, 20), (3, 35, 27), (4, 70, 32)):
        all_ = simhash.orders(4, shared)
        assert len(all_) == n and min(o.lead for o in all_) == lead
        for order in all_[::7]:
            keys = np.array([r.k for r in df.select(order.key().alias("k")).collect()], np.int64).view(np.uint64)
            assert order.back(keys).tolist() == fps
    assert [simhash.shared_blocks(x, 4) for x in (0, 1 << 26, 1 << 27, 1 << 35)] == [1, 1, 2, 3]


def test_pairs_of_chunks_are_pruned_before_keys_move(spark):
    rng = np.random.default_rng(6)
    keys = np.sort(np.unique(rng.integers(0, 1 << 52, 4000, dtype=np.uint64)))  # one value of the twelve leading bits
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), np.int32)), pa.array((keys ^ simhash._SIGN).view(np.int64))], ["b", "k"])
    rows = next(simhash._chunks(simhash.orders(4, 1), 8)(iter([batch]))).to_pylist()
    chunks = spark.createDataFrame([tuple(r.values()) for r in rows], "b int, lead long, lo long, hi long, common int, part long, keys binary")
    lo = {r["part"]: r["lo"] for r in rows}
    got = {(lo[r.part], lo[r.part2]) for r in simhash.chunk_pairs(chunks, 4).collect()}
    n = len(rows)
    assert n == 500 and len(got) < n * (n - 1) / 2 * 0.85
    members = {r["lo"]: np.frombuffer(r["keys"], np.uint64) for r in rows}
    for a in list(members)[::25]:
        for b in members:
            near = (np.bitwise_count(members[a][:, None] ^ members[b][None, :]) <= 4).any()
            assert not near or a >= b or (a, b) in got


def slow_wide(texts, words=5):
    """Components of all pairs of wide fingerprints within the budget."""
    fps = simhash.wide_fingerprints(pa.array(texts, pa.string()), words)
    i, j = np.triu_indices(len(fps), 1)
    ok = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= simhash.WIDE_BUDGET
    return graph.local_components(len(fps), i[ok], j[ok])


def test_wide_fingerprints_of_each_text_alone():
    texts = ["a b c d e f g " * 30, "", None, "one", "Two words", "x y z " * 9000]
    together = simhash.wide_fingerprints(pa.array(texts), 5)
    for i, text in enumerate(texts):
        assert (simhash.wide_fingerprints(pa.array([text], pa.string()), 5)[0] == together[i]).all()
    assert not together[1].any() and (together[1] == together[2]).all() and together[3].any()


def edited(words, share, rng):
    out = list(words)
    for at in rng.choice(len(out), int(share * len(out)), replace=False):
        out[at] = f"new{rng.integers(1 << 40)}"
    return out


def test_similar_texts_are_found_and_others_are_not(spark):
    rng = np.random.default_rng(8)
    rows, groups = [], []
    for g in range(150):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for text in (base, edited(base, 0.01, rng), [*base, "the", "end"]):
            rows.append((len(rows), " ".join(text), "clash"))
            groups.append(g)
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=5, budget=simhash.WIDE_BUDGET, bits=simhash.WIDE).collect()}
    assert len(got) == len(rows) and len(got[0].fingerprint) == 64
    roots = {g: {got[i].component_id for i in range(len(rows)) if groups[i] == g} for g in range(150)}
    assert len(set.union(*roots.values())) >= 150  # no two groups are joined
    assert sum(len(r) == 1 for r in roots.values()) >= 147


def test_wide_tries_match_all_pairs(spark):
    """A dense group of fingerprints, some with equal keys, cut into small chunks."""
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    fps = np.repeat(centre, 60, axis=0)
    for row in fps:
        for bit in rng.choice(256, int(rng.integers(0, 40)), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    fps = np.unique(fps, axis=0)
    df = spark.createDataFrame([(i, f.tobytes()) for i, f in enumerate(fps)], "node long, fp binary").repartition(3)
    i, j = np.triu_indices(len(fps), 1)
    ok = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= simhash.WIDE_BUDGET
    want = graph.local_components(len(fps), i[ok], j[ok])
    for chunk in (5, 4096):
        edges = simhash.wide_edges(df, chunk=chunk).collect()
        got = graph.local_components(len(fps), np.array([e.u for e in edges]), np.array([e.v for e in edges]))
        assert all(want[a] == want[b] for a, b in enumerate(got)) and len(set(got.tolist())) <= len(set(want.tolist())) + 3


def test_query_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base, base.replace("w7 ", "v7 "), base + " end", "other text of five words", "", None, " \n", "short", "SHORT"]
    rows = [(3 * i + 1, t, "clash") for i, t in enumerate(texts)] + [(1, base, "again"), (None, "short", "no id")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    fps = {r[0]: slow_fingerprint(r[1]) for r in rows}
    label = slow_components([slow_fingerprint(r[1]) for r in rows])
    for row in got:
        assert row.fingerprint == f"{fps[row.doc_id]:016x}"
        me = [r[0] for r in rows].index(row.doc_id)
        assert row.component_id == min(r[0] for r, x in zip(rows, label, strict=True) if x == label[me] and r[0] is not None)
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA), words=4, budget=4, bits=64)
    assert kept.columns == ["doc_id", "text", "fingerprint"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted({r.component_id for r in got} | {-1})


def test_keep_one_of_repeated_ids(spark):
    """Against components of all pairs of rows: rows of one id in different components stay, each for its own."""
    rng = random.Random(4)
    base = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(12)]
    rows = [(i % 5, t, f"n{i}") for i, t in enumerate(base)] + [(2, base[0], "copy"), (0, base[0], "again"), (7, base[3], "later"), (-1, base[4], "first"), (None, base[4], "no id"), (9, base[11] + " tail", "near")]
    fps = [int.from_bytes(simhash.wide_fingerprints(pa.array([t]), 5, simhash.WIDE).tobytes(), "little") for _, t, _ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.WIDE_BUDGET and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "fingerprint"]
    kept = {r.fingerprint for r in got.collect()}
    assert len(kept) == got.count() and "no id" in kept
    for component in set(label):
        mine = [r for r, x in zip(rows, label, strict=True) if x == component and r[0] is not None]
        stays = [r for r in mine if r[2] in kept]
        assert len(stays) == 1 and stays[0][0] == min(r[0] for r in mine)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
