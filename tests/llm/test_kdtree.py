"""KD-tree search against all inner products."""

import math

import numpy as np
import pyarrow as pa
import pytest

from vetloom.llm import kdtree

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k, every, kind=np.float32):
    whole = lambda x: math.floor(256 * x) if abs(x) < 2**60 else 256 * int(x)
    fine = [(i, [whole(float(kind(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fine if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_tree_boxes_hold_their_vectors():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-200, 200, (1000, 5))
    tree = kdtree.build(np.arange(1000), vectors, leaf=16)
    for a, b, low, high in zip(tree.first, tree.last, tree.low, tree.high, strict=True):
        assert (tree.vectors[a:b].min(axis=0) == low).all() and (tree.vectors[a:b].max(axis=0) == high).all()
    assert (vectors[tree.ids] == tree.vectors).all()


def test_all_products(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (4, 8))
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(0, 0.2, 8)], "", "") for i in range(300)]
    rows += [(300 + i, rows[0][1], "", "") for i in range(40)]  # ties
    rows += [(500, None, "", ""), (501, [1.0, None], "", ""), (502, [float("nan")] * 8, "", ""), (503, [float("inf")] * 8, "", ""), (None, [1.0] * 8, "", ""), (510, [9.0, -9.0], "", ""), (7, [5.0] * 8, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for shard, tree in ((50, 2), (10_000, 64)):
        monkeypatch.setattr(kdtree, "PER_TREE", tree)
        monkeypatch.setattr(kdtree, "PER_GROUP", 3)
        got = kdtree.top_k(df, query_every=10, per_shard=shard).collect()
        assert sorted(map(tuple, got)) == brute(rows, 5, 10)


def test_regions_are_balanced_and_hold_every_vector():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-500, 500, (3000, 4))
    split = kdtree.regions(vectors[:500], 7)
    n = np.bincount(split.of(vectors), minlength=7)
    assert len(n) == 7 and n.min() > 200
    same = kdtree.regions(np.ones((50, 4), np.int64), 7)
    assert (same.of(vectors) == 0).all()


def test_far_shards_are_not_asked():
    queries = np.array([[10, 0], [0, 10]])
    asked = kdtree.A.pack(np.array([1, 2]), queries, np.array([50, 200]), np.zeros(2, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    boxes = kdtree.A.pack(np.array([0, 1, 2]), np.array([0, 0, 0, 0, -9, -9]), np.array([9, 9, 4, 4, 9, 25]))
    batch = pa.RecordBatch.from_pylist([{"_part": 0, "_asked": asked, "_boxes": boxes}])
    rows = next(kdtree._asker(2)(iter([batch]))).to_pylist()
    assert [(r["_part"], kdtree.A.unpack(r["_blob"])[0].tolist()) for r in rows] == [(2, [1, 2])]  # shard 1 reaches 40 of 50 and of 200


def test_large_components(spark):
    one = 800_000_000 / 256
    rows = [(0, [one] + [0.0] * 63, "", ""), (1, [one] + [0.0] * 63, "", ""), (2, [-one] + [1.0] * 63, "", ""), (10, [1.0] * 64, "", "")]
    got = kdtree.top_k(spark.createDataFrame(rows, SCHEMA), query_every=10, per_shard=2).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 10)
    with pytest.raises(Exception, match="64 bits"):  # the best score is far over 64 bits
        kdtree.top_k(spark.createDataFrame([(0, [2.0**40], "", ""), (1, [2.0**40], "", "")], SCHEMA), query_every=10).collect()
    with pytest.raises(Exception, match="64 bits"):  # there is no better one than that far below
        kdtree.top_k(spark.createDataFrame([(0, [2.0**40], "", ""), (1, [-(2.0**40)], "", ""), (2, [1.0], "", "")], SCHEMA), query_every=10).collect()


@pytest.mark.parametrize("shard", [3, 1000])
def test_components_of_any_size(spark, shard):
    """An error only where a score beyond 64 bits is returned."""
    rng = np.random.default_rng(8)
    rows = [(i, (-rng.integers(0, 9, 3)).astype(float).tolist(), "", "") for i in range(40)] + [(200 + i, [0.0] * 3, "", "") for i in range(1, 6)]
    # large components meet those of other rows as nothing or with the other sign
    rows += [(101, [1e17, 0.0, 0.0], "", ""), (102, [1e300, -1.0, 0.0], "", ""), (103, [0.0, 0.0, 1.7e308], "", ""), (110, [0.0, 2.0**80, -5.0], "", ""), (110, [0.0, 2.0**81, 0.0], "", "")]
    got = kdtree.top_k(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), query_every=10, per_shard=shard).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 10, float)
    assert {110, 20, 30} <= {r.query_id for r in got} and not {101, 102, 103} & {r.vec_id for r in got}


def test_trees_are_copied_by_demand(spark, monkeypatch):
    """Queries in one corner ask few shards: no tree is read where none comes."""
    rng = np.random.default_rng(9)
    far = [(i, [float(x) for x in rng.normal(0, 1, 4)], "", "") for i in range(1, 400) if i % 10]
    near = [(i * 10, [50.0 + float(x) for x in rng.normal(0, 1, 4)], "", "") for i in range(1, 40)]
    read = []
    real = kdtree.frames.stored

    def stored(df, path=None):
        done = real(df, path)
        read.append(done)
        return done

    monkeypatch.setattr(kdtree.frames, "stored", stored)
    got = kdtree.top_k(spark.createDataFrame(far + near, SCHEMA), query_every=10, per_shard=20)
    assert sorted(map(tuple, got.collect())) == brute(far + near, 5, 10)
    shards, asked = (r for r in read if "_tree" in r.columns or "_from" in r.columns)
    assert asked.select("_part").distinct().count() < shards.count() / 2


def test_few_and_none(spark):
    assert kdtree.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(0, [1.0], "", ""), (1, [2.0], "", "")]
    assert [tuple(r) for r in kdtree.top_k(spark.createDataFrame(few, SCHEMA)).collect()] == [(0, 1, 1, 256 * 512)]
