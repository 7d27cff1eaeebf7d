"""The hash-prefix forest against brute force."""

import numpy as np
import pytest

from flowlake.llm import ann, queries


def brute(ids, vectors, query, k=10):
    far = np.sqrt(((vectors - vectors[query]) ** 2).sum(axis=1))
    order = sorted((f, i) for n, (f, i) in enumerate(zip(far, ids)) if n != query)
    return order[:k]


def load(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)


def test_query_is_near_exact_on_given_tables(spark):
    """At the registered parameters: all scores exact, and the recall."""
    for sf in ("sf0.01", "sf0.1"):
        ids, vectors = load(spark, sf)
        got = {}
        for r in queries.op4_hash_prefix_forest(spark, f"/root/testdata/{sf}").collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == {i for i in ids if i % 100 == 0}
        place, hits = {i: n for n, i in enumerate(ids)}, []
        for i, rows in got.items():
            rows.sort()
            assert [r[0] for r in rows] == list(range(1, 11)) and [r[2] for r in rows] == sorted(r[2] for r in rows)
            assert np.allclose([r[2] for r in rows], [np.linalg.norm(vectors[place[r[1]]] - vectors[place[i]]) for r in rows], rtol=1e-12)
            hits.append(len({r[1] for r in rows} & {x[1] for x in brute(ids, vectors, place[i])}))
        assert np.mean(hits) / 10 >= 0.9


def test_recall_on_a_large_table(spark):
    """20,480 vectors of little structure, at the registered parameters, and how few are compared."""
    vectors = np.random.default_rng(3).standard_normal((20_480, 32)) * np.linspace(1, 0.3, 32)
    forest, hits = ann.Forest(vectors), []
    wanted = int(ann.SHARE * len(vectors))
    asked = list(range(0, 20_480, 400))
    ranges = forest.ranges(vectors[asked])
    for n, q in enumerate(asked):
        found = forest.candidates(ranges[:, :, n], wanted)
        assert len(found) <= wanted
        hits.append(len(set(found.tolist()) & {x[1] for x in brute(range(len(vectors)), vectors, q)}))
    assert np.mean(hits) / 10 >= 0.9


def test_recall_with_shards(spark):
    ids, vectors = load(spark, "sf0.1")
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.nearest(rows, rows.where("vec_id % 20 = 0"), shard_rows=700).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[i] & {x[1] for x in brute(ids, vectors, n)}) for n, i in enumerate(ids) if i % 20 == 0]
    assert np.mean(hits) / 10 >= 0.9


def test_forest_ascends_by_prefix():
    vectors = np.random.default_rng(0).standard_normal((500, 16))
    forest = ann.Forest(vectors, trees=8, letters=3)
    ranges = forest.ranges(vectors[7:8])[:, :, 0]
    assert 7 in forest.candidates(ranges, 1)
    sizes = [len(forest.candidates(ranges[:k], 500)) for k in (1, 2, 3)]
    assert sizes == sorted(sizes) and sizes[0] >= 1 and sizes[2] < 500
    few = forest.candidates(ranges, 20)
    assert len(few) <= max(20, sizes[0])


def test_odd_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [1.0, 0.0], "b"), (3, [0.0, 1.0], "c"), (3, [0.0, 1.0], "c"), (4, [0.0, 0.0], "d")]
    rows += [(5, None, "e"), (6, [nan, 1.0], "f"), (7, [inf, 1.0], "g"), (8, [None, 1.0], "h"), (200, None, "i"), (None, [1.0, 1.0], "j"), (9, [1.0, 2.0, 3.0], "k")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string")
    got = ann.nearest(frame, frame.where("vec_id % 100 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(100, 1, 1), (100, 2, 2), (100, 3, 3), (100, 4, 3)]
    assert got[2].score == pytest.approx(2**0.5)
    assert ann.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_hot_vector(spark):
    frame = spark.range(5000).selectExpr("id as vec_id", "if(id % 2 = 0, array(1f, 2f), array(float(id), 1f)) as embedding")
    got = ann.nearest(frame, frame.where("vec_id = 200")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(0, 20, 2))
