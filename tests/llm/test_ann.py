import math
import random

import numpy as np
import pytest

from basketlens.llm import ann, queries

from .util import SF


def frame(spark, rows, schema="vec_id long, embedding array<float>"):
    return spark.createDataFrame(rows, schema).repartition(3)


def clustered(n, d=16, seed=0, centres=40):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return [(i, [float(np.float32(v)) for v in c[rng.integers(centres)] + 0.3 * rng.normal(size=d)]) for i in range(n)]


def search(spark, rows, k=5, n_lists=None, every=50):
    v = ann.valid_vectors(frame(spark, rows)).cache()
    q = v.where(f"vec_id % {every} = 0").selectExpr("vec_id query_id", "embedding")
    index = ann.build(v, n_lists)
    got = ann.search(index, q, k).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    return got, ann.exact(v, q, k).sort_values(["query_id", "rank"]).reset_index(drop=True)


def recall(got, want):
    have = set(zip(got.query_id, got.vec_id))
    return sum(x in have for x in zip(want.query_id, want.vec_id)) / len(want)


def test_recall_order_and_scores(spark):
    rows = clustered(2500)
    got, want = search(spark, rows, n_lists=25, every=20)
    assert recall(got, want) >= 0.9
    vec = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, g in got.groupby("query_id"):
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        for i, s in zip(g.vec_id, g.score):
            a, b = vec[q], vec[i]
            assert i != q and abs(s - a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) < 1e-12


def test_equal_vectors_tie_to_the_smaller_id_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rng = random.Random(3)
    hot = [1.0, 2.0, -1.0, 0.5]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    got, want = search(spark, rows, n_lists=8, every=30)
    assert got[["query_id", "rank", "vec_id"]].equals(want[["query_id", "rank", "vec_id"]].astype(got[["query_id", "rank", "vec_id"]].dtypes.to_dict()))
    first = got[got.query_id == 0]
    assert list(first.vec_id) == [3, 6, 9, 12, 15] and first.score.nunique() == 1


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (50, [2.0, 1.0]), (50, [2.0, 1.0])]
    v = ann.valid_vectors(frame(spark, [(i, e, "x") for i, e in rows], "vec_id long, embedding array<float>, score string"))
    assert sorted(r.vec_id for r in v.collect()) == [0, 1, 50, 50]
    got, _ = search(spark, rows)
    assert [(r.query_id, r["rank"], r.vec_id) for _, r in got.iterrows()] == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]


def test_repeated_rows_count_once(spark):
    rows = clustered(600)
    got, _ = search(spark, rows * 6, n_lists=6, every=20)
    once, _ = search(spark, rows, n_lists=6, every=20)
    want = ann.exact(ann.valid_vectors(frame(spark, rows)), ann.valid_vectors(frame(spark, rows)).where("vec_id % 20 = 0").selectExpr("vec_id query_id", "embedding"), 5)
    assert got.groupby("query_id").size().eq(5).all() and not got.duplicated(["query_id", "vec_id"]).any()
    assert recall(got, want) >= 0.9 and recall(once, want) >= 0.9


def test_few_vectors_beside_large_clusters_get_k_rows(spark):
    rng = np.random.default_rng(5)
    axes = np.eye(16)
    rows = [(i * 50 + 1, [float(v) for v in axes[i % 4] + 0.01 * rng.normal(size=16)]) for i in range(1200)]
    rows += [(i * 50, [float(v) for v in axes[4 + i] + 0.01 * rng.normal(size=16)]) for i in range(6)]           # alone
    rows += [(50_000 * (i + 2), [float(v) for v in axes[12] + 0.01 * rng.normal(size=16)]) for i in range(3)]    # a small group
    got, want = search(spark, rows, n_lists=12)
    assert len(want) == 9 * 5 and got.groupby("query_id").size().to_dict() == want.groupby("query_id").size().to_dict()
    group = {100_000, 150_000, 200_000}
    for i in group:
        assert set(got[(got.query_id == i) & (got["rank"] <= 2)].vec_id) == group - {i}


def test_widened_search_reaches_all_lists():
    g = ann.CentroidGraph(ann.unit(np.random.default_rng(4).normal(size=(60, 8))))
    x = ann.unit(np.random.default_rng(6).normal(size=(5, 8)))
    assert [len(g.probes(x, n)[0]) for n in (1, 8, 60, 64)] == [5, 40, 300, 300]


def test_empty_and_single(spark):
    assert ann.build(ann.valid_vectors(frame(spark, []))) is None
    got, _ = search(spark, [(0, [1.0, 2.0])])
    assert got.empty


def test_graph_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    c = ann.unit(rng.normal(size=(300, 8)))
    x = ann.unit(rng.normal(size=(200, 8)))
    node, dist = ann.CentroidGraph(c).walk(x, 48)
    best = (1 - x @ c.T).argsort(axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b[:48])) / 5 for a, b in zip(best, node)]) > 0.97
    assert (np.diff(dist, axis=1) >= 0).all()


def test_lists_are_balanced_and_boundary_vectors_are_replicated():
    rng = np.random.default_rng(2)
    x = ann.unit(np.concatenate([rng.normal(size=(3000, 8)) * 0.2 + 1, rng.normal(size=(500, 8))]))   # one dense region
    g = ann.CentroidGraph(ann.balanced_centroids(x, 30))
    rows, lists = g.replicas(x)
    assert set(rows) == set(range(len(x))) and len(rows) > 1.02 * len(x)
    own = np.bincount((1 - x @ g.centroids.T).argmin(axis=1), minlength=30)
    assert own.max() < 6 * own.mean()


def test_query_recall(spark):
    got = queries.QUERIES["op8_nearest_neighbours"](spark, SF).toPandas()
    v = ann.valid_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"))
    want = ann.exact(v, v.where("vec_id % 50 = 0").selectExpr("vec_id query_id", "embedding"), 5)
    assert len(got) == len(want) and recall(got, want) >= 0.9
