"""Neighbours of every item against brute force."""

import numpy as np
import pytest

from basketlens.operators import neighbours as nb
from basketlens.sources.shared import materialize


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, n):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = np.round(x @ x.T, 12)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-near[a, b], ids[b]))[:n]
        out[i] = [ids[b] for b in order]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append(r.neighbour)
        assert r["rank"] == len(out[r.item_id])
    return out


def clustered(count, seed=5, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, dim))
    x = centres[rng.integers(0, 60, count)] + 0.6 * rng.standard_normal((count, dim))
    return [(i * 3 + 1, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]


def test_few_vectors_are_exact(spark):
    rows = clustered(300)
    assert lists(nb.all_neighbours(frame(spark, rows), n=7)) == brute(rows, 7)


@pytest.mark.parametrize("extra", [0, 700])
def test_bands_reach_the_recall(spark, extra):
    """Many blocks; with extra rows in one dense direction."""
    rows = clustered(1500)
    rng = np.random.default_rng(9)
    rows += [(100_000 + i, [float(c) for c in v]) for i, v in enumerate((1 + 0.05 * rng.standard_normal((extra, 16))).astype(np.float32))]
    got, true = lists(nb.all_neighbours(frame(spark, rows), n=10, block=64, step=4)), brute(rows, 10)
    assert got.keys() == true.keys() and all(len(v) == 10 for v in got.values())
    assert sum(len(set(got[i]) & set(true[i])) for i in true) / (10 * len(true)) >= 0.9


def test_bands_are_added_until_the_target(spark):
    rows = [(i, v) for i, v in clustered(1200)]
    vectors = materialize(frame(spark, rows).selectExpr("vec_id AS cid", "cast(embedding AS array<double>) AS v"), "test-vectors")
    found, recall, bands = nb.vector_lists(vectors, 10, target=0.97, block=32, step=2)
    assert recall >= 0.97 and bands > 2
    with pytest.warns(UserWarning, match="were asked for"):
        less = nb.vector_lists(vectors, 10, target=0.999, block=8, step=1, most=1)
    assert less[1] < recall and less[2] == 1


def test_blocks_are_bounded(spark):
    """A third of the vectors in one direction: no comparison exceeds three blocks."""
    rng = np.random.default_rng(2)
    sizes = []
    real = nb._best

    def spy(ids, x, others, y, n):
        sizes.append((len(ids), len(others)))
        return real(ids, x, others, y, n)

    import pyarrow as pa
    x = [[float(c) for c in v] for v in 1 + 1e-9 * rng.standard_normal((1000, 8))]
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(1000, np.int32)), pa.array(np.zeros(1000, np.int64)), pa.array(np.arange(1000)), pa.array(x)],
                                       names=["band", "place", "cid", "v"])
    nb._best = spy
    try:
        out = list(nb._compare(5, 50)(iter([batch.slice(0, 333), batch.slice(333)])))
    finally:
        nb._best = real
    assert max(a for a, _ in sizes) == 50 and max(b for _, b in sizes) == 150
    assert sum(b.num_rows for b in out) == 1000


def test_copies_and_odd_rows(spark):
    """40 copies of one vector, scaled and opposite ones, and rows that take no part."""
    rows = [(i, [1.0, 2.0, 0.0]) for i in range(40)] + [(50, [2.0, 4.0, 0.0]), (51, [-1.0, -2.0, 0.0]), (52, [0.0, 1.0, 1.0])]
    odd = [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 0.0]), (63, [float("nan"), 1.0, 1.0]), (64, [float("inf"), 1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (3, [1.0, 2.0, 0.0])]
    got = lists(nb.all_neighbours(frame(spark, rows + odd), n=5))
    assert got == brute(rows, 5)
    assert got[0] == [1, 2, 3, 4, 5] and got[39] == [0, 1, 2, 3, 4] and len(got) == 43


def test_none_and_one(spark):
    assert nb.all_neighbours(frame(spark, [])).collect() == []
    assert nb.all_neighbours(frame(spark, [(1, [1.0, 2.0])])).collect() == []
    assert lists(nb.all_neighbours(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))) == {1: [2], 2: [1]}


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="differ in length"):
        nb.all_neighbours(frame(spark, [(1, [1.0, 2.0]), (2, [1.0])])).collect()
