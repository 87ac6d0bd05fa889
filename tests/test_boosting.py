"""Boosted trees on cells against rows, exhaustive search and row-level AUC."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import boosting as bo
from basketlens.operators import ml

POINT = {"max_depth": 3, "learning_rate": 0.1, "subsample": 1.0, "colsample": 1.0}


def events(spark, n=1500, seed=1):
    """The label depends on a and b together, and on the category."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(8), rng.randrange(40) / 2, rng.choice(["x", "x", "y", "z", None])
        rows.append((i, float(a), b if i % 50 else None, c, rng.random(), int(rng.random() < (0.8 if (a > 3) == (b > 9) else 0.15) + 0.1 * (c == "y"))))
    return spark.createDataFrame(rows, "event_id long, a double, b double, c string, noise double, label int")


def as_rows(cells):
    """The same data with a cell for each row."""
    kinds = [(k, f, y) for k in range(len(cells.bins)) for f in range(cells.rows.shape[1])
             for y, n in ((1, cells.positive[k, f]), (0, cells.rows[k, f] - cells.positive[k, f])) for _ in range(int(n))]
    rows, positive = np.zeros((len(kinds), cells.rows.shape[1])), np.zeros((len(kinds), cells.rows.shape[1]))
    for i, (_, f, y) in enumerate(kinds):
        rows[i, f], positive[i, f] = 1, y
    return bo.Cells(cells.bins[[k for k, _, _ in kinds]], rows, positive)


@pytest.fixture(scope="module")
def fitted(spark):
    df = events(spark)
    binning = bo.fit_binning(df, ["a", "b", "noise"], ["c"], bins=8)
    return df, binning, bo.count_cells(df, binning, "event_id")


def test_cells_count_every_row(fitted):
    df, binning, cells = fitted
    assert cells.rows.sum() == 1500 and cells.positive.sum() == df.agg(F.sum("label")).first()[0]
    got = {tuple(r) for r in df.select(*[binning.bin(f) for f in binning.features]).distinct().collect()}
    assert got == {tuple(x) for x in cells.bins.tolist()} and len(got) == len(cells.bins)
    assert binning.values["c"] == ["x", "y", "z"] or set(binning.values["c"]) == {"x", "y", "z"}


def test_cells_give_the_trees_of_their_rows(fitted):
    _, _, cells = fitted
    rows = as_rows(cells)
    one, other = (next(bo.boost(x, 8, POINT, [0, 2], [25]))[2] for x in (cells, rows))
    assert all((a == b).all() for a, b in zip(one.feature, other.feature)) and all((a == b).all() for a, b in zip(one.split, other.split))
    np.testing.assert_allclose(one.margin(cells.bins), other.margin(cells.bins), atol=1e-9)


def test_a_stump_is_the_best_split():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 6, (200, 3))
    y = (rng.random(200) < 0.2 + 0.5 * (bins[:, 1] > 2)).astype(float)
    g, h = y - y.mean(), np.full(200, y.mean() * (1 - y.mean()))

    def gain(f, cut):
        left = bins[:, f] <= cut
        return sum(g[x].sum() ** 2 / (h[x].sum() + bo.PENALTY) for x in (left, ~left))

    best = max(((gain(f, c), f, c) for f, c in itertools.product(range(3), range(5))), key=lambda x: x[0])
    feature, split, value, node = bo._grow(bins, 6, g, h, np.arange(3), 1)
    assert (feature[0], split[0]) == best[1:] and feature[1] == feature[2] == -1
    left = bins[:, feature[0]] <= split[0]
    np.testing.assert_allclose(value[1:], [g[x].sum() / (h[x].sum() + bo.PENALTY) for x in (left, ~left)])
    assert (node == np.where(left, 1, 2)).all() and (bo._leaf(bins, feature, split) == node).all()


def test_stages_are_fits_of_fewer_trees(fitted):
    _, _, cells = fitted
    point = {**POINT, "subsample": 0.8, "colsample": 0.5}
    stages = [(t, m.copy()) for t, m, _ in bo.boost(cells, 8, point, [0], [5, 20])]
    alone = [next(bo.boost(cells, 8, point, [0], [t])) for t in (5, 20)]
    for (t, margin), (u, again, trees) in zip(stages, alone):
        assert t == u
        np.testing.assert_allclose(margin, again)
        np.testing.assert_allclose(trees.margin(cells.bins), again)


def test_every_point_of_the_grid_has_the_auc_of_its_rows(spark, fitted):
    df, binning, cells = fitted
    grid = {"max_depth": [1, 3], "learning_rate": [0.1], "subsample": [0.8, 1.0], "colsample": [1.0]}
    found = bo.grid_search(df, cells, 8, grid, [4, 12]).collect()
    assert len(found) == 8
    rows = df.withColumn("fold", bo.md5_mod(F.concat_ws(":", F.col("event_id").cast("string"), F.lit("fold")), 3))
    for r in found:
        for fold in range(3):
            trees = next(bo.boost(cells, 8, r.asDict(), [x for x in range(3) if x != fold], [r["trees"]]))[2]
            scored = bo.scored(rows.where(F.col("fold") == fold), bo.Model(binning, trees, {}))
            assert ml.auc_rank(scored).first()["auc"] == pytest.approx(r["fold_auc"][fold], abs=1e-9)
        assert r["auc"] == pytest.approx(sum(r["fold_auc"]) / 3)


def test_the_best_model_beats_one_feature_and_importance_finds_the_cause(spark):
    train, test = events(spark, 3000, 5), events(spark, 1200, 6)
    model, scores = bo.train_model(train, ["a", "b", "noise"], ["c"], grid={"max_depth": [1, 3], "learning_rate": [0.1], "subsample": [1.0], "colsample": [1.0]}, trees=[10, 40], bins=8)
    assert scores.count() == 4 and model.params["max_depth"] == 3
    scored = bo.scored(test, model)
    auc = ml.auc_rank(scored).first()["auc"]
    assert auc > 0.75 and auc > ml.auc_rank(test.withColumn("score", F.col("a"))).first()["auc"] + 0.1
    drop = {r.feature: r.auc_drop for r in bo.permutation_importance(test, model, ["a", "b", "noise"]).collect()}
    assert min(drop["a"], drop["b"]) > 0.1 > abs(drop["noise"]) + 0.05
    one = bo.permutation_importance(test, model, ["noise"]).first()
    assert one.feature == "noise" and abs(one.auc_drop) < 0.05


def test_importance_needs_unique_ids_and_bins_are_bounded(spark, fitted):
    df, binning, cells = fitted
    model = bo.Model(binning, bo.Trees(0.0), {})
    with pytest.raises(ValueError, match="unique"):
        bo.permutation_importance(df.unionByName(df.limit(1)), model, ["a"])
    with pytest.raises(ValueError, match="cells"):
        bo.fit_binning(df, ["a", "b", "noise", "label", "event_id", "a"], [], bins=16)


def test_auc_of_cells():
    assert bo.auc(np.array([0.1, 0.4, 0.4, 0.9]), np.array([0, 1, 2, 3.0]), np.array([5, 1, 1, 0.0])) == pytest.approx((3 * 7 + 3 * (5 + 1)) / (6 * 7))
    assert np.isnan(bo.auc(np.array([1.0]), np.array([0.0]), np.array([2.0])))


def test_bins_of_a_user_and_an_item_add_up_to_the_cell(spark):
    rows = [(float(i % 13) if i % 5 else None, float(i % 7), f"c{i % 4}" if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c string")
    binning = bo.fit_binning(df, ["a", "b"], ["c"], 8)
    got = df.select(binning.cell().alias("whole"), (binning.cell(["a"]) + binning.cell(["b", "c"])).alias("parts"),
                    F.when(F.col("a").isNull(), binning.cell(["a"], blank=True) + binning.cell(["b", "c"])).alias("blank")).collect()
    assert all(r.whole == r.parts and r.blank in (None, r.whole) for r in got) and any(r.blank is not None for r in got)


def test_scores_of_several_batches_and_given_cells(spark, fitted):
    df, binning, cells = fitted
    trees = next(bo.boost(cells, 8, {"max_depth": 3, "learning_rate": 0.1, "subsample": 1.0, "colsample": 1.0}, [0, 1, 2], [10]))[2]
    model = bo.Model(binning, trees, {})
    rows = df.crossJoin(spark.range(12)).coalesce(1).withColumn("cell", binning.cell())  # more than one Arrow batch
    got = bo.scored(bo.scored(rows, model), model, "again", cell=F.col("cell")).select("cell", "score", "again").distinct().toPandas()
    np.testing.assert_allclose(got["score"], trees.score(binning.split(got["cell"].to_numpy(np.int64))))
    assert (got["score"] == got["again"]).all() and got["cell"].is_unique
