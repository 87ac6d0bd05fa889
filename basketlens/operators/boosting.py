"""Boosted trees by cells of binned features: the click model, its
cross-validated grid and what is read off it (M3, M5, M6).

Every feature is cut into at most ``bins`` bins (quantiles of the training
rows for numbers, the most frequent values for categories), so a row is one of
at most MAX_CELLS cells, however many rows there are. One grouping of the
log, with map-side partial sums, counts the rows and the positive ones of each
(cell, fold); this bounded table is all that a fit needs, since histograms,
gradients and AUC are sums over cells. Reading the log again for each level
of each tree of each of hundreds of fits would not be.

The grid is a DataFrame with a row for each (parameters, fold). Rows are dealt
to as many tasks; each fits its trees on the broadcast cells once, to the
largest number of trees, and the smaller numbers are read off on the way.

Trees follow the second-order scheme of gradient boosting (logistic loss,
L2 penalty on leaf values); row sampling thins the counts of a cell
binomially, which is what sampling its rows does.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import md5_mod
from .sequences import global_rank

MAX_CELLS = 1 << 20
PENALTY = 1.0            # on squared leaf values
LEAST_CHILD = 1.0        # sum of second derivatives in a child

# The search grid.
GRID = {"max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1], "subsample": [0.8, 1.0], "colsample": [0.8, 1.0]}
TREES = [100, 200, 300]
FOLDS = 3


@dataclass
class Binning:
    """Where features are cut: edges of numbers, most frequent values of categories."""

    bins: int
    edges: dict[str, list[float]]
    values: dict[str, list] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.edges, *self.values]

    def bin(self, feature: str, blank: bool = False) -> Column:
        """Native bin number of a feature's column (null: 0 as a number, the last bin as a category), or of null."""
        x = F.lit(None) if blank else F.col(feature)
        if feature in self.edges:
            x = F.coalesce(x.cast("double"), F.lit(0.0))
            return reduce(lambda a, e: a + (x > F.lit(e)).cast("int"), self.edges[feature], F.lit(0))
        known = self.values[feature]
        return reduce(lambda a, k: F.when(x == F.lit(known[k]), F.lit(k)).otherwise(a), range(len(known)), F.lit(len(known)))

    def cell(self, features: list[str] | None = None, blank: bool = False) -> Column:
        """Cell of a row; or what some features add to it (if ``blank``: with
        nulls for values), so that those of a user and an item can be found
        before their rows meet."""
        chosen = self.features if features is None else features
        return reduce(lambda a, x: a + x[1] * F.lit(self.bins ** x[0]), ((i, self.bin(f, blank)) for i, f in enumerate(self.features) if f in chosen), F.lit(0)).cast("int")

    def split(self, cells: np.ndarray) -> np.ndarray:
        """Bin numbers (a column for each feature) of cells."""
        return np.stack([cells // self.bins ** i % self.bins for i in range(len(self.features))], axis=1).astype(np.int64)


def fit_binning(train: DataFrame, numeric: list[str], categorical: list[str] = (), bins: int = 16) -> Binning:
    """Cuts from the training rows: two small aggregates reach the driver."""
    if bins ** (len(numeric) + len(categorical)) > MAX_CELLS:
        raise ValueError(f"{bins} bins of {len(numeric) + len(categorical)} features are more than {MAX_CELLS} cells")
    marks = [i / bins for i in range(1, bins)]
    cuts = train.agg(*[F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), marks, 10_000).alias(c) for c in numeric]).first()
    edges = {c: sorted(set(cuts[c] or [])) for c in numeric}
    values = {c: [r[c] for r in train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(bins - 1).collect()] for c in categorical}
    return Binning(bins, edges, values)


@dataclass
class Cells:
    """Rows and positive rows of each cell (a column for each fold)."""

    bins: np.ndarray
    rows: np.ndarray
    positive: np.ndarray


def count_cells(train: DataFrame, binning: Binning, id_col: str, label: str = "label", folds: int = FOLDS) -> Cells:
    """The (cell, fold) counts of the training rows; folds by a hash of the id."""
    fold = md5_mod(F.concat_ws(":", F.col(id_col).cast("string"), F.lit("fold")), folds)
    counted = (train.select(binning.cell().alias("cell"), fold.cast("int").alias("fold"), F.col(label).cast("long").alias("y"))
               .groupBy("cell", "fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positive")).toPandas())  # MAX_CELLS * folds rows at most
    cells, at = np.unique(counted["cell"].to_numpy(np.int64), return_inverse=True)
    rows, positive = np.zeros((len(cells), folds)), np.zeros((len(cells), folds))
    rows[at, counted["fold"]] = counted["rows"]
    positive[at, counted["fold"]] = counted["positive"]
    return Cells(binning.split(cells), rows, positive)


@dataclass
class Trees:
    """Trees as heaps (the children of node k are 2k + 1 and 2k + 2)."""

    base: float
    feature: list[np.ndarray] = field(default_factory=list)   # -1: a leaf
    split: list[np.ndarray] = field(default_factory=list)     # largest bin that goes left
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for feature, split, value in zip(self.feature, self.split, self.value):
            out += value[_leaf(bins, feature, split)]
        return out

    def score(self, bins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(bins)))


def _leaf(bins: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(int(np.log2(len(feature) + 1)) - 1):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (bins[row, f] > split[node]), node)
    return node


def _grow(bins: np.ndarray, n_bins: int, g: np.ndarray, h: np.ndarray, features: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree on gradients and second derivatives of the cells: (feature,
    split, leaf value without step size, leaf of each cell)."""
    size, k = 2 ** (depth + 1) - 1, len(features)
    feature, split, value, node = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(len(bins), np.int64)
    codes = bins[:, features] + np.arange(k) * n_bins
    here, local = np.arange(len(bins)), node
    for level in range(depth + 1):
        first, count = 2 ** level - 1, 2 ** level
        total_g, total_h = (np.bincount(local, x[here], count) for x in (g, h))
        value[first : first + count] = total_g / (total_h + PENALTY)
        if level == depth or not len(here):
            break
        # histograms of all nodes and features at once, then sums to the left of every cut
        at = (local[:, None] * (k * n_bins) + codes[here]).ravel()
        left_g, left_h = (np.cumsum(np.bincount(at, np.repeat(x[here], k), count * k * n_bins).reshape(count, k, n_bins), axis=2)[:, :, :-1] for x in (g, h))
        right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
        gain = left_g ** 2 / (left_h + PENALTY) + right_g ** 2 / (right_h + PENALTY) - (total_g ** 2 / (total_h + PENALTY))[:, None, None]
        gain[(left_h < LEAST_CHILD) | (right_h < LEAST_CHILD)] = 0
        gain = np.round(gain, 9).reshape(count, -1)  # sums in another order give the same first best cut
        best = gain.argmax(axis=1)
        splits = np.flatnonzero(gain[np.arange(count), best] > 0)
        feature[first + splits], split[first + splits] = features[best[splits] // (n_bins - 1)], best[splits] % (n_bins - 1)
        f = feature[first + local]
        go = f >= 0
        here, local, f = here[go], local[go], f[go]
        local = 2 * local + (bins[here, f] > split[first + local])
        node[here] = 2 * count - 1 + local
    return feature, split, value, node


def boost(cells: Cells, n_bins: int, params: dict, folds: list[int], stages: list[int], seed: int = 42) -> Iterator[tuple[int, np.ndarray, Trees]]:
    """Fit on the rows of ``folds``; at each number of trees in ``stages``:
    (trees, margin of every cell, the trees so far)."""
    rows, positive = cells.rows[:, folds].sum(axis=1), cells.positive[:, folds].sum(axis=1)
    share = np.clip(positive.sum() / max(1.0, rows.sum()), 1e-6, 1 - 1e-6)
    made, rng, k = Trees(float(np.log(share / (1 - share)))), np.random.default_rng(seed), cells.bins.shape[1]
    margin = np.full(len(rows), made.base)
    for t in range(1, max(stages) + 1):
        n, y = rows, positive
        if params["subsample"] < 1:
            y = rng.binomial(positive.astype(np.int64), params["subsample"])
            n = y + rng.binomial((rows - positive).astype(np.int64), params["subsample"])
        features = np.sort(rng.choice(k, max(1, round(params["colsample"] * k)), replace=False)) if params["colsample"] < 1 else np.arange(k)
        p = 1 / (1 + np.exp(-margin))
        feature, split, value, node = _grow(cells.bins, n_bins, y - n * p, n * p * (1 - p), features, params["max_depth"])
        value = value * params["learning_rate"]
        margin = margin + value[node]
        for kept, x in ((made.feature, feature), (made.split, split), (made.value, value)):
            kept.append(x)
        if t in stages:
            yield t, margin, made


def auc(score: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """Area under the ROC curve of cells with these counts (ties: a half);
    nan without both kinds."""
    _, at = np.unique(score, return_inverse=True)
    p, n = np.bincount(at, positive), np.bincount(at, negative)
    return float((p * (np.cumsum(n) - n / 2)).sum() / (p.sum() * n.sum())) if p.sum() and n.sum() else float("nan")


def points(grid: dict | None = None) -> list[dict]:
    grid = grid or GRID
    return [dict(zip(grid, x)) for x in itertools.product(*grid.values())]


def grid_search(train: DataFrame, cells: Cells, n_bins: int, grid: dict | None = None, trees: list[int] | None = None, seed: int = 42) -> DataFrame:
    """M3: cross-validated AUC of every point: the parameters, trees, auc (mean
    of the folds) and fold_auc. A task fits one (parameters, fold)."""
    spark, folds, stages = train.sparkSession, cells.rows.shape[1], trees or TREES
    shared = spark.sparkContext.broadcast(cells)
    names = list(grid or GRID)
    jobs = [(*x.values(), fold) for x in points(grid) for fold in range(folds)]
    schema = ", ".join(f"{n} {'int' if n == 'max_depth' else 'double'}" for n in names)
    todo = spark.createDataFrame([tuple(int(v) if n in ("max_depth", "fold") else float(v) for n, v in zip([*names, "fold"], j)) for j in jobs], f"{schema}, fold int")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for job in pdf.to_dict("records"):
                known, fold = shared.value, job["fold"]
                p, n = known.positive[:, fold], known.rows[:, fold]
                others = [f for f in range(folds) if f != fold]
                yield pd.DataFrame([{**job, "trees": t, "auc": auc(margin, p, n - p)} for t, margin, _ in boost(known, n_bins, job, others, stages, seed)])

    found = todo.repartition(len(jobs)).mapInPandas(fit, f"{schema}, fold int, trees int, auc double")
    return found.groupBy(*names, "trees").agg(F.avg("auc").alias("auc"), F.array_sort(F.collect_list(F.struct("fold", "auc")))["auc"].alias("fold_auc"))


@dataclass
class Model:
    binning: Binning
    trees: Trees
    params: dict


def best_point(scores: DataFrame) -> dict:
    """The point with the highest mean AUC (ties: fewer, shallower trees, then smaller values)."""
    names = [c for c in scores.columns if c not in ("auc", "fold_auc")]
    return scores.select(*names, "auc").orderBy(F.desc(F.nanvl(F.col("auc"), F.lit(0.0))), "trees", *[n for n in names if n != "trees"]).first().asDict()


def refit(spark, cells: Cells, binning: Binning, point: dict, seed: int = 42) -> Model:
    """The model of a point on all folds (one fit, in a task)."""
    shared = spark.sparkContext.broadcast(cells)

    def fit(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle
        for _, _, made in boost(shared.value, binning.bins, point, list(range(shared.value.rows.shape[1])), [point["trees"]], seed):
            yield pd.DataFrame({"model": [pickle.dumps(made)]})

    import pickle
    made = pickle.loads(bytes(spark.range(0, 1, 1, 1).mapInPandas(fit, "model binary").first()["model"]))
    return Model(binning, made, point)


def train_model(train: DataFrame, numeric: list[str], categorical: list[str], id_col: str = "event_id", grid: dict | None = None,
                trees: list[int] | None = None, bins: int = 16) -> tuple[Model, DataFrame]:
    """(best model of the grid, the grid's scores)."""
    from ..sources.shared import materialize

    binning = fit_binning(train, numeric, categorical, bins)
    cells = count_cells(train, binning, id_col)
    scores = materialize(grid_search(train, cells, bins, grid, trees), "grid-scores")
    return refit(train.sparkSession, cells, binning, best_point(scores)), scores


def scored(df: DataFrame, model: Model, out: str = "score", cell: Column | None = None) -> DataFrame:
    """M6: ``df`` with the probability of the positive class. Cells are found
    natively (or given as a column); a task walks the trees once for each of
    its distinct cells and keeps their scores, MAX_CELLS at most."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees, binning = shared.value.trees, shared.value.binning
        known = np.full(binning.bins ** len(binning.features), np.nan)
        for batch in batches:
            cells = batch.to_numpy(np.int64)
            new = np.unique(cells)
            new = new[np.isnan(known[new])]
            if len(new):
                known[new] = trees.score(binning.split(new))
            yield pd.Series(known[cells])

    return df.withColumn(out, walk(model.binning.cell() if cell is None else cell))


def permutation_importance(df: DataFrame, model: Model, features: list[str], id_col: str = "event_id", label: str = "label", seed: int = 42) -> DataFrame:
    """M5: feature, auc_drop: how much AUC falls when one feature's values are
    permuted among the rows. Rows are ranked by their id and, once for all
    features, by a seeded hash of it; a row takes the permuted values of the
    row whose second rank is its first. All variants are scored in one pass,
    and AUC comes from counts by distinct score (at most MAX_CELLS a variant).
    ``id_col`` must be unique and not null, which is checked."""
    bad = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
    if not bad.isEmpty():
        raise ValueError(f"{id_col} must be unique and not null")
    first = global_rank(df.withColumn("_k", F.struct(id_col)), "_k", out="_ra").drop("_ra_ties", "_k")
    second = global_rank(df.select(F.struct(*features).alias("_p"), F.struct(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).alias("_k")), "_k", out="_ra").select("_ra", "_p")
    both = first.join(second, "_ra")
    kinds = F.array(F.lit(None).cast("string"), *[F.lit(f) for f in features])
    variants = both.select(F.explode(kinds).alias("feature"), "*").select(
        "feature", F.col(label).cast("long").alias("y"), *[F.when(F.col("feature") == f, F.col("_p")[f]).otherwise(F.col(f)).alias(f) for f in features],
        *[c for c in model.binning.features if c not in features])
    counted = scored(variants, model).groupBy("feature", "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("feature").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = counted.withColumn("area", F.col("p") * (below + F.col("n") / 2)).groupBy("feature").agg((F.sum("area") / (F.sum("p") * F.sum("n"))).alias("auc"))
    base = F.max(F.when(F.col("feature").isNull(), F.col("auc"))).over(Window.partitionBy())  # a row for each feature
    return area.withColumn("auc_drop", base - F.col("auc")).where(F.col("feature").isNotNull()).select("feature", "auc_drop")
