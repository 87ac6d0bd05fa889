"""Approximate nearest neighbours with balanced posting lists.

Index: centroids are fitted on a bounded sample (SAMPLE_ROWS, by hash of the
id) by a k-means that penalises full clusters, so that the posting lists are
about equally long. Every vector is stored in the list of its nearest
centroid, and a boundary vector also in the lists of other centroids that
are nearly as close (BOUNDARY), unless such a centroid is closer to one that
already holds it. A list longer than BLOCK_ROWS is cut into blocks by hash,
so a list that holds a third of all vectors is searched by many tasks.

Search: the centroids, in memory, are the nodes of a proximity graph; a
best-first walk with a beam finds those near a query, and the lists whose
centroid distance is within a ratio of the closest one are searched, each
block by matching its vectors with the queries that chose the list. The
best of each block meet in a final top-k per query. Queries that got fewer
than k rows search again, in WIDEN times as many lists each time and at last
in all, so that none gets fewer than there are. The ratio is set when
the index is fitted: so that on the sample the lists searched hold at least
COVERED of the true neighbours. On clustered vectors that prunes nearly all
lists; on vectors without structure (neighbours hardly nearer than strangers)
many lists have to be searched for the same recall.

Nearness is the cosine. Scores are cosines in double precision of the
original vectors, computed row by row, so equal vectors get equal scores;
ties go to the smaller id. Vectors that are null, empty, zero, or hold null
or non-finite components take no part; so do rows with a null id and rows
whose dimension differs from the most common one. Rows that repeat an id
and its score for a query count once for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SAMPLE_ROWS = 20_000     # rows on which centroids are fitted, whatever the table's size
LIST_ROWS = 400          # vectors a list should hold
MAX_LISTS = 16_384       # centroids held in memory; beyond it lists grow and are cut into blocks
BLOCK_ROWS = 4_096       # vectors, or queries, that one block holds
BOUNDARY = 1.1           # replicate to centroids within this ratio of the nearest distance (1 - cosine)
REPLICAS = 4
COVERED = 0.97           # of the sample's true neighbours, for setting the search ratio
NEIGHBOURS = 5           # for which it is set
TRIALS = 400             # sample rows used as queries for it
DEGREE = 24              # edges of a node of the centroid graph
BEAM = 48                # least width of the best-first walk
ROUNDS = 12              # of k-means
WIDEN = 8                # lists of the next search of queries with too few results, as a multiple


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class CentroidGraph:
    """Unit centroids joined to their nearest others; searched by a
    best-first walk that all queries of a batch take at the same time."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.float32)
        k = len(centroids)
        degree = min(DEGREE, k - 1)
        self.edges = np.zeros((k, degree), dtype=np.int32)
        for at in range(0, k, 1024):
            near = -(self.centroids[at : at + 1024] @ self.centroids.T)
            near[np.arange(len(near)), np.arange(at, at + len(near))] = np.inf
            if degree:
                close = np.argpartition(near, degree - 1, axis=1)[:, : max(1, degree - 4)]
                self.edges[at : at + 1024, : close.shape[1]] = close
        if degree > 4:  # a few long edges keep the graph connected: a ring, and strides over it
            for j, stride in enumerate((1, max(1, k // 7), max(1, k // 3), k - 1)):
                self.edges[:, degree - 4 + j] = (np.arange(k) + stride) % k
        elif degree:
            self.edges[:, -1] = (np.arange(k) + 1) % k
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(np.int32))
        self.prune, self.beam = 1.0, BEAM

    def calibrate(self, sample: np.ndarray, k: int) -> None:
        """Set the search ratio (and a beam that reaches the lists within it)
        on unit rows of a sample."""
        rows, lists = self.replicas(sample)
        tried = np.arange(0, len(sample), max(1, len(sample) // TRIALS))
        to_list = 1 - sample[tried] @ self.centroids.T.astype(np.float64)
        ratio = to_list / np.maximum(to_list.min(axis=1, keepdims=True), 1e-9)
        starts = np.searchsorted(rows, np.arange(len(sample) + 1))
        needed = []
        for i, q in enumerate(tried):
            near = sample @ sample[q]
            near[q] = -np.inf
            for j in np.argsort(-near, kind="stable")[: min(k, len(sample) - 1)]:
                needed.append(ratio[i, lists[starts[j] : starts[j + 1]]].min())
        self.prune = float(np.quantile(needed, COVERED)) if needed else 1.0
        self.beam = max(BEAM, int(1.25 * (ratio <= self.prune).sum(axis=1).max()))

    def walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, distance) of up to ``beam`` near centroids of each unit
        row of x, nearest first; distance is 1 - cosine."""
        x = x.astype(np.float32)
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        rows = np.arange(n)
        seen = np.zeros((n, k), dtype=bool)
        node = np.broadcast_to(self.entries, (n, len(self.entries)))
        dist = 1 - x @ self.centroids[self.entries].T
        seen[:, self.entries] = True
        open_ = np.ones(node.shape, dtype=bool)
        while True:
            order = np.argsort(np.where(np.isfinite(dist), dist, np.inf), axis=1, kind="stable")[:, :beam]
            node, dist, open_ = (np.take_along_axis(a, order, axis=1) for a in (node, dist, open_))
            first = open_.argmax(axis=1)  # the nearest node not yet expanded
            live = open_[rows, first] & np.isfinite(dist[rows, first])
            if not live.any() or not self.edges.shape[1]:
                return node, dist
            open_[rows, first] = False
            new = self.edges[node[rows, first]]
            fresh = ~np.take_along_axis(seen, new, axis=1) & live[:, None]
            np.put_along_axis(seen, new, True, axis=1)
            d = np.where(fresh, 1 - np.einsum("nd,njd->nj", x, self.centroids[new]), np.inf)
            node, dist, open_ = np.concatenate([node, new], axis=1), np.concatenate([dist, d], axis=1), np.concatenate([open_, fresh], axis=1)

    def replicas(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) pairs: the lists that hold each unit row of x."""
        rows, lists = [], []
        for at in range(0, len(x), 512):
            node, dist = self.walk(x[at : at + 512], 24)
            limit = np.maximum(dist[:, :1], 1e-9) * BOUNDARY
            chosen = np.zeros(node.shape, dtype=bool)
            chosen[:, 0] = True
            for j in range(1, node.shape[1]):
                ok = np.isfinite(dist[:, j]) & (dist[:, j] <= limit[:, 0]) & (chosen.sum(axis=1) < REPLICAS)
                for i in np.flatnonzero(ok):  # not if a centroid that holds it is nearer to this one than the vector is
                    held = node[i, :j][chosen[i, :j]]
                    ok[i] = (1 - self.centroids[held] @ self.centroids[node[i, j]]).min() >= dist[i, j]
                chosen[:, j] = ok
            r, j = np.nonzero(chosen)
            rows.append(r + at)
            lists.append(node[r, j])
        return np.concatenate(rows), np.concatenate(lists)

    def probes(self, x: np.ndarray, nearest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) pairs: the lists that each query searches; the
        ``nearest`` so many, if given (all, if there are no more)."""
        rows, lists = [], []
        k = len(self.centroids)
        if nearest is not None and nearest >= k:
            return np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x))
        for at in range(0, len(x), 512):
            if nearest is not None:
                node, dist = self.walk(x[at : at + 512], nearest)
                r, j = np.nonzero(np.isfinite(dist))
                rows.append(r + at)
                lists.append(node[r, j])
                continue
            node, dist = self.walk(x[at : at + 512], self.beam)
            r, j = np.nonzero(np.isfinite(dist) & (dist <= np.maximum(dist[:, :1], 1e-9) * self.prune))
            rows.append(r + at)
            lists.append(node[r, j])
        return np.concatenate(rows), np.concatenate(lists)


def balanced_centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """k unit centroids of the unit rows of a sample; a cluster's size adds
    to its distance, so that clusters come out about equally full."""
    rng = np.random.default_rng(7)
    distinct = np.unique(sample.astype(np.float32), axis=0).astype(np.float64)
    k = min(k, len(distinct))
    centroids = distinct[rng.choice(len(distinct), k, replace=False)]
    penalty = np.zeros(k)
    for _ in range(ROUNDS):
        sums, sizes = np.zeros_like(centroids), np.zeros(k)
        for at in range(0, len(distinct), 4096):
            x = distinct[at : at + 4096]
            best = (1 - x @ centroids.T + penalty).argmin(axis=1)
            np.add.at(sums, best, x)
            sizes += np.bincount(best, minlength=k)
        empty = sizes == 0
        sums[empty] = distinct[rng.choice(len(distinct), int(empty.sum()))]
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids)
        penalty = 0.5 * penalty + 0.02 * np.log1p(sizes / max(1.0, sizes.mean()))
    return centroids


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(ok, v).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (common["d"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Index:
    """A fitted index: the centroid graph (broadcast; at most MAX_LISTS
    centroids) and the posting lists, a table (list, block, vec_id,
    embedding)."""

    def __init__(self, graph, lists: DataFrame, blocks: DataFrame):
        self.graph, self.lists, self.blocks = graph, lists, blocks


def build(rows: DataFrame, n_lists: int | None = None) -> Index | None:
    """Fit on a sample and store every row of (vec_id, embedding); None if
    there is no row."""
    n = rows.count()
    if not n:
        return None
    sample = (rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, 1.2 * SAMPLE_ROWS / n)))
              .select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE_ROWS).toPandas())
    # a repeated row is no neighbour of its own
    sample = sample[~pd.DataFrame({"h": sample["h"], "v": [np.asarray(x).tobytes() for x in sample["embedding"]]}).duplicated()]
    if sample.empty:
        sample = rows.limit(1).select("embedding").toPandas()
    points = unit(np.stack(sample["embedding"]))
    k = n_lists or max(1, min(MAX_LISTS, n // LIST_ROWS, max(1, len(points) // 4)))
    spark = rows.sparkSession
    fitted = CentroidGraph(balanced_centroids(points, k))
    fitted.calibrate(points, NEIGHBOURS)
    graph = spark.sparkContext.broadcast(fitted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r, lists = graph.value.replicas(unit(_matrix(batch.column(1))))
                part = pa.Table.from_batches([batch]).take(pa.array(r)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *part.columns], names=["list", "vec_id", "embedding"])

    stored = materialize(rows.mapInArrow(assign, "list int, vec_id long, embedding array<double>"), "ann-lists")
    sizes = stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("n_blocks"))
    blocks = materialize(sizes, "ann-sizes")  # at most MAX_LISTS rows
    lists = (stored.join(F.broadcast(blocks), "list")
             .select("list", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int").alias("block"), "vec_id", "embedding"))
    return Index(graph, lists, blocks)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest indexed rows of every query (query_id, embedding), other
    than the rows of the query's own id: query_id, rank, vec_id, score. Fewer
    only where there are fewer rows."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:  # a replicated vector is found once in each of its lists
        return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    n_lists = len(index.graph.value.centroids)
    queries = queries.select("query_id", "embedding")
    best = materialize(ranked(_found(index, queries, k)), "ann-best")
    nearest = 1
    while nearest < n_lists:
        nearest = min(n_lists, nearest * WIDEN)
        full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
        short = materialize(queries.join(full, "query_id", "left_anti").select("query_id", "embedding"), "ann-short")
        if short.isEmpty():
            break
        more = _found(index, short, k, nearest)
        best = materialize(ranked(best.drop("rank").unionByName(more)), "ann-best")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(index: Index, queries: DataFrame, k: int, nearest: int | None = None) -> DataFrame:
    """(query_id, vec_id, score): the k best rows for every query of each
    block searched; in the ``nearest`` lists, if given."""
    graph = index.graph

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r, lists = graph.value.probes(unit(_matrix(batch.column(1))), nearest)
                part = pa.Table.from_batches([batch]).take(pa.array(r)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *part.columns], names=["list", "query_id", "embedding"])

    asked = queries.mapInArrow(choose, "list int, query_id long, embedding array<double>")
    asked = materialize(asked, "ann-asked")
    # queries of a crowded list are cut into blocks too
    crowds = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("n_asked"))
    plan = materialize(index.blocks.join(crowds, "list"), "ann-plan")  # at most MAX_LISTS rows
    q = (asked.join(F.broadcast(plan), "list")
         .select("list", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"),
                 F.pmod(F.xxhash64("query_id"), F.col("n_asked")).cast("int").alias("asked"), "query_id", "embedding"))
    v = (index.lists.join(F.broadcast(plan.select("list", "n_asked")), "list")
         .select("list", "block", F.explode(F.sequence(F.lit(0), F.col("n_asked") - 1)).alias("asked"), "vec_id", "embedding"))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x = right["vec_id"].to_numpy(), np.stack(right["embedding"]).astype(np.float64)
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], x[by_id]
            norms = np.sqrt((x * x).sum(axis=1))
            for query_id, y in zip(left["query_id"], left["embedding"]):
                score = (x * y).sum(axis=1) / (norms * np.sqrt((y * y).sum()))
                score[ids == query_id] = -np.inf
                best = np.argsort(-score, kind="stable")
                again = (ids[best[1:]] == ids[best[:-1]]) & (score[best[1:]] == score[best[:-1]])  # rows are in order of score and id
                best = best[np.concatenate([[True], ~again])][:k]
                out += [(query_id, ids[j], score[j]) for j in best if np.isfinite(score[j])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return (q.groupBy("list", "block", "asked").cogroup(v.groupBy("list", "block", "asked"))
            .applyInPandas(block, "query_id long, vec_id long, score double"))


def exact(rows: DataFrame, queries: DataFrame, k: int) -> pd.DataFrame:
    """Brute force on the driver, for tests and recall on small tables."""
    a, b = rows.toPandas(), queries.toPandas()
    x = np.stack(a["embedding"])
    ids = a["vec_id"].to_numpy()
    norms = np.sqrt((x * x).sum(axis=1))
    out = []
    for query_id, y in zip(b["query_id"], b["embedding"]):
        score = (x * y).sum(axis=1) / (norms * np.sqrt((y * y).sum()))
        score[ids == query_id] = -np.inf
        for rank, j in enumerate(np.lexsort((ids, -score))[:k], 1):
            if np.isfinite(score[j]):
                out.append((query_id, rank, ids[j], score[j]))
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
