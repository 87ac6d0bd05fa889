"""N-gram Jaccard join by filtering under several global token orders.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two
sets of sizes a and b with Jaccard similarity of at least t share at least
t / (1 + t) * (a + b) members, so under any total order of the tokens their
short prefixes share a token. The join uses three orders. All put frequent
tokens last (by frequency class, from counts over all documents) and order
the tokens of a class by three different hashes. A pair is a candidate only
if its prefixes share a token under each order; only then are the full sets
compared, exactly.

Steps, each a Spark job whose result is a table on shared storage:

1. sizes, set hashes and token counts. Counts are kept in CELL_ROWS rows of
   cells (a bounded array for each task, summed by cell range), so they cost
   the same for any vocabulary. They only decide the order, so the error that
   a shared cell causes can't lose a pair.
2. one representative (the smallest id) for every distinct set: copies are
   linked through it, and never compared.
3. prefixes under the first order; tokens in the prefixes of two or more
   representatives are kept.
4. star links: in each token's group the member with the fewest rarer tokens
   is compared with the others. In a group of near copies that links most of
   them, with as many comparisons as members.
5. the rest: members of a token's group that are not yet connected are joined
   on the token, in blocks if the group is large, with the filters on sizes
   and positions in the join; then the second and third order filter them.
6. connected components of the links, by alternating stars.

No candidate is capped: what step 4 leaves out, step 5 compares. For
components, members that are already connected aren't compared again;
``similar_links(every=True)`` and ``link_counts`` compare them too and give
every link between different sets.

The node of a document is its id. An id that occurs with several different
sets has a node for each (a 64-bit hash of id and text), so that each text is
compared as it is; only the components of ``jaccard_components`` join them.

Hashes: a token is a 64-bit hash and a set is known by 128 bits; two
different tokens of one pair of documents share a hash with a probability
below 2**-40 for texts of a million words.

Edge cases: null and empty texts have the empty set (size 0), are linked
with nothing and are their own component; a text with fewer than n words has
one member, the whole sequence; rows that repeat an id are in one component,
whatever their texts, but ``keep_one`` takes each text for itself; a null id
is linked with nothing and has a null component; an empty table gives an empty
result; extra columns are left out, and kept by ``keep_one``, whatever their
names; texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, drop_written, free_name, materialize, rows_of, written
from .texthash import constants, mix, word_chunks

CELLS_LOG2 = 20          # cells of a row of the token counts: 2**20
CELL_ROWS = 4            # rows; the least of a token's cells counts
CELL_RANGE = 1 << 15     # cells that one row of partial counts holds
CELL_GROUPS = 64         # groups of tasks whose counts are summed first
BLOCK = 512              # members of a token's group in one block of step 5
_U = np.uint64
_PLACE = constants(64, 5)
_ORDER = constants(3, 6)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text of a string column. A text
    with fewer than n words has one, of the whole sequence."""
    empty = np.zeros(0, dtype=np.uint64)
    for chunk in word_chunks(column):
        word, edges = chunk.hashes, chunk.edges
        if len(word) >= words:
            m = len(word) - words + 1
            grams = np.zeros(m, dtype=np.uint64)
            for j in range(words):
                grams += word[j : j + m] * _PLACE[j]
            grams = mix(grams)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if hi - lo >= words:
                g = np.sort(grams[lo : hi - words + 1])
                keep = np.ones(len(g), dtype=bool)
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                yield g[keep]
            elif hi > lo:
                yield mix((word[lo:hi] * _PLACE[: hi - lo]).sum(keepdims=True) + _U(words * 64 + hi - lo))
            else:
                yield empty


def _set_hash(tokens: np.ndarray, which: int) -> np.uint64:
    return mix(tokens ^ _PLACE[which]).sum(dtype=np.uint64)


def least_common(n, m, percent: int):
    """Smallest overlap of sets of n and m members that are similar enough."""
    return -((-percent * (n + m)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Members that a set of n can miss of a similar set, and one more."""
    return n - (-((-percent * n) // 100)) + 1


def _cell_ids(tokens: np.ndarray) -> Iterator[np.ndarray]:
    """The cell of each token in each row: other bits of its hash, and of that mixed again."""
    mask = _U((1 << CELLS_LOG2) - 1)
    bits = tokens
    for row in range(CELL_ROWS):
        if row % 3 == 0 and row:
            bits = mix(bits ^ _PLACE[61])
        yield ((bits >> _U(64 - CELLS_LOG2 * (row % 3 + 1))) & mask).astype(np.int64) + (row << CELLS_LOG2)


def _ordered(tokens: np.ndarray, classes: np.ndarray, order: int, size: int) -> np.ndarray:
    """The first ``size`` tokens under one of the orders, first to last."""
    cls = None
    for at in _cell_ids(tokens):
        cls = classes[at] if cls is None else np.minimum(cls, classes[at])
    key = (cls.astype(np.uint64) << _U(58)) | (mix(tokens ^ _ORDER[order]) >> _U(6))
    if size < len(key):
        few = np.argpartition(key, size - 1)[:size]
        return tokens[few[np.argsort(key[few], kind="stable")]]
    return tokens[np.argsort(key, kind="stable")]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(v.view(np.int64) for v in values)])))


def _halves(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *((v >> _U(32)).astype(np.uint32).view(np.int32) for v in values)])))


def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """Per document: doc_id, n, s1, s2 (set hash); and, as rows with part and
    counts, each task's token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELL_ROWS << CELLS_LOG2, dtype=np.int32)
        names = ["doc_id", "n", "s1", "s2", "part", "counts"]

        def count(tokens: np.ndarray) -> None:
            for row, at in enumerate(_cell_ids(tokens)):
                cells[row << CELLS_LOG2 : (row + 1) << CELLS_LOG2] += np.bincount(at - (row << CELLS_LOG2), minlength=1 << CELLS_LOG2).astype(np.int32)

        for batch in batches:
            n, s1, s2, waiting, held = [], [], [], [], 0
            for tokens in shingle_sets(batch.column(1), words):
                n.append(len(tokens))
                s1.append(_set_hash(tokens, 62))
                s2.append(_set_hash(tokens, 63))
                waiting.append(tokens)
                held += len(tokens)
                if held >= 1 << 20:
                    count(np.concatenate(waiting))
                    waiting, held = [], 0
            if held:
                count(np.concatenate(waiting))
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)),
                                              pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        for at in range(0, len(cells), CELL_RANGE):
            some = cells[at : at + CELL_RANGE]
            if some.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([at // CELL_RANGE], pa.int32()), pa.array([zlib.compress(some.astype("<i4").tobytes(), 1)], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, part int, counts binary")


def _classes(counts: DataFrame) -> np.ndarray:
    """Frequency class of every cell (eight bytes each reach the driver, for a
    table of any size). Class 0: hardly more than a cell gets by chance; then
    one class for every doubling."""

    def add(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, some in zip(batch.column(0).to_pylist(), batch.column(1)):
                    sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(some.as_py()), kind).astype(np.int64)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in sums.values()], pa.binary())], names=["part", "sums"])
        return run

    # summed in two rounds: by range of cells and group of tasks, then by range
    some = counts.withColumn("group", F.spark_partition_id() % F.lit(CELL_GROUPS)).repartition("part", "group").select("part", "counts").mapInArrow(add("<i4"), "part int, sums binary")
    cells = np.zeros(CELL_ROWS << CELLS_LOG2, dtype=np.int64)
    for row in some.repartition("part").mapInArrow(add("<i8"), "part int, sums binary").collect():
        cells[row["part"] * CELL_RANGE : (row["part"] + 1) * CELL_RANGE] = np.frombuffer(zlib.decompress(row["sums"]), "<i8")
    usual = float(np.median(cells))
    out = np.zeros(len(cells), dtype=np.uint8)
    for at in range(0, len(cells), 1 << 16):
        excess = (cells[at : at + (1 << 16)] - usual) / (1.5 * np.sqrt(usual + 1.0))
        out[at : at + (1 << 16)] = np.where(excess > 1, np.minimum(np.floor(np.log2(np.maximum(excess, 1))) + 1, 31), 0)
    return out


def _prefixes(docs: DataFrame, classes, words: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, prefix) of texts with words, under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, s1, prefix = [], [], [], []
            for k, tokens in enumerate(shingle_sets(batch.column(1), words)):
                if len(tokens):
                    at.append(k)
                    n.append(len(tokens))
                    s1.append(_set_hash(tokens, 62))
                    prefix.append(_ordered(tokens, classes.value, 0, prefix_length(len(tokens), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(np.array(s1, np.uint64).view(np.int64)), _lists(prefix)],
                                             names=["doc_id", "n", "s1", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n int, s1 long, prefix array<long>")


def _sets(p: _Prepared, ids: DataFrame, full: bool) -> DataFrame:
    """(node, n, tokens) of the documents ``ids``; or (node, n, p2, p3), the
    prefixes of their sets under the other orders, as the upper halves of the
    tokens."""
    words, percent, classes = p.words, p.percent, p.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = list(shingle_sets(part.column(1), words))
                lists = [_lists(sets)] if full else [
                    _halves([_ordered(t, classes.value, o, prefix_length(len(t), percent)) if len(t) else t for t in sets]) for o in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in sets], pa.int32()), *lists], names=["node", "n", *(["tokens"] if full else ["p2", "p3"])])

    return rows_of(p.docs, ids).mapInArrow(run, "node long, n int, " + ("tokens array<long>" if full else "p2 array<int>, p3 array<int>"))


def _size_ok(percent: int):
    return F.least("a_n", "b_n").cast("long") * 100 >= F.greatest("a_n", "b_n").cast("long") * percent


def _needed(percent: int):
    return F.ceil((F.col("a_n") + F.col("b_n")) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _position_ok(percent: int):
    """What follows the first common token has to suffice."""
    return F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= _needed(percent)


def _with_sets(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """(a, b, x, y): the pairs with these columns of a's and of b's set. Few
    pairs are broadcast (they are counted), so of the sets only what a pair
    needs is shuffled, by pair."""
    ends = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("left")),
                                                    F.struct(F.col("b").alias("node"), F.lit(False).alias("left")))).alias("e")).select("a", "b", "e.node", "e.left")
    got = sets.select("node", F.struct(*columns).alias("s")).join(F.broadcast(ends) if pairs.count() <= BROADCAST_IDS else ends, "node")
    return got.groupBy("a", "b").agg(F.first(F.when(F.col("left"), F.col("s")), ignorenulls=True).alias("x"),
                                     F.first(F.when(~F.col("left"), F.col("s")), ignorenulls=True).alias("y"))


def _verified(p: _Prepared, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes meet under the second and third order
    and whose sets are similar enough: a, b, common. Prefixes are made for all
    ends of the pairs, whole sets only for those of the pairs that remain."""
    ids = materialize(_ends(pairs), "jj-ids")
    some = (_with_sets(pairs, _sets(p, ids, full=False), "n", "p2", "p3").select("a", "b", F.col("x.n").alias("a_n"), F.col("y.n").alias("b_n"), "x", "y")
            .where(_size_ok(p.percent) & F.arrays_overlap("x.p2", "y.p2") & F.arrays_overlap("x.p3", "y.p3")).select("a", "b"))
    some = materialize(some, "jj-candidates")
    ids = materialize(_ends(some), "jj-ids")
    total = F.col("x.n").cast("long") + F.col("y.n")
    return (_with_sets(some, _sets(p, ids, full=True), "n", "tokens").withColumn("common", F.size(F.array_intersect("x.tokens", "y.tokens")))
            .where(F.col("common") * 100 >= (total - F.col("common")) * p.percent).select("a", "b", "common"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b), component being
    the smallest node that can be reached. Alternating large and small stars:
    each round links every neighbour to the smallest one, natively and with
    partial minima; the rounds grow with the logarithm of a path's length."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc-edges")
    mark = None
    while True:
        # large star: u's larger neighbours (and u) go to u's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc-large")
        # small star: u's smaller neighbours (and u) go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "cc-edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == mark:
            break
        mark = (now["n"], now["h"])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class _Prepared:
    """Tables that the steps share. ``docs`` and all tables made of it are
    keyed by node, in the column doc_id."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        if not 1 <= words < 60 or not 1 <= percent <= 100:
            raise ValueError("words: 1 to 59; percent: 1 to 100")
        self.words, self.percent = words, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = materialize(_summaries(self.docs, words), "jj-summaries")
        self.classes = docs.sparkSession.sparkContext.broadcast(_classes(rows.where("part IS NOT NULL").select("part", "counts")))
        slim = rows.where("part IS NULL").select("doc_id", "n", "s1", "s2")
        sets = slim.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi"))
        self.several = materialize(sets.where("lo <> hi").select("doc_id"), "jj-several")
        self.plain = self.several.isEmpty()  # nodes are ids
        self.names = None  # node, id: of the ids with several sets
        if not self.plain:
            keyed = self.with_node(self.docs, "node")
            self.names = materialize(keyed.join(self.several, "doc_id", "left_semi").select("node", F.col("doc_id").alias("id")).distinct(), "jj-names")
            self.docs = keyed.select(F.col("node").alias("doc_id"), "text")
            slim = materialize(_summaries(self.docs, words), "jj-summaries").where("part IS NULL").select("doc_id", "n", "s1", "s2")
        self.slim = slim
        self.known = slim.where("n > 0 AND doc_id IS NOT NULL")
        self.reps = materialize(self.known.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "jj-representatives")

    def with_node(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` (doc_id, text, ...) with each row's node."""
        if self.plain:
            return df.withColumn(name, F.col("doc_id").cast("long"))
        mark = free_name(df, "several")
        ids = self.several.select(F.col("doc_id").alias(mark))
        few = ids.count() <= BROADCAST_IDS
        return (df.join(F.broadcast(ids) if few else ids, F.col("doc_id").cast("long") == F.col(mark), "left")
                .withColumn(name, F.when(F.col(mark).isNotNull(), F.xxhash64(F.col(mark), F.col("text").cast("string"))).otherwise(F.col("doc_id").cast("long"))).drop(mark))

    def with_id(self, df: DataFrame, node: str) -> DataFrame:
        """``df`` with the ``id`` of each node."""
        if self.plain:
            return df.withColumn("id", F.col(node))
        return df.join(self.names.withColumnRenamed("node", "_node"), F.col(node) == F.col("_node"), "left").withColumn("id", F.coalesce("id", node)).drop("_node")


def similar_links(docs: DataFrame, words: int = 4, percent: int = 85, prepared: _Prepared | None = None, every: bool = False) -> DataFrame:
    """Verified links (a, b, common) between representatives of different
    sets: with ``every`` all of them, else enough for the same components (of
    a group of near copies, not every pair)."""
    p = prepared or _Prepared(docs, words, percent)
    before = written()
    prefixes = materialize(_prefixes(p.docs.where("doc_id IS NOT NULL"), p.classes, p.words, p.percent), "jj-prefixes")
    shared = prefixes.select("s1", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"))
    shared = materialize(shared.where("lo <> hi").select("token"), "jj-shared")  # by two different sets
    entries = prefixes.select(F.col("doc_id").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    entries = materialize(entries.join(shared, "token").join(p.reps.select(F.col("rep").alias("node")), "node", "left_semi"), "jj-entries")

    # Step 4: within a band of sizes, the member with the fewest rarer tokens against the others.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(percent / 100.0) if percent < 100 else 1.0))
    e = entries.withColumn("band", band)
    pivot = e.groupBy("token", "band").agg(F.min(F.struct("pos", "n", "node")).alias("pivot"), F.max("node").alias("hi"), F.min("node").alias("lo")).where("lo < hi")
    star = (e.join(pivot.select("token", "band", "pivot"), ["token", "band"])
            .select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.col("pivot.node").alias("b"), F.col("pivot.n").alias("b_n"), F.col("pivot.pos").alias("b_pos"))
            .where((F.col("a") != F.col("b")) & _size_ok(percent) & _position_ok(percent))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    star = materialize(star, "jj-star-pairs")
    first = materialize(_verified(p, star), "jj-star-links")

    # Step 5: members of a token's group that are not yet connected (or compared).
    if every:
        e = entries.withColumn("component", F.col("node"))
    else:
        found = materialize(components(first), "jj-star-components")
        e = materialize(entries.join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node")), "jj-connected")
    mixed = (e.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
             .select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    open_ = materialize(e.join(mixed, "token"), "jj-open")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def side(x: str, own: str, other: str) -> DataFrame:
        return open_.select("token", mine.alias(own), every.alias(other), *(F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "pos", "component")))

    rest = (side("a", "i", "j").join(side("b", "j", "i"), ["token", "i", "j"])
            .where((F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component")) & _size_ok(percent) & _position_ok(percent))
            .select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct())
    rest = materialize(rest.join(star, ["a", "b"], "left_anti"), "jj-rest-pairs")
    links = materialize(first.unionByName(_verified(p, rest)), "jj-links")
    drop_written(docs.sparkSession, before, keep=1)  # only the links are read from here on
    return links


def _found(p: _Prepared, links: DataFrame, join_ids: bool) -> DataFrame:
    """(node, n, id, group, component) of every row with a set. Rows of a group
    are connected by links, and with ``join_ids`` by the same id; component is
    the smallest id in it."""
    owned = materialize(p.with_id(p.known, "doc_id").join(p.reps, ["s1", "s2"]).select(F.col("doc_id").alias("node"), "n", "id", "rep"), "jj-members")
    edges = links.select("a", "b")
    if not p.plain and join_ids:
        several = owned.join(p.names.select("node").distinct(), "node", "left_semi")
        first = several.groupBy("id").agg(F.min("rep").alias("b"))  # the sets of an id meet in one of them
        edges = edges.unionByName(several.join(first, "id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct())
    found = materialize(components(edges).withColumnRenamed("node", "rep"), "jj-components")
    full = owned.join(found, "rep", "left").withColumn("group", F.coalesce("component", "rep")).drop("rep", "component")
    if p.plain:
        return full.withColumn("component", F.col("group"))
    full = materialize(full, "jj-found")
    return full.join(full.groupBy("group").agg(F.min("id").alias("component")), "group")


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id,
    the smallest doc_id that links of at least ``percent`` % lead to."""
    p = _Prepared(docs, words, percent)
    full = _found(p, similar_links(docs, words, percent, p), join_ids=True)
    alone = p.with_id(p.slim.where("n = 0 OR doc_id IS NULL"), "doc_id").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    if not p.plain:  # an empty text of an id that has others, too
        known = full.groupBy("id").agg(F.min("component").alias("least"))
        alone = alone.join(known, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return full.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(alone)


def link_counts(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs`` with a set: doc_id, n_shingles, n_copies (other rows
    with the same set) and n_links (rows with another, similar set)."""
    p = _Prepared(docs, words, percent)
    links = similar_links(docs, words, percent, p, every=True)
    sizes = materialize(p.known.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("rows")).join(p.reps, ["s1", "s2"]), "jj-sizes")
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    linked = both.join(sizes.select(F.col("rep").alias("other"), "rows"), "other").groupBy("rep").agg(F.sum("rows").alias("n_links"))
    counted = sizes.join(linked, "rep", "left").select("s1", "s2", (F.col("rows") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return p.with_id(p.known, "doc_id").join(counted, ["s1", "s2"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "n_copies", "n_links")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (all columns) without the near copies: of each component one
    row with the smallest id stays. Rows with other words stay, also where
    their id repeats; so do rows without words, or without an id."""
    before = written()
    p = _Prepared(docs, words, percent)
    marked = materialize(_found(p, similar_links(docs, words, percent, p), join_ids=False), "jj-marked")
    if p.plain:
        drop_written(docs.sparkSession, before, keep=1)  # only the marks are read from here on
        copies = marked.where("node <> group").select("node").distinct()
    else:
        keepers = marked.groupBy("group").agg(F.min(F.struct("id", "node"))["node"].alias("keeper"))
        copies = marked.join(keepers, "group").where("node <> keeper").select("node").distinct()
    copies = materialize(copies, "jj-copies")
    repeated = materialize(marked.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("node"), "jj-repeated")
    mark = free_name(docs, "node")
    rest = rows_of(p.with_node(docs, mark), copies.withColumnRenamed("node", mark), mark, without=True)
    if not repeated.isEmpty():
        again = repeated.withColumnRenamed("node", mark)
        rest = rows_of(rest, again, mark, without=True).unionByName(rows_of(rest, again, mark).dropDuplicates([mark]))
    return rest.select(*docs.columns)
