"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs (its lines). Every paragraph is
hashed to a wide vector and the fingerprint is the sum of the vectors, lane
by lane, modulo a power of two. So the order of the paragraphs does not
matter, and a paragraph is inserted or deleted by adding or subtracting its
vector, without the rest of the text.

A vector has two parts:

* identity lanes (32 lanes modulo 2**32): an extendable hash of the
  paragraph's UTF-8 bytes. Different multisets collide with probability
  2**-1024 for texts that were not made to collide.
* likeness lanes (256 lanes modulo 2**16): every pair of neighbouring words
  of the paragraph (every single word too, so that one-word paragraphs count)
  adds +1 or -1 to one hashed lane. The difference of two sums is then the
  sum of what only one text has, and the cosine of the two sums estimates
  how much the texts share. The standard error is about 1/16.

Edge cases: a null text is the empty text; the empty text has one empty
paragraph. Two texts without words are alike (1.0) when their fingerprints
are equal, else 0.0. A lane wraps at 2**16, so the likeness of texts that
repeat one word pair more than 32,767 times in excess may be off; equality is
not affected.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

ID_LANES, LIKE_LANES = 32, 256
#: Word hashes remembered by one worker.
MEMORY_WORDS = 300_000
#: Rows that one partition of the neighbour pass should get.
ROWS_PER_BUCKET = 8_192
#: At most so many buckets: their first ids are passed through the driver.
MAX_BUCKETS = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd 64-bit constant of Fibonacci hashing


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = h
        return h


_WORDS = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)  # fixed value: multiplier of a 64-bit finaliser
    return x ^ (x >> np.uint64(32))


class Fingerprint:
    """A multiset of paragraphs as the sum of their vectors."""

    __slots__ = ("ids", "like")

    def __init__(self, ids: np.ndarray | None = None, like: np.ndarray | None = None):
        self.ids = np.zeros(ID_LANES, dtype="<u4") if ids is None else ids
        self.like = np.zeros(LIKE_LANES, dtype="<u2") if like is None else like

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        return cls().insert(text or "")

    def insert(self, paragraphs: str, sign: int = 1) -> Fingerprint:
        """Add the paragraphs of a piece of text (sign -1: delete them)."""
        lines = paragraphs.split("\n")
        raw = b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(4 * ID_LANES) for p in lines)
        ids = np.frombuffer(raw, dtype="<u4").reshape(-1, ID_LANES).sum(axis=0, dtype=np.uint32)
        if len(_WORDS) > MEMORY_WORDS:
            _WORDS.clear()
        words = [p.split() for p in lines]
        flat = np.fromiter(map(_WORDS.__getitem__, (w for p in words for w in p)), dtype=np.uint64)
        self.ids = self.ids + ids if sign > 0 else self.ids - ids
        if len(flat):
            sizes = np.fromiter(map(len, words), dtype=np.int64)
            sizes = sizes[sizes > 0]
            inside = np.ones(len(flat), dtype=bool)  # a pair never crosses the end of a paragraph
            inside[np.cumsum(sizes) - 1] = False
            pairs = (flat[:-1] * np.uint64(3) + _mixed(flat[1:]))[inside[:-1]]
            h = _mixed(np.concatenate([flat, pairs]))
            lane = (h >> np.uint64(8)).astype(np.int64) % LIKE_LANES
            weight = np.where(h & np.uint64(1), 1, -1)
            weight[len(flat):] *= 2  # neighbours say more than words alone
            like = np.bincount(lane, weights=weight, minlength=LIKE_LANES).astype(np.int64).astype(np.uint16)
            self.like = self.like + like if sign > 0 else self.like - like
        return self

    def delete(self, paragraphs: str) -> Fingerprint:
        return self.insert(paragraphs, -1)

    def likeness(self, other: Fingerprint) -> float:
        """0 to 1: cosine of the likeness lanes as signed numbers, floored at 0."""
        if self == other:
            return 1.0
        a, b = (x.like.view("<i2").astype(np.float64) for x in (self, other))
        n = float(np.sqrt(a @ a) * np.sqrt(b @ b))
        return min(1.0, max(0.0, float(a @ b) / n)) if n else 0.0

    def __eq__(self, other) -> bool:
        return isinstance(other, Fingerprint) and bool((self.ids == other.ids).all() and (self.like == other.like).all())

    __hash__ = None

    def __str__(self) -> str:
        return base64.b64encode(self.ids.tobytes() + self.like.tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[: 4 * ID_LANES], "<u4").copy(), np.frombuffer(raw[4 * ID_LANES :], "<u2").copy())


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text_col`` (a map-only job)."""
    return add_columns(df, [text_col], [T.StructField(out_col, T.StringType())],
                       lambda texts: [pa.array([str(Fingerprint.of(x.as_py())) for x in texts], pa.string())])


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points of ``text`` replaced
    by the first as many (or all) of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _buckets(docs: DataFrame) -> list[int]:
    """Lower bounds of id ranges of about ROWS_PER_BUCKET rows each. They only
    decide where a row is worked on, so approximate quantiles do."""
    n = docs.count()
    wanted = min(MAX_BUCKETS, max(1, -(-n // ROWS_PER_BUCKET)))
    if wanted == 1:
        return []
    return sorted({int(x) for x in docs.approxQuantile("doc_id", [k / wanted for k in range(1, wanted)], 0.2 / wanted)})


def with_following(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (doc_id, text, bucket, own) and the number of buckets (numbered
    from 0, some may be empty) such that each bucket, sorted by
    (doc_id, text), holds a run of neighbouring documents and, as its last
    row with own = false, the first document of the next non-empty bucket
    (of the first bucket after the last).

    The texts are shuffled once: a row goes to the bucket of its id, and the
    few first documents also go, as copies, to the bucket before. Which
    documents are first comes from the ids alone; one id for each bucket
    passes through the driver (at most MAX_BUCKETS)."""
    ids = docs.select("doc_id")
    bounds = _buckets(ids.where("doc_id IS NOT NULL"))
    spark = docs.sparkSession
    if bounds:
        known = spark.sparkContext.broadcast(np.array(bounds, dtype=np.int64))

        def bucket_of(ids: pa.Array) -> list[pa.Array]:
            x = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            return [pa.array(np.searchsorted(known.value, x, side="right"), pa.int64())]

        def add(df):
            return add_columns(df, ["doc_id"], [T.StructField("bucket", T.LongType())], bucket_of, rows=1000)
    else:
        def add(df):
            return df.withColumn("bucket", F.lit(0).cast("long"))
    # The first document of a bucket: smallest id, null before all, ties by text.
    first = (add(ids).groupBy("bucket").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("has_null"))
             .select("bucket", F.when(F.col("has_null"), F.lit(None)).otherwise(F.col("doc_id")).cast("long").alias("doc_id")).collect())
    first.sort(key=lambda r: r["bucket"])
    before = {r["doc_id"]: first[k - 1]["bucket"] for k, r in enumerate(first)}
    copies = [(i, b) for i, b in before.items()]
    lead = spark.createDataFrame(copies or [(None, 0)], "first_id long, target long").where(F.lit(bool(copies)))
    own = add(docs).withColumn("own", F.lit(True))
    borrowed = (docs.join(F.broadcast(lead), F.col("doc_id").eqNullSafe(F.col("first_id")))  # at most MAX_BUCKETS rows
                .groupBy("first_id", "target").agg(F.min("text").alias("text"))  # of rows with one id, the first
                .select(F.col("first_id").alias("doc_id"), "text", F.col("target").alias("bucket"), F.lit(False).alias("own")))
    return own.unionByName(borrowed), len(bounds) + 1


def edit_report(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, the SHA-256 of its edited text (``edited``: the
    next document is the one that follows by ascending doc_id, after the last
    the first), the fingerprints of both texts, and the likeness of its
    fingerprint to the edited text's and to the next document's.

    Null ids come first, rows with the same id follow each other in the order
    of their texts; a lone document follows itself."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, buckets = with_following(d)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, fingerprint) of the row before
        for batch in batches:
            out = []
            for bucket, own, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                mine = Fingerprint.of(text)
                if held is not None and held[0] == bucket:
                    _, i, t, f = held
                    e = edited(t, text)
                    g = f if e == t else Fingerprint.of(e)
                    out.append((i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), str(f), str(g), f.likeness(g), f.likeness(mine)))
                held = (bucket, doc_id, text, mine) if own else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])],
                                                 names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return (rows.select("bucket", "own", "doc_id", "text").repartitionById(buckets, F.col("bucket").cast("int"))  # a bucket each: hashes would put several together
            .sortWithinPartitions("bucket", F.desc("own"), F.asc_nulls_first("doc_id"), "text").mapInArrow(run, schema))
