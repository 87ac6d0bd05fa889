"""Benchmark passages inside documents.

Texts are normalised to words: A-Z become a-z, every other character below
0x80 but 0-9 and a-z separates words, all characters from 0x80 on belong to
words. A window is WINDOW consecutive words of a benchmark item; an item of
fewer words, but not none, is one window.

All windows are the patterns of one Aho-Corasick automaton over normalised
text (words between single spaces, so that a pattern only matches whole
words). Each document is normalised and scanned once. A match gives the
number of its last word, hence the words of the document that the window
covers; the runs of covered words are mapped back to code points of the
original text.

The automaton is broadcast, so its size is bounded: windows are cut into
blocks and dealt into as many automata as keep each below MAX_PATTERN_BYTES
(one, for benchmarks up to some 60,000 windows). With several, documents are
scanned by one after the other, a written table between them, so that a
worker holds one automaton at a time; results are the same.

Edge cases: null, empty and wordless texts have no words and no hits; a null
or wordless item has no windows; a null item id counts as an item, listed as
an empty string; rows that repeat an item id are one item with the windows of
all of them; an empty benchmark hits nothing; repeated documents and extra
columns are kept, but a column that has the name of a result is replaced;
long texts and items are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, free_name, materialize

WINDOW = 10
MAX_PATTERN_BYTES = 4 << 20    # patterns of one automaton
BLOCK_BYTES = 64 << 10         # patterns that are dealt together

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False)
RESULTS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType(), False)),
           T.StructField("spans", _SPANS)]


def folded(text: str | None) -> bytes:
    """The UTF-8 text with A-Z lower-cased and a space for every separator;
    as long as the text."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""


def patterns(words: list[bytes], window: int = WINDOW) -> list[bytes]:
    """The windows of an item's words, each between single spaces."""
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))] if words else []


class PassageFinder:
    """Windows of benchmark items in one automaton."""

    def __init__(self, found: list[tuple[str, bytes]]):
        """``found``: (item id, pattern) pairs."""
        owners: dict[bytes, set[str]] = {}
        for item, pattern in found:
            owners.setdefault(pattern, set()).add(item)
        self.patterns = list(owners)
        self.owners = [tuple(owners[p]) for p in self.patterns]
        self.widths = [p.count(b" ") - 1 for p in self.patterns]
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _built(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for i, p in enumerate(self.patterns):
                a.add_word(p.decode("latin-1"), i)  # one character for each byte
            if self.patterns:
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which of a text's words lie in an occurrence of a window (None: no
        word), and the items with occurring windows."""
        if not words or not self.patterns:
            return None, set()
        text = b" " + b" ".join(words) + b" "
        matches = list(self._built().iter(text.decode("latin-1")))
        if not matches:
            return None, set()
        ends = np.fromiter((m[0] for m in matches), np.int64, len(matches))
        which = np.fromiter((m[1] for m in matches), np.int64, len(matches))
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        after = np.searchsorted(spaces, ends)  # words up to the match's end
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, after - np.asarray(self.widths)[which], 1)
        np.add.at(change, after, -1)
        return np.cumsum(change[:-1]) > 0, {x for i in set(which.tolist()) for x in self.owners[i]}


def original_spans(raw: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code points (from, to) of the original text whose
    folded bytes are ``raw``."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], data != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])  # begin and end of each word, in turn
    run = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    begin, end = points[edge[0::2][run[0::2]]], points[edge[1::2][run[1::2] - 1]]
    return [{"begin": int(b), "end": int(e)} for b, e in zip(begin, end)]


def _blocks(window: int):
    """(item, patterns, size) rows of an item's windows in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block, size = [], 0
                for p in patterns(folded(text.as_py()).split(), window):
                    block.append(p)
                    size += len(p)
                    if size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_pydict({"item": [item], "patterns": [block], "size": [size]}, schema)
                        block, size = [], 0
                if block:
                    yield pa.RecordBatch.from_pydict({"item": [item], "patterns": [block], "size": [size]}, schema)

    schema = pa.schema([("item", pa.string()), ("patterns", pa.list_(pa.binary())), ("size", pa.int64())])
    return run


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, drop_text: bool = False) -> DataFrame:
    """``docs`` (all columns) with n_words, n_hit (words inside occurring
    windows), items (ids of items with occurring windows, sorted) and spans
    (begin, end of the hit runs, in code points of the text).

    ``benchmark``: item_id, text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    blocks = items.mapInArrow(_blocks(window), "item string, patterns array<binary>, size long")
    shards = 1
    size = blocks.agg(F.sum("size")).first()[0] or 0
    if size > MAX_PATTERN_BYTES:
        shards = -(-2 * size // MAX_PATTERN_BYTES)
        blocks = materialize(blocks, "benchmark-windows")
    spark, bits, out = docs.sparkSession, free_name(docs, "bits"), docs
    for shard in range(shards):
        part = blocks if shards == 1 else blocks.where(F.pmod(F.xxhash64("item", "patterns"), F.lit(shards)) == shard)
        # at most MAX_PATTERN_BYTES of patterns (a share of 1 / shards, twice as many as needed)
        finder = spark.sparkContext.broadcast(PassageFinder([(r["item"], bytes(p)) for r in part.select("item", "patterns").collect() for p in r["patterns"]]))
        last = shard == shards - 1
        out = add_columns(out, [text_col] if not shard else [text_col, bits, "items"], [*RESULTS, *([] if last else [T.StructField(bits, T.BinaryType())])],
                          _scanner(finder, last), drop=(*((text_col,) if last and drop_text else ()), *((bits,) if last and shard else ())))
        if not last:
            out = materialize(out, f"decontaminate-{shard}")
    return out


def _scanner(finder, last: bool):
    def compute(texts: pa.Array, before: pa.Array | None = None, known: pa.Array | None = None) -> list[pa.Array]:
        n_words, n_hit, items, spans, bits = [], [], [], [], []
        for i, text in enumerate(texts):
            raw = folded(text.as_py())
            words = raw.split()
            hit, found = finder.value.scan(words)
            if before is not None and before[i].as_py():
                earlier = np.unpackbits(np.frombuffer(before[i].as_py(), np.uint8), count=len(words)).astype(bool)
                hit = earlier if hit is None else hit | earlier
                found = found | set(known[i].as_py())
            n_words.append(len(words))
            n_hit.append(0 if hit is None else int(hit.sum()))
            items.append(sorted(found))
            spans.append([] if hit is None else original_spans(raw, hit))
            bits.append(b"" if hit is None else np.packbits(hit).tobytes())
        out = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
               pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
        return out if last else [*out, pa.array(bits, pa.binary())]
    return compute


def without_passages(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` of ``find`` with the hit passages cut out of their texts (null
    texts stay null)."""
    at = F.aggregate(F.col(spans_col), F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
                     lambda acc, s: F.struct(F.concat(acc["text"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (s["begin"] - acc["at"]).cast("int"))).alias("text"),
                                             s["end"].alias("at")))
    cut = F.concat(at["text"], F.substring(F.col(text_col), (at["at"] + 1).cast("int"), F.length(text_col)))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), cut))
