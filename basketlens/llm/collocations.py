"""Phrases of two to five words that occur together more often than their parts.

Texts (A-Z lower-cased) are cut into pieces at ``.,;:!?`` and line ends, and
pieces into words at spaces and tabs; each language is counted for itself. A
candidate is a phrase with at least ``min_count`` occurrences. Its score is
floor(1000 * a * n / (l * r)) of its lowest-scoring cut into two parts.

Counting. Words are 64-bit ids (a hash of language and word; a collision among
the counted words is found, and another hash is taken). A task counts phrases
in a HAT-trie (``HatTrie``): hash containers, keyed by the remaining words,
under a shallow trie of word ids; a container that grows too large bursts
into one for each next word. When a task's trie is full, its largest subtrees
are written out whole as sorted runs and freed. Runs are cut by prefix
partition (a hash of the first words, up to three), shuffled there, and
merged partition by partition, where counts are added up and rare phrases go.

A phrase occurs no more often than its parts. So the texts are read three
times: for words, then for pairs of frequent words, then for longer phrases of
frequent pairs. Whether a word or pair is frequent is asked of a broadcast
bitmap of at most FILTER_BITS bits, without false negatives; a false positive
is counted and dropped at the merge. Results are exact at any size.

Hot groups: a frequent word's phrases are spread over partitions by three
words, and each task sends a phrase once for each of its runs. Scores, drops
and ranks are joins and groupings over frequent phrases only.

Edge cases: null texts are empty; a null language counts as ``und``; empty
tables and languages without candidates give no rows; repeated rows count
again; ids and extra columns play no part; long texts and words are taken
whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialize
from .texthash import Chunk, constants, mix, word_chunks

FILTER_BITS = 1 << 28      # bits of a filter at most (32 MB)
TRIE_ENTRIES = 400_000     # phrases that a task holds
WORD_ENTRIES = 200_000     # words that a task holds
BURST = 2_048              # phrases of a container
DEPTH = 3                  # words of a phrase that the trie may branch on
GROUP_BYTES = 32 << 20     # of runs in a prefix partition, about

_U = np.uint64
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[[0x20, 0x09]] = True


class HatTrie:
    """Counts of phrases, given as 8 bytes (big-endian) a word."""

    class Node(dict):
        """Children by their next word; a child is a Node or a container, a
        plain dict from the remaining words to a count."""

    def __init__(self, limit: int = TRIE_ENTRIES, burst: int = BURST):
        self.root, self.limit, self.burst, self.entries = HatTrie.Node(), limit, burst, 0

    def add(self, keys: Iterable[bytes], counts: Iterable[int]) -> None:
        node, root, new = HatTrie.Node, self.root, 0
        for key, count in zip(keys, counts):
            place, at = root, 0
            while type(place) is node:
                word = key[at : at + 8]
                at += 8
                above, place = place, place.get(word)
                if place is None:
                    place = above[word] = {}
            rest = key[at:]
            if rest in place:
                place[rest] += count
            else:
                place[rest] = count
                new += 1
                if len(place) > self.burst and at < 8 * DEPTH and rest:
                    above[key[at - 8 : at]] = self._burst(place)
        self.entries += new

    @staticmethod
    def _burst(container: dict[bytes, int]) -> dict:
        """A node with a container for each next word; a phrase that ends here
        stays under the empty word."""
        made = HatTrie.Node()
        for rest, count in container.items():
            made.setdefault(rest[:8], {})[rest[8:]] = count
        return made

    def _sorted(self, place: dict, prefix: bytes) -> Iterator[tuple[bytes, int]]:
        inner = type(place) is HatTrie.Node
        for word in sorted(place):
            if inner:
                yield from self._sorted(place[word], prefix + word)
            else:
                yield prefix + word, place[word]

    def _size(self, place: dict) -> int:
        return sum(map(self._size, place.values())) if type(place) is HatTrie.Node else len(place)

    def full(self) -> bool:
        return self.entries > self.limit

    def spill(self, keep: float = 0.0) -> Iterator[tuple[bytes, int]]:
        """Free the largest subtrees until the share ``keep`` of the limit is
        left; their phrases and counts, sorted."""
        sizes = sorted(((self._size(place), word) for word, place in self.root.items()), reverse=True)
        gone = []
        for size, word in sizes:
            if self.entries <= keep * self.limit and keep:
                break
            gone.append(word)
            self.entries -= size
        for word in sorted(gone):
            yield from self._sorted(self.root.pop(word), word)


class Bits:
    """A set of 64-bit hashes, as a bitmap of their lowest bits."""

    def __init__(self, blocks: list[tuple[int, bytes]], size: int):
        self.size, self.data = size, np.zeros(size // 8, np.uint8)
        for block, found in blocks:  # 4 KB each, as bitmap_construct_agg makes them
            self.data[block * 4096 : (block + 1) * 4096] = np.frombuffer(found, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & _U(self.size - 1)
        return (self.data[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _U(0x9E3779B97F4A7C15) + second)


def _salt(lang: str, extra: str = "") -> int:
    return int.from_bytes(hashlib.blake2b(f"{lang}\t{extra}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _word_ids(chunk: Chunk, langs: list[str]) -> np.ndarray:
    salts = np.array([_salt(x) for x in langs], dtype=np.uint64)
    return mix(chunk.hashes ^ np.repeat(salts, np.diff(chunk.edges)))


def _chunks(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[Chunk, list[str]]]:
    """Chunks of a (lang, text) batch with the language of each text."""
    at = 0
    langs = batch.column(0).to_pylist()
    for chunk in word_chunks(batch.column(1), _SEPARATOR, constants(256, seed)):
        n = len(chunk.offsets) - 1
        yield chunk, langs[at : at + n]
        at += n


def _together(chunk: Chunk) -> np.ndarray:
    """Whether word i and word i + 1 are in the same piece, for all but the last."""
    breaks = np.concatenate(([0], np.cumsum(_BREAK[chunk.raw])))
    out = breaks[chunk.begin[1:]] == breaks[chunk.end[:-1]]
    last = chunk.edges[1:-1] - 1  # a text's last word has no next one
    out[last[(last >= 0) & (last < len(out))]] = False
    return out


def _repeats(chunk: Chunk, first: np.ndarray) -> np.ndarray:
    """Whether each word has the same (lower-cased) bytes as the word that
    ``first`` names for it."""
    raw = np.where((chunk.raw >= 65) & (chunk.raw <= 90), chunk.raw + 32, chunk.raw)
    size = chunk.end - chunk.begin
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    other = np.minimum(np.repeat(chunk.begin[first], size) + at, len(raw) - 1)
    differs = raw[np.repeat(chunk.begin, size) + at] != raw[other]
    bad = np.bincount(np.repeat(np.arange(len(size)), size)[differs], minlength=len(size)) > 0
    return ~bad & (size == size[first])


def _count_words(seed: int):
    """(id, entry, n) rows: words of the rows read, the entry being language,
    tab and word; also one row with an empty word for each language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        entries: dict[int, str] = {}
        odd: list[tuple[int, str]] = []  # words whose id another one has

        def out() -> pa.RecordBatch:
            ids = [*counts, *(i for i, _ in odd)]
            made = pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), pa.array([*(entries[i] for i in counts), *(e for _, e in odd)], pa.string()),
                                               pa.array([*counts.values(), *(0 for _ in odd)], pa.int64())], names=["id", "entry", "n"])
            for x in (counts, entries, odd):
                x.clear()
            return made

        for batch in batches:
            for chunk, langs in _chunks(batch, seed):
                ids = _word_ids(chunk, langs)
                found, first, inverse, n = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
                text = np.searchsorted(chunk.edges, first, side="right") - 1

                def entry(word: int, doc: int) -> str:
                    return langs[doc] + "\t" + chunk.raw[chunk.begin[word] : chunk.end[word]].tobytes().lower().decode("utf-8", "replace")

                for i, c, word, doc in zip(found.tolist(), n.tolist(), first.tolist(), text.tolist()):
                    if i in counts:
                        counts[i] += c
                    else:
                        counts[i], entries[i] = c, entry(word, doc)
                if len(ids):
                    for word in np.flatnonzero(~_repeats(chunk, first[inverse])).tolist():
                        odd.append((int(ids[word]), entry(word, int(np.searchsorted(chunk.edges, word, side="right")) - 1)))
                for lang, c in zip(langs, np.diff(chunk.edges).tolist()):
                    i = _salt(lang, "words")
                    counts[i] = counts.get(i, 0) + c
                    entries[i] = f"{lang}\t"
                if len(counts) > WORD_ENTRIES:
                    yield out()
        yield out()
    return run


def _phrases(ids: np.ndarray, linked: np.ndarray, lengths: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct phrases as rows of ids, counts) of each length, where
    linked[i] says that word i and word i + 1 may follow each other."""
    words, code = np.unique(ids, return_inverse=True)
    start, number, kinds = np.arange(len(ids)), code, [words[:, None]]
    for length in range(2, lengths.stop):
        # phrases of the length before that go on with one more word
        on = start + length - 2
        go = on < len(linked)
        go[go] = linked[on[go]]
        start, number = start[go], number[go]
        if not len(start):
            return
        both, number, n = np.unique(number * len(words) + code[start + length - 1], return_inverse=True, return_counts=True)
        made = np.concatenate([kinds[0][both // len(words)], words[both % len(words)][:, None]], axis=1)
        kinds = [made]
        if length in lengths:
            yield made, n


def _runs(found: Iterator[tuple[bytes, int]], groups: int) -> Iterator[pa.RecordBatch]:
    """Sorted phrases as (part, words, keys, counts) rows, one for each prefix
    partition and phrase length."""
    by_length: dict[int, tuple[list[bytes], list[int]]] = {}
    for key, count in found:
        keys, counts = by_length.setdefault(len(key) // 8, ([], []))
        keys.append(key)
        counts.append(count)
    for length, (keys, counts) in by_length.items():
        ids = np.frombuffer(b"".join(keys), ">u8").reshape(-1, length)
        prefix = np.zeros(len(ids), np.uint64)
        for k in range(min(DEPTH, length)):
            prefix = pair_hash(prefix, ids[:, k].astype(np.uint64))
        part = (prefix >> _U(16)) % _U(groups)
        order = np.argsort(part, kind="stable")  # sorted within each partition
        edges = np.flatnonzero(np.diff(part[order], prepend=_U(groups)))
        ids, n = ids[order], np.array(counts, dtype=np.int64)[order]
        ends = [*edges[1:].tolist(), len(ids)]
        yield pa.RecordBatch.from_arrays([
            pa.array(part[order][edges].astype(np.int64)), pa.array([length] * len(edges), pa.int32()),
            pa.array([ids[a:b].tobytes() for a, b in zip(edges.tolist(), ends)], pa.binary()),
            pa.array([n[a:b].tobytes() for a, b in zip(edges.tolist(), ends)], pa.binary())], names=["part", "words", "keys", "counts"])


def _count_phrases(seed: int, lengths: range, groups: int, words, pairs=None):
    """Runs of the phrases of these lengths whose words, and pairs if given,
    are in the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie()
        for batch in batches:
            for chunk, langs in _chunks(batch, seed):
                ids = _word_ids(chunk, langs)
                if len(ids) < 2:
                    continue
                often = words.value.has(ids)
                linked = _together(chunk) & often[:-1] & often[1:]
                if pairs is not None:
                    at = np.flatnonzero(linked)
                    linked[at] = pairs.value.has(pair_hash(ids[at], ids[at + 1]))
                for made, n in _phrases(ids, linked, lengths):
                    raw = made.astype(">u8").tobytes()
                    width = 8 * made.shape[1]
                    trie.add((raw[i : i + width] for i in range(0, len(raw), width)), n.tolist())
                if trie.full():
                    yield from _runs(trie.spill(keep=0.5), groups)
        yield from _runs(trie.spill(), groups)
    return run


def _merge(min_count: int):
    """Frequent phrases (key, words, a, id) of a prefix partition's runs."""

    def run(table: pa.Table) -> pa.Table:
        length = table.column("words")[0].as_py()
        ids = np.frombuffer(b"".join(x.as_py() for x in table.column("keys")), ">u8").reshape(-1, length).astype(np.uint64)
        counts = np.frombuffer(b"".join(x.as_py() for x in table.column("counts")), np.int64)
        order = np.lexsort(ids.T[::-1])  # merges the sorted runs
        ids, counts = ids[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1))))
        total = np.add.reduceat(counts, first)
        often = total >= min_count
        ids, total = ids[first][often], total[often]
        spots = pair_hash(ids[:, 0], ids[:, 1]).view(np.int64)
        return pa.table({"key": pa.array([x.tobytes() for x in ids.astype(">u8")], pa.binary()), "words": pa.array(np.full(len(ids), length, np.int32)),
                         "a": pa.array(total), "id": pa.array(spots)})
    return run


def frequent_bits(ids: DataFrame) -> Bits:
    """The hashes in column ``id`` as a filter: 16 bits for each, FILTER_BITS
    at most."""
    size = 1 << 16
    n = ids.count()
    while size < min(16 * n, FILTER_BITS):
        size *= 2
    at = F.col("id").bitwiseAND(F.lit(size - 1))
    blocks = (ids.groupBy(F.floor(at / 32768).alias("block")).agg(F.bitmap_construct_agg(at % 32768).alias("bits"))
              .collect())  # FILTER_BITS / 8 bytes at most
    return Bits([(r["block"], bytes(r["bits"])) for r in blocks], size)


def count_words(texts: DataFrame, min_count: int, seed: int) -> DataFrame:
    """Frequent words (id, n, lang, word) of (lang, text) rows; the empty word
    of each language stands for all its words."""
    counted = (texts.mapInArrow(_count_words(seed), "id long, entry string, n long").groupBy("id")
               .agg(F.sum("n").alias("n"), F.min("entry").alias("entry"), F.max("entry").alias("other")))
    word = F.substring_index("entry", "\t", -1)
    return materialize(counted.select("id", "n", F.expr("left(entry, length(entry) - length(substring_index(entry, '\t', -1)) - 1)").alias("lang"), word.alias("word"),
                                      (F.col("entry") != F.col("other")).alias("clash")).where((F.col("n") >= min_count) | (F.col("word") == "")), "collocation-words")


def frequent_phrases(texts: DataFrame, min_count: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases: key, words, a, lang for single words only; words: key, word;
    totals: lang, n) of (lang, text) rows. A key is 8 bytes a word."""
    for seed in (101, 102, 103):
        words = count_words(texts, min_count, seed)
        if words.where("clash").isEmpty():
            break
    else:
        raise ValueError("three hashes in a row gave different words the same id")
    spark = texts.sparkSession
    totals = words.where("word = ''").select("lang", "n").where("n > 0")
    words = words.where("word <> ''")
    n = totals.agg(F.sum("n")).first()[0] or 0
    groups = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(n) * 24 // GROUP_BYTES)
    merged = "key binary, words int, a long, id long"
    known = spark.sparkContext.broadcast(frequent_bits(words))

    def counted(lengths: range, name: str, *filters) -> DataFrame:
        runs = texts.mapInArrow(_count_phrases(seed, lengths, groups, *filters), "part long, words int, keys binary, counts binary")
        return materialize(runs.groupBy("part", "words").applyInArrow(_merge(min_count), merged), name)

    pairs = counted(range(2, 3), "collocation-pairs", known)
    found = pairs
    if longest > 2:
        found = pairs.unionByName(counted(range(3, longest + 1), "collocation-longer", known, spark.sparkContext.broadcast(frequent_bits(pairs))))
    keyed = words.select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key"), "word", "lang", F.col("n").alias("a"))
    phrases = keyed.select("key", F.lit(1).alias("words"), "a", "lang").unionByName(found.select("key", "words", "a"), allowMissingColumns=True)
    return materialize(phrases, "collocation-phrases"), keyed.select("key", "word"), totals


def _part(key: Column, first, count) -> Column:
    """Words ``first`` (from 0) and on of a key, ``count`` of them."""
    return key.substr(F.lit(8) * first + 1, F.lit(8) * count)


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, percent: int = 100) -> DataFrame:
    """The best ``top`` phrases of each language of ``docs`` (lang, text):
    lang, rank, phrase, a, l, r, n, score. Phrases go that lie inside a longer
    candidate with at least ``percent`` % of their occurrences."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    phrases, words, totals = frequent_phrases(texts, min_count, longest)
    candidates = phrases.where("words > 1").select("key", "words", "a")
    # a phrase inside a longer one is inside one that is longer by a word, which occurs at least as often
    longer = candidates.where("words > 2").select(F.explode(F.array(_part(F.col("key"), F.lit(0), F.col("words") - 1), _part(F.col("key"), F.lit(1), F.col("words") - 1))).alias("inner"), "a")
    longer = longer.groupBy("inner").agg(F.max("a").alias("most"))
    kept = candidates.join(longer, F.col("key") == F.col("inner"), "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * percent)).drop("inner", "most")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    left = phrases.select(F.col("key").alias("left_key"), F.col("a").alias("l"), "lang")
    right = phrases.select(F.col("key").alias("right_key"), F.col("a").alias("r"))
    cuts = (cuts.join(left, _part(F.col("key"), F.lit(0), F.col("k")) == F.col("left_key"))
            .join(right, _part(F.col("key"), F.col("k"), F.col("words") - F.col("k")) == F.col("right_key")))
    whole = cuts.groupBy("key").agg(F.max("lang").alias("lang"), F.max("a").alias("a"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))  # the first cut's left part is a word
    few = totals.count() <= BROADCAST_IDS
    whole = whole.join(F.broadcast(totals) if few else totals, "lang")

    def big(col: Column) -> Column:
        return col.cast("decimal(19,0)")

    each = F.transform("cuts", lambda c: F.struct(F.call_function("div", F.lit(1000).cast("decimal(38,0)") * (big(F.col("a")) * big(F.col("n"))), big(c["l"]) * big(c["r"])).alias("score"),
                                                  c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    scored = whole.withColumn("cut", F.array_min(each)).select("lang", "key", "a", "n", "cut.score", "cut.l", "cut.r")
    by_lang = Window.partitionBy("lang")
    best = scored.withColumn("place", F.rank().over(by_lang.orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top).drop("place")
    best = materialize(best, "collocation-best")  # top rows of each language, and ties of the last
    spelled = (best.select("key", F.posexplode(F.transform(F.sequence(F.lit(1), F.expr("int(length(key) div 8)")), lambda i: _part(F.col("key"), (i - 1).cast("int"), F.lit(1)))).alias("at", "word_key"))
               .join(words.withColumnRenamed("key", "word_key"), "word_key").groupBy("key")
               .agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.struct("at", "word")))["word"]).alias("phrase")))
    rank = F.row_number().over(by_lang.orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.join(spelled, "key").withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
