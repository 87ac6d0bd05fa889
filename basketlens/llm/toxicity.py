"""Toxicity scores from a weighted lexicon.

A text is folded first: compatibility forms, case and accents go, letters of
other scripts that look like Latin ones and digits that stand for letters
become those letters, invisible characters go, and what isn't a letter
becomes one space. Letters that are easily taken for each other (i, l, 1)
become the same one, in texts and lexicon alike.

The lexicon is learned from labelled texts: whole words and word beginnings
that are significantly more frequent in toxic ones, weighted by their log
odds ratio. It is matched by one Aho-Corasick automaton together with
exception phrases (a lexicon word with its neighbour, given by the caller or
seen repeatedly and only in clean texts); a match inside an exception doesn't
count. The sum of weights is divided by a power of the number of words, and
that density is mapped to a probability; power and map are fitted too.

The fit takes about SAMPLE_TOXIC and SAMPLE_CLEAN labelled ids, chosen by a
hash, and at most twice as many texts of them (those with the least hashes);
copies among them count once. Counting is a Spark job; the driver gets at most
MAX_CANDIDATES counted patterns and a few numbers for each sampled text.
Scoring is a map-only job over whole texts.

Edge cases: null, empty and wordless texts have no match and get the score of
a clean text, very long ones are matched whole; an empty table gives an empty
result; repeated labels of an id count by their largest; without toxic
labels every text scores 0; repeated rows and extra columns are kept, but one
that has the name of the score column is replaced.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, bounded_rows

SAMPLE_TOXIC, SAMPLE_CLEAN = 5_000, 10_000
MAX_CANDIDATES = 20_000
MAX_PATTERNS = 4_000
LEAST_TEXTS = 6          # toxic texts that a pattern occurs in
LEAST_G = 30.0           # its log-likelihood ratio statistic (or 1.2 for each toxic text, if they are few)
LEAST_WEIGHT = 2.0       # its log odds ratio
BEGINNINGS = range(4, 9)  # letters of a word beginning
LONGEST_WORD = 40        # longer words are only matched by their beginnings
THRESHOLD = 0.3

# Letters that look like Latin ones (Cyrillic, Greek, others).
_LOOKALIKES = {"а": "a", "α": "a", "ɑ": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "є": "e", "ɡ": "g",
               "һ": "h", "н": "h", "і": "i", "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "п": "n", "η": "n",
               "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v",
               "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d"}
# Digits that stand for letters.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
_CONFUSED = {"l": "i"}
_TABLE = {ord(k): "".join(_CONFUSED.get(c, c) for c in v) for k, v in {**_LOOKALIKES, **_DIGITS, **_CONFUSED}.items()}
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿̀-ͯ]+")
_SIGNS = re.compile("[@$](?=[a-z])")
_OTHER = re.compile(r"[^a-zɐ-￿\U00010000-\U0010ffff]+|[ -⯿　-〿]+")


def fold(text: str | None) -> str:
    """The words of a text, folded, each between single spaces; " " if none."""
    if not text:
        return " "
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower().translate(_TABLE)
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    text = _OTHER.sub(" ", text).strip()
    return f" {text} " if text else " "


def signature(folded: str) -> str:
    """The same for copies and most near copies of a text: the least hashes
    of its words under two seeds."""
    words = set(folded.split())
    return " ".join(str(min((zlib.crc32(w.encode("utf-8", "surrogatepass"), seed) for w in words), default=0)) for seed in (1, 77))


def patterns(folded: str) -> set[str]:
    """Whole words (" word ") and word beginnings (" wor") of a folded text."""
    out = set()
    for w in set(folded.split()):
        if 3 <= len(w) <= LONGEST_WORD:
            out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in BEGINNINGS if k <= len(w))
    return out


class Match(NamedTuple):
    start: int
    end: int
    weight: float
    pattern: str


class Lexicon:
    """Weighted patterns and exception phrases in one automaton, with the map
    from matches to a score."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = (), power: float = 0.0, line: tuple[float, float] = (-4.0, 2.0)):
        self.weights, self.exceptions = dict(weights), sorted({fold(x) for x in exceptions} - {" "})
        self.power, self.line = power, line
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _built(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for x in self.exceptions:
                a.add_word(x, (x, None))
            for p, w in self.weights.items():
                if p not in a:
                    a.add_word(p, (p, w))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, folded: str) -> list[Match]:
        """Weighted matches outside exception phrases."""
        a = self._built()
        if not len(a):
            return []
        found, spared = [], []
        for end, (p, w) in a.iter(folded):
            if w is None:
                spared.append((end - len(p) + 1, end))
            else:
                found.append(Match(end - len(p) + 1, end, w, p))
        return [m for m in found if not any(s <= m.start and m.end <= e for s, e in spared)] if spared else found

    def raw(self, text: str | None) -> tuple[float, int]:
        """(sum of weights, number of words)."""
        folded = fold(text)
        return sum(m.weight for m in self.matches(folded)), folded.count(" ") - 1

    def density(self, total, words):
        return np.log1p(np.asarray(total) / np.maximum(1.0, np.asarray(words) / 100.0) ** self.power)

    def score(self, text: str | None) -> float:
        total, words = self.raw(text)
        return float(1 / (1 + np.exp(-(self.line[0] + self.line[1] * self.density(total, words)))))


def _fit_line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[tuple[float, float], float]:
    """Weighted logistic regression on one variable with a weak prior:
    ((intercept, slope), loss)."""
    b = np.zeros(2)
    z = np.column_stack([np.ones_like(x), x])
    ridge = np.diag([1e-6, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (y - p)) - ridge @ b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ b, -30, 30))), 1e-12, 1 - 1e-12)
    return (float(b[0]), max(0.0, float(b[1]))), float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def _counted(sample: DataFrame, of, name: str) -> DataFrame:
    """Texts of either label that each string of ``of(text)`` occurs in:
    name, toxic, clean. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            arrays = [pa.array(keys, pa.string()), *(pa.array([counts[k][x] for x in keys], pa.int64()) for k in (1, 0))]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[name, "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[toxic].update(of(text.as_py()))
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield out()
        yield out()

    return (sample.select("text", "toxic").mapInArrow(run, f"{name} string, toxic long, clean long")
            .groupBy(name).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _g(a, b, n_a: int, n_b: int):
    """Log-likelihood ratio statistic of a of n_a and b of n_b, as columns."""
    def term(x, n, total):
        expected = (a + b) * F.lit(n / total)
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    return (term(a, n_a, n_a + n_b) + term(b, n_b, n_a + n_b)) * 2


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([signature(fold(x.as_py())) for x in batch.column(0)], pa.string())], names=["text", "toxic", "signature"])


def learn(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = ()) -> Lexicon:
    """A lexicon from ``labels`` (doc_id, toxic 0/1; the caller leaves held-out
    rows away) and the texts of ``docs`` (doc_id, text)."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .where("toxic IN (0, 1)").persist())
    try:
        n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
        if not n.get(1) or not n.get(0):
            return Lexicon({}, exceptions, line=(-30.0, 0.0))
        spread = F.pmod(F.xxhash64("label_id", F.lit(5)), F.lit(1 << 30))
        size = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
        chosen = [known.where((F.col("toxic") == t) & (spread < int(min(1.0, size[t] / n[t]) * (1 << 30)))).limit(2 * size[t]) for t in (1, 0)]
        ids = chosen[0].unionByName(chosen[1])
        # at most 2 * (SAMPLE_TOXIC + SAMPLE_CLEAN) ids
        sample = (docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
                  .select("text", "toxic"))
        sample = bounded_rows(sample, 2 * (SAMPLE_TOXIC + SAMPLE_CLEAN)).mapInArrow(_signed, "text string, toxic int, signature string")
        # copies say the same thing once
        sample = sample.groupBy("signature", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").persist()
        try:
            return _learned(sample, n, exceptions)
        finally:
            sample.unpersist()
    finally:
        known.unpersist()


def _learned(sample: DataFrame, n: dict[int, int], exceptions: Iterable[str]) -> Lexicon:
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_t, n_c = seen.get(1, 0), seen.get(0, 0)
    if not n_t or not n_c:
        return Lexicon({}, exceptions, line=(-30.0, 0.0))
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    weight = F.log((a + 0.5) / (n_t - a + 0.5)) - F.log((b + 0.5) / (n_c - b + 0.5))
    rows = (_counted(sample, lambda t: patterns(fold(t)), "pattern").where(a >= min(LEAST_TEXTS, max(2, n_t // 10)))
            .select("pattern", weight.alias("weight"), _g(a, b, n_t, n_c).alias("g"))
            .where((F.col("weight") >= LEAST_WEIGHT) & (F.col("g") >= min(LEAST_G, 1.2 * n_t)))
            .orderBy(F.desc("g"), F.length("pattern"), "pattern").limit(MAX_CANDIDATES).collect())
    weights: dict[str, float] = {}
    taken: set[str] = set()       # all beginnings of the chosen patterns
    for r in rows:  # strongest first; of a word and its beginnings one is enough
        p = r["pattern"]
        heads = {p.rstrip()[:k] for k in range(2, len(p.rstrip()) + 1)}
        if p.rstrip() in taken or any(h in weights for h in heads) or len(weights) >= MAX_PATTERNS:
            continue
        weights[p] = float(r["weight"])
        taken |= heads
    first = Lexicon(weights, exceptions)

    def phrases(text: str) -> set[str]:
        folded, out = fold(text), set()
        for m in first.matches(folded):
            word_end = folded.index(" ", m.start + 1)
            before = folded.rfind(" ", 0, m.start) if m.start else -1
            after = folded.find(" ", word_end + 1)
            if before >= 0:
                out.add(folded[before : word_end + 1])
            if after > 0:
                out.add(folded[word_end - (word_end - m.start) : after + 1])
        return out

    spared = (_counted(sample, phrases, "phrase").where("toxic = 0 AND clean >= 5").orderBy(F.desc("clean"), "phrase").limit(MAX_PATTERNS).collect()) if weights else []
    lexicon = Lexicon(weights, [*exceptions, *(r["phrase"] for r in spared)])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.raw(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([float(x) for x, _ in found]), pa.array([int(x) for _, x in found]), batch.column(1)], names=["total", "words", "toxic"])

    got = sample.select("text", "toxic").mapInArrow(numbers, "total double, words long, toxic int").collect()
    total, words, y = (np.array([r[k] for r in got], dtype=float) for k in range(3))
    w = np.where(y == 1, n[1] / n_t, n[0] / n_c)  # as frequent as among all labels
    w /= w.mean()
    best = None
    for power in (0.25, 0.5, 0.75, 1.0):
        lexicon.power = power
        line, loss = _fit_line(lexicon.density(total, words), y, w)
        if best is None or loss < best[0] - 1e-9:
            best = (loss, power, line)
    _, lexicon.power, lexicon.line = best
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` (all columns) with the score of each whole text, 0 to 1. The
    lexicon is broadcast (at most MAX_PATTERNS patterns and the exceptions)."""
    known = docs.sparkSession.sparkContext.broadcast(lexicon)
    return add_columns(docs, [text_col], [T.StructField(score_col, T.DoubleType())],
                       lambda texts: [pa.array([known.value.score(x.as_py()) for x in texts], pa.float64())], rows=1000)
