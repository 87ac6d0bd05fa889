"""Quality classifier by positive-unlabelled learning.

Only trusted positives (texts labelled good) and unlabelled web text are
used; texts labelled bad play no part in the fit. A small network on
measures of the whole text minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

where, when the second term turns negative on a batch, the step goes the
other way for it. The class prior (the share of good texts among the
unlabelled) is estimated first: a network tells positives from unlabelled
texts, and the prior is the smallest ratio, over score thresholds, of the
share of unlabelled texts above the threshold to that of positives, less
its standard error. (A prior that is too large would keep the risk from
ever calling a text bad; one that is a little too small only costs a few
hundredths of the scores of good texts.)

The fit takes about SAMPLE_POSITIVE and SAMPLE_UNLABELLED ids, chosen by a
hash, and at most twice as many rows of them (of an id's texts those with the
least hashes); measuring and scoring are map-only jobs over whole texts.

Edge cases: null and empty texts have measures like any other (all zero), very
long ones are measured whole; an empty table gives an empty result;
rows of ``labels`` that repeat an id or have null labels are reduced to the
largest label or ignored; without positives every text scores 0.5; repeated
rows and extra columns are kept, but one that has the name of the score
column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, bounded_rows
from .texthash import Chunk, constants, mix, word_chunks

SAMPLE_POSITIVE = 12_000
SAMPLE_UNLABELLED = 24_000
WINDOW = 32              # words of a window for local measures
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 512, 0.01, 1e-4
THRESHOLD = 0.3

MEASURES = ("words", "bytes", "word length", "its deviation", "upper case", "digits", "symbol words", "bar words", "exclaimed words",
            "sentence ends", "equal neighbours", "distinct words", "repeated trigrams", "repeated lines", "commonest word", "line ends",
            "long words", "window: fewest distinct words", "window: most symbol words", "window: most upper case",
            "window: most equal neighbours", "window: most bar words", "window: most exclaimed words", "window: most digits")
_PLACE = constants(3, 9)
_CLASS = np.zeros((6, 256), dtype=bool)  # upper, digit, symbol, bar, exclamation, sentence end
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [ord(c) for c in "#$%&*@^_~<>{}[]\\/=+`|!"]] = True
_CLASS[3, ord("|")] = True
_CLASS[4, ord("!")] = True
_CLASS[5, [ord(c) for c in ".?!"]] = True


def _windows(x: np.ndarray) -> np.ndarray:
    """Rows of WINDOW words; the last row ends with the text."""
    if len(x) <= WINDOW:
        return x[None, :]
    whole = x[: len(x) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return np.concatenate([whole, x[None, -WINDOW:]]) if len(x) % WINDOW else whole


def _chunk_measures(c: Chunk) -> Iterator[np.ndarray]:
    kinds = _CLASS[:, c.raw]
    # upper-case letters of Latin-1 and their neighbours in UTF-8: 0xC3 0x80 to 0x9E
    if len(c.raw) > 1:
        kinds[0, 1:] |= (c.raw[:-1] == 0xC3) & (c.raw[1:] >= 0x80) & (c.raw[1:] <= 0x9E)
    letters = ((c.raw | 32) >= 97) & ((c.raw | 32) <= 122) | (c.raw >= 0xC0)
    sums = np.zeros((7, len(c.raw) + 1), dtype=np.int32)
    np.cumsum(kinds, axis=1, out=sums[:6, 1:])
    np.cumsum(letters, out=sums[6, 1:])
    per_word = sums[:, c.end] - sums[:, c.begin]
    length = (c.end - c.begin).astype(np.float64)
    lines = np.flatnonzero(c.raw == 10)
    grams = mix(c.hashes[:-2] * _PLACE[0] + c.hashes[1:-1] * _PLACE[1] + c.hashes[2:] * _PLACE[2]) if len(c.hashes) > 2 else np.zeros(0, np.uint64)
    for k in range(len(c.edges) - 1):
        lo, hi = int(c.edges[k]), int(c.edges[k + 1])
        n, size = hi - lo, int(c.offsets[k + 1] - c.offsets[k])
        out = np.zeros(len(MEASURES))
        out[1] = np.log1p(size)
        if n:
            h, w, ln = c.hashes[lo:hi], per_word[:, lo:hi], length[lo:hi]
            total = w.sum(axis=1)
            same = np.zeros(n)
            same[1:] = h[1:] == h[:-1]
            ordered = np.sort(h)
            runs = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
            symbol, bar, exclaimed = w[2] > 0, w[3] > 0, w[4] > 0
            out[0] = np.log1p(n)
            out[2], out[3] = ln.mean(), ln.std()
            out[4], out[5] = total[0] / max(1, total[6]), total[1] / size
            out[6], out[7], out[8], out[9] = symbol.mean(), bar.mean(), exclaimed.mean(), min(1.0, total[5] / n)
            out[10], out[11] = same.mean(), len(runs) / n
            if n > 2:
                out[12] = 1 - len(np.unique(grams[lo : hi - 2])) / (n - 2)
            a, b = np.searchsorted(lines, c.offsets[k]), np.searchsorted(lines, c.offsets[k + 1])
            if b > a:
                text = c.raw[c.offsets[k] : c.offsets[k + 1]].tobytes().split(b"\n")
                out[13] = 1 - len(set(text)) / len(text)
            out[14], out[15], out[16] = runs.max() / n if n > 8 else 0, (b - a) / n, (ln > 30).mean()
            rows = np.sort(_windows(h), axis=1)
            wide = rows.shape[1]
            out[17] = ((rows[:, 1:] != rows[:, :-1]).sum(axis=1) + 1).min() / wide
            out[18] = _windows(symbol).mean(axis=1).max()
            out[19] = (_windows(w[0]).sum(axis=1) / np.maximum(1, _windows(w[6]).sum(axis=1))).max()
            out[20] = _windows(same).mean(axis=1).max()
            out[21] = _windows(bar).mean(axis=1).max()
            out[22] = _windows(exclaimed).mean(axis=1).max()
            out[23] = (_windows(w[1]).sum(axis=1) / np.maximum(1, _windows(ln).sum(axis=1))).max()
        yield out


def measures(column: pa.Array) -> np.ndarray:
    """One row of MEASURES for each text of a string column."""
    rows = [m for chunk in word_chunks(column) for m in _chunk_measures(chunk)]
    return np.array(rows).reshape(len(rows), len(MEASURES))


class Network:
    """One hidden layer; out(x) is the logit that a text is good."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.weights = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.first = [np.zeros_like(w) for w in self.weights]
        self.second = [np.zeros_like(w) for w in self.weights]
        self.steps = 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def out(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(self.scaled(x) @ a + b) @ c + d[0]

    def step(self, x: np.ndarray, gradient: np.ndarray) -> None:
        """One Adam step against d(risk)/d(logit) of each row."""
        a, b, c, _ = self.weights
        z = self.scaled(x)
        h = np.tanh(z @ a + b)
        back = gradient[:, None] * c * (1 - h * h)
        grads = [z.T @ back + DECAY * a, back.sum(axis=0), h.T @ gradient + DECAY * c, gradient.sum(keepdims=True)]
        self.steps += 1
        for w, g, m, v in zip(self.weights, grads, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _batches(rng, n_p: int, n_u: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rounds = max(1, -(-n_u // BATCH))
    p = np.resize(rng.permutation(n_p), rounds * max(1, min(BATCH, n_p)))
    for k, u in enumerate(np.array_split(rng.permutation(n_u), rounds)):
        size = len(p) // rounds
        yield p[k * size : (k + 1) * size], u


def _shares_above(p_fit, u_fit, p_test, u_test, mean, scale) -> tuple[np.ndarray, np.ndarray]:
    """Shares of held-back positives and unlabelled texts above thresholds of
    a network that tells the other halves apart."""
    rng, net = np.random.default_rng(1), Network(mean, scale, 1)
    for _ in range(max(10, EPOCHS // 3)):
        for p, u in _batches(rng, len(p_fit), len(u_fit)):
            x = np.concatenate([p_fit[p], u_fit[u]])
            y = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
            w = np.concatenate([np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))])
            net.step(x, w * (_sigmoid(net.out(x)) - y))
    sp, su = np.sort(net.out(p_test)), np.sort(net.out(u_test))
    at = np.quantile(sp, np.linspace(0.01, 0.6, 60))
    return 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> float:
    """Share of positives among the unlabelled; each half is measured with
    the network fitted on the other."""
    halves = (positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2])
    if min(map(len, halves)) < 10:
        return 0.5
    p0, p1, u0, u1 = halves
    folds = [_shares_above(p0, u0, p1, u1, mean, scale), _shares_above(p1, u1, p0, u0, mean, scale)]
    q_p, q_u = (np.maximum(1e-9, np.mean(x, axis=0)) for x in zip(*folds))
    error = q_u / q_p * np.sqrt((1 - q_u) / q_u / len(unlabelled) + (1 - q_p) / q_p / len(positive))
    return float(np.clip((q_u / q_p - error).min(), 0.02, 0.98))


class Model:
    def __init__(self, net: Network | None, prior: float):
        self.net, self.prior = net, prior

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.full(len(column), 0.5)
        return _sigmoid(self.net.out(measures(column)))


def fit_measures(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Minimise the non-negative unbiased risk (logistic loss)."""
    if not len(positive) or not len(unlabelled):
        return Model(None, 0.5)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    prior = estimate_prior(positive, unlabelled, mean, scale) if prior is None else prior
    rng, net = np.random.default_rng(2), Network(mean, scale)
    for _ in range(EPOCHS):
        for p, u in _batches(rng, len(positive), len(unlabelled)):
            xp, xu = positive[p], unlabelled[u]
            fp, fu = net.out(xp), net.out(xu)
            # loss(f) = log(1 + exp(-f)) for a positive, log(1 + exp(f)) for a negative
            rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            g_pos = -prior * _sigmoid(-fp) / len(fp)
            g_rest_p, g_rest_u = -prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
            if rest >= 0:
                net.step(np.concatenate([xp, xu]), np.concatenate([g_pos + g_rest_p, g_rest_u]))
            else:  # the network fits the sample too well: undo that part
                net.step(np.concatenate([xp, xu]), -np.concatenate([g_rest_p, g_rest_u]))
    return Model(net, prior)


def _measured(rows: DataFrame) -> np.ndarray:
    """Measures of the texts of a bounded sample, on the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measures(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(m.tolist(), pa.list_(pa.float64()))], names=["m"])

    return np.array([r["m"] for r in rows.select("text").mapInArrow(run, "m array<double>").collect()]).reshape(-1, len(MEASURES))


def _few_ids(ids: DataFrame, size: int) -> DataFrame:
    """At most 2 * ``size`` ids (about ``size``), by hash."""
    n = ids.count()
    share = min(1.0, size / n) if n else 1.0
    return ids.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col("doc_id").alias("few_id")).limit(2 * size)


def fit(docs: DataFrame, positives: DataFrame) -> Model:
    """Fit on the texts of ``docs`` (doc_id, text): ``positives`` (doc_id)
    lists the trusted ones, all of ``docs`` is the unlabelled web text. At
    most 2 * SAMPLE_POSITIVE and 2 * SAMPLE_UNLABELLED rows are measured."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    p = _few_ids(positives.select("doc_id").distinct(), SAMPLE_POSITIVE)
    u = _few_ids(d.select("doc_id").distinct(), SAMPLE_UNLABELLED)
    # bounded by the sample sizes, so the ids are broadcast; an id may repeat without end, so the rows are bounded too
    return fit_measures(*(_measured(bounded_rows(d.join(F.broadcast(ids), d["doc_id"] == ids["few_id"], "left_semi"), 2 * size))
                          for ids, size in ((p, SAMPLE_POSITIVE), (u, SAMPLE_UNLABELLED))))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` (all columns) with the score of each whole text, 0 to 1."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, [text_col], [T.StructField(score_col, T.DoubleType())],
                       lambda texts: [pa.array(known.value.scores(texts), pa.float64())], rows=1000)


def trusted_positives(labels: DataFrame, held_out) -> DataFrame:
    """Ids labelled good and outside the held-out fold (a condition on doc_id)."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out)
            .groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id"))
