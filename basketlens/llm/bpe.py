"""BPE encoding and decoding.

A text is normalised and cut into words as the vocabulary file says; each
word's symbols form a doubly linked list, and a priority queue of merge ranks
joins the best adjacent pair until none is left. Queue entries whose symbols
have changed since they were pushed are skipped as stale. Decoding
concatenates the vocabulary strings (with a space between, as a file without
a decoder asks for).

Edge cases: a null text is the empty text (no ids, empty decoded text); texts
of any length are encoded whole; repeated rows and extra columns are kept,
but a column that has the name of an output column is replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

#: Words remembered by one worker; beyond it the memory is emptied and refilled.
CACHE_WORDS = 400_000
CACHE_WORD_CHARS = 64

# Unicode White_Space; str.split() also splits on U+001C..U+001F, which are not in it.
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 bytes stand for themselves, the others
    take the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class BpeCodec:
    """Encoder and decoder of one vocabulary file (tokenizers JSON with a BPE
    model, byte-level alphabet and an end-of-word suffix)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE vocabulary")
        self.steps = _steps(spec["normalizer"], "normalizers")
        self.splits = [regex.compile(s["pattern"]["Regex"])
                       for s in _steps(spec["pre_tokenizer"], "pretokenizers") if s["type"] == "Split"]
        if len(self.splits) != 1 or spec.get("decoder") is not None:
            raise ValueError("this codec handles one split pattern and no decoder")
        self.vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        size = 1 + max([*self.vocab.values(), *special.values()])
        self.strings = np.full(size, "", dtype=object)
        for s, i in [*self.vocab.items(), *special.items()]:
            self.strings[i] = s
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        alphabet, suffix = byte_alphabet(), model.get("end_of_word_suffix") or ""
        self.inner = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + suffix] for c in alphabet]
        self.words = _WordMemory(self)

    @classmethod
    def from_file(cls, path: str) -> BpeCodec:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def normalise(self, text: str) -> str:
        for step in self.steps:
            kind = step["type"]
            if kind == "NFC":
                text = text if text.isascii() else unicodedata.normalize("NFC", text)
            elif kind == "Lowercase":  # letter by letter: no final-sigma rule
                text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
            elif kind == "Replace" and step["pattern"] == {"Regex": "\\s+"}:
                pass  # words() cuts at the same white space, which no word contains
            else:
                raise ValueError(f"unknown normaliser {kind}")
        return text

    def chunks(self, text: str) -> list[str]:
        """Stretches without white space; no word crosses them."""
        text = self.normalise(text)
        return [x for x in _SPACE.split(text) if x] if _SEPARATORS.search(text) else text.split()

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode("utf-8")
        n = len(raw)
        symbol = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges, queue = self.merges, []
        for i in range(n - 1):
            if m := merges.get((symbol[i], symbol[i + 1])):
                queue.append((m[0], i, symbol[i], symbol[i + 1]))
        heapify(queue)
        while queue:
            _, i, a, b = heappop(queue)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # stale: one of the two has been merged meanwhile
            symbol[i], symbol[j] = merges[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((symbol[i], symbol[k])):
                    heappush(queue, (m[0], i, symbol[i], symbol[k]))
            if (h := before[i]) >= 0 and (m := merges.get((symbol[h], symbol[i]))):
                heappush(queue, (m[0], h, symbol[h], symbol[i]))
        return [s for s in symbol if s >= 0]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, dtype="<u4")
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        parts = self.special_re.split(text) if self.special_re else [text]
        raw = b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if k % 2 else b"".join(map(known.__getitem__, self.chunks(p)))
                       for k, p in enumerate(parts))
        return np.frombuffer(raw, dtype="<u4")

    def decode(self, ids) -> str:
        return " ".join(self.strings[np.asarray(ids, dtype=np.int64)].tolist())


class _WordMemory(dict):
    """Stretch of text -> its ids as bytes, encoded when first asked for."""

    def __init__(self, codec: BpeCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        ids = [i for w in self.codec.splits[0].findall(chunk) for i in self.codec.merge(w)]
        raw = np.array(ids, dtype="<u4").tobytes()
        if len(chunk) <= CACHE_WORD_CHARS:
            self[chunk] = raw
        return raw


def _steps(spec: dict | None, plural: str) -> list[dict]:
    if spec is None:
        return []
    return spec[plural] if spec["type"] == "Sequence" else [spec]


_CODECS: dict[str, BpeCodec] = {}


def _codec(source) -> BpeCodec:
    """The worker's codec of a broadcast vocabulary (parsed once a worker)."""
    key, text = source.value
    if key not in _CODECS:
        _CODECS[key] = BpeCodec(json.loads(text))
    return _CODECS[key]


def _source(df: DataFrame, path: str):
    """Vocabulary file as a broadcast (a file of a few MB; ``path`` need only exist on the driver)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), text))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` (all columns) with ``ids_col``, the token ids of ``text_col``.

    Null and empty texts get an empty array. A map-only job: nothing is
    shuffled, memory is one Arrow batch and the word memory."""
    source = _source(df, path)

    def ids(texts: pa.Array) -> list[pa.Array]:
        codec = _codec(source)
        return [_lists([codec.encode(x.as_py()).astype(np.int32) for x in texts])]

    return add_columns(df, [text_col], [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], ids)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` (all columns) with ``text_col``, the text of the ids in
    ``ids_col`` (null ids: empty text)."""
    source = _source(df, path)

    def texts(lists: pa.Array) -> list[pa.Array]:
        codec = _codec(source)
        return [pa.array([codec.decode(x.values.to_numpy() if x.is_valid else []) for x in lists], pa.string())]

    return add_columns(df, [ids_col], [T.StructField(text_col, T.StringType())], texts)


def digests(df: DataFrame, path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``df`` without ``text_col`` and with n_tokens, the SHA-256 of the ids
    (unsigned 32-bit little-endian) and of the decoded text, and the ids if
    asked for. Encodes and decodes in one pass."""
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    source = _source(df, path)

    def made(texts: pa.Array) -> list[pa.Array]:
        codec = _codec(source)
        n, ids_sha, text_sha, kept = [], [], [], []
        for x in texts:
            ids = codec.encode(x.as_py())
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            kept += [ids.astype(np.int32)] * with_ids
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), *([_lists(kept)] * with_ids)]

    return add_columns(df.withColumn(text_col, F.col(text_col).cast("string")), [text_col], new, made, drop=(text_col,))
