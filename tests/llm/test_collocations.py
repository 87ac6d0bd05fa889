import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from basketlens.llm import collocations as co
from basketlens.llm import queries

from .util import SF

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_counts(rows, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    return f, n


def brute(rows, least, top=2000, percent=100):
    f, n = brute_counts(rows)
    out = []
    for lang in f:
        often = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= percent * f[lang][p[i:j]]}
        found = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def made(seed, docs=160, langs=("en", "de", None, "und", "x\ty")):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "ÜBER", "New", "york", "city", "a" * 300, "x-1", " ", "ß"]
    rows = []
    for _ in range(docs):
        words = []
        for _ in range(rng.randrange(0, 120)):
            words.append(rng.choice([*vocabulary, "new york", "New\tYork city hall", f"r{rng.randrange(40)}"]) + rng.choice(["", "", "", "", ".", ",", "!\n", "\r", ";:"]))
        rows.append((rng.choice(langs), " ".join(words)))
    return [*rows, ("en", None), (None, ""), ("de", " \t."), ("en", "New York. " * 3_000)]


@pytest.mark.parametrize("seed,least,percent", [(1, 8, 100), (2, 3, 60)])
def test_equals_brute_force(spark, seed, least, percent):
    rows = made(seed)
    df = spark.createDataFrame([(i % 3, "z", *r) for i, r in enumerate(rows)], "key int, n string, lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in co.collocations(df, least, top=25, percent=percent).collect())
    assert got == brute(rows, least, 25, percent)


def test_repeated_rows_and_empty_tables(spark):
    rows = [("en", "red fish, blue fish")] * 7
    got = [tuple(r) for r in co.collocations(spark.createDataFrame(rows, "lang string, text string"), 7).collect()]
    assert sorted(got) == brute(rows, 7)
    assert co.collocations(spark.createDataFrame([], "lang string, text string"), 1).count() == 0
    assert co.collocations(spark.createDataFrame([(None, None)], "lang string, text string"), 1).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    # 1000 * a * n passes 2**64; the division must floor exactly
    rows = [("en", "p q")] * 3
    phrases = spark.createDataFrame([(b"a" * 8, 1, 3 * 10 ** 11 + 7, "en"), (b"b" * 8, 1, 7 * 10 ** 11 + 1, "en"), (b"a" * 8 + b"b" * 8, 2, 10 ** 11 + 3, None)], "key binary, words int, a long, lang string")
    words = spark.createDataFrame([(b"a" * 8, "p"), (b"b" * 8, "q")], "key binary, word string")
    totals = spark.createDataFrame([("en", 9 * 10 ** 14 + 11)], "lang string, n long")
    monkeypatch.setattr(co, "frequent_phrases", lambda *a: (phrases, words, totals))
    row = co.collocations(spark.createDataFrame(rows, "lang string, text string")).first()
    assert (row.phrase, row.score) == ("p q", 1000 * (10 ** 11 + 3) * (9 * 10 ** 14 + 11) // ((3 * 10 ** 11 + 7) * (7 * 10 ** 11 + 1)))


def test_trie_bursts_and_spills_whole_subtrees():
    rng = random.Random(4)
    trie, want, runs = co.HatTrie(limit=900, burst=16), Counter(), []
    for _ in range(40):
        keys = [b"".join(rng.choice([1, 2, 3, 5, 8, 2 ** 63]).to_bytes(8, "big") for _ in range(rng.choice([2, 3, 4, 5]))) for _ in range(120)]
        trie.add(keys, [2] * len(keys))
        want.update({k: 2 * n for k, n in Counter(keys).items()})
        if trie.full():
            before = {w: trie._size(p) for w, p in trie.root.items()}
            run = list(trie.spill(keep=0.5))
            first = {k[:8] for k, _ in run}
            assert len(run) == sum(before[w] for w in first) and not first & set(trie.root) and trie.entries <= 450
            runs.append(run)
    assert type(next(iter(trie.root.values()), None)) in (dict, co.HatTrie.Node)
    runs.append(list(trie.spill()))
    assert trie.entries == 0 and len(runs) > 3 and all([k for k, _ in r] == sorted({k for k, _ in r}) for r in runs)
    total = Counter()
    for r in runs:
        total.update(dict(r))
    assert total == want


def test_runs_merge_to_the_counts():
    rng = np.random.default_rng(5)
    batches, want = [], Counter()
    for _ in range(6):
        found = Counter(rng.integers(0, 4, (300, 3), dtype=np.uint64).astype(">u8").tobytes()[i : i + 24] for i in range(0, 7200, 24))
        want.update(found)
        batches += list(co._runs(iter(sorted(found.items())), 7))
    table = pa.Table.from_batches(batches)
    got = {}
    for part in set(table.column("part").to_pylist()):
        chosen = table.filter(pa.compute.equal(table.column("part"), part))
        got |= {r["key"]: r["a"] for r in co._merge(20)(chosen).to_pylist()}
    assert got == {k: n for k, n in want.items() if n >= 20}


def test_small_memory_gives_the_same(spark, monkeypatch):
    rows = made(9, 60)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    runs = co._count_phrases(101, range(2, 4), 5, type("B", (), {"value": type("A", (), {"has": staticmethod(lambda x: np.ones(len(x), bool))})}))
    monkeypatch.setattr(co.HatTrie.__init__, "__defaults__", (50, 4))
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] or "und" for r in rows], "text": [r[1] for r in rows]})
    got = Counter()
    for b in runs(iter([batch.slice(i, 10) for i in range(0, len(rows), 10)])):
        for r in b.to_pylist():
            n = np.frombuffer(r["counts"], np.int64)
            got.update({r["keys"][i * 8 * r["words"] : (i + 1) * 8 * r["words"]]: int(n[i]) for i in range(len(n))})
    f, _ = brute_counts(rows, 3)
    assert sorted(got.values()) == sorted(a for lang in f for p, a in f[lang].items() if len(p) > 1)
    assert df.count() == len(rows)


def test_colliding_words_are_found(spark, monkeypatch):
    texts = spark.createDataFrame([("en", "one two three")] * 4, "lang string, text string").coalesce(1)
    chunk, _ = next(co._chunks(pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["ab ab ac abc Ab"]}), 101))
    assert co._repeats(chunk, np.zeros(5, int)).tolist() == [True, True, False, False, True]
    real, calls = co.count_words, []
    monkeypatch.setattr(co, "count_words", lambda t, n, seed: calls.append(seed) or real(t, n, seed).withColumn("clash", co.F.lit(seed == 101)))
    assert co.collocations(texts, 2).count() == 1 and calls == [101, 102]
    monkeypatch.setattr(co, "count_words", lambda t, n, seed: real(t, n, seed).withColumn("clash", co.F.lit(True)))
    with pytest.raises(ValueError, match="same id"):
        co.collocations(texts, 2)


def test_filter_bits(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 65535, -1, -2 ** 63, 2 ** 63 - 1, 123456789012345]
    bits = co.frequent_bits(spark.createDataFrame([(i,) for i in ids], "id long"))
    assert bits.has(np.array(ids, np.int64).view(np.uint64)).all()
    other = np.setdiff1d(np.arange(60_000, dtype=np.uint64), np.array(ids, np.int64).view(np.uint64) & np.uint64(bits.size - 1))
    assert not bits.has(other).any()


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({queries.ORACLES['op11_collocations']}) ORDER BY lang, rank").fetchall()
    assert [tuple(r) for r in queries.QUERIES["op11_collocations"](spark, SF).orderBy("lang", "rank").collect()] == want
