import random
import re

import duckdb
import pytest

from basketlens.llm import decontaminate as dc
from basketlens.llm import queries

from .util import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    """(n_words, n_hit, items, hit texts) of each (id, text)."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, spots = words(text), [m.span() for m in WORD.finditer((text or "").translate(LOWER))]
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for at in range(len(w) - k + 1):
                owners = windows.get(tuple(w[at : at + k]))
                if owners:
                    hit |= set(range(at, at + k))
                    found |= owners
        spans = []
        for j in sorted(hit):
            if j - 1 in hit:
                spans[-1] = (spans[-1][0], spots[j][1])
            else:
                spans.append(spots[j])
        out.append((i, len(w), len(hit), sorted(found), spans))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice(["ab", "Cd", "é1", "ß", "漢字", "x", " ", "z "]) + rng.choice([" ", " ", ", ", "-", "\n", "\x00", "\t", "_"]) for _ in range(n))

    items = [(rng.randrange(30), text(rng.choice([1, 2, 5, 9, 10, 11, 40]))) for _ in range(40)] + [(7, None), (8, " ,.-"), (None, "lone ITEM text")]
    docs = []
    for i in range(150):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            item = rng.choice(items)[1] or ""
            cut = rng.randrange(0, len(item) // 2 + 1)
            parts += [rng.choice([item.upper(), item, item[cut:]]), text(rng.randrange(0, 9))]
        docs.append((i % 140, rng.choice([" ", "", "\U0001f600 ", "x"]).join(parts)))
    return items, [*docs, (900, None), (901, ""), (902, " .\n"), (903, "a LONE\titem, TEXT b"), (904, "lone item texts")]


def frame(spark, rows, *more):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def results(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), [(s.begin, s.end) for s in r.spans]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,window", [(1, 10), (2, 3)])
def test_equals_brute_force(spark, seed, window):
    items, docs = made(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert results(dc.find(frame(spark, docs), bench, window=window)) == brute(docs, items, window)


def test_several_automata_give_the_same(spark, monkeypatch):
    items, docs = made(3)
    monkeypatch.setattr(dc, "MAX_PATTERN_BYTES", 3_000)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)
    found = dc.find(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans"]
    assert results(found) == brute(docs, items)


def test_passages_are_cut_out(spark):
    item = "One two three four five six seven eight nine ten eleven"
    docs = [(1, f"Vorher, äö {item.upper().replace(' ', ' - ')}! Nachher"), (2, None), (3, "clean"), (4, item)]
    found = dc.without_passages(dc.find(frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert {r.doc_id: r.text for r in found.collect()} == {1: "Vorher, äö ! Nachher", 2: None, 3: "clean", 4: ""}


def test_empty_tables_long_texts_and_clashing_names(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two", "old", 5, "b"), (1, "one two", "old", 5, "b")], "doc_id long, text string, items string, n_hit int, bits string")
    out = dc.find(docs, none).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r["items"], r.bits) for r in out] == [(1, 2, 0, [], "b")] * 2
    assert dc.find(frame(spark, []), none).count() == 0
    item = " ".join(f"w{i}" for i in range(30))
    long = "filler " * 300_000 + item + " filler" * 1000
    row = dc.find(frame(spark, [(1, long)]), spark.createDataFrame([(5, item)], "item_id long, text string"), drop_text=True).first()
    assert (row.n_words, row.n_hit, row["items"]) == (301_030, 30, ["5"]) and [(s.begin, s.end) for s in row.spans] == [(2_100_000, 2_100_000 + len(item))]
    assert "text" not in row


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({queries.ORACLES['op13_decontaminate']}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in queries.QUERIES["op13_decontaminate"](spark, SF).orderBy("doc_id").collect()]
    assert got == want and any(r[-1] for r in got)
