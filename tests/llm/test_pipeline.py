from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from basketlens.llm import jaccard_join, quality, queries, toxicity
from basketlens.llm.common import crc_remainder

from .test_bpe import library_digest
from .test_jaccard_join import brute, shingles
from .util import SF

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_all_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert entry.queries()["pipeline"] is cp.run and [n for n, _ in cp.STAGES] == ["quality", "toxicity", "near_duplicates", "mixture", "tokens"]


def test_run_equals_the_stages_by_brute_force(spark, documents):
    """The filters recomputed row by row from their operators' scores, the groups by comparing everything, the tokens by the library."""
    tokenizers = pytest.importorskip("tokenizers")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(documents, quality.trusted_positives(labels, crc_remainder(F.col("doc_id"), 5) == 0))
    good = quality.score(documents, model).where(f"score >= {quality.THRESHOLD}").cache()
    lexicon = toxicity.learn(good.select(*COLUMNS), labels.where(crc_remainder(F.col("doc_id"), 4) != 2))
    rows = [(r.doc_id, r.text) for r in good.collect() if lexicon.score(r.text) < toxicity.THRESHOLD]
    of = brute(rows, 5, 80)
    want = {i: t for i, t in rows if of[i] == i or not shingles(t, 5)}
    assert 0 < len(want) < len(rows) < good.count() < documents.count()
    out = cp.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(want.keys())
    assert sorted(r.position for r in out) == list(range(len(out)))
    library = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    for r in out:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == library_digest(library, want[r.doc_id]) and len(r.ids) == r.n_tokens


def odd_rows(spark, documents):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with the operators' names."""
    some = documents.limit(40)
    text = some.first().text
    odd = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", "en", "", 0), (None, text, "en", "s", 1), (900_003, text, None, None, None),
                                 (900_003, text, None, None, None), (900_004, "word " * 60_000, "en", "s", 300_000), (None, None, None, None, None)], documents.schema)
    return (some.unionByName(odd).withColumn("score", F.lit("mine")).withColumn("slot", F.lit(-1)).withColumn("block", F.lit("b")).withColumn("component_id", F.lit(7))
            .withColumn("row", F.lit(1.5)).withColumn("ids", F.lit("i")).withColumn("position", F.lit("p")).withColumn("k", F.lit(None).cast("string")))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, documents, tmp_path, k):
    name, stage = cp.STAGES[k]
    odd_rows(spark, documents).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    out = stage(spark, docs, SF)
    out.write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    if k < 4:
        assert out.columns == docs.columns
        kept, given = Counter(tuple(r) for r in rows), Counter(tuple(r) for r in docs.collect())
        assert not kept - given and rows
    ids = Counter(r.doc_id for r in rows)
    if name == "mixture" or name == "tokens":
        assert ids == Counter(r.doc_id for r in docs.select("doc_id").collect())
    if name == "near_duplicates":
        assert ids[900_001] == ids[900_002] == ids[900_004] == 1 and ids[None] == 2 and ids[900_003] <= 1
    if name == "tokens":
        assert sorted(r.position for r in rows) == list(range(len(rows))) and {r.n_tokens for r in rows if r.doc_id in (900_001, 900_002)} == {0}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_an_empty_table(spark, documents, tmp_path, k):
    documents.limit(0).write.parquet(f"{tmp_path}/in")
    out = cp.STAGES[k][1](spark, spark.read.parquet(f"{tmp_path}/in"), SF)
    out.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 0
    if k < 4:
        assert out.columns == COLUMNS


def test_rows_that_are_not_files_have_no_position(spark):
    df = spark.createDataFrame([(1, "hello", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r.position, r.n_tokens) for r in cp.encode_tokens(spark, df, SF).collect()] == [(None, 1)]


def test_near_duplicates_use_five_words_and_eighty_percent(spark, documents):
    sets = {r.doc_id: shingles(r.text, 5) for r in cp.drop_near_duplicates(spark, documents, SF).collect()}
    ids = [i for i in sets if sets[i]]
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k])
    assert jaccard_join.keep_one(documents).count() == len(sets)
