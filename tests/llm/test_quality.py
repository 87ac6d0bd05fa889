import random
import zlib

import numpy as np
import pyarrow as pa

from basketlens.llm import quality as ql
from basketlens.llm import queries

from .util import SF, docs_frame, words


def auc(good, bad):
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)


def test_measures_of_small_texts():
    m = dict(zip(ql.MEASURES, ql.measures(pa.array(["Aa bb bb | x! 12\nÉ bb"]))[0]))
    assert abs(m["words"] - np.log1p(8)) < 1e-12 and abs(m["distinct words"] - 6 / 8) < 1e-12 and m["equal neighbours"] == 1 / 8
    assert m["bar words"] == 1 / 8 and m["exclaimed words"] == 1 / 8 and m["line ends"] == 1 / 8
    rows = ql.measures(pa.array(["", None, " ", "a"]))
    assert rows.shape == (4, len(ql.MEASURES)) and not rows[0].any() and not rows[1].any() and np.isfinite(rows).all()


def test_measures_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [" ".join(words(rng, rng.randrange(120))) + "\n" * rng.randrange(3) for _ in range(60)] + ["z " * 700_000, None, "Ü" * 10]
    whole = ql.measures(pa.array(texts))
    one = np.concatenate([ql.measures(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, one)


def test_local_junk_shows_in_a_long_text():
    rng = random.Random(3)
    clean = words(rng, 2000)
    junk = clean[:1000] + ["same"] * 40 + clean[1000:]
    at = ql.MEASURES.index("window: most equal neighbours")
    m = ql.measures(pa.array([" ".join(clean), " ".join(junk)]))
    assert m[0, at] < 0.1 < 0.5 < m[1, at]


def toy(seed=5, n=3000, prior=0.7):
    rng = np.random.default_rng(seed)
    d = len(ql.MEASURES)
    y = rng.random(n) < prior
    x = rng.normal(size=(n, d))
    x[:, :3] += np.where(y, 1.6, -1.6)[:, None]
    return x, y


def test_non_negative_risk_separates_without_negatives():
    x, y = toy()
    positive = toy(6)[0][toy(6)[1]][:800]
    model = ql.fit_measures(positive, x)
    assert abs(model.prior - 0.7) < 0.08
    score = ql._sigmoid(model.net.out(x))
    assert auc(score[y][:400], score[~y][:400]) > 0.98
    assert np.mean(score[y] >= 0.3) > 0.95 and np.mean(score[~y] < 0.3) > 0.75


def test_prior_is_estimated_not_assumed():
    for prior in (0.3, 0.9):
        x, _ = toy(8, 6000, prior)
        p, py = toy(9, 4000, 0.5)
        p = p[py]
        both = np.concatenate([p, x])
        assert abs(ql.estimate_prior(p, x, both.mean(axis=0), both.std(axis=0)) - prior) < 0.08


def test_edge_cases(spark):
    df = docs_frame(spark, [(1, "a b c", 0.1), (1, "a b c", 0.1), (2, None, None), (3, "", 0.2), (4, "w " * 100_000, 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 1)], "doc_id long, quality int")
    p = ql.trusted_positives(labels, labels["doc_id"] < 0)
    assert sorted(r.doc_id for r in p.collect()) == [1, 9]
    out = ql.score(df, ql.fit(df, p)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in ql.score(df, ql.fit(df, p.where("doc_id > 9"))).collect()} == {0.5}
    empty = docs_frame(spark, [])
    assert ql.score(empty, ql.fit(empty, p)).count() == 0


def test_bad_labels_play_no_part(spark):
    df = docs_frame(spark, [(i, " ".join(words(random.Random(i), 40)) if i % 4 else "junk " * 40) for i in range(400)])
    good = spark.createDataFrame([(i, 1) for i in range(400) if i % 4], "doc_id long, quality int")
    bad = good.unionByName(spark.createDataFrame([(i, 0) for i in range(0, 400, 4)], "doc_id long, quality int"))
    a, b = (ql.fit(df, ql.trusted_positives(x, x["doc_id"] < 0)) for x in (good, bad))
    assert a.prior == b.prior and all((x == y).all() for x, y in zip(a.net.weights, b.net.weights))


def test_query_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    out = queries.QUERIES["op10_quality"](spark, big).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in out)
    good, bad = ([r.score for r in out if r.held_out and labels.get(r.doc_id) == y] for y in (1, 0))
    assert auc(good, bad) > 0.97 and np.mean(np.array(good) >= 0.3) > 0.97 and np.mean(np.array(bad) < 0.3) > 0.9


def test_query_on_a_small_table(spark):
    assert queries.QUERIES["op10_quality"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_a_repeated_id_stays_within_the_bound(spark, monkeypatch):
    from pyspark.sql import functions as F

    from basketlens.llm.common import bounded_rows

    df = spark.range(3_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2_000).cast("string")).alias("text"))
    assert bounded_rows(df, 3_000).count() == 3_000
    few = bounded_rows(df, 500).collect()
    assert len(few) == 500 and len({r.text for r in few}) == 500
    assert bounded_rows(df, 2_500).count() == 2_000
    monkeypatch.setattr(ql, "SAMPLE_POSITIVE", 100)
    monkeypatch.setattr(ql, "SAMPLE_UNLABELLED", 200)
    seen = []
    monkeypatch.setattr(ql, "fit_measures", lambda p, u: seen.append((len(p), len(u))))
    ql.fit(df, df.select("doc_id"))
    assert seen == [(200, 400)]
