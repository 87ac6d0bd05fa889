import math
import random
import zlib

import pytest

from basketlens.llm import queries
from basketlens.llm import toxicity as tx

from .util import SF, docs_frame, words


@pytest.mark.parametrize("text,want", [
    (None, " "), ("", " "), ("...", " "), ("Idiot!", " idiot "), ("1D10T", " idiot "), ("іdіоt", " idiot "), ("ÍDÍÓT", " idiot "), ("id​i­ot", " idiot "),
    ("ｉｄｉｏｔ", " idiot "), ("$tupid b@d 5$$", " stupid bad s "), ("loser l0ser 1oser", " ioser ioser ioser "), ("a-b_c", " a b c "), ("日本 語", " 日本 語 "), ("Straße", " strasse ")])
def test_fold(text, want):
    assert tx.fold(text) == want


def brute(lexicon, text):
    folded = tx.fold(text)
    spans = [(k, k + len(x) - 1) for x in lexicon.exceptions for k in range(len(folded)) if folded.startswith(x, k)]
    return sum(w for p, w in lexicon.weights.items() for k in range(len(folded))
               if folded.startswith(p, k) and not any(s <= k and k + len(p) - 1 <= e for s, e in spans))


def test_automaton_equals_brute_force_with_exceptions():
    rng = random.Random(4)
    vocabulary = ["ab", "abc", "abcd", "bad", "badly", "fish", "clown", "trash", "can"]
    lexicon = tx.Lexicon({" abc": 1.0, " bad ": 2.0, " ciown": 4.0, " trash ": 8.0}, exceptions=["clown fish", "trash can", "not bad"])
    for _ in range(300):
        text = " ".join(rng.choice([*vocabulary, "not", "x"]) for _ in range(rng.randrange(12)))
        assert lexicon.raw(text) == (brute(lexicon, text), len(text.split()))
    assert lexicon.raw("clown fish")[0] == 0 and lexicon.raw("fish clown")[0] == 4


def test_score_grows_with_weight_and_falls_with_length():
    lexicon = tx.Lexicon({" bad ": 2.0}, power=1.0, line=(-3.0, 2.0))
    assert lexicon.score("bad bad") > lexicon.score("bad") > lexicon.score("good") == lexicon.score(None) == lexicon.score("")
    assert lexicon.score("bad " + "good " * 1000) < lexicon.score("bad")


@pytest.fixture(scope="module")
def corpus():
    """Texts; a third of the ids are labelled; toxic ones hold a bad word or a word with a bad beginning."""
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(1500):
        w, toxic = words(rng, rng.randrange(5, 60)), i % 10 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "1d1ot", "sсum", "vex" + rng.choice("abcdef") + "qu" + rng.choice("aeiou")]))
        elif i % 40 == 1:
            w[0:0] = ["scum", "line"]          # a harmless phrase
        docs.append((i, " ".join(w)))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
    return docs, labels


def test_learned_lexicon_generalises(spark, corpus):
    docs, labels = corpus
    d, lab = docs_frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = tx.learn(d, lab)
    assert any(p.startswith(" idiot") or p == " idio" for p in lexicon.weights) and any(p.startswith(" vex") for p in lexicon.weights)
    assert " scum iine " in lexicon.exceptions
    scores = {r.doc_id: r.score for r in tx.score(d, lexicon).collect()}
    unseen = set(dict(docs)) - set(dict(labels))
    wrong = [i for i in unseen if (scores[i] >= tx.THRESHOLD) != (i % 10 == 0)]
    assert len(wrong) <= 0.02 * len(unseen)
    again = tx.learn(docs_frame(spark, docs[::-1]), lab)
    assert again.weights == lexicon.weights and again.exceptions == lexicon.exceptions


def test_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    df = docs_frame(spark, [(1, "a b", 7.0), (1, "a b", 7.0), (2, None, None), (3, "", 1.0), (4, "x " * 50_000, 1.0)], "doc_id long, text string, score double")
    out = tx.score(df, tx.learn(df, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    none = tx.learn(df, labels.where("toxic > 5"))
    assert {r.score < 1e-9 for r in tx.score(df, none).collect()} == {True}
    empty = docs_frame(spark, [])
    assert tx.score(empty, tx.learn(empty, labels)).count() == 0


def test_query_holds_out_its_fold(spark):
    out = queries.QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and not math.isnan(r.score)


def test_query_quality_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    out = [(r.score, labels[r.doc_id]) for r in queries.QUERIES["op6_toxicity"](spark, big).collect() if r.held_out and labels.get(r.doc_id) is not None]
    bad, good = [s for s, y in out if y == 1], [s for s, y in out if y == 0]
    assert sum((a > b) + (a == b) / 2 for a in bad for b in good) / len(bad) / len(good) > 0.9
    assert sum(s >= 0.3 for s in bad) > 0.8 * len(bad) and sum(s >= 0.3 for s in good) < 0.03 * len(good)
