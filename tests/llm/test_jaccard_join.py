import random
import re

import numpy as np
import pyarrow as pa
import pytest

from basketlens.llm import jaccard_join as jj
from basketlens.llm.texthash import word_chunks

from .util import docs_frame, near_groups, words

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    """{doc_id: component}, by comparing everything with everything."""
    known = [(i, shingles(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return {i: find(i) for i in parent}


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def expected(rows, n, percent):
    of = brute(rows, n, percent)
    return sorted(((i, len(shingles(t, n)), of.get(i)) for i, t in rows), key=str)


@pytest.mark.parametrize("n,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 60, 3), (3, 100, 4)])
def test_components_equal_brute_force(spark, n, percent, seed):
    rows = near_groups(seed)
    assert result(jj.jaccard_components(docs_frame(spark, rows), n, percent)) == expected(rows, n, percent)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    """One group of near copies and texts that share a long passage, with blocks of 8."""
    monkeypatch.setattr(jj, "BLOCK", 8)
    rng = random.Random(9)
    rows = near_groups(7, groups=1, copies=120, n=120)
    passage = words(rng, 60)
    rows += [(200_000 + i, " ".join(words(rng, rng.randrange(1, 40)) + passage)) for i in range(40)]
    assert result(jj.jaccard_components(docs_frame(spark, rows), 4, 85)) == expected(rows, 4, 85)


def test_chains_are_followed_to_their_smallest_id(spark):
    """Each text is linked with its neighbours only; the component is the whole chain."""
    w = [f"w{i}" for i in range(300)]
    rows = [(1000 - i, " ".join(w[i * 6 : i * 6 + 100])) for i in range(30)]
    out = jj.jaccard_components(docs_frame(spark, rows), 4, 85)
    assert result(out) == expected(rows, 4, 85) and {r[2] for r in result(out)} == {971}


def test_repeated_ids_null_ids_extra_columns_and_empty_tables(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(5, text), (5, text), (5, "quite another text with more than four words"), (3, "quite another text with more than four words"), (None, text), (8, text), (9, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n int")
    out = result(jj.jaccard_components(df, 4, 85))
    # both texts of id 5 are one node, so it joins them
    assert out == sorted([(5, 27, 3), (5, 27, 3), (5, 5, 3), (3, 5, 3), (None, 27, None), (8, 27, 3), (9, 0, 9)], key=str)
    assert result(jj.jaccard_components(docs_frame(spark, []), 4, 85)) == []


def test_keep_one_keeps_every_group_once(spark):
    rows = near_groups(12)
    rows = rows + rows[:5]
    df = spark.createDataFrame([(i, t, "e", len(t or "")) for i, t in rows], "doc_id long, text string, gone string, twice long")
    out = [(r.doc_id, r.text) for r in jj.keep_one(df, 5, 80).collect()]
    of = brute(rows, 5, 80)
    wordless = [(i, t) for i, t in rows if not shingles(t, 5)]
    assert sorted(i for i, t in out if shingles(t, 5)) == sorted({c for i, c in of.items() if any(shingles(t, 5) for j, t in rows if j == i)})
    assert sorted((x for x in out if not shingles(x[1], 5)), key=str) == sorted(wordless, key=str)
    assert jj.keep_one(df, 5, 80).columns == df.columns


def test_word_hashes_follow_the_definition_of_a_word():
    texts = ["", "A b\tC\x0bd\x0c\r\ne", None, "no\xa0break \x1cx", "ÉCLAIR éclair ÉCLAIR", "z" * 3_000_000, "end", " "]
    got = [len(c.hashes[c.edges[k] : c.edges[k + 1]]) for c in word_chunks(pa.array(texts)) for k in range(len(c.edges) - 1)]
    assert got == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]
    one = list(jj.shingle_sets(pa.array(["A b C d", "a B c D", "a b c", "a b c d e"]), 4))
    assert (one[0] == one[1]).all() and len(one[2]) == 1 and one[2][0] != one[0][0] and len(np.intersect1d(one[0], one[3])) == 1
    sliced = list(jj.shingle_sets(pa.array(["x", "A b C d"]).slice(1), 4))
    assert (sliced[0] == one[0]).all()


def test_prefixes_are_long_enough():
    for n in range(1, 200):
        for percent in (50, 80, 85, 100):
            need = min(c for c in range(n + 1) if 100 * c >= percent * n)
            assert jj.prefix_length(n, percent) == n - need + 1


def other_texts(seed):
    """Rows whose ids repeat with near copies of different groups, and with no words."""
    rows = near_groups(seed, groups=4, copies=6)
    rng = random.Random(seed)
    return rows + [(rng.choice(rows)[0], t) for _, t in rng.sample(rows, 12)] + [(rows[0][0], ""), (rows[0][0], None), *rows[3:6]]


def row_groups(rows, n, percent):
    """Components of rows by links of their own texts."""
    of = brute([(k, t) for k, (_, t) in enumerate(rows)], n, percent)
    return {k: of[k] for k in of}


@pytest.mark.parametrize("seed", [21, 22])
def test_an_id_with_several_texts(spark, seed):
    rows = other_texts(seed)
    parent = {}
    for i, t in rows:  # texts of an id meet
        parent.setdefault(i, []).append(t)
    groups = row_groups(rows, 4, 85)
    root = {k: k for k in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(rows)):
        for j in range(k):
            if rows[k][0] is not None and rows[k][0] == rows[j][0] or groups.get(k) is not None and groups.get(k) == groups.get(j) and shingles(rows[k][1], 4):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    want = sorted(((i, len(shingles(t, 4)), least[find(k)]) for k, (i, t) in enumerate(rows)), key=str)
    assert result(jj.jaccard_components(docs_frame(spark, rows), 4, 85)) == want


@pytest.mark.parametrize("seed", [31, 32])
def test_keep_one_drops_only_near_copies(spark, seed):
    rows = other_texts(seed)
    out = [(r.doc_id, r.text) for r in jj.keep_one(docs_frame(spark, rows), 5, 80).collect()]
    groups = row_groups(rows, 5, 80)
    worded = [k for k, (_, t) in enumerate(rows) if shingles(t, 5)]
    want = sorted(min(rows[k][0] for k in worded if groups[k] == g) for g in {groups[k] for k in worded})
    assert sorted(i for i, t in out if shingles(t, 5)) == want
    assert sorted((x for x in out if not shingles(x[1], 5)), key=str) == sorted((x for x in rows if not shingles(x[1], 5)), key=str)
    left = [shingles(t, 5) for _, t in out if shingles(t, 5)]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(left) for b in left[:k])


def test_two_texts_of_an_id_are_compared_as_they_are(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " more")]
    assert result(jj.jaccard_components(docs_frame(spark, rows), 4, 85)) == [(5, 37, 5), (5, 37, 5), (7, 38, 5), (9, 38, 5)]
    assert sorted((r.doc_id, r.text) for r in jj.keep_one(docs_frame(spark, rows), 4, 85).collect()) == [(5, a), (5, b)]


@pytest.mark.parametrize("seed,block", [(41, 512), (42, 4)])
def test_every_link_and_its_counts(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    rows = near_groups(seed, groups=3, copies=15) + other_texts(seed)[-17:]
    sets = [shingles(t, 4) for _, t in rows]

    def links(k):
        return [j for j, b in enumerate(sets) if j != k and b and 100 * len(sets[k] & b) >= 85 * len(sets[k] | b)]

    want = sorted((rows[k][0], len(a), sum(sets[j] == a for j in links(k)), sum(sets[j] != a for j in links(k))) for k, a in enumerate(sets) if a)
    assert sorted(tuple(r) for r in jj.link_counts(docs_frame(spark, rows), 4, 85).collect()) == want
    plain = near_groups(seed, groups=3, copies=15)
    every = jj.similar_links(docs_frame(spark, plain), 4, 85, every=True).collect()
    kinds = {}
    for i, t in sorted((x for x in plain if shingles(x[1], 4)), key=lambda x: x[0]):
        kinds.setdefault(shingles(t, 4), i)
    known = sorted(kinds.items(), key=lambda x: x[1])
    assert sorted((r.a, r.b, r.common) for r in every) == sorted((i, j, len(a & b)) for x, (a, i) in enumerate(known) for b, j in known[x + 1 :] if 100 * len(a & b) >= 85 * len(a | b))
