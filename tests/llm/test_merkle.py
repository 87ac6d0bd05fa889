import hashlib
import string
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from basketlens.llm import merkle, queries
from basketlens.llm.common import crc_remainder

from .util import SF

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def H(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def leaf(d):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d[0], d[3], d[2], d[4], d[1])))


def tree(nodes):
    """(root, for each leaf its (left, right) pairs)"""
    proofs, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for i in range(0, len(nodes), 16):
            run = nodes[i : i + 16]
            for j in range(len(run)):
                for x in below[i + j]:
                    proofs[x].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H("".join(run)))
            over.append([x for b in below[i : i + 16] for x in b])
        nodes, below = up, over
    return nodes[0], proofs


def brute(docs):
    groups = defaultdict(list)
    for d in docs:
        groups[d[3]].append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, found = [], []
    for g in order:
        rows = sorted(groups[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        sub, proofs = tree([leaf(d) for d in rows])
        subs.append(sub)
        found.append((rows, proofs))
    root, tops = tree(subs) if subs else (None, [])
    out = []
    for (rows, proofs), top, sub in zip(found, tops, subs):
        for d, proof in zip(rows, proofs):
            changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            x = leaf((d[0], d[1] and d[1].translate(LOWER) if changed else d[1], *d[2:]))
            for left, right in proof + top:
                x = H(left + x + right)
            out.append((d[0], leaf(d), sub, root, H("".join(a + b for a, b in proof + top)), x, x == root))
    return sorted(out, key=repr)


def check(df):
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.check(df, COLUMNS, "doc_id", "source", crc_remainder(F.col("doc_id"), 5) == 0, {"text": lowered})


def rows(sizes):
    out, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 3
            out.append((i, [f"Text {i} É", "lower", "", None][i % 4], ["en", None][i % 2], source, i % 7 or None))
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 16}, {"a": 17}, {"a": 273, "b": 1, None: 2, "": 16, "=": 33, "ab": 256, "é": 257, "￿": 1, "\U00010000": 1},
    {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_equals_brute_force(spark, sizes):
    docs = rows(sizes)
    assert sorted((tuple(r) for r in check(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect()), key=repr) == brute(docs)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    docs = [(None, "A", "en", "s", 1), (None, "B", "en", "s", 1), (5, "Same", "en", "s", 4), (5, "Same", "en", "s", 4), (5, "Other", "en", "s", 5), (10, "x" * 300_000, None, None, None)] * 9
    df = spark.createDataFrame(docs, SCHEMA)
    want = brute(docs)
    assert sorted((tuple(r) for r in check(df).collect()), key=repr) == want
    clashing = df.withColumn("rank", F.lit(1)).withColumn("path", F.lit("x")).withColumn("digest", F.lit("y")).withColumn("n", F.lit(0))
    assert sorted((tuple(r) for r in check(clashing).collect()), key=repr) == want


def test_empty_table(spark):
    assert check(spark.createDataFrame([], SCHEMA)).collect() == []
    assert merkle.manifest(spark.createDataFrame([], "id long, grp string, digest string"))[1] is None


def test_hot_group_spans_partitions(spark):
    """Ranks of one group come from several range partitions."""
    df = spark.range(5_000).select((F.col("id") * 7 % 5_000).alias("id"), F.lit("=a").alias("grp"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    ranked = merkle.ranked(df.repartition(4), ["id"], "test")
    assert [(r["rank"], r["n"]) for r in ranked.orderBy("id").collect()] == [(i, 5_000) for i in range(5_000)]
    tops = merkle.levels(ranked, "test")
    assert [t.count() for t in tops] == [313, 20, 2, 1]
    assert all(r.hi - r.lo <= 16 ** (i + 1) and r.lo % 16 ** (i + 1) == 0 and len(r.kids) <= 16 for i, t in enumerate(tops) for r in t.collect())


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({queries.ORACLES['op12_merkle_manifest']}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in queries.QUERIES["op12_merkle_manifest"](spark, SF).orderBy("doc_id").collect()]
    assert got == want and 0 < sum(r[-1] for r in got) < len(got)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(got, key=repr) == brute(docs)
