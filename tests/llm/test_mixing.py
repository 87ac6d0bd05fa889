import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import corpus_pipeline
from basketlens.llm import mixing as mx
from basketlens.llm import queries

from .util import SF


def weights(spark, w):
    return spark.createDataFrame(list(w.items()), "source string, weight double")


def check_schedule(rows):
    """Every slot used once, in its window; less than one block from the share after any number of slots."""
    assert sorted(r.slot0 for r in rows) == list(range(rows[0].period))
    sources = {r.source: r.parts for r in rows}
    by_slot = {r.slot0: r for r in rows}
    done = Counter()
    for t in range(rows[0].period):
        r = by_slot[t]
        assert r.release0 <= t < r.deadline0 and r.turn == done[r.source]
        done[r.source] += 1
        for s, parts in sources.items():
            assert abs(done[s] - Fraction((t + 1) * parts, r.period)) < 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0.01, 10), min_size=1, max_size=7))
def test_schedule_meets_all_deadlines(spark, ws):
    one = mx.shares(weights(spark, {f"s{i}": w for i, w in enumerate(ws)}), resolution=40)
    check_schedule(mx.period_schedule(one).collect())


def test_every_row_has_one_place_and_sources_keep_their_share(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), "x") for i in range(900)] + [(5, "a", "x"), (None, "b", "x"), (None, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    out = mx.mix(df, spark.createDataFrame([("a", 2.0), ("b", 1.0), (None, 1.0)], "source string, weight double"), block_rows=5, resolution=12).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((i, s) for i, s, _ in rows)
    by = defaultdict(list)
    for r in out:
        by[r.source].append((r.block, r.place))
    for places in by.values():
        assert sorted(places) == [(k // 5, k % 5) for k in range(len(places))]
    assert len({(r.slot, r.place) for r in out}) == len(out) and all(r.release <= r.slot < r.deadline for r in out)
    slots = {r.slot: r.source for r in out}
    for t in range(max(s for s, x in slots.items() if x is None)):
        n = sum(1 for s in range(t + 1) if slots.get(s) == "a")
        assert abs(n - (t + 1) / 2) < 1


def check_exactly(spark, ws, blocks):
    """All blocks in their windows, these within a slot (and 1e-8 blocks) of the unrounded shares, and less than one block from the unrounded share while all sources last."""
    frame = spark.createDataFrame(list(blocks.items()), "source string, blocks long")
    rows = sorted(mx.exact_schedule(weights(spark, ws), frame).collect(), key=lambda r: r.slot)
    share = {s: Fraction(w) / sum(map(Fraction, ws.values())) for s, w in ws.items()}
    assert Counter(r.source for r in rows) == Counter(blocks) and len({r.slot for r in rows}) == len(rows)
    done = Counter()
    for r in rows:
        assert r.block == done[r.source] and r.release <= r.slot < r.deadline
        assert abs(r.block - r.release * share[r.source]) < share[r.source] + 1e-8 and abs(r.block + 1 - r.deadline * share[r.source]) < share[r.source] + 1e-8
        done[r.source] += 1
        if all(done[s] < blocks[s] for s in share):
            assert all(abs(done[s] - (r.slot + 1) * share[s]) < 1 for s in share)


def test_exact_shares_at_length_and_below_a_thousandth(spark):
    ws = {"a": 2 ** 0.5, "b": 1.0, "c": 3.14159 / 7, "tiny": 3e-4}
    check_exactly(spark, ws, {s: int(3300 * w / sum(ws.values())) + 2 for s, w in ws.items()})
    check_exactly(spark, {"a": 1.0, "b": 1e-9}, {"a": 30, "b": 3})


def test_exact_shares_of_more_sources_than_a_period_holds(spark):
    check_exactly(spark, {f"s{i}": 1.0 + i % 7 for i in range(1100)}, {f"s{i}": 1 for i in range(1100)})


def test_exact_mix_is_broadcast_or_shuffled_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(300)] + [(None, "b")], "doc_id long, source string")
    w = mx.temperature_weights(df, 0.7).where("source IS DISTINCT FROM 'b'")
    few = sorted(map(str, mx.mix(df, w, block_rows=4).collect()))
    monkeypatch.setattr(mx, "BROADCAST_IDS", 0)
    assert sorted(map(str, mx.mix(df, w, block_rows=4).collect())) == few and sum("slot=None" in x for x in few) == 1


def test_sources_without_a_weight_follow_the_mix(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "doc_id long, source string")
    w = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", float("nan")), ("e", 3.0)], "source string, weight double")
    out = {r.doc_id: r.slot for r in mx.mix(df, w).collect()}
    assert out[1] is not None and out[2] is out[3] is out[4] is None
    ordered = [r.doc_id for r in mx.in_order(mx.scheduled(df, w), 2).collect()]
    assert ordered[0] == 1 and sorted(ordered) == [1, 2, 3, 4]


def test_empty_tables_and_too_many_sources(spark):
    df = spark.createDataFrame([], "doc_id long, source string")
    assert mx.mix(df, mx.temperature_weights(df, 0.5)).collect() == []
    assert mx.mix(spark.createDataFrame([(1, "a")], df.schema), spark.createDataFrame([], "source string, weight double")).collect()[0].slot is None
    with pytest.raises(Exception, match="more than 3 sources"):
        mx.shares(weights(spark, {str(i): 1.0 for i in range(4)}), resolution=3).collect()


def test_buckets_do_not_change_the_numbers(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)], "doc_id long, source string")

    def numbers():
        return sorted((r.row.doc_id, r.source, r.nr) for r in mx.numbered(df).collect())

    one = numbers()
    monkeypatch.setattr(mx, "BUCKET_ROWS", 3)
    assert numbers() == one


def test_written_files_hold_the_mix_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 4}") for i in range(400)], "doc_id long, source string")
    rows = mx.scheduled(df, mx.temperature_weights(df, 0.5), block_rows=4)
    want = [r.row.doc_id for r in rows.orderBy("slot", "place").collect()]
    mx.in_order(rows, 5).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index r").orderBy("f", "r").collect()
    assert [r.doc_id for r in got] == want


def test_no_python_in_the_plan(spark):
    plan = queries.QUERIES["op2_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_exact_shares_over_many_slots(spark):
    check_exactly(spark, {"third": 1 / 3, "rest": 2 / 3 - 1 / 5000, "tiny": 1 / 5000}, {"third": 6_700, "rest": 13_400, "tiny": 5})


def test_blocks_grow_with_the_table(spark, monkeypatch):
    df = spark.range(1_000)
    assert mx.block_size(df, 16) == 16
    monkeypatch.setattr(mx, "MAX_BLOCKS", 30)
    assert mx.block_size(df, 16) == 34 and mx.block_size(df.limit(0), 16) == 16


def test_query_and_pipeline_have_blocks_of_one_size_at_any_size(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, f"s{i % 3}") for i in range(400)], "doc_id long, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    def mixes():
        out = queries.QUERIES["op2_mixing"](spark, str(tmp_path)).orderBy("doc_id").collect()
        return out, [tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]

    want = mixes()
    monkeypatch.setattr(mx, "MAX_BLOCKS", 5)  # as a table of more blocks would meet it
    assert mixes() == want and max(r.place for r in want[0]) == queries.MIX_BLOCK - 1


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, source, block, place, slot, release, deadline FROM ({queries.OP2_SQL}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in queries.QUERIES["op2_mixing"](spark, SF).select("doc_id", "source", "block", "place", "slot", "release", "deadline").orderBy("doc_id").collect()] == want
