"""Panes, margins and posting lists against plain forms."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketlens.operators import catalog, metrics
from basketlens.sources import shared

from .conftest import SF_SMALL

T0 = datetime(2024, 3, 1, 23, 50)


def test_sliding_users_without_copies_of_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, *range(2, 12), None]), T0 + timedelta(seconds=rng.choice([rng.randrange(5_000), rng.randrange(90_000)]))) for _ in range(800)] + [(3, None)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")
    want = {}
    for u, t in rows:
        if u is not None and t is not None:
            for k in range(5):
                want.setdefault(t.replace(second=0, microsecond=0) - timedelta(minutes=k), set()).add(u)
    out = metrics.active_users_sliding(df)
    assert {r.window_start: (r.active_users, r.window_end) for r in out.collect()} == {s: (len(u), s + timedelta(minutes=5)) for s, u in want.items()}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert metrics.active_users_sliding(df.limit(0)).count() == 0


def test_pane_sketches_merge_to_the_windows(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3_000), T0 + timedelta(seconds=rng.randrange(1_800))) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")
    exact = {r.window_start: r.active_users for r in metrics.active_users_sliding(df).collect()}
    about = {r.window_start: r.active_users for r in metrics.active_users_from_panes(metrics.active_user_panes(df)).collect()}
    assert set(about) == set(exact)
    errors = [abs(about[w] - n) / n for w, n in exact.items()]
    assert max(errors) < 0.08 and sum(errors) / len(errors) < 0.025


def test_cube_margins_are_sums_of_cells(spark):
    import __spark_entry__ as entry
    rows = {(r.user_cohort, r.item_cohort): r for r in entry.queries()["cold_start_cube"](spark, SF_SMALL).collect()}
    cells = [r for r in rows.values() if r.margin == 0]
    total = rows[(None, None)]
    assert (total.margin, total.n, total.clicks) == (3, sum(r.n for r in cells), sum(r.clicks for r in cells))
    for c in {r.user_cohort for r in cells}:
        assert rows[(c, None)].n == sum(r.n for r in cells if r.user_cohort == c) and rows[(c, None)].margin == 1


@pytest.fixture(scope="module")
def products(spark):
    rng = random.Random(3)
    words = ["red", "Bolt", "ring", "small-ring", "économie", "x1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) if i % 9 else None, rng.choice([*words, None]), {"type": rng.choice(words)} if i % 7 else None) for i in range(300)]
    return spark.createDataFrame(rows, "product_id long, name string, description string, specs map<string,string>")


def test_index_gives_the_rows_of_the_scan(spark, products):
    path = shared.shared_path(spark, "test-index")
    catalog.write_index(products, path)
    whole = products.withColumn("specs", F.coalesce("specs", F.expr("map('', '')"))).fillna("", ["name", "description"])
    for terms in (["red", "ring"], ["BOLT"], ["nothing"], ["x1", "x1", "small"]):
        want = sorted((r.product_id, r.score) for r in catalog.boosted_search(whole, terms).collect())
        assert sorted(tuple(r) for r in catalog.search_index(spark, path, terms).collect()) == want
        named = sorted(r.product_id for r in catalog.keyword_search(whole, terms).collect())
        assert sorted(r.product_id for r in catalog.search_index(spark, path, terms, {"name": 1, "description": 1}).collect()) == named
    n = Counter(r.product_id for r in catalog.posting_lists(products).where("term = 'red'").select("product_id").distinct().collect())
    assert catalog.term_frequencies(spark, path, ["red", "none"]).collect()[0].asDict() == {"term": "red", "products": len(n)}


def test_posting_lists_are_summed_after_the_products_are_dealt(spark, products):
    """No task sums the terms of a whole split of the products; rows of one id meet all the same."""
    plan = catalog.posting_lists(products, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.rfind("Exchange hashpartitioning(product_id") > plan.rfind("HashAggregate") > -1
    twice = catalog.posting_lists(products.union(products), 4)
    once = Counter({(r.term, r.field, r.product_id): 2 * r.hits for r in catalog.posting_lists(products).collect()})
    assert Counter({(r.term, r.field, r.product_id): r.hits for r in twice.collect()}) == once and twice.count() == len(once)


def test_a_search_reads_only_the_lists_of_its_terms(spark, products):
    path = shared.shared_path(spark, "test-index")
    catalog.write_index(products, path)
    plan = catalog.search_index(spark, path, ["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert "PushedFilters: [" in plan and "EqualTo(term,red)" in plan or "In(term" in plan
    files = spark.read.parquet(f"{path}/lists").where("term = 'red'").select(F.input_file_name()).distinct().count()
    assert files >= 1


def test_variant_metrics_scan_the_log_few_times(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["variant_metrics"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert sum("events.parquet" in line for line in plan.splitlines()) <= 3
