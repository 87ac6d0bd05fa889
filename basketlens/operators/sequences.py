"""Per-key ordered-sequence kernels that stay parallel under a hot key.

``bounded_history`` gives each row the values of its key's previous ``k``
rows (in a total order) without a ``Window.partitionBy(key)`` over all of
the key's rows: rows are cut into (key, time bucket) partitions, and each
bucket receives a halo of the last ``k`` rows that precede it, found from a
summary with at most ``k + 1`` rows per (key, bucket).

``global_rank`` ranks a whole column with a range-partitioned sort and
per-partition offsets, so no window without ``partitionBy`` (one task) is
needed for percent ranks or rank-sum statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _shuffle_partitions(spark) -> int:
    """The session's shuffle partition count (200 when unset or not numeric)."""
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        return 200


def _micros(ts: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            F.col(ts).cast("timestamp_ntz"))


#: Rows of a key that one time bucket holds at most, about (but for equal times).
BUCKET_ROWS = 1_000_000
SPLIT = 16               # parts that a full bucket is cut into


def _cell(ts: str, width: int) -> Column:
    """Start, in microseconds, of the time cell of a width."""
    m = _micros(ts)
    return (m - F.pmod(m, F.lit(width).cast("bigint"))).cast("bigint")


def time_buckets(frames: list[tuple[DataFrame, str]], keys: list[str], base_seconds: int, limit: int | None = None, out: str = "_b",
                 counts: list[int | None] | None = None) -> list[DataFrame]:
    """The frames (each with its time column) with ``out``, a time bucket (its
    start) that no key fills with more than ``limit`` rows of all frames
    together, whatever the density: a (key, bucket) of ``base_seconds`` that
    holds more is cut into SPLIT parts, and full parts again, down to a
    microsecond. Buckets are the same for all frames and don't decrease with time.

    Full cells are found by counts with map-side partial sums, only inside the
    full cells of the level above; no more than ``limit`` rows in all need no
    such count (``counts``: rows of the frames, where the caller knows them).
    A level's full cells are at most rows / limit, and are
    joined to the rows (broadcast when Spark finds them small)."""
    from ..sources.shared import materialize

    limit = limit or BUCKET_ROWS
    width = base_seconds * 1_000_000
    found = [df.withColumn(out, _cell(ts, width)) for df, ts in frames]
    total = 0
    for (df, _), known in zip(frames, counts or [None] * len(frames)):
        total += df.count() if known is None else known
        if total > limit:
            break
    else:
        return found
    rows = [df.select(*keys, F.col(ts).alias("_t"), out) for df, (_, ts) in zip(found, frames)]
    everything = rows[0]
    for r in rows[1:]:
        everything = everything.unionByName(r)
    while True:
        full = everything.groupBy(*keys, out).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
        full = materialize(full.select(*[F.col(k).alias(f"_full_{k}") for k in keys], F.col(out).alias("_full")), "full-buckets")
        if width == 1 or full.isEmpty():
            return found
        width = max(1, width // SPLIT)

        def same(df: DataFrame) -> Column:
            on = F.col(out) == F.col("_full")
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"_full_{k}"))
            return on

        everything = everything.join(full, same(everything), "left_semi").withColumn(out, _cell("_t", width))
        found = [df.join(full, same(df), "left").withColumn(out, F.when(F.col("_full").isNotNull(), _cell(ts, width)).otherwise(F.col(out)))
                 .drop("_full", *[f"_full_{k}" for k in keys]) for df, (_, ts) in zip(found, frames)]


def _last_n(arr: Column, n: int) -> Column:
    """Last ``n`` elements of an array (all of it when shorter)."""
    return F.slice(arr, F.greatest(F.lit(1), F.size(arr) - F.lit(n - 1)), F.lit(n))


def bounded_history(df: DataFrame, key: str, ts: str, tiebreak: str, value: str, k: int,
                    bucket_seconds: int = 86400, out: str = "history") -> DataFrame:
    """Add ``out``: array of ``value`` over the key's last ``k+1`` rows up to and
    including the current one, oldest first (like ``rowsBetween(-k, 0)``)."""
    d = time_buckets([(df, ts)], [key], bucket_seconds)[0]
    order = [F.col(ts), F.col(tiebreak)]
    # 1. last k rows of every (key, bucket): WindowGroupLimit keeps this partial.
    w_desc = Window.partitionBy(key, "_b").orderBy(F.col(ts).desc(), F.col(tiebreak).desc())
    tail = (d.withColumn("_r", F.row_number().over(w_desc)).where(F.col("_r") <= k)
             .select(key, "_b", ts, tiebreak, F.col(value).alias("_v"), F.lit(False).alias("_marker")))
    # 2. one marker per non-empty (key, bucket); the halo of a bucket is the last k
    #    real rows before its marker. Markers never outnumber real rows + 1, so a
    #    frame of 2k+1 rows always holds k real ones when they exist.
    markers = (tail.select(key, "_b").distinct()
                   .select(key, "_b", F.lit(None).cast(df.schema[ts].dataType).alias(ts),
                           F.lit(None).cast(df.schema[tiebreak].dataType).alias(tiebreak),
                           F.lit(None).cast(df.schema[value].dataType).alias("_v"),
                           F.lit(True).alias("_marker")))
    w_key = (Window.partitionBy(key)
             .orderBy(F.col("_b"), F.col("_marker").desc(), F.col(ts), F.col(tiebreak))
             .rowsBetween(-(2 * k + 1), -1))
    halo = (tail.unionByName(markers)
                .withColumn("_prev", F.collect_list(
                    F.when(~F.col("_marker"), F.struct(F.col("_b"), F.col(ts), F.col(tiebreak), F.col("_v"))))
                    .over(w_key))
                .where(F.col("_marker"))
                .select(key, "_b", _last_n(F.transform(F.array_sort("_prev"), lambda s: s["_v"]),
                                           k).alias("_halo")))
    # 3. in-bucket frame joined with the halo.
    w_in = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(-k, 0)
    empty = F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")
    res = (d.withColumn("_in", F.collect_list(value).over(w_in))
            .join(halo, [key, "_b"], "left")
            .withColumn(out, _last_n(F.concat(F.coalesce(F.col("_halo"), empty), F.col("_in")), k + 1)))
    return res.drop("_b", "_in", "_halo")


def _running_before(batches):
    """Per partition: count of rows with a smaller value (rows arrive sorted)."""
    carry = 0
    for pdf in batches:
        n = pdf["_n"].astype("int64")
        csum = n.cumsum()
        pdf["_before_local"] = (csum - n + carry).astype("int64")
        carry += int(n.sum())
        yield pdf


def global_rank(df: DataFrame, value: str, out: str = "rank", partitions: int | None = None) -> DataFrame:
    """SQL ``rank()`` (1-based, ties share the lowest rank) over the whole of
    ``value``, without a single-partition window.

    Distinct values with their counts are range-partitioned and sorted; a
    per-partition running count (``mapInPandas``, no shuffle) plus the total
    of all earlier partitions is the number of smaller values. The running
    counts are written, with the partition they were made in, before the
    totals are taken: range boundaries come from a sample, so evaluating the
    partitioning once for the counts and again for the totals would only be
    right if Spark happened to reuse the exchange. Only one row per partition
    is ever combined in one place. Null values get no rank.
    """
    from ..sources.shared import materialize
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    n_parts = partitions or _shuffle_partitions(df.sparkSession)
    ranged = (counts.repartitionByRange(n_parts, F.col(value))
                    .sortWithinPartitions(F.col(value))
                    .withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType(ranged.schema.fields + [T.StructField("_before_local", T.LongType())])
    local = materialize(ranged.mapInPandas(_running_before, schema), "global-rank")
    totals = local.groupBy("_pid").agg(F.sum("_n").alias("_tot"))
    # one row per partition: a global window here is bounded by the partition count
    offsets = totals.select("_pid", F.coalesce(
        F.sum("_tot").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_offset"))
    ranks = (local.join(F.broadcast(offsets), "_pid")
                  .select(value, (F.col("_offset") + F.col("_before_local") + 1).cast("bigint").alias(out),
                          F.col("_n").alias(f"{out}_ties")))
    return df.join(ranks, value, "left")


def number_within(df: DataFrame, key: str, bucket: Column, order: list[Column], out: str = "seq") -> DataFrame:
    """1-based position of each row in its key's total order, without a window
    over a whole key. ``bucket`` must not decrease along the order: rows are
    numbered inside (key, bucket) and shifted by the sizes of the key's
    earlier buckets (one summary row each)."""
    d = _bucketed(df, key, bucket)
    sizes = d.groupBy("_kb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_kb.k").orderBy("_kb.b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_kb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = d.withColumn("_r", F.row_number().over(Window.partitionBy("_kb").orderBy(*order)))
    return (inside.join(offsets, "_kb").withColumn(out, (F.col("_before") + F.col("_r")).cast("bigint")).drop("_kb", "_before", "_r"))


def _bucketed(df: DataFrame, key: str, bucket: Column) -> DataFrame:
    """Rows dealt by ``_kb``, (key, bucket) as one struct: equal structs may
    hold nulls, so windows, summaries and the joins between them all use this
    one exchange, null keys included."""
    return df.withColumn("_kb", F.struct(F.col(key).alias("k"), bucket.alias("b"))).repartition("_kb")


def lag_within(df: DataFrame, key: str, bucket: Column, order: list[str], values: dict[str, str], number: str | None = None) -> DataFrame:
    """Add the previous row's ``values`` (column -> new name) in each key's
    total order (columns ``order``), without a window over a whole key: a lag
    inside (key, bucket), and for a bucket's first row the last row of the
    key's bucket before. ``bucket`` must not decrease along the order. The
    first row of a key gets nulls. ``number`` names a column for the row's
    1-based position in its key, made in the same pass."""
    d = _bucketed(df, key, bucket)
    packed = F.struct(*[F.col(c).alias(n) for c, n in values.items()])
    # a bucket's last row with all columns, so that rows and summary read the same exchange
    last = d.groupBy("_kb").agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("_kb.k").orderBy("_kb.b")
    carried = last.select("_kb", F.lag(F.struct(*[F.col("_row")[c].alias(n) for c, n in values.items()])).over(along).alias("_carried"),
                          F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_kb").orderBy(*order)
    out = d.withColumn("_prev", F.lag(packed).over(w))
    if number:
        out = out.withColumn("_r", F.row_number().over(w))
    out = out.join(carried, "_kb").withColumn("_prev", F.coalesce("_prev", "_carried"))
    made = [(F.col("_before") + F.col("_r")).cast("bigint").alias(number)] if number else []
    return out.select(*df.columns, *made, *[F.col(f"_prev.{n}").alias(n) for n in values.values()])


def month_index(ts: str) -> Column:
    """Months since year 0: a time bucket for long histories."""
    return F.year(ts) * 12 + F.month(ts)


def interval_anti_join(starts: DataFrame, answers: DataFrame, key: str, within_seconds: int,
                       start_ts: str = "ts", answer_ts: str = "ts") -> DataFrame:
    """Start rows with no answer of the same key in (t, t + within].

    The equality key is (key, time bucket of width ``within``): an answer in
    bucket ``c`` can only serve starts in buckets ``c`` and ``c - 1``, so it
    is sent to both. Only the next answer after a start matters: inside a
    (key, bucket) the rows are read once from the latest to the earliest,
    carrying the last answer seen, so a full bucket costs a sort, not a
    comparison of every start with every answer.
    """
    w = F.make_dt_interval(secs=F.lit(within_seconds))
    s = starts.withColumn("_b", _bucket_of(start_ts, within_seconds)).withColumn("_is_answer", F.lit(0))
    a = (answers.where(F.col(key).isNotNull() & F.col(answer_ts).isNotNull())
                .select(F.col(key), F.col(answer_ts).alias(start_ts), F.col(answer_ts).alias("_a_ts"), F.lit(1).alias("_is_answer"))
                .withColumn("_ab", _bucket_of(start_ts, within_seconds))
                .withColumn("_b", F.explode(F.array(F.col("_ab"), F.col("_ab") - 1))).drop("_ab"))
    # an answer at the very time of a start doesn't serve it: it comes after it here
    later = Window.partitionBy(key, "_b").orderBy(F.desc(start_ts), F.asc("_is_answer")).rowsBetween(Window.unboundedPreceding, -1)
    both = s.unionByName(a, allowMissingColumns=True).withColumn("_next", F.last("_a_ts", ignorenulls=True).over(later))
    return both.where((F.col("_is_answer") == 0) & (F.col("_next").isNull() | (F.col("_next") > F.col(start_ts) + w))).select(*starts.columns)


def _bucket_of(ts: str, seconds: int) -> Column:
    m = _micros(ts)
    d = F.lit(seconds * 1_000_000).cast("bigint")
    return ((m - F.pmod(m, d)) / d).cast("bigint")


def rank_within(df: DataFrame, group: str, order: list[Column], out: str = "rank") -> DataFrame:
    """0-based rank inside ``group`` by ``order`` without a per-group window:
    a global distributed rank of (group, order...) minus the group's first
    rank (one row per group)."""
    keyed = df.withColumn("_k", F.struct(F.col(group).alias("_g"), *order))
    r = global_rank(keyed, "_k", out="_gr").drop("_gr_ties")
    first = r.groupBy(group).agg(F.min("_gr").alias("_g0"))
    return r.join(first, group).withColumn(out, (F.col("_gr") - F.col("_g0")).cast("bigint")).drop("_k", "_gr", "_g0")
