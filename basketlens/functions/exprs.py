"""Scalar column helpers (inventory F1-F18). All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts) -> Column:
    """Seconds since epoch as double, independent of the session time zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                              _c(ts).cast("timestamp_ntz"))
    return micros / 1e6


def from_epoch(sec) -> Column:
    """epoch seconds (double) -> timestamp (reference uses to_timestamp)."""
    return F.timestamp_seconds(_c(sec))


def hour_key(ts) -> Column:
    """hour bucket key ``yyyyMMddHH``."""
    return F.date_format(_c(ts), "yyyyMMddHH")


def floor_bucket(ts, seconds: int) -> Column:
    """floor a timestamp to a ``seconds`` bucket (as epoch seconds, bigint)."""
    return (F.floor(epoch_seconds(ts) / seconds) * seconds).cast("bigint")


def try_ratio(a, b) -> Column:
    """guarded ratio; null when the denominator is 0 or null."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def ratio_or_zero(a, b) -> Column:
    """F6 where the reference says 0 for an empty denominator."""
    return F.coalesce(try_ratio(a, b), F.lit(0.0))


def key_concat(*cols) -> Column:
    """F8: ``f"{a}:{b}"`` keys."""
    return F.concat_ws(":", *[_c(c).cast("string") for c in cols])


def md5_mod(s, modulus: int) -> Column:
    """``int(md5(s).hexdigest(), 16) % modulus`` without a UDF.

    The 128-bit digest is folded four 32-bit hex chunks at a time (Horner's
    rule modulo ``modulus``), so every intermediate fits in a bigint.
    """
    h = F.md5(_c(s).cast("string"))
    base = (1 << 32) % modulus
    acc = F.lit(0).cast("bigint")
    for i in range(4):
        chunk = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")
        acc = (acc * F.lit(base) + chunk % F.lit(modulus)) % F.lit(modulus)
    return acc


# Abramowitz & Stegun 26.2.17 coefficients for the normal tail.
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def norm_sf(x) -> Column:
    """Upper tail 1 - Phi(x) for x >= 0 (A&S 26.2.17, abs error < 7.5e-8)."""
    x = _c(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * x)
    poly = F.lit(0.0)
    for b in reversed(AS_B):
        poly = (poly + F.lit(b)) * t
    pdf = F.exp(-x * x / 2.0) / F.lit((2 * 3.141592653589793) ** 0.5)
    return pdf * poly


def two_sided_p(z) -> Column:
    """two-sided p-value ``2 * (1 - Phi(|z|))``."""
    return F.lit(2.0) * norm_sf(F.abs(_c(z)))


def norm_sf_sql(x: str) -> str:
    """Same polynomial as SQL text (for the DuckDB oracle)."""
    t = f"(1.0/(1.0+{AS_P}*({x})))"
    poly = "0.0"
    for b in reversed(AS_B):
        poly = f"(({poly})+({b}))*{t}"
    return f"(exp(-({x})*({x})/2.0)/{(2 * 3.141592653589793) ** 0.5!r}*({poly}))"


def category_sim(a, b) -> Column:
    """0.8 equal, 0.5 same 3-char prefix (both non-empty), else 0.1."""
    a = F.coalesce(_c(a), F.lit(""))
    b = F.coalesce(_c(b), F.lit(""))
    return (F.when(a == b, F.lit(0.8))
            .when((F.length(a) > 0) & (F.length(b) > 0)
                  & (F.substring(a, 1, 3) == F.substring(b, 1, 3)), F.lit(0.5))
            .otherwise(F.lit(0.1)))


def cents(x) -> Column:
    """Money/duration as integer cents so sums are exact in every engine."""
    return F.round(_c(x) * 100).cast("bigint")


def mean_from_cents(sum_cents, n) -> Column:
    return F.try_divide(_c(sum_cents).cast("double"), F.lit(100.0) * _c(n).cast("double"))


def r6(x) -> Column:
    """Round a double to 6 places (results compared across engines)."""
    return F.round(_c(x).cast("double"), 6)


def sorted_csv(arr) -> Column:
    """Array as a sorted comma string (stable across engines)."""
    return F.array_join(F.sort_array(_c(arr).cast("array<string>")), ",")


def epoch_micros(ts) -> Column:
    """Microseconds since epoch (bigint), time-zone independent."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            _c(ts).cast("timestamp_ntz"))


def bucket_index(ts, seconds: int) -> Column:
    """Exact integer ``floor(epoch / seconds)`` (no floating-point rounding)."""
    m = epoch_micros(ts)
    d = F.lit(seconds * 1_000_000).cast("bigint")
    return ((m - F.pmod(m, d)) / d).cast("bigint")


NTZ_EPOCH = "1970-01-01 00:00:00"


def ntz_from_bucket(idx, seconds: int) -> Column:
    """Start of bucket ``idx`` (of ``seconds``) as TIMESTAMP_NTZ, independent
    of the session time zone."""
    return (F.lit(NTZ_EPOCH).cast("timestamp_ntz")
            + F.make_dt_interval(secs=(_c(idx) * F.lit(seconds)).cast("decimal(18,6)")))


def trunc_hour_ntz(ts) -> Column:
    """Hour start of a wall-clock timestamp without time-zone conversion."""
    return ntz_from_bucket(bucket_index(ts, 3600), 3600)


def week_start_ntz(ts) -> Column:
    """Monday 00:00 of the timestamp's week (ISO), without time-zone conversion."""
    return F.date_sub(F.next_day(F.to_date(_c(ts).cast("timestamp_ntz")), "Mon"), 7).cast("timestamp_ntz")
