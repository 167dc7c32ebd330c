"""Exact (R type 7 / linear interpolation) quantiles per group that never
hold one group in one task.

Spark's built-in ``percentile`` keeps a value→count map per group in a
single aggregation buffer; a constant factor (one level = every row) or a
coverage-wide numeric summary would therefore pull a whole column through
one task.  Here the quantile is found from global ranks instead:

1. value-frequency table per (group, value) – partial aggregation collapses
   repeated values on the map side.  It is written once, and everything below
   reads it instead of the rows;
2. order-preserving value buckets: split points of each measure's *distinct*
   values (so a rare measure is spread as evenly as a dense one), about
   ``PER_BUCKET`` values to a bucket, embedded as literals;
3. an index of one row per (group, bucket): its rows, extremes and sum, and
   the rows in the group's buckets before it (window bounded by the number of
   buckets).  Counts, extremes, totals and means are rolled up from it;
4. running counts per (group, bucket) (window bounded by one bucket); only the
   values whose rank interval covers floor/ceil of h = (n - 1) p are kept and
   interpolated: x_lo + (h - floor h)(x_hi - x_lo).

One path for every size: few distinct values simply mean one bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage

#: Distinct values of a bucket, and the most buckets of one measure.
PER_BUCKET, MAX_BUCKETS = 65_536, 1024


def value_splits(values: DataFrame, value: str, tag: str | None = None, per_bucket: int = PER_BUCKET) -> dict:
    """Split points of the distinct values of each ``tag`` (None without one),
    as bounded lists of doubles.  They are baked into the plan as literals, so
    every re-execution (retries, lost executors, both sides of a self-join)
    assigns the same bucket to a row."""
    tags = [F.col(f"`{tag}`").alias("_t")] if tag else [F.lit(None).cast("string").alias("_t")]
    x = values.select(*tags, F.col(f"`{value}`").cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    out = {}
    for r in x.groupBy("_t").agg(F.approx_count_distinct("_x").alias("n")).collect():      # a row for each measure
        n = min(MAX_BUCKETS, -(-r["n"] // per_bucket))
        points = []
        if n > 1:
            own = x.where(F.col("_t").eqNullSafe(F.lit(r["_t"]))).select("_x").distinct()
            points = sorted(set(own.approxQuantile("_x", [i / n for i in range(1, n)], 1.0 / (4 * n))))
        out[r["_t"]] = points
    return out


def bucket_of(v, splits: list[float]):
    """Index of the bucket of ``v`` among sorted ``splits`` (number of split
    points strictly below ``v``) as a balanced CASE tree: log2(n) compares."""
    def build(lo: int, hi: int):
        # answer lies in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > F.lit(splits[mid]), build(mid + 1, hi)).otherwise(build(lo, mid))
    return build(0, len(splits))


def value_frequencies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys + ``_v`` (value as double, NULL kept as its own row) + ``_c``
    (rows).  The partial aggregate collapses repeats before the shuffle."""
    vals = df.select(*keys, F.col(value).cast("double").alias("_v"))
    return vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))


def _bucket(splits: dict, tag: str | None):
    """The bucket of ``_v`` among the split points of the row's measure; NULL
    is in the first one."""
    if tag is None or len(splits) <= 1:
        return bucket_of(F.col("_v"), next(iter(splits.values()), []))
    out = None
    for t, points in splits.items():
        here, b = F.col(f"`{tag}`") == F.lit(t), bucket_of(F.col("_v"), points)
        out = F.when(here, b) if out is None else out.when(here, b)
    return out.otherwise(F.lit(0))


def group_statistics(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], tag: str | None = None,
                     per_bucket: int = PER_BUCKET) -> DataFrame:
    """One row per group of ``keys``: ``_rows`` (NULL values included), ``_n``
    (without them), ``_min``, ``_max``, ``_tot``, ``_avg`` and a type-7 quantile
    for each entry of ``probs``.  ``tag`` is the key that names the measure of
    a row, if there are several.  NULL keys form groups of their own."""
    vf = stage(value_frequencies(df, keys, value), "value-frequencies")
    bucket = _bucket(value_splits(vf, "_v", tag, per_bucket), tag)
    # a struct of the keys equals itself with NULL fields too, so plain joins do
    key = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("_"))
    vf = vf.select(key.alias("_k"), bucket.alias("_b"), "_v", "_c")
    c, v = F.col("_c"), F.col("_v")
    there = F.sum(F.when(v.isNotNull(), c).otherwise(0))
    group = Window.partitionBy("_k")
    index = vf.groupBy("_k", "_b").agg(F.sum(c).alias("_rows"), there.alias("_pc"), F.min(v).alias("_min"), F.max(v).alias("_max"),
                                       F.sum(v * c).alias("_tot"))
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    index = index.select("_k", "_b", F.coalesce(F.sum("_pc").over(before), F.lit(0)).alias("_off"), F.sum("_pc").over(group).alias("_n"),
                         F.sum("_rows").over(group).alias("_rows"), F.min("_min").over(group).alias("_min"),
                         F.max("_max").over(group).alias("_max"), F.sum("_tot").over(group).alias("_tot"))
    running = Window.partitionBy("_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = vf.withColumn("_cum", F.sum(F.when(v.isNotNull(), c).otherwise(0)).over(running))
    pos = ranked.join(index, ["_k", "_b"])
    end = F.col("_off") + F.col("_cum")          # exclusive end position (0-based)
    start = end - c
    aggs, covers = [], []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        for side, idx in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            flag = v.isNotNull() & (idx >= start) & (idx < end)
            covers.append(flag)
            aggs.append(F.max(F.when(flag, v)).alias(f"_{side}_{_safe(name)}"))
    # a group without values keeps its NULL row alone
    wanted = pos.where(_any(covers) | v.isNull())
    once = [F.first(x).alias(x) for x in ("_rows", "_n", "_min", "_max", "_tot")]
    picked = wanted.groupBy("_k").agg(*once, *aggs)
    out = [F.col(f"_k.`{k}`").alias(k) for k in keys] + ["_rows", "_n", "_min", "_max", "_tot", F.try_divide("_tot", "_n").alias("_avg")]
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{_safe(name)}"), F.col(f"_hi_{_safe(name)}")
        out.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return picked.select(*out)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    per_bucket: int = PER_BUCKET) -> DataFrame:
    """Return ``keys`` + one double column per entry of ``probs`` (name → p).

    NULL values are skipped (Spark semantics); groups without any non-NULL
    value are absent.  NULL keys form their own group.
    """
    return group_statistics(df, keys, value, probs, per_bucket=per_bucket).where("_n > 0").select(*keys, *probs)


def _safe(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name)


def _any(flags):
    acc = flags[0]
    for f in flags[1:]:
        acc = acc | f
    return acc


def type7_quantile(values: list[float], p: float) -> float:
    """Reference implementation for tests (R type 7)."""
    xs = sorted(values)
    h = (len(xs) - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    return xs[lo] + (h - lo) * (xs[hi] - xs[lo])
