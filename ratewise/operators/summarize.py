"""Summaries: AGG1/AGG2 factor summary, AGG3 numeric summary, AGG4 level
counts, AGG20 histogram and Gaussian KDE behind the distribution figures."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FACTORS, MEASURES
from .factor_cells import factor_statistics
from .quantiles import PER_BUCKET, exact_quantiles, group_statistics
from .reshape import unpivot_factors

# Output suffix per measure and the numeric-summary labels.
MEASURE_SUFFIX = {
    "EARNED_EXPOSURE": "earned_exposure",
    "ULTIMATE_AMOUNT": "ultimate_amount",
    "ULTIMATE_CLAIM_COUNT": "ultimate_count",
}
QUARTILES = {"q1": 0.25, "med": 0.5, "q3": 0.75}
NUMERIC_SUMMARY_COLUMNS = ["Min.", "1st Qu.", "Median", "Mean", "3rd Qu.", "Max."]


def factor_summary(df: DataFrame, by: list[str] | None = None, factors: list[str] | None = None,
                   measures: list[str] | None = None, per_bucket: int = PER_BUCKET) -> DataFrame:
    """AGG2 over (by..., variable, level): count and min/q1/med/avg/q3/max/tot
    of each measure, with exact type-7 quartiles.

    Rows are counted by level and by cells of each measure's values, in the
    tasks that read them (``factor_cells``).  Sorted by (by, variable, level).
    """
    by = by or []
    factors = factors or FACTORS
    measures = measures or MEASURES
    tkeys = by + ["_vi", "level"]
    per_measure = factor_statistics(df, by, factors, measures, QUARTILES, per_bucket)
    aggs = [F.max("_rows").alias("count")]
    for i, m in enumerate(measures):
        s = MEASURE_SUFFIX.get(m, m.lower())
        pick = lambda col, i=i: F.first(F.when(F.col("_mi") == i, F.col(col)), ignorenulls=True)
        aggs += [pick("_min").alias(f"min_{s}"), pick("q1").alias(f"q1_{s}"), pick("med").alias(f"med_{s}"),
                 pick("_avg").alias(f"avg_{s}"), pick("q3").alias(f"q3_{s}"), pick("_max").alias(f"max_{s}"),
                 pick("_tot").alias(f"tot_{s}")]
    names = F.array(*[F.lit(f) for f in factors])
    basic = (per_measure.groupBy(*tkeys).agg(*aggs)
             .withColumn("variable", F.element_at(names, F.col("_vi") + 1)).drop("_vi"))
    return basic.select(*_summary_columns(by, measures)).orderBy(*by, "variable", "level")


def _summary_columns(by: list[str], measures: list[str]) -> list[str]:
    out = [*by, "variable", "level", "count"]
    for m in measures:
        s = MEASURE_SUFFIX.get(m, m.lower())
        out += [f"{x}_{s}" for x in ("min", "q1", "med", "avg", "q3", "max", "tot")]
    return out


#: Size parameter of the sketches, and the share of a group's rows by which a
#: sketch's quantile may miss its rank: 2.446 / k^0.9433 holds for one quantile
#: at 99 %; three times that covers all quartiles of a table of many groups.
SKETCH_K = 800


#: Groups of a factor whose quartiles are broadcast to the rows.
BROADCAST_LEVELS = 5_000


def sketch_error(k: int = SKETCH_K) -> float:
    return 3 * 2.446 / k ** 0.9433


def factor_sketches(df: DataFrame, by: list[str] | None = None, factors: list[str] | None = None,
                    measures: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """AGG1, stored form: per (by..., variable, level) the count and of each
    measure min, max, total, number of values and a mergeable quantile sketch
    of bounded size.  Partial sketches are merged on the map side, so a level
    that all rows have costs no more than any other; days or coverages that
    are summarised apart are rolled up from their sketches alone."""
    by, factors, measures = by or [], factors or FACTORS, measures or MEASURES
    long = unpivot_factors(df.select(*by, *measures, *factors), by + measures, factors)
    aggs = [F.count(F.lit(1)).alias("count")]
    for m in measures:
        s, v = MEASURE_SUFFIX.get(m, m.lower()), F.col(m).cast("double")
        aggs += [F.min(v).alias(f"min_{s}"), F.max(v).alias(f"max_{s}"), F.sum(v).alias(f"tot_{s}"), F.count(v).alias(f"n_{s}"),
                 F.kll_sketch_agg_double(v, F.lit(k)).alias(f"sketch_{s}")]
    return long.groupBy(*by, "variable", "level").agg(*aggs)


def roll_up(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Stored sketches of finer groups merged to ``keys``."""
    names = [c[len("sketch_"):] for c in sketches.columns if c.startswith("sketch_")]
    aggs = [F.sum("count").alias("count")]
    for s in names:
        aggs += [F.min(f"min_{s}").alias(f"min_{s}"), F.max(f"max_{s}").alias(f"max_{s}"), F.sum(f"tot_{s}").alias(f"tot_{s}"),
                 F.sum(f"n_{s}").alias(f"n_{s}"), F.kll_merge_agg_double(f"sketch_{s}").alias(f"sketch_{s}")]
    return sketches.groupBy(*keys).agg(*aggs)


def sketch_summary(sketches: DataFrame) -> DataFrame:
    """AGG1, readable form: the columns of ``factor_summary`` with quartiles
    from the sketches; NULL for a group without values."""
    out = sketches
    names = [c[len("sketch_"):] for c in sketches.columns if c.startswith("sketch_")]
    for s in names:
        some = F.col(f"n_{s}") > 0
        out = out.withColumns({f"avg_{s}": F.try_divide(f"tot_{s}", f"n_{s}")} | {
            f"{q}_{s}": F.when(some, F.kll_sketch_get_quantile_double(f"sketch_{s}", F.lit(p))) for q, p in QUARTILES.items()})
    keys = [c for c in sketches.columns[:sketches.columns.index("count")]]
    return out.select(*keys, "count", *[f"{x}_{s}" for s in names for x in ("min", "q1", "med", "avg", "q3", "max", "tot")])


def sketch_misses(df: DataFrame, summary: DataFrame, by: list[str] | None = None, factors: list[str] | None = None,
                  measures: list[str] | None = None) -> DataFrame:
    """How far each quartile of ``sketch_summary`` is from its rank: per
    (by..., variable, level, measure, quartile) ``miss``, the distance of p
    from the shares of the group's values below and up to the quantile."""
    by, factors, measures = by or [], factors or FACTORS, measures or MEASURES
    keys, names = [*by, "variable", "level"], {m: MEASURE_SUFFIX.get(m, m.lower()) for m in measures}
    found = summary.select(*keys, *[f"{q}_{s}" for s in names.values() for q in QUARTILES])
    # rows meet the quartiles of their group where they are, and only counts are exchanged; rows of factors with many
    # groups are exchanged
    sizes = found.groupBy("variable").agg(F.count("*").alias("n")).collect()                # a row for each factor
    many = [r["variable"] for r in sizes if r["n"] > BROADCAST_LEVELS]
    counts = []
    for s, m in ((s, m) for m, s in names.items()):
        v = F.col(f"a.`{m}`").cast("double")
        counts += [F.count(v).alias(f"n_{s}")] + [F.count_if(test).alias(f"{side}_{q}_{s}") for q in QUARTILES
                                                  for side, test in (("lo", v < F.col(f"b.{q}_{s}")), ("hi", v <= F.col(f"b.{q}_{s}")))]

    def counted(own: list[str], few: bool) -> DataFrame:
        groups = found.where(F.col("variable").isin(own))
        left = unpivot_factors(df.select(*by, *measures, *own), by + measures, own).alias("a")
        right = (F.broadcast(groups) if few else groups.hint("merge")).alias("b")
        joined = left.join(right, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys])
        return joined.groupBy(*[F.col(f"a.`{k}`") for k in keys]).agg(*counts)

    parts = [counted(own, few) for own, few in (([f for f in factors if f not in many], True), ([f for f in factors if f in many], False)) if own]
    shares = reduce(DataFrame.unionByName, parts)
    miss = lambda s, q, p: F.greatest(F.col(f"lo_{q}_{s}") / F.col(f"n_{s}") - p, p - F.col(f"hi_{q}_{s}") / F.col(f"n_{s}"), F.lit(0.0))
    there = [F.when(F.col(f"n_{s}") > 0, F.struct(F.lit(s).alias("measure"), F.lit(q).alias("quartile"), miss(s, q, p).alias("miss"), F.col(f"n_{s}").alias("n")))
             for s in names.values() for q, p in QUARTILES.items()]
    return shares.select(*keys, F.inline(F.array_compact(F.array(*there))))


def numeric_summary(df: DataFrame, by: list[str] | None = None, measures: list[str] | None = None,
                    per_bucket: int = PER_BUCKET) -> DataFrame:
    """AGG3 + RSH5: R ``summary()`` of each measure — Min., 1st Qu., Median,
    Mean, 3rd Qu., Max. — one row per (by..., variable).

    The measures are unpivoted first, so one grouped job replaces the three
    summaries + row-bind; every group is a whole column, which is exactly the
    hot-group case the skew-safe quantiles are built for.
    """
    by = by or []
    measures = measures or ["EARNED_EXPOSURE", "ULTIMATE_CLAIM_COUNT", "ULTIMATE_AMOUNT"]
    long = (df.select(*by, *[F.col(m).cast("double").alias(m) for m in measures])
              .unpivot(by, measures, "variable", "value"))
    keys = by + ["variable"]
    out = group_statistics(long, keys, "value", {"1st Qu.": 0.25, "Median": 0.5, "3rd Qu.": 0.75}, tag="variable", per_bucket=per_bucket)
    return out.select(*keys, F.col("_min").alias("Min."), F.col("`1st Qu.`"), F.col("Median"),
                      F.col("_avg").alias("Mean"), F.col("`3rd Qu.`"), F.col("_max").alias("Max."))


def level_counts(df: DataFrame, by: list[str] | None = None, factors: list[str] | None = None) -> DataFrame:
    """AGG4: rows per level of every plotted factor — one unpivot + grouped
    count instead of one job per factor."""
    by = by or []
    factors = factors or FACTORS
    long = unpivot_factors(df.select(*by, *factors), by, factors)
    return long.groupBy(*by, "variable", "level").agg(F.count(F.lit(1)).alias("n"))


def level_histogram(df: DataFrame, value: str, bins: int = 20, by: list[str] | None = None,
                    factors: list[str] | None = None) -> DataFrame:
    """AGG20 (violin data): per (by, variable, level) a ``bins``-bucket
    histogram of ``value`` over the global [min, max] of ``value`` within
    ``by``.  The range comes from a grouped aggregate joined back (one row per
    ``by`` group), not from a driver round trip."""
    by = by or []
    factors = factors or FACTORS
    v = F.col(value)
    src = _with_group_stats(df.select(*by, value, *factors), df, by,
                            [F.min(value).alias("_lo"), F.max(value).alias("_hi")])
    width = F.col("_hi") - F.col("_lo")
    bucket = (F.when(width == 0, F.lit(1))
               .otherwise(F.least(F.floor((v - F.col("_lo")) / width * bins), F.lit(bins - 1)) + 1))
    src = src.withColumn("bucket", bucket.cast("int"))
    long = unpivot_factors(src.where(v.isNotNull()), by + ["bucket", "_lo", "_hi"], factors)
    out = long.groupBy(*by, "variable", "level", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return out.select(*by, "variable", "level", "bucket",
                      (F.col("_lo") + (F.col("bucket") - 1) * w).alias("bin_lo"),
                      (F.col("_lo") + F.col("bucket") * w).alias("bin_hi"), "n")


def _attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate as scalar sub-queries
    (evaluated once, inlined as literals) — no join."""
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def _with_group_stats(src: DataFrame, df: DataFrame, by: list[str], aggs) -> DataFrame:
    """Per-``by`` statistics joined back on ``by``, or scalar sub-queries when
    ``by`` is empty."""
    stats = df.groupBy(*by).agg(*aggs)
    return _join_stats(src, stats, by) if by else _attach_scalars(src, stats)


#: Groups whose statistics are broadcast to the rows; more are joined by shuffle.
BROADCAST_GROUPS = 10_000


def _join_stats(src: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    few = src.select(*by).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return src.join(F.broadcast(stats) if few else stats, by, "inner")


def gaussian_kde(df: DataFrame, value: str, grid_points: int = 64, by: list[str] | None = None,
                 bandwidth: float | None = None) -> DataFrame:
    """AGG20 (density figures): Gaussian kernel density on an evenly spaced
    grid between the group's min and max.

    The bandwidth defaults to Silverman's rule 0.9·min(sd, IQR/1.34)·n^(-1/5)
    (R's ``bw.nrd0``).  Each value meets a fixed-size grid (``grid_points``,
    a parameter, not data-sized) through ``explode(sequence)``; the density is
    a partial-aggregated sum, so memory per task is constant.
    """
    by = by or []
    v = F.col(value).cast("double")
    base = df.select(*by, v.alias("_x")).where(F.col("_x").isNotNull())
    stats = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"),
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    if bandwidth is None:
        q = exact_quantiles(base, by, "_x", {"_q1": 0.25, "_q3": 0.75})
        stats = stats.join(q, by) if by else _attach_scalars(stats, q)
        iqr = (F.col("_q3") - F.col("_q1")) / 1.34
        spread = F.when(iqr > 0, F.least(F.col("_sd"), iqr)).otherwise(F.col("_sd"))
        bw = 0.9 * spread * F.pow(F.col("_n").cast("double"), -0.2)
        stats = stats.withColumn("_bw", F.when(bw > 0, bw).otherwise(F.lit(1.0)))
    else:
        stats = stats.withColumn("_bw", F.lit(float(bandwidth)))
    stats = stats.drop("_q1", "_q3", "_sd")
    # equal values meet the grid once
    counted = base.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    joined = _join_stats(counted, stats, by) if by else _attach_scalars(counted, stats)
    step = (F.col("_hi") - F.col("_lo")) / max(grid_points - 1, 1)
    pts = joined.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))))
    pts = pts.withColumn("x", F.col("_lo") + F.col("_g") * step)
    z = (F.col("x") - F.col("_x")) / F.col("_bw")
    kern = F.exp(-0.5 * z * z) / (F.col("_bw") * math.sqrt(2 * math.pi))
    return (pts.groupBy(*by, "_g", "x")
               .agg((F.sum(kern * F.col("_c")) / F.first("_n")).alias("density"))
               .withColumnRenamed("_g", "grid_index"))


def six_numbers(df: DataFrame, keys: list[str], value: str, per_bucket: int = PER_BUCKET) -> DataFrame:
    """keys + min, q1, med, avg, q3, max of ``value`` per group (exact type-7
    quartiles, skew-safe: a group may be a whole prediction file)."""
    out = group_statistics(df, keys, value, QUARTILES, per_bucket=per_bucket)
    return out.select(*keys, F.col("_min").alias("min"), "q1", "med", F.col("_avg").alias("avg"),
                      "q3", F.col("_max").alias("max"))
