"""Categorical encodings: ML1 ordinal encoding, ML2 'EnumLimited' top-k
lumping and 'Eigen' (first principal component of the one-hot).

The fitted state of an encoder is a (variable, level, code) table, bounded by
the factor cardinalities, not by rows.  It is joined to the long form of the
rows here; ``ml.features`` applies it to model rows through an indexer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reshape import unpivot_factors

MAX_ENCODED_LEVELS = 2_000_000   # size bound for the driver-side mapping


def ordinal_codes(train: DataFrame, features: list[str]) -> DataFrame:
    """Fit ML1: (variable, level, code) with code = dense_rank - 1 over the
    distinct train levels; a factor whose levels all parse as numbers is
    ordered numerically, otherwise as text.  NULL levels get no code."""
    long = unpivot_factors(train.select(*features), [], features).where(F.col("level").isNotNull())
    levels = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("_rows"))
    num = F.expr("try_cast(level AS DOUBLE)")
    numeric = levels.groupBy("variable").agg(F.bool_and(num.isNotNull()).alias("_numeric"))
    lv = levels.join(numeric, "variable")
    sort_num = F.when(F.col("_numeric"), num)
    w = Window.partitionBy("variable").orderBy(sort_num.asc_nulls_last(), F.col("level"))
    return lv.select("variable", "level", (F.dense_rank().over(w) - 1).cast("int").alias("code"))


def transform_join(df: DataFrame, codes: DataFrame, key: str, features: list[str]) -> DataFrame:
    """ML1 transform for unbounded level sets: long form join with the code
    table (one shuffle), result (key, variable, code)."""
    long = unpivot_factors(df.select(key, *features), [key], features)
    return (long.join(codes, ["variable", "level"], "left")
                .select(key, "variable", F.coalesce("code", F.lit(-1)).alias("code")))


def top_levels(train: DataFrame, features: list[str], k: int, buckets: int = 64) -> DataFrame:
    """ML2 fit: the k most frequent levels of each factor (ties by level).

    Two-stage top-k so a factor with millions of levels never sits in one
    window: rank inside (variable, hash bucket of level), keep ≤ k per bucket,
    then rank the ≤ k·buckets survivors per variable."""
    long = unpivot_factors(train.select(*features), [], features).where(F.col("level").isNotNull())
    counts = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_bk", F.abs(F.xxhash64("level")) % buckets)
    w1 = Window.partitionBy("variable", "_bk").orderBy(F.desc("n"), "level")
    stage1 = counts.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy("variable").orderBy(F.desc("n"), "level")
    return (stage1.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
                  .select("variable", "level", "n", "rank"))


def enum_limited(df: DataFrame, top: DataFrame, key: str, features: list[str],
                 other: str = "other") -> DataFrame:
    """ML2 transform (long form): levels outside the kept top-k → ``other``."""
    long = unpivot_factors(df.select(key, *features), [key], features)
    kept = top.select("variable", "level", F.lit(True).alias("_kept"))
    return (long.join(kept, ["variable", "level"], "left")
                .select(key, "variable",
                        F.when(F.col("_kept"), F.col("level")).otherwise(F.lit(other)).alias("level")))


def _first_component(p):
    """Unit eigenvector of the largest eigenvalue of diag(p) − p pᵀ."""
    import numpy as np
    if len(p) == 1:
        return np.ones(1)
    order = np.argsort(-p, kind="stable")
    hi, lo = p[order[0]], p[order[1]]
    if hi - lo <= 1e-12 * hi:                  # a tie: the difference of the two levels
        v = np.zeros(len(p))
        v[order[0]], v[order[1]] = 1.0, -1.0
        return v / np.sqrt(2.0)
    gap = lambda x: float(np.sum(p * p / (p - x))) - 1.0  # noqa: E731  rises from -inf to inf between lo and hi
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if gap(mid) < 0:
            lo = mid
        else:
            hi = mid
    v = p / (p - (lo + hi) / 2)
    v /= np.linalg.norm(v)
    return v if v[np.argmax(np.abs(v))] > 0 else -v


def eigen_codes(train: DataFrame, features: list[str]) -> dict[str, dict[str, float]]:
    """ML2 'Eigen': each factor → its centred projection on the first
    principal component of the factor's one-hot matrix.

    The covariance of the one-hot indicators is diag(p) − p pᵀ (p = level
    shares): its largest eigenvalue lies between the two largest shares and
    solves Σ p²/(p − λ) = 1, and the component is p/(p − λ).  So the level
    counts (bounded by the factor cardinalities, size-checked) and vectors of
    that length are enough.  Sign fixed so the largest loading is positive;
    unseen levels map to 0 (the mean)."""
    import numpy as np
    long = unpivot_factors(train.select(*features), [], features).where(F.col("level").isNotNull())
    counts = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    if counts.count() > MAX_ENCODED_LEVELS:
        raise ValueError("too many levels for the Eigen encoding")
    by_var: dict[str, list] = {}
    for r in counts.collect():                 # bounded by MAX_ENCODED_LEVELS (checked)
        by_var.setdefault(r["variable"], []).append((r["level"], r["n"]))
    out = {}
    for var, items in by_var.items():
        items.sort()
        levels = [lv for lv, _ in items]
        p = np.array([n for _, n in items], dtype=float)
        p /= p.sum()
        v = _first_component(p)
        proj = v - float(p @ v)
        out[var] = {lv: float(x) for lv, x in zip(levels, proj)}
    return out


def eigen_transform(df: DataFrame, codes: dict[str, dict[str, float]], key: str) -> DataFrame:
    """ML2 'Eigen' transform in long form: (key, variable, value)."""
    table = df.sparkSession.createDataFrame([(f, lv, x) for f, m in codes.items() for lv, x in m.items()],
                                            "variable string, level string, code double")
    long = unpivot_factors(df.select(key, *codes), [key], list(codes))
    return (long.join(table, ["variable", "level"], "left")
            .select(key, "variable", F.coalesce("code", F.lit(0.0)).alias("value")))
