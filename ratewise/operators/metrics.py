"""Model metrics as grouped SQL aggregates: AGG12 regression metrics,
AGG13 classification metrics, both per model and per split, pivoted to the
tuning-results layout (train metric, ``_valid`` metric)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOGLOSS_EPS = 1e-15


def regression_metrics(pred: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """r², mse, rmse, rmsle, mae per ``by`` group in one grouped aggregate:
    r² = 1 − SSE/SST, SST around the group mean as count · var_pop.  rmsle is
    NULL when any prediction or response is ≤ −1 (log1p undefined)."""
    e = F.col(y) - F.col(p)
    sle = F.pow(F.log1p(F.col(p)) - F.log1p(F.col(y)), 2)
    bad = (F.col(p) <= -1) | (F.col(y) <= -1)
    agg = pred.groupBy(*by).agg(
        F.sum(e * e).alias("_sse"), (F.var_pop(F.col(y).cast("double")) * F.count(y)).alias("_sst"),
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(~bad, sle)).alias("_msle"), F.max(bad.cast("int")).alias("_bad"))
    return agg.select(
        *by, (1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r_2"), "mse", F.sqrt("mse").alias("rmse"),
        F.when(F.col("_bad") == 1, F.lit(None).cast("double")).otherwise(F.sqrt("_msle")).alias("rmsle"),
        "mae")


def _p_true(label: str) -> F.Column:
    lab = F.col(label)
    return (F.when(lab == 0, F.col("p0")).when(lab == 1, F.col("p1"))
             .when(lab == 2, F.col("p2")).otherwise(F.col("p3")))


def classification_metrics(pred: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Multiclass logloss avg(−ln(max(p[y], 1e-15))); mse = avg((1 − p[y])²);
    rmse; r² = 1 − mse / var_pop(y)."""
    pt = _p_true(label)
    agg = pred.groupBy(*by).agg(
        F.avg(-F.log(F.greatest(pt, F.lit(LOGLOSS_EPS)))).alias("logloss"),
        F.avg(F.pow(1 - pt, 2)).alias("mse"), F.var_pop(F.col(label).cast("double")).alias("_var"))
    return agg.select(*by, (1 - F.try_divide(F.col("mse"), F.col("_var"))).alias("r_2"), "mse",
                      F.sqrt("mse").alias("rmse"), "logloss")


def to_tuning_layout(per_split: DataFrame, keys: list[str], metrics: list[str], split_col: str = "split",
                     train: str = "train", valid: str = "validate", single: dict | None = None) -> DataFrame:
    """Pivot per-split metrics to one row per model: ``m`` (train) and
    ``m_valid`` (validation); ``single`` maps metric → split for metrics
    reported once (e.g. logloss on test)."""
    single = single or {}
    aggs = []
    for m in metrics:
        if m in single:
            aggs.append(F.first(F.when(F.col(split_col) == single[m], F.col(m)), ignorenulls=True).alias(m))
            continue
        aggs.append(F.first(F.when(F.col(split_col) == train, F.col(m)), ignorenulls=True).alias(m))
        aggs.append(F.first(F.when(F.col(split_col) == valid, F.col(m)), ignorenulls=True).alias(f"{m}_valid"))
    return per_split.groupBy(*keys).agg(*aggs)


def minmax_scale(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """AGG19: (x − min) / (max − min) per column (parallel-coordinates data).
    The table is a tuning-results table (one row per model)."""
    w = Window.partitionBy(*(by or []))
    out = df
    for c in cols:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        out = out.withColumn(c, F.when(hi == lo, F.lit(0.0)).otherwise((F.col(c) - lo) / (hi - lo)))
    return out
