"""Tuning and comparison analysis: PRJ14–PRJ16, JON2, JON8, FLT6, AGG5–AGG7,
AGG10, WIN2–WIN4, SET2.

Inputs are per-model tables (tuning results, the pair comparison,
prediction summaries): their size is set by the grids, not by the policy
rows, so the windows here partition by coverage over a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hours_label, model_type, results_path


def with_model_types(cmp: DataFrame) -> DataFrame:
    """PRJ14 on both sides of a comparison."""
    return (cmp.withColumn("sev_mod_type", model_type("sev_mod_file"))
               .withColumn("freq_mod_type", model_type("freq_mod_file")))


def compare_by_type(cmp: DataFrame, by: list[str]) -> DataFrame:
    """AGG5: mean MAE and MSE by (severity type, frequency type)."""
    t = with_model_types(cmp)
    return t.groupBy(*by, "sev_mod_type", "freq_mod_type").agg(
        F.avg("mae").alias("mae"), F.avg("mse").alias("mse"))


def enrich_comparison(cmp: DataFrame, sev_metrics: DataFrame, freq_metrics: DataFrame,
                      by: list[str]) -> DataFrame:
    """JON2 + PRJ15: comparison rows with the severity model's and the
    frequency model's tuning metrics (left joins on (results file, model)).
    Metrics tables carry ``file`` = prediction path, ``mod_num`` and metrics."""
    c = (cmp.withColumn("sev_mod_file", results_path("sev_mod_file"))
            .withColumn("freq_mod_file", results_path("freq_mod_file")))
    s = sev_metrics.select(*by, results_path("file").alias("sev_mod_file"), F.col("mod_num").alias("sev_mod_num"),
                           *[F.col(m).alias(f"sev_{m}") for m in
                             ("r_2", "r_2_valid", "mse", "mse_valid", "mae", "mae_valid")])
    f = freq_metrics.select(*by, results_path("file").alias("freq_mod_file"), F.col("mod_num").alias("freq_mod_num"),
                            *[F.col(m).alias(f"freq_{m}") for m in
                              ("r_2", "r_2_valid", "mse", "mse_valid", "logloss")])
    return (c.join(s, [*by, "sev_mod_file", "sev_mod_num"], "left")
             .join(f, [*by, "freq_mod_file", "freq_mod_num"], "left"))


def tuning_heatmap(results: DataFrame, x: str, y: str, metric: str, by: list[str], where=None) -> DataFrame:
    """AGG6: mean metric by (x, y) then a filter; label = metric rounded to a
    whole number (half-even, as R)."""
    agg = results.groupBy(*by, x, y).agg(F.avg(metric).alias("avg_mae"))
    if where is not None:
        agg = agg.where(where)
    return agg.withColumn("label", F.bround("avg_mae", 0))


def time_by_family(results: DataFrame, by: list[str], family: str = "model",
                   seconds: str = "time_to_create") -> DataFrame:
    """AGG7 + WIN2–WIN4 (donut data): total fit time per family, families in
    descending name order, running total (y_max), previous running total
    (y_min), segment mid-point and an hours label."""
    tot = results.groupBy(*by, family).agg(F.sum(seconds).alias(seconds))
    w = Window.partitionBy(*by).orderBy(F.desc(family))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (tot.withColumn("y_max", F.sum(seconds).over(upto))
               .withColumn("y_min", F.coalesce(F.sum(seconds).over(before), F.lit(0.0)))
               .withColumn("label_pos", (F.col("y_max") + F.col("y_min")) / 2)
               .withColumn("label_val", hours_label(seconds, " Hours")))


def percentile_of_best(best: DataFrame, freq_summary: DataFrame, sev_summary: DataFrame,
                       by: list[str]) -> DataFrame:
    """AGG10: where the best pair's models sit among all models of the
    coverage — share of frequency models with a lower median / mean class
    probability, share of severity models with a higher median and a lower
    mean prediction.  The best row is one row per group (a scalar per
    coverage) joined to the per-model summaries."""
    bf = (freq_summary.join(best.select(*by, F.col("freq_mod_file").alias("file"),
                                        F.col("freq_mod_num").alias("mod_num")), [*by, "file", "mod_num"])
          .select(*by, *[F.col(c).alias(f"_b_{c}") for c in
                         ("med_p0", "mean_p0", "mean_p1", "mean_p2", "mean_p3")]))
    bs = (sev_summary.join(best.select(*by, F.col("sev_mod_file").alias("file"),
                                       F.col("sev_mod_num").alias("mod_num")), [*by, "file", "mod_num"])
          .select(*by, F.col("med").alias("_b_med"), F.col("avg").alias("_b_avg")))
    share = lambda cond: F.avg(cond.cast("double"))
    fs = freq_summary.join(bf, by).groupBy(*by).agg(
        share(F.col("med_p0") < F.col("_b_med_p0")).alias("share_med_p0_below"),
        *[share(F.col(f"mean_p{k}") < F.col(f"_b_mean_p{k}")).alias(f"share_mean_p{k}_below") for k in range(4)])
    ss = sev_summary.join(bs, by).groupBy(*by).agg(
        share(F.col("med") > F.col("_b_med")).alias("share_sev_med_above"),
        share(F.col("avg") < F.col("_b_avg")).alias("share_sev_avg_below"))
    return fs.join(ss, by, "full")


def best_params(best: DataFrame, params_long: DataFrame, by: list[str]) -> DataFrame:
    """JON8 + FLT6: the winning pair's hyper-parameters looked up in the
    (long) parameter tables: (by, side, file, mod_num, param, value).
    ``params_long`` has (set_key, mod_num, param, value); the pair's files
    are mapped to their set keys first."""
    from ..sources.synthetic import set_key_of_file
    sides = []
    for side, fcol, mcol in (("severity", "sev_mod_file", "sev_mod_num"),
                             ("frequency", "freq_mod_file", "freq_mod_num")):
        sides.append(best.select(*by, F.lit(side).alias("side"), results_path(fcol).alias("file"),
                                 F.col(mcol).alias("mod_num"), set_key_of_file(F.col(fcol)).alias("set_key")))
    b = sides[0].unionByName(sides[1])
    return b.join(params_long, ["set_key", "mod_num"], "inner").drop("set_key")
