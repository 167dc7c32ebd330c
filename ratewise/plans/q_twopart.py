"""Registered queries: two-part evaluation on synthetic model outputs
(PRJ8–PRJ10, JON1, JON7, AGG8, AGG9, AGG11–AGG13, ML14, SRT3, SRT4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import model_type, residual
from ..operators.metrics import classification_metrics, regression_metrics, to_tuning_layout
from ..operators.summarize import six_numbers
from ..operators.twopart import (add_expected_cost, back_transform_predictions, best_pair,
                                 combine_predictions, compare_models, cost_error)
from ..sources.synthetic import (frequency_predictions, frequency_predictions_sql, severity_predictions,
                                 severity_predictions_sql)
from .registry import query
from .sqlparts import SPLIT, rnd, with_
from .stages import round_doubles, split_table

# ------------------------------------------------------------------ Spark side


def test_rows(spark, sf) -> DataFrame:
    return split_table(spark, sf).where(F.col("split") == "test")


def sev_test(spark, sf) -> DataFrame:
    return severity_predictions(test_rows(spark, sf).select("coverage", "row_num"))


def freq_test(spark, sf) -> DataFrame:
    return frequency_predictions(test_rows(spark, sf).select("coverage", "row_num"))


def comparison(spark, sf) -> DataFrame:
    actual = test_rows(spark, sf).select("coverage", "row_num", "ULTIMATE_AMOUNT")
    return compare_models(sev_test(spark, sf), freq_test(spark, sf), actual, keys=["coverage"])


def _round_cmp(df: DataFrame) -> DataFrame:
    # mse is in squared currency (~1e9): whole units are the stable digits.
    return df.withColumn("mae", F.round("mae", 6)).withColumn("mse", F.round("mse", 0))


def _one_pair(df: DataFrame, algo: str, mod: int) -> DataFrame:
    return df.where(F.col("file").contains(f"_{algo}_") & (F.col("mod_num") == mod))


# -------------------------------------------------------------------- SQL side

_TEST = SPLIT + """,
_test AS (SELECT coverage, row_num, ULTIMATE_AMOUNT FROM split WHERE split = 'test')"""
_SEV = _TEST + f""",
_sev AS ({severity_predictions_sql('_test')}),
_sevb AS (SELECT * REPLACE (CASE WHEN response = 'log_severity' THEN exp(predict) ELSE predict END AS predict) FROM _sev)"""
_FREQ = _SEV + f""",
_freq AS ({frequency_predictions_sql('_test')})"""

_PAIR = """
_f1 AS (SELECT * FROM _freq WHERE contains(file, '_rf_') AND mod_num = 1),
_s1 AS (SELECT * FROM _sevb WHERE contains(file, '_gb_') AND mod_num = 1),
_comb AS (SELECT f.coverage, f.row_num, f.p0, f.p1, f.p2, f.p3, s.predict
          FROM _f1 f LEFT JOIN _s1 s ON f.coverage = s.coverage AND f.row_num = s.row_num)"""

# ------------------------------------------------------------------- queries


@query("back_transform",
       rnd(with_(_SEV, "SELECT coverage, file, mod_num, row_num, predict FROM _sevb"), ["predict"]),
       "PRJ8 SRC7 (log models exp'd)")
def q_back_transform(spark, sf):
    return round_doubles(back_transform_predictions(sev_test(spark, sf))
                         .select("coverage", "file", "mod_num", "row_num", "predict"))


@query("combine_predictions",
       rnd(with_(_FREQ, "," + _PAIR + "\nSELECT * FROM _comb"), ["p0", "p1", "p2", "p3", "predict"]),
       "JON1 RSH4 FLT8")
def q_combine(spark, sf):
    f = _one_pair(freq_test(spark, sf), "rf", 1)
    s = _one_pair(back_transform_predictions(sev_test(spark, sf)), "gb", 1)
    out = combine_predictions(f.select("coverage", "row_num", "p0", "p1", "p2", "p3", "predict"), s, ["coverage"])
    return round_doubles(out)


_EXP_COLS = ["amount_1_claim", "amount_2_claim", "amount_3_claim", "expected_ultimate_amount",
             "actual_ultimate_amount"]
_EXPECTED_SQL = with_(_FREQ, "," + _PAIR + """
SELECT c.coverage, c.row_num, c.predict AS amount_1_claim, 2 * c.predict AS amount_2_claim,
       3 * c.predict AS amount_3_claim,
       c.predict * c.p1 + (2 * c.predict) * c.p2 + (3 * c.predict) * c.p3 AS expected_ultimate_amount,
       t.ULTIMATE_AMOUNT AS actual_ultimate_amount
FROM _comb c LEFT JOIN _test t ON c.coverage = t.coverage AND c.row_num = t.row_num""")


@query("expected_cost", rnd(_EXPECTED_SQL, _EXP_COLS), "PRJ10 JON7 PRJ19")
def q_expected_cost(spark, sf):
    f = _one_pair(freq_test(spark, sf), "rf", 1)
    s = _one_pair(back_transform_predictions(sev_test(spark, sf)), "gb", 1)
    comb = combine_predictions(f.select("coverage", "row_num", "p0", "p1", "p2", "p3", "predict"), s, ["coverage"])
    actual = test_rows(spark, sf).select("coverage", "row_num", "ULTIMATE_AMOUNT")
    out = add_expected_cost(comb, actual, ["coverage"])
    return round_doubles(out.select("coverage", "row_num", *_EXP_COLS))


_COST_SQL = with_(_FREQ, "," + _PAIR + """
SELECT c.coverage,
       round(avg(abs(t.ULTIMATE_AMOUNT - (c.predict * c.p1 + (2 * c.predict) * c.p2 + (3 * c.predict) * c.p3))), 6) AS mae,
       round(avg(pow(t.ULTIMATE_AMOUNT - (c.predict * c.p1 + (2 * c.predict) * c.p2 + (3 * c.predict) * c.p3), 2)), 0) AS mse
FROM _comb c JOIN _test t ON c.coverage = t.coverage AND c.row_num = t.row_num
GROUP BY c.coverage""")


@query("cost_error", _COST_SQL, "AGG11")
def q_cost_error(spark, sf):
    f = _one_pair(freq_test(spark, sf), "rf", 1)
    s = _one_pair(back_transform_predictions(sev_test(spark, sf)), "gb", 1)
    comb = combine_predictions(f.select("coverage", "row_num", "p0", "p1", "p2", "p3", "predict"), s, ["coverage"])
    actual = test_rows(spark, sf).select("coverage", "row_num", "ULTIMATE_AMOUNT")
    return _round_cmp(cost_error(add_expected_cost(comb, actual, ["coverage"]), ["coverage"]))


_RESID_SQL = with_(SPLIT + f""",
_tc AS (SELECT coverage, row_num, severity FROM split WHERE split = 'test'),
_p AS ({severity_predictions_sql('_tc')})""", """
SELECT p.coverage, p.row_num, t.severity - p.predict AS residual
FROM _p p JOIN _tc t ON p.coverage = t.coverage AND p.row_num = t.row_num
WHERE contains(p.file, '_glm_')""")


@query("residuals", rnd(_RESID_SQL, ["residual"]), "PRJ9 (baseline severity model on all test rows)")
def q_residuals(spark, sf):
    tc = test_rows(spark, sf).select("coverage", "row_num", "severity")
    p = severity_predictions(tc.select("coverage", "row_num")).where(F.col("file").contains("_glm_"))
    j = p.join(tc, ["coverage", "row_num"])
    return round_doubles(j.select("coverage", "row_num", residual("severity", "predict").alias("residual")))


_CMP_KEYS = "f.coverage, s.file AS sev_mod_file, s.mod_num AS sev_mod_num, f.file AS freq_mod_file, f.mod_num AS freq_mod_num"
_E = "(s.predict * f.p1 + (2 * s.predict) * f.p2 + (3 * s.predict) * f.p3)"
_CMP_BODY = f""",
_cmpr AS (
  SELECT {_CMP_KEYS},
         avg(abs(t.ULTIMATE_AMOUNT - {_E})) AS mae,
         avg(pow(t.ULTIMATE_AMOUNT - {_E}, 2)) AS mse
  FROM _freq f JOIN _sevb s ON f.coverage = s.coverage AND f.row_num = s.row_num
  JOIN _test t ON t.coverage = f.coverage AND t.row_num = f.row_num
  GROUP BY ALL
),
_cmp AS (SELECT * REPLACE (round(mae, 6) AS mae, round(mse, 0) AS mse) FROM _cmpr)"""


@query("compare_models_blocked", with_(_FREQ, _CMP_BODY + "\nSELECT * FROM _cmp"),
       "ML14 JON3 JON4 UDF2 AGG17 FLT10 (blocked all-pairs two-part MAE/MSE)", headline=True)
def q_compare_models(spark, sf):
    return _round_cmp(comparison(spark, sf))


_BEST_SQL = with_(_FREQ, _CMP_BODY + """
SELECT * EXCLUDE (_r) FROM (
  SELECT *, row_number() OVER (PARTITION BY coverage ORDER BY mae NULLS LAST, sev_mod_file, sev_mod_num,
                                                              freq_mod_file, freq_mod_num) AS _r
  FROM _cmp {where}) WHERE _r = 1""")


@query("best_pair", _BEST_SQL.format(where=""), "SRT3 SNK6 (top-1 pair by MAE per coverage)")
def q_best_pair(spark, sf):
    return best_pair(_round_cmp(comparison(spark, sf)), "mae", by=["coverage"])


_TREE = ("(contains(sev_mod_file, 'gb') OR contains(sev_mod_file, 'rf')) "
         "AND NOT contains(sev_mod_file, 'nn') AND NOT contains(freq_mod_file, 'nn') "
         "AND (contains(freq_mod_file, 'rf') OR contains(freq_mod_file, 'gb'))")


@query("best_tree_pair", _BEST_SQL.format(where="WHERE " + _TREE), "SRT4 PRJ14 FLT7")
def q_best_tree_pair(spark, sf):
    cmp = _round_cmp(comparison(spark, sf))
    st, ft = model_type("sev_mod_file"), model_type("freq_mod_file")
    return best_pair(cmp, "mae", by=["coverage"], where=st.isin("gb", "rf") & ft.isin("rf", "gb"))


# ---------------------------------------------------------- tuning metrics

def severity_metric_rows(spark, sf, sets=None) -> DataFrame:
    rows = (split_table(spark, sf)
            .where(F.col("split").isin("train", "validate") & (F.col("ULTIMATE_CLAIM_COUNT") > 0))
            .select("coverage", "row_num", "split", "severity", "log_severity"))
    p = severity_predictions(rows.select("coverage", "row_num", "split"), sets)
    # by row_num, which both sides are bucketed by, with a hash table of each bucket's
    # rows: neither all rows in every executor, as a broadcast by an estimate has
    # them, nor an exchange and a sort of the rows of all models
    d = p.join(rows.select("row_num", "severity", "log_severity").hint("shuffle_hash"), "row_num")
    d = d.where((F.col("response") != "log_severity") | (F.col("severity") > 1))
    return d.withColumn("y", F.when(F.col("response") == "log_severity", F.col("log_severity"))
                             .otherwise(F.col("severity")))


def severity_tuning_metrics(spark, sf, sets=None) -> DataFrame:
    d = severity_metric_rows(spark, sf, sets)
    m = regression_metrics(d, "y", "predict", ["coverage", "file", "response", "mod_num", "split"])
    return to_tuning_layout(m, ["coverage", "file", "response", "mod_num"], ["r_2", "mse", "rmse", "rmsle", "mae"])


def _round_reg(df: DataFrame) -> DataFrame:
    df = round_doubles(df)
    for c in ("mse", "mse_valid"):
        df = df.withColumn(c, F.when(F.col("response") == "log_severity", F.col(c))
                              .otherwise(F.round(c, 0)))
    return df


REG_CTES = f""",
_rrows AS (SELECT coverage, row_num, split, severity, log_severity FROM split
          WHERE split IN ('train', 'validate') AND ULTIMATE_CLAIM_COUNT > 0),
_rp AS ({severity_predictions_sql('_rrows', extra=', split')}),
_rd AS (SELECT p.*, CASE WHEN p.response = 'log_severity' THEN r.log_severity ELSE r.severity END AS y
       FROM _rp p JOIN _rrows r ON p.coverage = r.coverage AND p.row_num = r.row_num AND p.split = r.split
       WHERE p.response <> 'log_severity' OR r.severity > 1),
_rm AS (
  SELECT coverage, file, response, mod_num, split,
         1 - sum(pow(y - predict, 2)) / nullif(sum(pow(y - ybar, 2)), 0) AS r_2,
         avg(pow(y - predict, 2)) AS mse, sqrt(avg(pow(y - predict, 2))) AS rmse,
         CASE WHEN max(CASE WHEN predict <= -1 OR y <= -1 THEN 1 ELSE 0 END) = 1 THEN NULL
              ELSE sqrt(avg(pow(ln(1 + predict) - ln(1 + y), 2))) END AS rmsle,
         avg(abs(y - predict)) AS mae
  FROM (SELECT *, avg(y) OVER (PARTITION BY coverage, file, response, mod_num, split) AS ybar FROM _rd)
  GROUP BY 1, 2, 3, 4, 5
 ),
_regw AS (
SELECT coverage, file, response, mod_num,
       round(max(CASE WHEN split = 'train' THEN r_2 END), 6) AS r_2,
       round(max(CASE WHEN split = 'validate' THEN r_2 END), 6) AS r_2_valid,
       CASE WHEN response = 'log_severity' THEN round(max(CASE WHEN split = 'train' THEN mse END), 6)
            ELSE round(max(CASE WHEN split = 'train' THEN mse END), 0) END AS mse,
       CASE WHEN response = 'log_severity' THEN round(max(CASE WHEN split = 'validate' THEN mse END), 6)
            ELSE round(max(CASE WHEN split = 'validate' THEN mse END), 0) END AS mse_valid,
       round(max(CASE WHEN split = 'train' THEN rmse END), 6) AS rmse,
       round(max(CASE WHEN split = 'validate' THEN rmse END), 6) AS rmse_valid,
       round(max(CASE WHEN split = 'train' THEN rmsle END), 6) AS rmsle,
       round(max(CASE WHEN split = 'validate' THEN rmsle END), 6) AS rmsle_valid,
       round(max(CASE WHEN split = 'train' THEN mae END), 6) AS mae,
       round(max(CASE WHEN split = 'validate' THEN mae END), 6) AS mae_valid
FROM _rm GROUP BY 1, 2, 3, 4)"""
_REG_SQL = with_(SPLIT + REG_CTES, "SELECT * FROM _regw")


@query("regression_metrics", _REG_SQL, "AGG12 FLT2 FLT3 (train + validation metrics per model)")
def q_regression_metrics(spark, sf):
    return _round_reg(severity_tuning_metrics(spark, sf))


def frequency_tuning_metrics(spark, sf, sets=None) -> DataFrame:
    rows = split_table(spark, sf).select("coverage", "row_num", "split", "label")
    p = frequency_predictions(rows.select("coverage", "row_num", "split"), sets)
    d = p.join(rows, ["coverage", "row_num", "split"])
    m = classification_metrics(d, "label", ["coverage", "file", "mod_num", "split"])
    return to_tuning_layout(m, ["coverage", "file", "mod_num"], ["r_2", "mse", "rmse", "logloss"],
                            single={"logloss": "test"})


CLS_CTES = f""",
_crows AS (SELECT coverage, row_num, split, label FROM split),
_cp AS ({frequency_predictions_sql('_crows', extra=', split')}),
_cd AS (SELECT p.*, r.label,
              CASE WHEN r.label = 0 THEN p.p0 WHEN r.label = 1 THEN p.p1 WHEN r.label = 2 THEN p.p2 ELSE p.p3 END AS pt
       FROM _cp p JOIN _crows r ON p.coverage = r.coverage AND p.row_num = r.row_num AND p.split = r.split),
_cm AS (
  SELECT coverage, file, mod_num, split,
         avg(-ln(greatest(pt, 1e-15))) AS logloss, avg(pow(1 - pt, 2)) AS mse,
         1 - avg(pow(1 - pt, 2)) / nullif(var_pop(CAST(label AS DOUBLE)), 0) AS r_2, sqrt(avg(pow(1 - pt, 2))) AS rmse
  FROM _cd GROUP BY 1, 2, 3, 4
 ),
_clsw AS (
SELECT coverage, file, mod_num,
       round(max(CASE WHEN split = 'train' THEN r_2 END), 6) AS r_2,
       round(max(CASE WHEN split = 'validate' THEN r_2 END), 6) AS r_2_valid,
       round(max(CASE WHEN split = 'train' THEN mse END), 6) AS mse,
       round(max(CASE WHEN split = 'validate' THEN mse END), 6) AS mse_valid,
       round(max(CASE WHEN split = 'train' THEN rmse END), 6) AS rmse,
       round(max(CASE WHEN split = 'validate' THEN rmse END), 6) AS rmse_valid,
       round(max(CASE WHEN split = 'test' THEN logloss END), 6) AS logloss
FROM _cm GROUP BY 1, 2, 3)"""
_CLS_SQL = with_(SPLIT + CLS_CTES, "SELECT * FROM _clsw")


@query("classification_metrics", _CLS_SQL, "AGG13 (class-probability metrics, test logloss)")
def q_classification_metrics(spark, sf):
    return round_doubles(frequency_tuning_metrics(spark, sf))


# ------------------------------------------------------ prediction summaries

_SEV_SUM_SQL = with_(_SEV, """
SELECT file, mod_num, min(predict) AS min, quantile_cont(predict, 0.25) AS q1, quantile_cont(predict, 0.5) AS med,
       avg(predict) AS avg, quantile_cont(predict, 0.75) AS q3, max(predict) AS max
FROM _sevb GROUP BY file, mod_num""")


def sev_summary(spark, sf, keys) -> DataFrame:
    sev = back_transform_predictions(sev_test(spark, sf))
    return round_doubles(six_numbers(sev, keys, "predict"))


@query("severity_pred_summary", rnd(_SEV_SUM_SQL, ["min", "q1", "med", "avg", "q3", "max"]),
       "AGG8 SET3 (per prediction file and model)")
def q_sev_pred_summary(spark, sf):
    return sev_summary(spark, sf, ["file", "mod_num"])


_FSUM_COLS = [f"{s}_p{k}" for k in range(4) for s in ("min", "q1", "med", "mean", "q3", "max")] + \
             [f"pct_{k}" for k in range(4)]
_FREQ_SUM_SQL = with_(_FREQ, "\nSELECT file, mod_num, " + ", ".join(
    [f"min(p{k}) AS min_p{k}, quantile_cont(p{k}, 0.25) AS q1_p{k}, quantile_cont(p{k}, 0.5) AS med_p{k}, "
     f"avg(p{k}) AS mean_p{k}, quantile_cont(p{k}, 0.75) AS q3_p{k}, max(p{k}) AS max_p{k}" for k in range(4)]
    + [f"avg(CASE WHEN predict = {k} THEN 1.0 ELSE 0.0 END) AS pct_{k}" for k in range(4)])
    + "\nFROM _freq GROUP BY file, mod_num")


@query("frequency_pred_summary", rnd(_FREQ_SUM_SQL, _FSUM_COLS), "AGG9 (28 aggregates per model)")
def q_freq_pred_summary(spark, sf):
    return freq_summary(spark, sf, ["file", "mod_num"])


def freq_summary(spark, sf, keys) -> DataFrame:
    fr = freq_test(spark, sf)
    probs = ["p0", "p1", "p2", "p3"]
    long = fr.select(*keys, *probs).unpivot(keys, probs, "prob", "value")
    six = six_numbers(long, [*keys, "prob"], "value")
    aggs = []
    for k in range(4):
        pick = lambda c: F.first(F.when(F.col("prob") == f"p{k}", F.col(c)), ignorenulls=True)
        aggs += [pick("min").alias(f"min_p{k}"), pick("q1").alias(f"q1_p{k}"), pick("med").alias(f"med_p{k}"),
                 pick("avg").alias(f"mean_p{k}"), pick("q3").alias(f"q3_p{k}"), pick("max").alias(f"max_p{k}")]
    wide = six.groupBy(*keys).agg(*aggs)
    pct = fr.groupBy(*keys).agg(
        *[F.avg((F.col("predict") == k).cast("double")).alias(f"pct_{k}") for k in range(4)])
    return round_doubles(wide.join(pct, keys).select(*keys, *_FSUM_COLS))
