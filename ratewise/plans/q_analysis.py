"""Registered queries: tuning-results and comparison analysis (PRJ14–PRJ16,
PRJ21, JON2, JON8, FLT6, FLT7, AGG5–AGG7, AGG10, AGG19, WIN2–WIN4, SET2,
RSH3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import recode
from ..operators.analyze import (best_params, compare_by_type, enrich_comparison, percentile_of_best,
                                 time_by_family, tuning_heatmap, with_model_types)
from ..operators.grid import grid_frame, grid_long_rows, grid_rows
from ..operators.metrics import minmax_scale
from ..operators.reshape import unpivot_probs
from ..operators.twopart import best_pair
from ..sources.synthetic import (FAMILY_NAMES, GRIDS, SET_KEY_SQL, SEVERITY_SETS, FREQUENCY_SETS,
                                 set_key, set_key_of_file, time_to_create, time_to_create_sql)
from .q_twopart import (CLS_CTES, REG_CTES, _CMP_BODY, _FREQ, _round_cmp, _round_reg, _one_pair,
                        comparison, freq_summary, freq_test, frequency_tuning_metrics, sev_summary,
                        severity_tuning_metrics)
from .registry import query
from .sqlparts import rnd, with_
from .stages import round_doubles

_ALL = _FREQ + _CMP_BODY + REG_CTES + CLS_CTES


def _mt_sql(col: str) -> str:
    return (f"CASE WHEN contains({col}, 'nn') THEN 'nn' WHEN contains({col}, 'rf') THEN 'rf' "
            f"WHEN contains({col}, 'gb') THEN 'gb' ELSE 'lm' END")


def _family(file_col) -> F.Column:
    key = set_key_of_file(file_col)
    out = None
    for ms in SEVERITY_SETS + FREQUENCY_SETS:
        c = key == F.lit(set_key(ms))
        out = F.when(c, F.lit(FAMILY_NAMES[ms.algo])) if out is None else out.when(c, F.lit(FAMILY_NAMES[ms.algo]))
    return out


def _family_sql(col: str) -> str:
    key = SET_KEY_SQL.format(f=col)
    return "CASE " + " ".join(f"WHEN {key} = '{set_key(ms)}' THEN '{FAMILY_NAMES[ms.algo]}'"
                              for ms in SEVERITY_SETS + FREQUENCY_SETS) + " END"


def _values_sql(rows: list[tuple], names: list[str]) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS _v({', '.join(names)}))"


def severity_results(spark, sf, sets=None) -> DataFrame:
    """Tuning-results table of the severity sets: rounded metrics computed on
    the data + synthetic fit time + model family."""
    sets = sets or SEVERITY_SETS
    m = _round_reg(severity_tuning_metrics(spark, sf, sets))
    return (m.withColumn("time_to_create", time_to_create(F.col("mod_num"), F.col("file"), sets))
             .withColumn("model", _family(F.col("file"))))


# ----------------------------------------------------------------- queries

@query("model_type",
       with_(_ALL, f"SELECT *, {_mt_sql('sev_mod_file')} AS sev_mod_type, "
                   f"{_mt_sql('freq_mod_file')} AS freq_mod_type FROM _cmp"),
       "PRJ14 (model family from file name)")
def q_model_type(spark, sf):
    return with_model_types(_round_cmp(comparison(spark, sf)))


@query("compare_by_type",
       with_(_ALL, f"""
SELECT coverage, sev_mod_type, freq_mod_type, round(avg(mae), 6) AS mae, round(avg(mse), 0) AS mse
FROM (SELECT *, {_mt_sql('sev_mod_file')} AS sev_mod_type, {_mt_sql('freq_mod_file')} AS freq_mod_type FROM _cmpr)
GROUP BY 1, 2, 3"""),
       "AGG5 AGG15")
def q_compare_by_type(spark, sf):
    return _round_cmp(compare_by_type(comparison(spark, sf), ["coverage"]))


_ENRICH_SQL = with_(_ALL, """,
_ce AS (SELECT * REPLACE (regexp_replace(sev_mod_file, 'predictions', 'tuning_results') AS sev_mod_file,
                          regexp_replace(freq_mod_file, 'predictions', 'tuning_results') AS freq_mod_file) FROM _cmp),
_sm AS (SELECT coverage, regexp_replace(file, 'predictions', 'tuning_results') AS sev_mod_file, mod_num AS sev_mod_num,
               r_2 AS sev_r_2, r_2_valid AS sev_r_2_valid, mse AS sev_mse, mse_valid AS sev_mse_valid,
               mae AS sev_mae, mae_valid AS sev_mae_valid FROM _regw),
_fm AS (SELECT coverage, regexp_replace(file, 'predictions', 'tuning_results') AS freq_mod_file, mod_num AS freq_mod_num,
               r_2 AS freq_r_2, r_2_valid AS freq_r_2_valid, mse AS freq_mse, mse_valid AS freq_mse_valid,
               logloss AS freq_logloss FROM _clsw)
SELECT * FROM _ce LEFT JOIN _sm USING (coverage, sev_mod_file, sev_mod_num)
                  LEFT JOIN _fm USING (coverage, freq_mod_file, freq_mod_num)""")


@query("enrich_comparison", _ENRICH_SQL, "JON2 PRJ15 PRJ12")
def q_enrich_comparison(spark, sf):
    sev = _round_reg(severity_tuning_metrics(spark, sf))
    freq = round_doubles(frequency_tuning_metrics(spark, sf))
    return enrich_comparison(_round_cmp(comparison(spark, sf)), sev, freq, ["coverage"])


_RF = next(ms for ms in SEVERITY_SETS if ms.algo == "rf" and ms.response == "severity")
_RF_GRID = GRIDS[(_RF.algo, _RF.response)]
_RF_VALUES = _values_sql([(r["mod_num"], r["max_depth"], r["mtries"])
                          for r in grid_rows(_RF_GRID)],
                         ["mod_num", "max_depth", "mtries"])


@query("tuning_heatmap",
       with_(_ALL, f"""
SELECT coverage, max_depth, mtries, round(avg(mae_valid), 6) AS avg_mae, round_even(avg(mae_valid), 0) AS label
FROM _regw JOIN {_RF_VALUES} g USING (mod_num)
WHERE contains(file, '_rf_severity_')
GROUP BY 1, 2, 3 HAVING max_depth < 20"""),
       "AGG6 FLT7 PRJ21")
def q_tuning_heatmap(spark, sf):
    res = severity_results(spark, sf, [_RF]).join(grid_frame(spark, _RF_GRID), "mod_num")
    return round_doubles(tuning_heatmap(res, "max_depth", "mtries", "mae_valid", ["coverage"],
                                        where=F.col("max_depth") < 20))


_TIME_SQL = with_(_ALL, f""",
_tr AS (SELECT coverage, {_family_sql('file')} AS model,
               {time_to_create_sql('mod_num', 'file', SEVERITY_SETS)} AS time_to_create FROM _regw),
_tt AS (SELECT coverage, model, sum(time_to_create) AS time_to_create FROM _tr GROUP BY 1, 2),
_tw AS (
  SELECT coverage, model, time_to_create,
         sum(time_to_create) OVER (PARTITION BY coverage ORDER BY model DESC
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y_max,
         coalesce(sum(time_to_create) OVER (PARTITION BY coverage ORDER BY model DESC
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS y_min
  FROM _tt)
SELECT *, (y_max + y_min) / 2 AS label_pos,
       CAST(round_even(time_to_create / 3600.0, 2) AS VARCHAR) || ' Hours' AS label_val
FROM _tw""")


@query("time_by_family", rnd(_TIME_SQL, ["time_to_create", "y_max", "y_min", "label_pos"]),
       "AGG7 SET2 WIN2 WIN3 WIN4 SRT6 PRJ18 PRJ21")
def q_time_by_family(spark, sf):
    return round_doubles(time_by_family(severity_results(spark, sf), ["coverage"], "model"))


_LOG_SETS = [ms for ms in SEVERITY_SETS if ms.response == "log_severity"]
_MM_COLS = ["mae", "mae_valid", "mse", "mse_valid"]
_MM_SQL = with_(_ALL, f"""
SELECT coverage, file, mod_num, {_family_sql('file')} AS model,
       {", ".join(f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END AS {c}" for c in _MM_COLS)}
FROM _regw WHERE response = 'log_severity'
WINDOW w AS (PARTITION BY coverage)""")


@query("minmax_scale", rnd(_MM_SQL, _MM_COLS), "AGG19 SET2 (parallel-coordinates data)")
def q_minmax_scale(spark, sf):
    res = severity_results(spark, sf, _LOG_SETS).select("coverage", "file", "mod_num", "model", *_MM_COLS)
    return round_doubles(minmax_scale(res, _MM_COLS, by=["coverage"]))


_FS_SQL_COLS = ", ".join(
    [f"round(quantile_cont(p{k}, 0.5), 6) AS med_p{k}, round(avg(p{k}), 6) AS mean_p{k}" for k in range(4)])
_POB_SQL = with_(_ALL, f""",
_bestp AS (SELECT * EXCLUDE (_r) FROM (
  SELECT *, row_number() OVER (PARTITION BY coverage ORDER BY mae NULLS LAST, sev_mod_file, sev_mod_num,
                                                              freq_mod_file, freq_mod_num) AS _r FROM _cmp) WHERE _r = 1),
_fs AS (SELECT coverage, file, mod_num, {_FS_SQL_COLS} FROM _freq GROUP BY 1, 2, 3),
_ss AS (SELECT coverage, file, mod_num, round(quantile_cont(predict, 0.5), 6) AS med, round(avg(predict), 6) AS avg
        FROM _sevb GROUP BY 1, 2, 3),
_bf AS (SELECT f.* FROM _fs f JOIN _bestp b ON f.coverage = b.coverage AND f.file = b.freq_mod_file AND f.mod_num = b.freq_mod_num),
_bs AS (SELECT s.* FROM _ss s JOIN _bestp b ON s.coverage = b.coverage AND s.file = b.sev_mod_file AND s.mod_num = b.sev_mod_num),
_fsh AS (SELECT f.coverage,
                avg(CASE WHEN f.med_p0 < b.med_p0 THEN 1.0 ELSE 0.0 END) AS share_med_p0_below,
                {", ".join(f"avg(CASE WHEN f.mean_p{k} < b.mean_p{k} THEN 1.0 ELSE 0.0 END) AS share_mean_p{k}_below" for k in range(4))}
         FROM _fs f JOIN _bf b ON f.coverage = b.coverage GROUP BY f.coverage),
_ssh AS (SELECT s.coverage,
                avg(CASE WHEN s.med > b.med THEN 1.0 ELSE 0.0 END) AS share_sev_med_above,
                avg(CASE WHEN s.avg < b.avg THEN 1.0 ELSE 0.0 END) AS share_sev_avg_below
         FROM _ss s JOIN _bs b ON s.coverage = b.coverage GROUP BY s.coverage)
SELECT * FROM _fsh FULL JOIN _ssh USING (coverage)""")

_POB_COLS = ["share_med_p0_below"] + [f"share_mean_p{k}_below" for k in range(4)] + \
            ["share_sev_med_above", "share_sev_avg_below"]


@query("percentile_of_best", rnd(_POB_SQL, _POB_COLS), "AGG10 FLT6 AGG18")
def q_percentile_of_best(spark, sf):
    best = best_pair(_round_cmp(comparison(spark, sf)), "mae", by=["coverage"])
    fs = freq_summary(spark, sf, ["coverage", "file", "mod_num"])
    ss = sev_summary(spark, sf, ["coverage", "file", "mod_num"])
    return round_doubles(percentile_of_best(best, fs, ss, ["coverage"]))


def _param_rows():
    rows = []
    for ms in SEVERITY_SETS + FREQUENCY_SETS:
        for mod, p, v in grid_long_rows(GRIDS[(ms.algo, ms.response)]):
            rows.append((set_key(ms), mod, p, v))
    return rows


_BP_SQL = with_(_ALL, f""",
_bestp AS (SELECT * EXCLUDE (_r) FROM (
  SELECT *, row_number() OVER (PARTITION BY coverage ORDER BY mae NULLS LAST, sev_mod_file, sev_mod_num,
                                                              freq_mod_file, freq_mod_num) AS _r FROM _cmp) WHERE _r = 1),
_bs AS (
  SELECT coverage, 'severity' AS side, regexp_replace(sev_mod_file, 'predictions', 'tuning_results') AS file,
         sev_mod_num AS mod_num, {SET_KEY_SQL.format(f='sev_mod_file')} AS set_key FROM _bestp
  UNION ALL
  SELECT coverage, 'frequency' AS side, regexp_replace(freq_mod_file, 'predictions', 'tuning_results') AS file,
         freq_mod_num AS mod_num, {SET_KEY_SQL.format(f='freq_mod_file')} AS set_key FROM _bestp)
SELECT coverage, side, file, mod_num, param, value
FROM _bs JOIN {_values_sql(_param_rows(), ["set_key", "mod_num", "param", "value"])} p USING (set_key, mod_num)""")


@query("best_params", _BP_SQL, "JON8 FLT6 SRT3 PRJ15 SRC5 (winning models' parameters)")
def q_best_params(spark, sf):
    best = best_pair(_round_cmp(comparison(spark, sf)), "mae", by=["coverage"])
    pl = spark.createDataFrame(_param_rows(), "set_key string, mod_num int, param string, value string")
    return best_params(best, pl, ["coverage"]).select("coverage", "side", "file", "mod_num", "param", "value")


# Class-probability labels of the prediction figures.
PROB_LABELS = {0: "Probability of 0 Claims", 1: "Probability of 1 Claim",
               2: "Probability of 2 Claims", 3: "Probability of 3 Claims"}

_UP_SQL = with_(_ALL, f"""
SELECT coverage, row_num,
       CASE prob {" ".join(f"WHEN 'p{k}' THEN '{v}'" for k, v in PROB_LABELS.items())} END AS num_claims,
       prediction
FROM (SELECT coverage, row_num, p0, p1, p2, p3 FROM _freq WHERE contains(file, '_rf_') AND mod_num = 1)
UNPIVOT (prediction FOR prob IN (p0, p1, p2, p3))""")


@query("unpivot_probs", rnd(_UP_SQL, ["prediction"]), "RSH3 PRJ16")
def q_unpivot_probs(spark, sf):
    f = _one_pair(freq_test(spark, sf), "rf", 1)
    long = unpivot_probs(f, ["coverage", "row_num"])
    return round_doubles(long.select("coverage", "row_num", recode("num_claims", PROB_LABELS).alias("num_claims"),
                                     "prediction"))


_NN = next(ms for ms in SEVERITY_SETS if ms.algo == "nn")
_NN_GRID = GRIDS[(_NN.algo, _NN.response)]
_NN_VALUES = _values_sql([(r["mod_num"], r["hidden"]) for r in grid_rows(_NN_GRID)], ["mod_num", "hidden"])
_NN_SQL = with_(_ALL, f"""
SELECT r.coverage, r.file, r.mod_num, CAST(list_sum(g.hidden) AS INTEGER) AS total_nodes,
       CAST(len(g.hidden) AS INTEGER) AS num_layers, r.mae, r.mae_valid
FROM _regw r JOIN {_NN_VALUES} g USING (mod_num)
WHERE contains(r.file, '_nn_log_severity_')""")


@query("nn_tuning_results", _NN_SQL, "PRJ17 D8 JON5 (layer list → total nodes, layers)")
def q_nn_tuning_results(spark, sf):
    res = severity_results(spark, sf, [_NN]).join(grid_frame(spark, _NN_GRID), "mod_num")
    return res.select("coverage", "file", "mod_num", "total_nodes", "num_layers", "mae", "mae_valid")
