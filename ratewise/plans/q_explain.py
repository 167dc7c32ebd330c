"""Registered queries: mSHAP and explanation summaries on synthetic SHAP
rows of the test split (ML19–ML23, SRT5), and mSHAP on fitted models."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ml import models as M
from ..ml.features import fit_features
from ..ml.saved import training_rows
from ..ml.treeshap import tree_shap
from ..ml.tune import score
from ..operators.explain import ev_explained, ith_rows, mshap, shap_check, shap_local, shap_summary
from ..sources.synthetic import (freq_expected_sql, frequency_shap, sev_expected_sql, severity_shap, shap_expectations,
                                 shap_sql)
from ..schema import COVERAGES, MODEL_FEATURES
from .q_models import balanced_train, settings, split_frames
from .q_twopart import test_rows
from .registry import query
from .sqlparts import SPLIT, rnd, with_
from .stages import round_doubles, split_table

K = ["coverage"]


def _inputs(spark, sf):
    rows = test_rows(spark, sf).select("coverage", "row_num")
    return severity_shap(rows), frequency_shap(rows)


def _mshap(spark, sf):
    sv, fv = _inputs(spark, sf)
    return mshap(sv, fv, *shap_expectations(spark), keys=K)


_BASE = SPLIT + """,
_tr AS (SELECT coverage, row_num FROM split WHERE split = 'test')""" + shap_sql("_tr") + f""",
_G AS (SELECT coverage, row_num, sum(shap) AS G FROM _sv GROUP BY 1, 2),
_H AS (SELECT coverage, row_num, num_claims, sum(shap) AS H FROM _fv GROUP BY 1, 2, 3),
_E AS (SELECT h.coverage, h.num_claims,
              avg(({sev_expected_sql('h.coverage')} + g.G) * ({freq_expected_sql('h.coverage', 'h.num_claims')} + h.H)) AS expected_value
       FROM _H h JOIN _G g ON h.coverage = g.coverage AND h.row_num = g.row_num GROUP BY 1, 2),
_d AS (SELECT f.coverage, f.row_num, f.num_claims, f.feature,
              {sev_expected_sql('f.coverage')} * f.shap + {freq_expected_sql('f.coverage', 'f.num_claims')} * s.shap
                + 0.5 * (s.shap * h.H + f.shap * g.G) AS d,
              {freq_expected_sql('f.coverage', 'f.num_claims')} AS mu_h, {sev_expected_sql('f.coverage')} AS mu_g
       FROM _fv f JOIN _sv s ON f.coverage = s.coverage AND f.row_num = s.row_num AND f.feature = s.feature
       JOIN _H h ON f.coverage = h.coverage AND f.row_num = h.row_num AND f.num_claims = h.num_claims
       JOIN _G g ON f.coverage = g.coverage AND f.row_num = g.row_num),
_ms AS (SELECT d.*, e.expected_value,
               sum(abs(d)) OVER (PARTITION BY d.coverage, d.row_num, d.num_claims) AS sabs,
               count(*) OVER (PARTITION BY d.coverage, d.row_num, d.num_claims) AS nf
        FROM _d d JOIN _E e ON d.coverage = e.coverage AND d.num_claims = e.num_claims),
_mshap AS (SELECT coverage, row_num, num_claims, feature,
                  CASE WHEN sabs = 0 THEN d + (mu_g * mu_h - expected_value) / nf
                       ELSE d + (mu_g * mu_h - expected_value) * abs(d) / sabs END AS shap
           FROM _ms),
_ev AS (SELECT coverage, row_num, feature, sum(num_claims * shap) AS shap FROM _mshap GROUP BY 1, 2, 3)"""


@query("mshap", rnd(with_(_BASE, "SELECT * FROM _mshap"), ["shap"]), "ML19 UDF4 (product explanation)")
def q_mshap(spark, sf):
    vals, _ = _mshap(spark, sf)
    return round_doubles(vals)


@query("mshap_expected", rnd(with_(_BASE, "SELECT * FROM _E"), ["expected_value"]), "ML18 ML19 (expected values)")
def q_mshap_expected(spark, sf):
    _, e = _mshap(spark, sf)
    return round_doubles(e)


@query("ev_explained", rnd(with_(_BASE, "SELECT * FROM _ev"), ["shap"]), "ML20")
def q_ev_explained(spark, sf):
    vals, e = _mshap(spark, sf)
    ev, _ = ev_explained(vals, e, K)
    return round_doubles(ev)


_CHECK_SQL = with_(_BASE, f""",
_s AS (SELECT coverage, row_num, {sev_expected_sql('coverage')} + G AS s FROM _G),
_w AS (SELECT coverage, row_num, sum(num_claims * ({freq_expected_sql('coverage', 'num_claims')} + H)) AS w FROM _H GROUP BY 1, 2),
_p AS (SELECT s.coverage, avg(s.s * w.w) AS mean_prediction FROM _s s JOIN _w w
       ON s.coverage = w.coverage AND s.row_num = w.row_num GROUP BY 1)
SELECT p.coverage, p.mean_prediction, x.shap_expected_value
FROM _p p JOIN (SELECT coverage, sum(num_claims * expected_value) AS shap_expected_value FROM _E GROUP BY 1) x
ON p.coverage = x.coverage""")


@query("shap_check", rnd(_CHECK_SQL, ["mean_prediction", "shap_expected_value"]), "ML21 AGG18")
def q_shap_check(spark, sf):
    sv, fv = _inputs(spark, sf)
    means = shap_expectations(spark)
    _, e = mshap(sv, fv, *means, keys=K)
    return round_doubles(shap_check(sv, fv, *means, e, K))


_SUMMARY_SQL = with_(_BASE, """
SELECT coverage, feature, avg(abs(shap)) AS mean_abs_shap, min(shap) AS min_shap, max(shap) AS max_shap, count(*) AS n
FROM _ev GROUP BY 1, 2""")


@query("shap_summary", rnd(_SUMMARY_SQL, ["mean_abs_shap", "min_shap", "max_shap"]), "ML22")
def q_shap_summary(spark, sf):
    vals, e = _mshap(spark, sf)
    ev, _ = ev_explained(vals, e, K)
    return round_doubles(shap_summary(ev, K))


_LOCAL_K = 10
_LOCAL_SQL = with_(_BASE, f""",
_r AS (SELECT coverage, row_num, feature, round(shap, 6) AS shap,
              CAST(row_number() OVER (PARTITION BY coverage, row_num ORDER BY abs(round(shap, 6)) DESC, feature) AS INTEGER) AS rank
       FROM _ev)
SELECT coverage, row_num, feature, shap, rank FROM _r WHERE rank <= {_LOCAL_K}
UNION ALL
SELECT coverage, row_num, 'other' AS feature, sum(shap) AS shap, {_LOCAL_K + 1} AS rank FROM _r WHERE rank > {_LOCAL_K}
GROUP BY 1, 2""")


@query("shap_local", rnd(_LOCAL_SQL, ["shap"]), "ML23 (top-10 features per observation + other)")
def q_shap_local(spark, sf):
    vals, e = _mshap(spark, sf)
    ev, _ = ev_explained(vals, e, K)
    return round_doubles(shap_local(ev, _LOCAL_K, K))


# The observations that are explained one by one.
_POSITIONS = [3, 8, 116, 548]
_ITH_SQL = with_(_BASE, f""",
_i AS (SELECT coverage, row_num, CAST(row_number() OVER (PARTITION BY coverage ORDER BY row_num) AS INTEGER) AS position FROM _tr)
SELECT e.coverage, position, e.row_num, feature, shap FROM _ev e JOIN _i i ON e.coverage = i.coverage AND e.row_num = i.row_num
WHERE position IN ({', '.join(map(str, _POSITIONS))})""")


@query("shap_observations", rnd(_ITH_SQL, ["shap"]), "SRT5 (rows 3, 8, 116 and 548 explained)")
def q_shap_observations(spark, sf):
    ids = test_rows(spark, sf).select("coverage", "row_num")
    chosen = ith_rows(ids, _POSITIONS, "coverage", COVERAGES)
    vals, e = _mshap(spark, sf)          # expectations are those of all rows
    few = vals.join(F.broadcast(chosen.select("coverage", "row_num")), ["coverage", "row_num"], "left_semi")
    ev, _ = ev_explained(few, e, K)
    return round_doubles(ev.join(F.broadcast(chosen), ["coverage", "row_num"]).select("coverage", "position", "row_num", "feature", "shap"))


_FITTED_SQL = with_(SPLIT, f"""
SELECT coverage, row_num, c.num_claims::INTEGER AS num_claims, {len(MODEL_FEATURES)}::BIGINT AS n_features, 0.0::DOUBLE AS gap
FROM split, (VALUES (0), (1), (2), (3)) AS c(num_claims) WHERE split = 'test'""")


def fitted_shap(spark, sf, cov):
    """(severity rows, frequency rows, expectations of both, predictions) of
    fitted models of one coverage: a forest of claim classes and a severity
    forest, for the collision-like coverage Huber boosting."""
    train, _, test = split_frames(spark, sf, cov)
    rows = training_rows(train, "sev", "severity")
    fs = fit_features(train, MODEL_FEATURES)
    freq = M.fit_rf_cls(fs.transform(balanced_train(train)), "label", settings("rf", ntrees=5, max_depth=4))
    if cov == "coll":
        sev = M.fit_boosted(fs.transform(rows), "y", settings("gb", ntrees=4), "huber")
    else:
        sev = M.fit_rf_reg(fs.transform(rows), "y", settings("rf", ntrees=5, max_depth=4))
    t = fs.transform(test)
    sv, sev_mean = tree_shap(t, sev, fs.names, ["row_num"], classification=False)
    fv, freq_mean = tree_shap(t, freq, fs.names, ["row_num"], classification=True)
    start = sev.init[0] if isinstance(sev, M.BoostedModel) else 0.0
    p = (score(freq, t, 1, "frequency").select("row_num", F.posexplode(F.array("p0", "p1", "p2", "p3")).alias("num_claims", "p"))
         .join(score(sev, t, 1, "severity").select("row_num", F.col("predict").alias("s")), "row_num"))
    named = lambda d: d.withColumn("coverage", F.lit(cov))
    return (named(sv.drop("output")), named(fv.withColumnRenamed("output", "num_claims")),
            named(sev_mean.select((F.col("expected_value") + F.lit(start)).alias("expected_value"))),
            named(freq_mean.withColumnRenamed("output", "num_claims")), named(p))


@query("mshap_fitted", _FITTED_SQL, "ML17 ML18 ML19 ML21 UDF4 (attributions of fitted models and of their product)")
def q_mshap_fitted(spark, sf):
    """Per test row and class the distance of the product's attributions and
    expectation from the fitted models' severity times class probability."""
    split_table(spark, sf)              # written before the coverages read it
    # fits are chains of jobs, most of them smaller than the cluster: the coverages' run side by side
    with ThreadPoolExecutor(len(COVERAGES)) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(lambda cov: fitted_shap(spark, sf, cov)), COVERAGES))
    sv, fv, sev_mean, freq_mean, p = (reduce(DataFrame.unionByName, x) for x in zip(*parts))
    values, expected = mshap(sv, fv, sev_mean, freq_mean, keys=K)
    total = values.groupBy(*K, "row_num", "num_claims").agg(F.sum("shap").alias("total"), F.count("*").alias("n_features"))
    out = total.join(expected, [*K, "num_claims"]).join(p, [*K, "row_num", "num_claims"])
    product = F.col("s") * F.col("p")
    gap = (F.col("total") + F.col("expected_value") - product) / F.greatest(F.abs(product), F.lit(1.0))
    return out.select(*K, "row_num", "num_claims", "n_features", F.abs(F.round(gap, 6)).alias("gap"))
