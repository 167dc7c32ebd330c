from pyspark.sql import functions as F

from ratewise.operators.explain import ev_explained, mshap, shap_local
from ratewise.sources.synthetic import FREQ_EXPECTED, SEV_EXPECTED, frequency_shap, severity_shap


def test_mshap_additivity(spark):
    rows = spark.createDataFrame([("bi", i) for i in range(1, 200)], "coverage string, row_num long")
    sv, fv = severity_shap(rows), frequency_shap(rows)
    vals, e = mshap(sv, fv, SEV_EXPECTED, FREQ_EXPECTED, keys=["coverage"])
    tot = vals.groupBy("coverage", "row_num", "num_claims").agg(F.sum("shap").alias("s"))
    g = sv.groupBy("row_num").agg((F.lit(SEV_EXPECTED) + F.sum("shap")).alias("g"))
    h = fv.groupBy("row_num", "num_claims").agg((F.lit(0.25) + F.sum("shap")).alias("h"))
    chk = tot.join(e, ["coverage", "num_claims"]).join(g, "row_num").join(h, ["row_num", "num_claims"])
    bad = chk.where(F.abs(F.col("s") + F.col("expected_value") - F.col("g") * F.col("h")) > 1e-6).count()
    assert bad == 0


def test_zero_shap_rows_are_guarded(spark):
    sv = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0)], "row_num long, feature string, shap double")
    fv = spark.createDataFrame([(1, c, f, 0.0) for c in range(4) for f in ("a", "b")],
                               "row_num long, num_claims int, feature string, shap double")
    vals, e = mshap(sv, fv, 10.0, [0.1, 0.2, 0.3, 0.4])
    assert all(r.shap == 0.0 for r in vals.collect())   # E = mu_g * mu_h, nothing to spread


def test_local_top_k_plus_other(spark):
    rows = spark.createDataFrame([("bi", 1)], "coverage string, row_num long")
    sv, fv = severity_shap(rows), frequency_shap(rows)
    vals, e = mshap(sv, fv, SEV_EXPECTED, FREQ_EXPECTED, keys=["coverage"])
    ev, _ = ev_explained(vals, e, ["coverage"])
    loc = shap_local(ev, 5, ["coverage"]).collect()
    assert len(loc) == 6 and [r.feature for r in loc if r["rank"] == 6] == ["other"]
    assert abs(sum(r.shap for r in loc) - sum(r.shap for r in ev.collect())) < 1e-5


def test_rows_that_lie_by_row_num_are_gathered_without_an_exchange(spark):
    from conftest import SMALL_SF
    from ratewise.operators.explain import _gathered, _side_by_side
    from ratewise.plans.q_explain import _inputs
    long, classes = _side_by_side(*_inputs(spark, SMALL_SF), ["coverage"], FREQ_EXPECTED)
    plan = _gathered(long, ["coverage"], len(classes))._jdf.queryExecution().executedPlan().toString()
    assert classes == [0, 1, 2, 3] and "collect_list" in plan and "Exchange" not in plan


def test_missing_classes_and_features_are_left_out(spark):
    sv = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (4, "a", 1.0)], "row_num long, feature string, shap double")
    fv = spark.createDataFrame([(1, 0, "a", 0.5), (1, 1, "c", 0.25), (2, 1, "a", 0.5), (3, 0, "a", 0.5)],
                               "row_num long, num_claims int, feature string, shap double")
    vals, e = mshap(sv, fv, 10.0, [0.25, 0.5])
    assert sorted((r.row_num, r.num_claims, r.feature) for r in vals.collect()) == [(1, 0, "a"), (2, 1, "a")]
    assert {r.num_claims: r.expected_value for r in e.collect()} == {0: 13.0 * 0.75, 1: (13.0 * 0.75 + 11.0 * 1.0) / 2}


def test_coverages_of_fitted_models_run_side_by_side(spark, monkeypatch):
    import threading
    import pytest
    from ratewise.plans import q_explain as Q
    together = threading.Barrier(len(Q.COVERAGES))

    class Met(Exception):
        pass

    def fitted(spark, sf, cov):
        together.wait(20)
        raise Met
    monkeypatch.setattr(Q, "fitted_shap", fitted)
    monkeypatch.setattr(Q, "split_table", lambda spark, sf: None)
    with pytest.raises(Met):
        Q.q_mshap_fitted(spark, "")
