from ratewise.functions.columns import model_type, results_path
from ratewise.operators.analyze import enrich_comparison, percentile_of_best, time_by_family
from ratewise.operators.metrics import minmax_scale


def test_time_by_family_running_totals(spark):
    df = spark.createDataFrame([("bi", "A", 3600.0), ("bi", "B", 1800.0), ("bi", "B", 1800.0), ("bi", "C", 360.0)],
                               "coverage string, model string, time_to_create double")
    out = {r.model: r for r in time_by_family(df, ["coverage"]).collect()}
    # descending model order: C, B, A
    assert (out["C"].y_min, out["C"].y_max) == (0.0, 360.0)
    assert (out["B"].y_min, out["B"].y_max) == (360.0, 3960.0)
    assert (out["A"].y_min, out["A"].y_max) == (3960.0, 7560.0)
    assert out["A"].label_val == "1.0 Hours" and out["C"].label_val == "0.1 Hours"
    assert out["B"].label_pos == (360.0 + 3960.0) / 2


def test_model_type_and_results_path(spark):
    df = spark.createDataFrame([("output/bi_nn_x_predictions.csv",), ("output/bi_rf_predictions_predictions.csv",),
                                ("output/bi_glm_severity_predictions.csv",)], "f string")
    rows = df.select(model_type("f").alias("t"), results_path("f").alias("p")).collect()
    assert [r.t for r in rows] == ["nn", "rf", "lm"]
    assert rows[1].p == "output/bi_rf_tuning_results_predictions.csv"      # first match only


def test_enrich_comparison_joins_metrics(spark):
    cmp = spark.createDataFrame([("bi", "output/bi_gb_severity_predictions.csv", 1,
                                  "output/bi_rf_ultimate_claim_count_predictions.csv", 2, 10.0, 100.0)],
                                "coverage string, sev_mod_file string, sev_mod_num int, freq_mod_file string, "
                                "freq_mod_num int, mae double, mse double")
    sev = spark.createDataFrame([("bi", "output/bi_gb_severity_predictions.csv", 1, .5, .4, 9.0, 8.0, 3.0, 2.0)],
                                "coverage string, file string, mod_num int, r_2 double, r_2_valid double, "
                                "mse double, mse_valid double, mae double, mae_valid double")
    freq = spark.createDataFrame([("bi", "output/bi_rf_ultimate_claim_count_predictions.csv", 2, .1, .2, .3, .4, .9)],
                                 "coverage string, file string, mod_num int, r_2 double, r_2_valid double, "
                                 "mse double, mse_valid double, logloss double")
    r = enrich_comparison(cmp, sev, freq, ["coverage"]).collect()[0]
    assert r.sev_mod_file.endswith("_tuning_results.csv") and r.sev_mae_valid == 2.0 and r.freq_logloss == 0.9


def test_percentile_of_best(spark):
    best = spark.createDataFrame([("bi", "s", 1, "f", 2)],
                                 "coverage string, sev_mod_file string, sev_mod_num int, freq_mod_file string, "
                                 "freq_mod_num int")
    fcols = ["med_p0"] + [f"mean_p{k}" for k in range(4)]
    fs = spark.createDataFrame([("bi", "f", m, float(m), float(m), 0.0, 0.0, 0.0) for m in (1, 2, 3, 4)],
                               "coverage string, file string, mod_num int, " + ", ".join(f"{c} double" for c in fcols))
    ss = spark.createDataFrame([("bi", "s", m, float(10 - m), float(m)) for m in (1, 2, 3)],
                               "coverage string, file string, mod_num int, med double, avg double")
    r = percentile_of_best(best, fs, ss, ["coverage"]).collect()[0]
    assert r.share_med_p0_below == 0.25 and r.share_mean_p1_below == 0.0
    assert r.share_sev_med_above == 0.0 and r.share_sev_avg_below == 0.0


def test_minmax_scale(spark):
    df = spark.createDataFrame([("bi", 1.0), ("bi", 3.0), ("bi", 2.0), ("pd", 5.0)], "coverage string, x double")
    out = sorted((r.coverage, r.x) for r in minmax_scale(df, ["x"], ["coverage"]).collect())
    assert out == [("bi", 0.0), ("bi", 0.5), ("bi", 1.0), ("pd", 0.0)]
