import math

from pyspark.sql import functions as F

from ratewise.functions.columns import results_path
from ratewise.ml.grids import REFERENCE_GRIDS
from ratewise.ml.tune import done_models, run_grid
from ratewise.operators.grid import grid_frame, grid_rows, pending
from ratewise.operators.metrics import classification_metrics, regression_metrics


def test_regression_metrics_rmsle_null_and_values(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 1.0, -2.0)], "k string, y double, p double")
    out = {r.k: r for r in regression_metrics(df, "y", "p", ["k"]).collect()}
    assert out["a"].mse == 0.5 and out["a"].mae == 0.5
    assert abs(out["a"].rmsle - math.sqrt((math.log(3) - math.log(2)) ** 2 / 2)) < 1e-12
    assert out["a"].r_2 == 1 - 1.0 / 2.0
    assert out["b"].rmsle is None


def test_logloss_clip(spark):
    df = spark.createDataFrame([("m", 0, 0.0, 1.0, 0.0, 0.0)],
                               "k string, label int, p0 double, p1 double, p2 double, p3 double")
    r = classification_metrics(df, "label", ["k"]).collect()[0]
    assert abs(r.logloss - (-math.log(1e-15))) < 1e-9


def test_reference_grid_sizes():
    sizes = {k: len(grid_rows(v)) for k, v in REFERENCE_GRIDS.items()}
    assert sizes == {"rf_severity": 252, "gb_severity": 72, "nn_severity": 32,
                     "rf_frequency": 20, "gb_frequency": 36, "nn_frequency": 20}


def test_grid_numbering_first_parameter_fastest():
    rows = {r["mod_num"]: r for r in grid_rows(REFERENCE_GRIDS["gb_frequency"])}
    got = {m: (rows[m]["ntrees"], rows[m]["max_depth"], rows[m]["learn_rate"]) for m in (1, 2, 16, 18, 19)}
    assert got == {1: (300, 1, 0.001), 2: (500, 1, 0.001), 16: (300, 10, 0.001), 18: (1000, 10, 0.001), 19: (300, 1, 0.0001)}


def test_results_path(spark):
    df = spark.createDataFrame([("output/bi_gb_ultimate_claim_count_predictions.csv",)], "f string")
    r = df.select(results_path("f").alias("a"), results_path("f", "bi_freq_tuning").alias("b")).first()
    assert r.a == "output/bi_gb_ultimate_claim_count_tuning_results.csv"
    assert r.b == "output/bi_freq_tuning/bi_gb_ultimate_claim_count_tuning_results.csv"


def test_run_grid_survives_null_metrics_and_failing_models(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 5), 1.0) for i in range(60)], "row_num long, y double, x double")

    class Constant:
        def __init__(self, v):
            self.v = v

        def transform(self, d):
            return d.withColumn("prediction", F.lit(self.v))

    def fit(d, p):
        if p["value"] == 3:
            raise RuntimeError("no such model")
        return Constant(float(p["value"]))

    path, preds = str(tmp_path / "r"), str(tmp_path / "p")
    assert done_models(spark, path) == set()
    res = run_grid(spark, grid_rows({"value": [-5, 2, 3]}), fit, rows, rows, rows, "severity", "y", path, preds)
    got = {r.mod_num: r for r in res.collect()}
    assert set(got) == {1, 2} == done_models(spark, path) and got[1].rmsle is None and got[2].rmsle is not None
    assert spark.read.parquet(preds).count() == 120


def test_grid_frame_nn_shape_and_pending(spark):
    g = grid_frame(spark, {"hidden": [[100], [100, 100], [200, 200], [100, 100, 100]], "rate": [0.1, 0.01]})
    r = {x.mod_num: (x.total_nodes, x.num_layers) for x in g.collect()}
    assert r[1] == (100, 1) and r[8] == (300, 3)
    done = g.where("mod_num <= 3")
    assert sorted(x.mod_num for x in pending(g, done).collect()) == [4, 5, 6, 7, 8]
