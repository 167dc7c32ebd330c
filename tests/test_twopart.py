import math

from pyspark.sql import functions as F

from ratewise.operators.twopart import best_pair, compare_models, compare_models_join
from ratewise.sources.synthetic import frequency_predictions, severity_predictions


def _rows(spark, n=300):
    return spark.createDataFrame([("bi" if i % 3 else "pd", i, float((i * 7919) % 5000) * (i % 4 == 0))
                                  for i in range(1, n)], "coverage string, row_num long, ULTIMATE_AMOUNT double")


def _norm(df):
    return sorted((r.coverage, r.sev_mod_file, r.sev_mod_num, r.freq_mod_file, r.freq_mod_num, r.mae, r.mse)
                  for r in df.collect())


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5]
        assert math.isclose(x[5], y[5], rel_tol=1e-12) and math.isclose(x[6], y[6], rel_tol=1e-12)


def test_blocked_equals_join(spark):
    actual = _rows(spark)
    keys = actual.select("coverage", "row_num")
    sev, freq = severity_predictions(keys), frequency_predictions(keys)
    a = compare_models(sev, freq, actual, ["coverage"], max_cells=500)
    b = compare_models_join(sev, freq, actual, ["coverage"])
    _same(_norm(a), _norm(b))


def test_missing_severity_rows_are_skipped(spark):
    actual = _rows(spark, 60)
    keys = actual.select("coverage", "row_num")
    sev = severity_predictions(keys).where(F.col("row_num") % 5 != 0)
    freq = frequency_predictions(keys)
    _same(_norm(compare_models(sev, freq, actual, ["coverage"])),
          _norm(compare_models_join(sev, freq, actual, ["coverage"])))


def test_best_pair_tie_break(spark):
    cmp = spark.createDataFrame([("bi", "b", 1, "f", 1, 1.0, 1.0), ("bi", "a", 2, "f", 1, 1.0, 1.0),
                                 ("bi", "a", 1, "f", 1, 2.0, 0.0)],
                                "coverage string, sev_mod_file string, sev_mod_num int, freq_mod_file string, "
                                "freq_mod_num int, mae double, mse double")
    r = best_pair(cmp, "mae", by=["coverage"]).collect()
    assert len(r) == 1 and (r[0].sev_mod_file, r[0].sev_mod_num) == ("a", 2)


def test_rows_are_not_broadcast(spark, tmp_path):
    import re
    from pyspark.sql import functions as F
    from ratewise.operators.twopart import compare_models
    from ratewise.sources.results import read_predictions, table_path
    tests = spark.createDataFrame([("bi", 1, 5.0), ("bi", 2, 7.0)], "coverage string, row_num long, ULTIMATE_AMOUNT double")
    scored = tests.select("row_num", F.lit(1).alias("mod_num"), F.lit(2.0).alias("predict"), *[F.lit(0.25).alias(f"p{c}") for c in range(4)],
                          F.lit(1).cast("long").alias("written"))
    scored.write.parquet(table_path(str(tmp_path), "bi", "sev", "gb", "severity", "predictions"))
    scored.write.parquet(table_path(str(tmp_path), "bi", "freq", "rf", "ultimate_claim_count", "predictions"))
    sev, freq = (read_predictions(spark, str(tmp_path), part, rows=tests) for part in ("sev", "freq"))
    pairs = compare_models(sev, freq, tests, keys=["coverage"])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[[^]]*row_num", plan)
    assert [(r.mae, r.mse) for r in pairs.collect()] == [(3.0, 10.0)]


def test_severity_metrics_meet_their_rows_bucket_by_bucket(spark):
    """Neither all rows in each executor nor an exchange of the rows of all models."""
    from conftest import SMALL_SF
    from ratewise.plans.q_twopart import severity_metric_rows
    joined = severity_metric_rows(spark, SMALL_SF)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and "Exchange" not in plan and "Sort" not in plan
    assert joined.groupBy("row_num", "file", "mod_num").count().where("count > 1").count() == 0
