from pyspark.sql import functions as F

from ratewise.operators.clean import add_severity, clean, distinct_rows, drop_null_rows, exposure_audit
from ratewise.schema import RAW


def _raw(spark, rows):
    full = [tuple(r) + tuple(["a"] * 46) for r in rows]
    return spark.createDataFrame(full, RAW)


def test_clean_filters_exposure_and_rounds_half_even(spark):
    rows = [(1.0, 10.0, 0.5), (1.0, 10.0, 1.5), (1.0, 10.0, 2.5), (1.0, 10.0, 3.5),
            (-1.0, 1.0, 1.0), (0.0, 1.0, 1.0), (1e-4, 1.0, None), (None, 1.0, 1.0)]
    out = clean(_raw(spark, rows)).select("EARNED_EXPOSURE", "ULTIMATE_CLAIM_COUNT").collect()
    counts = [r[1] for r in out]
    assert len(out) == 5                      # -1, 0 and NULL exposure dropped
    assert counts[:4] == [0.0, 2.0, 2.0, 4.0]  # R round: half to even
    assert counts[4] is None


def test_severity_log_severity_and_cap(spark):
    rows = [(1.0, 100.0, 4.0), (1.0, 0.0, 1.0), (1.0, -50.0, 2.0), (1.0, 1.0, 1.0), (1.0, 5.0, 0.0),
            (1.0, 5.0, None)]
    out = add_severity(clean(_raw(spark, rows))).select(
        "severity", "log_severity", "ULTIMATE_CLAIM_COUNT").collect()
    assert out[0] == (25.0, __import__("math").log(25.0), 3.0)   # cap after severity: 100/4
    assert out[1][0] == 0.0 and out[1][1] is None                 # ln(0) -> NULL
    assert out[2][0] == -25.0 and out[2][1] is None               # negative severity
    assert out[3][:2] == (1.0, 0.0)
    assert out[4][:2] == (0.0, 0.0)                               # no claims -> 0, 0
    assert out[5] == (None, None, None)                           # NULL count stays NULL


def test_drop_null_and_distinct(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    assert drop_null_rows(df).count() == 2
    assert distinct_rows(df).count() == 2


def test_exposure_audit_shares(spark):
    df = spark.createDataFrame([("bi", 1.0, 1.0, 0.0), ("bi", 0.0, 0.0, 0.0), ("bi", -1.0, 0.0, 0.0),
                                ("bi", 2.0, 3.0, 1.0)],
                               "coverage string, EARNED_EXPOSURE double, ULTIMATE_AMOUNT double, "
                               "ULTIMATE_CLAIM_COUNT double")
    out = {r.exposure_class: r for r in exposure_audit(df).collect()}
    assert out["positive"].n_rows == 2 and out["positive"].pct_of_raw == 50.0
    assert out["zero"].n_rows == 1 and out["negative"].sum_exposure == -1.0
