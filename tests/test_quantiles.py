import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from ratewise.operators.quantiles import bucket_of, exact_quantiles, type7_quantile, value_splits
from ratewise.operators.summarize import numeric_summary, six_numbers

PROBS = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p10": 0.1}


def _check(spark, rows, per_bucket):
    df = spark.createDataFrame(rows, "g string, v double")
    out = exact_quantiles(df, ["g"], "v", PROBS, per_bucket=per_bucket).collect()
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert {r.g for r in out} == set(groups)
    for r in out:
        for name, p in PROBS.items():
            assert abs(r[name] - type7_quantile(groups[r.g], p)) < 1e-9


def test_hot_group_null_key_and_ties(spark):
    random.seed(7)
    rows = [("hot", float(random.randint(0, 300))) for _ in range(3000)]
    rows += [(None, 1.0), (None, 2.0), ("one", 5.0), ("ties", 2.0), ("ties", 2.0), ("ties", 9.0), ("nulls", None),
             ("nulls", 4.0)]
    _check(spark, rows, per_bucket=20)
    _check(spark, rows, per_bucket=10**6)


def test_rare_amounts_spread_over_buckets(spark):
    """Claims on 0.16 % of the rows: split points come from distinct values,
    so the positive amounts do not fall into one bucket."""
    random.seed(3)
    df = spark.createDataFrame([(float(random.randint(1, 10**6)) if i % 625 == 0 else 0.0,) for i in range(100_000)], "amount double")
    points = value_splits(df, "amount", per_bucket=10)[None]
    used = df.where("amount > 0").select(bucket_of(F.col("amount"), points).alias("b")).groupBy("b").count().collect()
    assert len(used) >= 12 and max(r["count"] for r in used) <= 40


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]),
                          st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False))), min_size=1, max_size=60))
def test_random_against_type7(spark, rows):
    _check(spark, rows, per_bucket=5)


def test_numeric_summary_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0, 10.0), (2.0, 1.0, 20.0), (3.0, 0.0, 30.0), (10.0, 3.0, 0.0)],
                               "EARNED_EXPOSURE double, ULTIMATE_CLAIM_COUNT double, ULTIMATE_AMOUNT double")
    out = {r.variable: r for r in numeric_summary(df).collect()}
    e = out["EARNED_EXPOSURE"]
    assert (e["Min."], e["1st Qu."], e["Median"], e["Mean"], e["3rd Qu."], e["Max."]) == (1.0, 1.75, 2.5, 4.0, 4.75, 10.0)


def test_six_numbers(spark):
    df = spark.createDataFrame([("m", float(x)) for x in (1, 2, 3, 10)], "k string, v double")
    r = six_numbers(df, ["k"], "v").collect()[0]
    assert (r["min"], r.q1, r.med, r.avg, r.q3, r["max"]) == (1.0, 1.75, 2.5, 4.0, 4.75, 10.0)
