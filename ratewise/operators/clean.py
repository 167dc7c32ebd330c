"""Cleaning stage: FLT1, PRJ1–PRJ7, FLT2–FLT4, AGG14, AGG16."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cap, log_severity, round_half_even, severity
from ..schema import FACTORS, MAX_CLAIMS, MEASURES


def clean(df: DataFrame) -> DataFrame:
    """FLT1 + PRJ1 + PRJ2 + PRJ3: keep positive exposure (NULL dropped),
    round the claim count half-to-even, measures as double, factors as text."""
    cols = []
    for c in df.columns:
        if c in MEASURES:
            e = F.col(c).cast("double")
            if c == "ULTIMATE_CLAIM_COUNT":
                e = round_half_even(e, 0)
            cols.append(e.alias(c))
        elif c in FACTORS:
            cols.append(F.col(c).cast("string").alias(c))
        else:
            cols.append(F.col(c))
    return df.where(F.col("EARNED_EXPOSURE") > 0).select(*cols)


def add_severity(df: DataFrame, max_claims: int = MAX_CLAIMS) -> DataFrame:
    """D3 modelling table: PRJ4 severity, PRJ5 log severity, then PRJ6 cap of
    the claim count (evaluated after severity, as in the reference)."""
    return (df.withColumn("severity", severity())
              .withColumn("log_severity", log_severity())
              .withColumn("ULTIMATE_CLAIM_COUNT", cap("ULTIMATE_CLAIM_COUNT", float(max_claims))))


def as_label(df: DataFrame, count: str = "ULTIMATE_CLAIM_COUNT", label: str = "label") -> DataFrame:
    """PRJ7: capped claim count → integer class label 0..3."""
    return df.withColumn(label, F.col(count).cast("int"))


def claims_only(df: DataFrame, count: str = "ULTIMATE_CLAIM_COUNT") -> DataFrame:
    """FLT2: rows with at least one claim (severity training / validation)."""
    return df.where(F.col(count) > 0)


def min_severity(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """FLT3: ``severity > threshold`` (log-severity models)."""
    return df.where(F.col("severity") > threshold)


def drop_null_rows(df: DataFrame) -> DataFrame:
    """FLT4: drop rows with a NULL in any column."""
    return df.dropna(how="any")


def distinct_rows(df: DataFrame) -> DataFrame:
    """AGG16: whole-row de-duplication (one shuffle on all columns)."""
    return df.distinct()


def exposure_audit(raw: DataFrame, by: str = "coverage") -> DataFrame:
    """AGG14: rows and sums of the raw table and by exposure sign class per
    coverage, with their shares of the raw rows, amount and claims.  One pass:
    the raw rows and the shares come from the (tiny) aggregated result."""
    e = F.col("EARNED_EXPOSURE")
    sign = (F.when(e.isNull(), F.lit("null")).when(e > 0, F.lit("positive"))
            .when(e == 0, F.lit("zero")).otherwise(F.lit("negative")))
    agg = (raw.groupBy(by, sign.alias("exposure_class"))
              .agg(F.count(F.lit(1)).alias("n_rows"),
                   F.sum("EARNED_EXPOSURE").alias("sum_exposure"),
                   F.sum("ULTIMATE_AMOUNT").alias("sum_amount"),
                   F.sum("ULTIMATE_CLAIM_COUNT").alias("sum_claims")))
    sums = ["n_rows", "sum_exposure", "sum_amount", "sum_claims"]
    raw_rows = agg.groupBy(by).agg(F.lit("raw").alias("exposure_class"), *[F.sum(c).alias(c) for c in sums])
    w = Window.partitionBy(by)
    of_raw = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.max(F.when(F.col("exposure_class") == "raw", F.col(c))).over(w)), 6)
    return (agg.unionByName(raw_rows).withColumn("pct_of_raw", of_raw("n_rows"))
            .withColumn("pct_amount", of_raw("sum_amount")).withColumn("pct_claims", of_raw("sum_claims")))
