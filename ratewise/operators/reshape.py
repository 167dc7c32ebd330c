"""Reshape operators: RSH1/RSH2 unpivot, RSH3 probability unpivot,
RSH4 positional zip (an equi-join on the stored ``row_num``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FACTORS


def unpivot_factors(df: DataFrame, ids: list[str], factors: list[str] | None = None,
                    variable: str = "variable", level: str = "level") -> DataFrame:
    """RSH1: factors → (variable, level) rows keeping the id/measure columns
    and NULL levels.  A narrow Expand; no shuffle."""
    factors = factors or FACTORS
    casted = df.select(*ids, *[F.col(f).cast("string").alias(f) for f in factors])
    return casted.unpivot(ids, factors, variable, level)


def unpivot_probs(df: DataFrame, ids: list[str], probs: list[str] | None = None) -> DataFrame:
    """RSH3: class probabilities p0..p3 → (num_claims, prediction)."""
    probs = probs or ["p0", "p1", "p2", "p3"]
    long = df.select(*ids, *probs).unpivot(ids, probs, "prob", "prediction")
    return long.withColumn("num_claims", F.substring("prob", 2, 10).cast("int")).drop("prob")


def zip_by_row_num(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """RSH4/JON7: column-bind by row identity (``row_num``)."""
    return left.join(right, "row_num", how)
