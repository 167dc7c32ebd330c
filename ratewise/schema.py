"""Declared schemas and column roles, reused by every stage (no inference)."""

from __future__ import annotations

from pyspark.sql import types as T

MEASURES = ["EARNED_EXPOSURE", "ULTIMATE_AMOUNT", "ULTIMATE_CLAIM_COUNT"]
FACTORS = [f"X_VAR{i}" for i in range(1, 47)]

# Factor roles of the policy table.
STATE_FACTOR = "X_VAR27"
YEAR_FACTOR = "X_VAR41"
CONSTANT_FACTORS = ["X_VAR2"]
HIGH_CARDINALITY_FACTORS = ["X_VAR19", "X_VAR34", "X_VAR46"]

# 42 model features: all factors but the constant one and the three
# high-cardinality ones.  Frequency models may add EARNED_EXPOSURE.
MODEL_FEATURES = [f for f in FACTORS if f not in CONSTANT_FACTORS + HIGH_CARDINALITY_FACTORS]
# 43 factors drawn in the distribution figures (only high cardinality excluded).
PLOT_FACTORS = [f for f in FACTORS if f not in HIGH_CARDINALITY_FACTORS]

# Raw delimited files carry no header; names are imposed by position.
RAW = T.StructType(
    [T.StructField(m, T.DoubleType(), True) for m in MEASURES]
    + [T.StructField(f, T.StringType(), True) for f in FACTORS]
)

# Clean / modelling policy table as stored in Parquet between stages.
POLICY = T.StructType(
    [T.StructField("policy_id", T.LongType(), False),
     T.StructField("coverage", T.StringType(), False)]
    + list(RAW.fields)
)

COVERAGES = ["bi", "pd", "coll"]
MAX_CLAIMS = 3                     # claim count cap → classes 0..3
N_CLASSES = MAX_CLAIMS + 1
