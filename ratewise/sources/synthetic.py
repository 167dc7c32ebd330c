"""Deterministic stand-ins for model outputs, derived from the split policy
rows (so their size grows with the data): severity and frequency
predictions per model, tuning grids with metrics, SHAP rows.

They let the comparison / analysis / explanation operators be checked value
by value against the DuckDB oracle, which evaluates the same arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MODEL_FEATURES


@dataclass(frozen=True)
class ModelSet:
    algo: str          # gb, rf, nn, glm
    response: str      # severity, log_severity, ultimate_claim_count
    n_models: int
    index: int         # distinguishes sets in the synthetic arithmetic

    def file(self, coverage: Column) -> Column:
        return F.concat(F.lit("output/"), coverage, F.lit(f"_{self.algo}_{self.response}_predictions.csv"))

    def file_sql(self) -> str:
        return f"'output/' || coverage || '_{self.algo}_{self.response}_predictions.csv'"


# The synthetic model sets (stand-ins for tuned model files)
# and the hyper-parameter grid behind each set (mod_num = position in the
# grid, first parameter varying fastest).
SEVERITY_SETS = [ModelSet("gb", "severity", 6, 0), ModelSet("nn", "log_severity", 4, 1),
                 ModelSet("glm", "severity", 1, 2), ModelSet("rf", "severity", 6, 3),
                 ModelSet("gb", "log_severity", 6, 4)]
FREQUENCY_SETS = [ModelSet("rf", "ultimate_claim_count", 4, 0), ModelSet("gb", "ultimate_claim_count", 3, 1),
                  ModelSet("glm", "ultimate_claim_count", 1, 2)]
GRIDS = {
    ("gb", "severity"): {"distribution": ["gaussian", "laplace"], "ntrees": [100, 300, 1000]},
    ("gb", "log_severity"): {"distribution": ["gaussian", "laplace"], "ntrees": [100, 300, 1000]},
    ("rf", "severity"): {"max_depth": [10, 20, 30], "mtries": [-1, 20]},
    ("nn", "log_severity"): {"hidden": [[50], [100], [50, 50], [100, 100]]},
    ("glm", "severity"): {},
    ("rf", "ultimate_claim_count"): {"ntrees": [100, 200], "max_depth": [10, 20]},
    ("gb", "ultimate_claim_count"): {"learn_rate": [0.1, 0.01, 0.001]},
    ("glm", "ultimate_claim_count"): {},
}
FAMILY_NAMES = {"gb": "Gradient Boosted Model", "rf": "Random Forest Model",
                "nn": "Neural Network Model", "glm": "Linear Model"}


def _models(rows: DataFrame, sets: list[ModelSet]) -> DataFrame:
    """``rows`` once for each model of ``sets``, by one generator: rows of a
    bucketed table stay where they are, which a union of sets forgets."""
    models = F.array(*[F.struct(F.lit(m).alias("mod_num"), F.lit(i).alias("set"), F.lit(m + 10 * ms.index).alias("_k"))
                       for i, ms in enumerate(sets) for m in range(1, ms.n_models + 1)])
    of_set = lambda values: F.element_at(F.array(*values), F.col("_m.set") + 1)
    return rows.withColumn("_m", F.explode(models)).select(
        *rows.columns, F.col("_m.mod_num").alias("mod_num"), of_set([ms.file(F.col("coverage")) for ms in sets]).alias("file"),
        of_set([F.lit(ms.response) for ms in sets]).alias("response"), F.col("_m._k").alias("_k"))


def severity_predictions(rows: DataFrame, sets=None) -> DataFrame:
    """(coverage, file, response, mod_num, row_num, predict[, split]) — one row per
    model per policy row; log-severity models predict on the log scale."""
    sets = sets or SEVERITY_SETS
    keep = [c for c in ("coverage", "row_num", "split") if c in rows.columns]
    raw = (F.lit(1000) + (F.col("row_num") * F.col("_k") * 37) % 5000).cast("double")
    pred = F.when(F.col("response") == "log_severity", F.log(raw)).otherwise(raw)
    return _models(rows.select(*keep), sets).withColumn("predict", pred).drop("_k")


def frequency_predictions(rows: DataFrame, sets=None) -> DataFrame:
    """(coverage, file, response, mod_num, row_num, predict, p0..p3[, split]):
    weights a_k = 1 + (row_num·K·(k+3)) mod 7, p_k = a_k / Σa, predict =
    lowest class with the largest weight."""
    sets = sets or FREQUENCY_SETS
    keep = [c for c in ("coverage", "row_num", "split") if c in rows.columns]
    d = _models(rows.select(*keep), sets)
    a = [F.lit(1) + (F.col("row_num") * F.col("_k") * (k + 3)) % 7 for k in range(4)]
    total = a[0] + a[1] + a[2] + a[3]
    best = F.greatest(*a)
    predict = (F.when(a[0] == best, 0).when(a[1] == best, 1).when(a[2] == best, 2).otherwise(3))
    return d.select(*d.columns, *[(a[k].cast("double") / total).alias(f"p{k}") for k in range(4)],
                    predict.cast("int").alias("predict")).drop("_k")


# ---------------------------------------------------------------- SQL twins

def severity_predictions_sql(rows: str, sets=None, extra: str = "") -> str:
    sets = sets or SEVERITY_SETS
    parts = []
    for ms in sets:
        raw = f"CAST(1000 + (row_num * (m + {10 * ms.index}) * 37) % 5000 AS DOUBLE)"
        pred = f"ln({raw})" if ms.response == "log_severity" else raw
        parts.append(
            f"SELECT coverage, row_num{extra}, {ms.file_sql()} AS file, '{ms.response}' AS response, "
            f"CAST(m AS INTEGER) AS mod_num, {pred} AS predict "
            f"FROM (SELECT *, unnest(range(1, {ms.n_models + 1})) AS m FROM {rows})")
    return "\nUNION ALL\n".join(parts)


def frequency_predictions_sql(rows: str, sets=None, extra: str = "") -> str:
    sets = sets or FREQUENCY_SETS
    parts = []
    for ms in sets:
        a = [f"(1 + (row_num * (m + {10 * ms.index}) * {k + 3}) % 7)" for k in range(4)]
        total = " + ".join(a)
        best = f"greatest({', '.join(a)})"
        pred = (f"CASE WHEN {a[0]} = {best} THEN 0 WHEN {a[1]} = {best} THEN 1 "
                f"WHEN {a[2]} = {best} THEN 2 ELSE 3 END")
        probs = ", ".join(f"CAST({a[k]} AS DOUBLE) / ({total}) AS p{k}" for k in range(4))
        parts.append(
            f"SELECT coverage, row_num{extra}, {ms.file_sql()} AS file, '{ms.response}' AS response, "
            f"CAST(m AS INTEGER) AS mod_num, {probs}, CAST({pred} AS INTEGER) AS predict "
            f"FROM (SELECT *, unnest(range(1, {ms.n_models + 1})) AS m FROM {rows})")
    return "\nUNION ALL\n".join(parts)


def set_key(ms: ModelSet) -> str:
    return f"{ms.algo}_{ms.response}"


def set_key_of_file(file: Column) -> Column:
    """'output/<cov>_<algo>_<response>_predictions.csv' → '<algo>_<response>'
    (also for the rewritten ..._tuning_results.csv paths)."""
    stripped = F.regexp_replace(file, r"^output/[^_]+_", "")
    return F.regexp_replace(stripped, r"_(predictions|tuning_results)\.csv$", "")


SET_KEY_SQL = ("regexp_replace(regexp_replace({f}, '^output/[^_]+_', ''), "
               "'_(predictions|tuning_results)\\.csv$', '')")


def time_to_create(mod_num: Column, file: Column, sets) -> Column:
    """Synthetic fit time in seconds: ((mod_num + 10·set index)·29) mod 113."""
    key = set_key_of_file(file)
    idx = None
    for ms in sets:
        cond = key == F.lit(set_key(ms))
        idx = F.when(cond, F.lit(ms.index)) if idx is None else idx.when(cond, F.lit(ms.index))
    return (((mod_num + 10 * idx) * 29) % 113).cast("double")


def time_to_create_sql(mod_num: str, file: str, sets) -> str:
    key = SET_KEY_SQL.format(f=file)
    cases = " ".join(f"WHEN {key} = '{set_key(ms)}' THEN {ms.index}" for ms in sets)
    return f"CAST((({mod_num} + 10 * (CASE {cases} END)) * 29) % 113 AS DOUBLE)"


# Synthetic SHAP layout — every model feature is explained —
# and expected values of the severity model and of the four class probabilities.
SHAP_FEATURES = len(MODEL_FEATURES)
SEV_EXPECTED = 2500.0
FREQ_EXPECTED = [0.25, 0.25, 0.25, 0.25]
SEV_EXPECTED_BY = {"bi": 2500.0, "pd": 1800.0, "coll": 3100.0}
FREQ_EXPECTED_BY = {"bi": [0.25, 0.25, 0.25, 0.25], "pd": [0.5, 0.25, 0.125, 0.125], "coll": [0.75, 0.125, 0.0625, 0.0625]}


def shap_expectations(spark) -> tuple[DataFrame, DataFrame]:
    """The two models' expected values of each coverage, as ``mshap`` takes them."""
    sev = spark.createDataFrame(list(SEV_EXPECTED_BY.items()), "coverage string, expected_value double")
    freq = spark.createDataFrame([(c, k, v) for c, x in FREQ_EXPECTED_BY.items() for k, v in enumerate(x)],
                                 "coverage string, num_claims int, expected_value double")
    return sev, freq


def sev_expected_sql(coverage: str) -> str:
    return "(CASE " + coverage + " " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in SEV_EXPECTED_BY.items()) + " END)::DOUBLE"


def freq_expected_sql(coverage: str, num_claims: str) -> str:
    return "(CASE " + coverage + " " + " ".join(f"WHEN '{c}' THEN {v}[{num_claims} + 1]" for c, v in FREQ_EXPECTED_BY.items()) + " END)::DOUBLE"


def shap_features() -> list[str]:
    return MODEL_FEATURES


def _feature_of(j: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in shap_features()]), j)


def severity_shap(rows: DataFrame) -> DataFrame:
    """(coverage, row_num, feature, shap): ((row_num·j·13) mod 101 − 50) / 16."""
    d = rows.select("coverage", "row_num").withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(SHAP_FEATURES))))
    return d.select("coverage", "row_num", _feature_of(F.col("_j")).alias("feature"),
                    (((F.col("row_num") * F.col("_j") * 13) % 101 - 50) / 16).alias("shap"))


def frequency_shap(rows: DataFrame) -> DataFrame:
    """(coverage, row_num, num_claims, feature, shap): ((row_num·j·(c+5)) mod 61 − 30) / 1024."""
    d = (rows.select("coverage", "row_num")
             .withColumn("num_claims", F.explode(F.sequence(F.lit(0), F.lit(3))))
             .withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(SHAP_FEATURES)))))
    return d.select("coverage", "row_num", "num_claims", _feature_of(F.col("_j")).alias("feature"),
                    (((F.col("row_num") * F.col("_j") * (F.col("num_claims") + 5)) % 61 - 30) / 1024).alias("shap"))


def shap_sql(rows: str) -> str:
    feats = "[" + ", ".join(f"'{f}'" for f in shap_features()) + "]"
    return f""",
_sv AS (SELECT coverage, row_num, {feats}[j] AS feature, ((row_num * j * 13) % 101 - 50) / 16 AS shap
        FROM (SELECT *, unnest(range(1, {SHAP_FEATURES + 1})) AS j FROM {rows})),
_fv AS (SELECT coverage, row_num, CAST(c AS INTEGER) AS num_claims, {feats}[j] AS feature,
               ((row_num * j * (c + 5)) % 61 - 30) / 1024 AS shap
        FROM (SELECT *, unnest(range(1, {SHAP_FEATURES + 1})) AS j
              FROM (SELECT *, unnest(range(0, 4)) AS c FROM {rows})))"""
