"""The best models of a run: refit, save, reload, score (ML15, SNK5, SRC9).

What is fitted depends on the file that won the comparison: its name gives the
algorithm and the response, its results table the parameters.  A saved model is
a folder with the fitted model, the feature space it was fitted on, and one
manifest row, so it scores raw rows after a reload without anything else.
"""

from __future__ import annotations

import ast
import json
import os
import re
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import (LogisticRegressionModel, MultilayerPerceptronClassificationModel,
                                       RandomForestClassificationModel)
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import back_transform
from ..operators.clean import claims_only, distinct_rows, min_severity
from ..schema import MODEL_FEATURES
from ..sources.results import read_results
from ..sources.sinks import stage
from . import models as M
from .features import FeatureSpace, fit_features
from .tune import score

#: Loaders of fitted models by class name.
LOADERS: dict[str, Callable] = {c.__name__: (lambda spark, path, c=c: c.load(path)) for c in (
    LinearRegressionModel, LogisticRegressionModel, RandomForestRegressionModel, RandomForestClassificationModel,
    GBTRegressionModel, MultilayerPerceptronClassificationModel)}
LOADERS["BoostedModel"] = M.BoostedModel.load

_FILE = re.compile(r"^(?P<coverage>[^_]+)_(?P<algo>[^_]+)_(?P<response>.+)_(?:predictions|tuning_results)$")


@dataclass(frozen=True)
class Winner:
    """A model of a comparison: where it came from and its parameters."""

    coverage: str
    part: str              # sev or freq
    algo: str              # baseline, rf, gb or nn
    response: str
    mod_num: int
    params: dict

    @property
    def kind(self) -> str:
        return "severity" if self.part == "sev" else "frequency"


def typed(value: str | None):
    """A parameter of a results table, which holds text: numbers, true/false
    and lists of numbers get their type back."""
    if value is None:
        return None
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    try:
        found = ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return value
    return list(found) if isinstance(found, tuple) else found


_NOT_PARAMETERS = {"coverage", "file", "response", "mod_num", "time_to_create", "logloss", "written"} | {
    f"{m}{v}" for m in ("r_2", "mse", "rmse", "rmsle", "mae") for v in ("", "_valid", "_cv")}


def winner(spark: SparkSession, root: str, part: str, file: str, mod_num: int) -> Winner:
    """The model ``mod_num`` of a predictions or results file, with the
    parameters of its results table."""
    m = _FILE.match(file)
    if not m:
        raise ValueError(f"no model file: {file}")
    table = read_results(spark, root, m["coverage"], part, m["algo"], m["response"])
    rows = [] if table is None else table.where(F.col("mod_num") == mod_num).limit(1).collect()
    if not rows:
        raise ValueError(f"{file} has no results of model {mod_num}")
    params = {k: typed(v) for k, v in rows[0].asDict().items() if k not in _NOT_PARAMETERS and v is not None}
    return Winner(m["coverage"], part, m["algo"], m["response"], int(mod_num), params)


# ------------------------------------------------------------------- families
def _gb(train, label, params, kind, valid, n_features):
    distribution = params.get("distribution", "multinomial" if kind == "frequency" else "gaussian")
    plain = distribution in ("gaussian", "laplace") and float(params.get("col_sample_rate_per_tree", 1.0)) >= 1.0
    if plain and not params.get("stopping_rounds"):
        return M.fit_gbt_reg(train, label, params)
    if distribution == "gamma":
        train = train.where(F.col(label) > 0)
    return M.fit_boosted(train, label, params, distribution, valid=valid)


def _rf(train, label, params, kind, valid, n_features):
    return M.fit_rf_cls(train, label, params) if kind == "frequency" else M.fit_rf_reg(train, label, params)


def _baseline(train, label, params, kind, valid, n_features):
    return M.fit_multinomial(train, label) if kind == "frequency" else M.fit_glm(train, label)


def _nn(train, label, params, kind, valid, n_features):
    if kind != "frequency":
        raise ValueError("neural networks are fitted for the claim classes only")
    return M.fit_mlp_cls(train, n_features, params, label)


#: Fitters by the algorithm in a model's file name.
FAMILIES: dict[str, Callable] = {"baseline": _baseline, "rf": _rf, "gb": _gb, "nn": _nn}


def training_rows(split: DataFrame, part: str, response: str) -> DataFrame:
    """Rows that a model of the part is fitted on, with its label as ``y``:
    distinct claims for severities (of 1 at least for their logarithm), all
    policies with their claim class for frequencies."""
    if part == "freq":
        return split.withColumn("y", F.col("label"))
    rows = distinct_rows(claims_only(split))
    if response == "log_severity":
        return min_severity(rows, 1.0).withColumn("y", F.log("severity"))
    return rows.withColumn("y", F.col("severity"))


def fit_family(train: DataFrame, algo: str, kind: str, params: dict, features: FeatureSpace, valid: DataFrame | None = None):
    """Fit one model of a family on rows with the label ``y``."""
    if algo not in FAMILIES:
        raise ValueError(f"no family {algo}: {', '.join(FAMILIES)}")
    held = features.transform(valid) if valid is not None and params.get("stopping_rounds") else None
    made = features.transform(train)
    n_features = made.select("features").first()[0].size
    return FAMILIES[algo](made, "y", params, kind, held, n_features)


@dataclass
class EncodedModel:
    """A model with its features, as one transformer of raw rows."""

    features: FeatureSpace
    model: object

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.features.transform(rows))


def grid_fitter(train: DataFrame, algo: str, kind: str, numeric: list[str] | None = None) -> Callable:
    """A fitter for ``run_grid`` on raw rows with the label ``y``: the grid's
    ``categorical_encoding`` decides the features, which are fitted on ``train``
    once for each encoding."""
    lock, spaces = threading.Lock(), {}

    def fit(rows: DataFrame, params: dict) -> EncodedModel:
        encoding = params.get("categorical_encoding", "ordinal")
        with lock:
            if encoding not in spaces:
                spaces[encoding] = fit_features(train, MODEL_FEATURES, numeric, one_hot=algo == "baseline", encoding=encoding)
        space = spaces[encoding]
        return EncodedModel(space, fit_family(rows, algo, kind, params, space))

    return fit


# --------------------------------------------------------------- saved models
@dataclass
class FittedModel:
    origin: Winner
    features: FeatureSpace
    model: object

    def predict(self, rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep``, ``mod_num``, ``row_num`` and the predictions of raw policy
        rows; log severities are back-transformed."""
        out = score(self.model, self.features.transform(rows), self.origin.mod_num, self.origin.kind, keep)
        return out.withColumn("predict", back_transform("predict", F.lit(self.origin.response == "log_severity")))

    def save(self, path: str) -> str:
        """SNK5: forced overwrite."""
        if isinstance(self.model, M.BoostedModel):
            self.model.save(os.path.join(path, "model"))
        else:
            self.model.write().overwrite().save(os.path.join(path, "model"))
        self.features.save(os.path.join(path, "features"))
        o = self.origin
        SparkSession.getActiveSession().createDataFrame(
            [(o.coverage, o.part, o.algo, o.response, o.mod_num, json.dumps(o.params), type(self.model).__name__)],
            "coverage string, part string, algo string, response string, mod_num int, params string, class string",
        ).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "manifest"))
        return path


def load_fitted(spark: SparkSession, path: str) -> FittedModel:
    """SRC9: a saved model with its features, by its folder."""
    row = spark.read.parquet(os.path.join(path, "manifest")).first()        # one row
    model = LOADERS[row["class"]](spark, os.path.join(path, "model"))
    origin = Winner(row["coverage"], row["part"], row["algo"], row["response"], row["mod_num"], json.loads(row["params"]))
    return FittedModel(origin, FeatureSpace.load(spark, os.path.join(path, "features")), model)


def refit(best: Winner, train: DataFrame, valid: DataFrame | None = None) -> FittedModel:
    """ML15: the winner's family fitted anew with its parameters on the split's
    training rows."""
    rows = stage(training_rows(train, best.part, best.response), "training")       # read by every pass of a fit
    numeric = ["EARNED_EXPOSURE"] if best.part == "freq" else []
    features = fit_features(rows, MODEL_FEATURES, numeric, one_hot=best.algo == "baseline",
                            encoding=best.params.get("categorical_encoding", "ordinal"))
    held = training_rows(valid, best.part, best.response) if valid is not None else None
    return FittedModel(best, features, fit_family(rows, best.algo, best.kind, best.params, features, held))


def save_best_pair(spark: SparkSession, root: str, best: dict, train: dict[str, DataFrame], valid: DataFrame | None = None) -> dict[str, str]:
    """Refit and save both models of a row of the comparison (``sev_mod_file``,
    ``sev_mod_num``, ``freq_mod_file``, ``freq_mod_num``): part → folder.
    ``train`` has the training rows of each part (frequencies may be balanced)."""
    paths = {}
    for part, name in (("sev", "severity"), ("freq", "frequency")):
        w = winner(spark, root, part, best[f"{part}_mod_file"], int(best[f"{part}_mod_num"]))
        paths[part] = refit(w, train[part], valid).save(os.path.join(root, f"{w.coverage}_best_{name}_mod"))
    return paths
