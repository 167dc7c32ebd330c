"""Model fitting jobs on MLlib (ML3–ML8, ML10) and the boosting loop used
where MLlib has no matching loss or setting (gamma / Huber severity,
multinomial frequency boosting, columns sampled per tree, validation stop).

Parameter translation from the tuning grids: ntrees → numTrees / maxIter,
max_depth → maxDepth (≤ 30), learn_rate → stepSize, sample_rate →
subsamplingRate, nbins → maxBins, min_split_improvement → minInfoGain,
mtries n → featureSubsetStrategy 'n' (−1 → 'onethird' for regression,
'sqrt' for classification).  Defaults are those of the tuned algorithms
(50 trees; depth 20 for forests, 5 for boosting).  Forests sample columns per
split (mtries), not per tree.
"""

from __future__ import annotations

import math
import os
import random
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark import SparkContext
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import N_CLASSES


def _subset(mtries, classification: bool) -> str:
    if mtries is None or int(mtries) == -1:
        return "sqrt" if classification else "onethird"
    return str(int(mtries))


def fit_glm(train: DataFrame, label: str, features: str = "features", weight: str | None = None):
    """ML3: gaussian GLM (least squares) — MLlib LinearRegression."""
    lr = LinearRegression(featuresCol=features, labelCol=label, regParam=0.0, maxIter=100)
    if weight:
        lr.setWeightCol(weight)
    return lr.fit(train)


def fit_multinomial(train: DataFrame, label: str = "label", features: str = "features"):
    """ML4: multinomial logistic regression over the claim classes."""
    return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial",
                              maxIter=100, regParam=0.0).fit(train)


def fit_rf_reg(train: DataFrame, label: str, params: dict, features: str = "features"):
    """ML5: random forest regression."""
    return RandomForestRegressor(
        featuresCol=features, labelCol=label, numTrees=int(params.get("ntrees", 50)),
        maxDepth=min(int(params.get("max_depth", 20)), 30),
        minInfoGain=float(params.get("min_split_improvement", 0.0)),
        subsamplingRate=float(params.get("sample_rate", 1.0)),
        featureSubsetStrategy=_subset(params.get("mtries"), False),
        maxBins=max(32, int(params.get("nbins", 32))), seed=int(params.get("seed", 16)),
        bootstrap=False).fit(train)


def fit_rf_cls(train: DataFrame, label: str, params: dict, features: str = "features", weight: str | None = None):
    """ML6: random forest classifier, optionally exposure-weighted."""
    rf = RandomForestClassifier(
        featuresCol=features, labelCol=label, numTrees=int(params.get("ntrees", 50)),
        maxDepth=min(int(params.get("max_depth", 20)), 30),
        minInfoGain=float(params.get("min_split_improvement", 0.0)),
        subsamplingRate=float(params.get("sample_rate", 1.0)),
        featureSubsetStrategy=_subset(params.get("mtries"), True),
        maxBins=max(32, int(params.get("nbins", 32))), seed=int(params.get("seed", 16)),
        bootstrap=False)
    if weight:
        rf.setWeightCol(weight)
    return rf.fit(train)


def fit_gbt_reg(train: DataFrame, label: str, params: dict, features: str = "features"):
    """ML7 gaussian / laplace: MLlib GBT with squared / absolute loss."""
    loss = {"gaussian": "squared", "laplace": "absolute"}[params.get("distribution", "gaussian")]
    return GBTRegressor(
        featuresCol=features, labelCol=label, maxIter=int(params.get("ntrees", 50)),
        maxDepth=min(int(params.get("max_depth", 5)), 30), stepSize=float(params.get("learn_rate", 0.1)),
        minInfoGain=float(params.get("min_split_improvement", 0.0)),
        subsamplingRate=float(params.get("sample_rate", 1.0)), lossType=loss,
        maxBins=max(2, int(params.get("nbins", 32))), seed=int(params.get("seed", 16))).fit(train)


def fit_mlp_cls(train: DataFrame, n_features: int, params: dict, label: str = "label",
                features: str = "features", max_iter: int = 100):
    """ML10: feed-forward network over the claim classes (MLlib: sigmoid hidden
    units, softmax output; no dropout or momentum)."""
    hidden = params.get("hidden", [100])
    hidden = list(hidden) if isinstance(hidden, (list, tuple)) else [int(hidden)]
    return MultilayerPerceptronClassifier(
        featuresCol=features, labelCol=label, layers=[n_features, *hidden, N_CLASSES],
        stepSize=float(params.get("rate", 0.03)), maxIter=max_iter, seed=int(params.get("seed", 16)),
        blockSize=128).fit(train)


# --------------------------------------------------------------------------
# Boosting loop for losses and settings MLlib's own boosting lacks.  Each
# round is one distributed DecisionTreeRegressor fit for each output on
# pseudo-residual columns; the running score is a column updated with the new
# tree's prediction.  Training rows are checkpointed every few rounds to keep
# the lineage short.
# --------------------------------------------------------------------------

LOSSES = ("gaussian", "laplace", "huber", "gamma", "multinomial")


def _ensemble(trees: list, rate: float, n_features: int) -> GBTRegressionModel:
    """Fitted trees as one MLlib ensemble: one pass scores all of them, and
    MLlib's writer keeps them in one node table."""
    sc = SparkContext._active_spark_context
    regression = sc._jvm.org.apache.spark.ml.regression
    nodes = sc._gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    weights = sc._gateway.new_array(sc._jvm.double, len(trees))
    for i, tree in enumerate(trees):
        nodes[i], weights[i] = tree._java_obj, float(rate)
    return GBTRegressionModel(regression.GBTRegressionModel(f"boosted_{uuid.uuid4().hex[:12]}", nodes, weights, n_features))


@dataclass
class BoostedModel:
    """``init`` plus one weighted ensemble for each output (1, or one for each
    class), linked to predictions by the loss."""

    init: list[float]
    outputs: list[GBTRegressionModel]
    loss: str

    def raw(self, df: DataFrame, features: str = "features") -> DataFrame:
        out = df
        for c, (start, model) in enumerate(zip(self.init, self.outputs)):
            out = model.setFeaturesCol(features).setPredictionCol(f"_f{c}").transform(out)
            out = out.withColumn(f"_f{c}", F.col(f"_f{c}") + F.lit(float(start)))
        return out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        out = self.raw(df, features)
        k = len(self.init)
        if self.loss == "multinomial":
            probabilities = _softmax(k)
            out = out.withColumns({f"p{c}": p for c, p in enumerate(probabilities)})
            best = F.greatest(*[F.col(f"p{c}") for c in range(k)])
            pred = F.lit(k - 1)
            for c in reversed(range(k - 1)):
                pred = F.when(F.col(f"p{c}") == best, F.lit(c)).otherwise(pred)
            out = out.withColumn("prediction", pred.cast("double"))
        elif self.loss == "gamma":
            out = out.withColumn("prediction", F.exp("_f0"))
        else:
            out = out.withColumn("prediction", F.col("_f0"))
        return out.drop(*[f"_f{c}" for c in range(k)])

    def save(self, path: str) -> None:
        """SNK5: a node table for each output (MLlib's own format) and one row
        with the start values and the loss."""
        spark = SparkSession.getActiveSession()
        for c, model in enumerate(self.outputs):
            model.write().overwrite().save(os.path.join(path, f"output_{c}"))
        spark.createDataFrame([(self.loss, self.init)], "loss string, init array<double>").coalesce(1).write.mode(
            "overwrite").parquet(os.path.join(path, "boosted"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedModel":
        row = spark.read.parquet(os.path.join(path, "boosted")).first()        # one row
        init = list(row["init"])
        return cls(init, [GBTRegressionModel.load(os.path.join(path, f"output_{c}")) for c in range(len(init))], row["loss"])


def _softmax(k: int) -> list[Column]:
    """Class probabilities of the score columns ``_f0`` to ``_f<k-1>``."""
    top = F.greatest(*[F.col(f"_f{c}") for c in range(k)]) if k > 1 else F.col("_f0")
    parts = [F.exp(F.col(f"_f{c}") - top) for c in range(k)]
    return [p / reduce(lambda a, b: a + b, parts) for p in parts]


def _deviance(d: DataFrame, loss: str, k: int) -> float:
    """Mean loss of the score columns: what stops a run on validation rows."""
    y, f = F.col("_y"), F.col("_f0")
    if loss == "multinomial":
        p = reduce(lambda acc, c: F.when(y == c, _softmax(k)[c]).otherwise(acc), range(k), F.lit(1e-15))
        e = -F.log(F.greatest(p, F.lit(1e-15)))
    elif loss == "gamma":
        e = y * F.exp(-f) + f
    elif loss == "gaussian":
        e = (y - f) * (y - f)
    else:
        e = F.abs(y - f)
    return float(d.agg(F.avg(e)).first()[0] or 0.0)


def fit_boosted(train: DataFrame, label: str, params: dict, loss: str, features: str = "features",
                huber_alpha: float = 0.9, checkpoint_every: int = 5, valid: DataFrame | None = None) -> BoostedModel:
    """ML7 / ML8: gradient boosting with DecisionTreeRegressor base learners on
    pseudo-residuals.

    gaussian: y - f; laplace: its sign; gamma: log link, residual y·e^{−f} − 1;
    huber: residual clipped at the ``huber_alpha`` quantile of |y − f| (per
    round, approximate quantile); multinomial: a score column for each class,
    residual 1[y = k] − softmax_k.  Parameters: ntrees, max_depth, learn_rate,
    min_split_improvement, sample_rate (of the rows, per tree),
    col_sample_rate_per_tree (features that a tree may split on: the others
    are zeroed for its fit), nbins (split candidates of a feature), seed; with
    ``valid`` also stopping_rounds and stopping_tolerance: the run ends when
    the best validation loss of the last stopping_rounds rounds is not better
    than the best before by the tolerance, a share of it."""
    if loss not in LOSSES:
        raise ValueError(f"loss is one of {', '.join(LOSSES)}")
    rounds = int(params.get("ntrees", 50))
    rate = float(params.get("learn_rate", 0.1))
    sub = float(params.get("sample_rate", 1.0))
    columns = float(params.get("col_sample_rate_per_tree", 1.0))
    patience = int(params.get("stopping_rounds", 0)) if valid is not None else 0
    tolerance = float(params.get("stopping_tolerance", 0.001))
    seed = int(params.get("seed", 16))
    d = train.select(features, F.col(label).cast("double").alias("_y")).cache()       # until the first round's rows are
    held: dict[str, DataFrame] = {"train": d}
    first = d.select(features).first()
    n_features = first[0].size if first else 0
    if loss == "multinomial":
        k = N_CLASSES
        prior = {r["_y"]: r["n"] for r in d.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
        tot = sum(prior.values())
        init = [math.log(max(prior.get(float(c), 0), 1) / tot) for c in range(k)]
    elif loss in ("huber", "laplace"):
        k, init = 1, [d.agg(F.percentile_approx("_y", 0.5, 10000)).first()[0]]
    else:
        mean = d.agg(F.avg("_y")).first()[0]
        k, init = 1, [math.log(mean) if loss == "gamma" else mean]
    start = {f"_f{c}": F.lit(float(init[c])) for c in range(k)}
    frames = {"train": d.withColumns(start)}
    if patience:
        frames["valid"] = valid.select(features, F.col(label).cast("double").alias("_y")).withColumns(start)
    trees: list[list] = [[] for _ in range(k)]
    losses: list[float] = []
    for r in range(rounds):
        d = frames["train"]
        f0 = F.col("_f0")
        if loss == "multinomial":
            d = d.withColumns({f"_g{c}": (F.col("_y") == c).cast("double") - p for c, p in enumerate(_softmax(k))})
        elif loss == "gamma":
            d = d.withColumn("_g0", F.col("_y") * F.exp(-f0) - 1)
        elif loss == "gaussian":
            d = d.withColumn("_g0", F.col("_y") - f0)
        elif loss == "laplace":
            d = d.withColumn("_g0", F.signum(F.col("_y") - f0))
        else:
            res = F.col("_y") - f0
            delta = d.select(F.percentile_approx(F.abs(res), huber_alpha, 1000).alias("q")).first()["q"] or 0.0
            d = d.withColumn("_g0", F.when(F.abs(res) <= delta, res).otherwise(F.signum(res) * delta))
        for c in range(k):
            sample, column = (d.sample(False, sub, seed + r) if sub < 1.0 else d), features
            if columns < 1.0:
                mask = ElementwiseProduct(scalingVec=Vectors.dense(_column_mask(n_features, columns, seed, r, c)),
                                          inputCol=features, outputCol="_masked")
                sample, column = mask.transform(sample), "_masked"
            tree = DecisionTreeRegressor(
                featuresCol=column, labelCol=f"_g{c}", predictionCol="_t", maxDepth=min(int(params.get("max_depth", 3)), 30),
                maxBins=max(2, int(params.get("nbins", 32))), seed=seed + r,
                minInfoGain=float(params.get("min_split_improvement", 0.0))).fit(sample)
            trees[c].append(tree)
            tree.setFeaturesCol(features)
            d = tree.transform(d).withColumn(f"_f{c}", F.col(f"_f{c}") + rate * F.col("_t")).drop("_t")
            if patience:
                frames["valid"] = tree.transform(frames["valid"]).withColumn(f"_f{c}", F.col(f"_f{c}") + rate * F.col("_t")).drop("_t")
        frames["train"] = d.drop(*[f"_g{c}" for c in range(k)])
        for name in frames:
            if (r + 1) % checkpoint_every == 0:
                frames[name] = frames[name].checkpoint(eager=True)      # reliable: cuts the growing lineage
                new = None
            else:
                new = frames[name] = frames[name].cache()               # reused by the next round's fits
                new.count()                                             # filled from the parent's cache, which goes next
            if held.get(name) is not None:
                held[name].unpersist()
            held[name] = new
        if patience:
            losses.append(_deviance(frames["valid"], loss, k))
            if len(losses) > patience and min(losses[-patience:]) > min(losses[:-patience]) * (1 - tolerance):
                break
    for frame in held.values():
        if frame is not None:
            frame.unpersist()
    return BoostedModel(init, [_ensemble(t, rate, n_features) for t in trees], loss)


def _column_mask(n: int, rate: float, seed: int, round_: int, output: int) -> list[float]:
    """1 for the features that a tree may split on, at least one of them."""
    rng = random.Random(f"{seed}|{round_}|{output}")
    chosen = set(rng.sample(range(n), max(1, round(rate * n))))
    return [1.0 if i in chosen else 0.0 for i in range(n)]


def class_probabilities(pred: DataFrame, prob_col: str = "probability") -> DataFrame:
    """ML13: MLlib probability vector → p0..p3 columns, class as int."""
    out = pred
    if prob_col in pred.columns:
        arr = vector_to_array(F.col(prob_col))
        for c in range(N_CLASSES):
            out = out.withColumn(f"p{c}", F.coalesce(arr[c], F.lit(0.0)))
    return out.withColumn("predict", F.col("prediction").cast("int"))
