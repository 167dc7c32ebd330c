"""Grid search (ML11), cross-validation (ML12), batch scoring (ML13) and
results tables (SNK2–SNK4).

The driver keeps a bounded number of *models* going (grid rows, a few hundred
at most); every fit and every metric is a distributed Spark job over the cached,
assembled train/validation frames.  One result row per model is collected
(metrics only) and appended to the results table; test predictions are appended
to the predictions table, so a failed or interrupted run keeps everything done
so far and a re-run skips finished models (resume).
"""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_int
from ..operators.grid import fmt_value
from ..sources.sinks import append_result
from ..operators.metrics import classification_metrics, regression_metrics
from .models import class_probabilities

log = logging.getLogger(__name__)


def score(model, df: DataFrame, mod_num: int, kind: str, keep: list[str] | None = None) -> DataFrame:
    """ML13: predictions tagged with ``mod_num`` and ``row_num``;
    frequency models also give p0..p3 and the class."""
    keep = keep or []
    pred = model.transform(df)
    if kind == "frequency":
        pred = class_probabilities(pred)
        cols = ["predict", "p0", "p1", "p2", "p3"]
    else:
        pred = pred.withColumn("predict", F.col("prediction"))
        cols = ["predict"]
    return pred.select(*keep, F.lit(mod_num).cast("int").alias("mod_num"), "row_num", *cols)


def _metrics(model, df: DataFrame, kind: str, label: str) -> dict:
    pred = score(model, df.withColumn("_y", F.col(label)), 0, kind, keep=["_y"])
    if kind == "frequency":
        m = classification_metrics(pred.withColumnRenamed("_y", "label").withColumn("label", F.col("label").cast("int")),
                                   "label", [])
    else:
        m = regression_metrics(pred, "_y", "predict", [])
    return m.first().asDict()          # one row of metrics


def _all_metrics(model, parts: dict[str, DataFrame], kind: str, label: str) -> dict[str, dict]:
    """Metrics of every split in one scoring job: the splits are tagged,
    unioned, scored once and aggregated by tag (one row per split)."""
    tagged = None
    for name, df in parts.items():
        t = df.withColumn("_split", F.lit(name)).withColumn("_y", F.col(label))
        tagged = t if tagged is None else tagged.unionByName(t)
    pred = score(model, tagged, 0, kind, keep=["_split", "_y"])
    if kind == "frequency":
        m = classification_metrics(pred.withColumn("label", F.col("_y").cast("int")), "label", ["_split"])
    else:
        m = regression_metrics(pred, "_y", "predict", ["_split"])
    return {r["_split"]: r.asDict() for r in m.collect()}      # one row per split


#: Models of a grid that are fitted at the same time: their small stages share
#: the cores, while the memory of cached rows stays that of one copy.
AT_ONCE = 4


def run_grid(spark: SparkSession, grid: list[dict], fit: Callable, train: DataFrame, valid: DataFrame,
             test: DataFrame | None, kind: str, label: str, results_path: str | None = None,
             predictions_path: str | None = None, done: set[int] | None = None, at_once: int = AT_ONCE,
             save_freq: int = 1, nfolds: int = 0) -> DataFrame:
    """Fit every grid row not in ``done``, ``at_once`` at a time, each in a job
    group and a scheduler pool of its own; the jobs of a model that fails are
    cancelled, the failure is logged, the others go on.  Results are appended
    as models finish, test predictions with every ``save_freq``-th of them and
    at the end.  With ``nfolds`` the mean fold metrics are there as well
    (``<metric>_cv``).  Returns the results of this run, one row per model in
    the order of the grid."""
    done = done or set()
    todo = [g for g in grid if int(g["mod_num"]) not in done]
    names = [k for k in (grid[0] if grid else {}) if k != "mod_num"]
    schema = results_schema(names, kind, nfolds)
    lock, waiting, rows = threading.Lock(), [], {}
    sc = spark.sparkContext

    def flush() -> None:
        while waiting:
            mod, model = waiting.pop(0)
            append_result(score(model, test, mod, kind), predictions_path)

    def one(g: dict) -> None:
        mod = int(g["mod_num"])
        params = {k: v for k, v in g.items() if k != "mod_num"}
        group = f"grid-{uuid.uuid4().hex[:8]}-{mod}"
        sc.setJobGroup(group, f"model {mod}", interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", f"model-{mod}")
        t0 = time.time()
        try:
            model = fit(train, params)
            secs = time.time() - t0
            parts = {"train": train, "valid": valid}
            if kind == "frequency" and test is not None:
                parts["test"] = test
            ms = _all_metrics(model, parts, kind, label)
            folds = cross_validate(train, fit, params, kind, label, nfolds) if nfolds else []
        except Exception as e:  # noqa: BLE001 — keep the grid going, as the reference does
            sc.cancelJobGroup(group)
            log.error("model %s failed: %s", mod, str(e)[:500])
            return
        rec = {"mod_num": mod, "time_to_create": secs, **{k: fmt_value(v) for k, v in params.items()}}
        tr, va = ms.get("train", {}), ms.get("valid", {})
        for k, v in tr.items():
            if k == "_split" or (kind == "frequency" and k == "logloss"):
                continue
            rec[k] = v
            rec[f"{k}_valid"] = va.get(k)
            if nfolds:
                found = [f[k] for f in folds if f.get(k) is not None]
                rec[f"{k}_cv"] = sum(found) / len(found) if found else None
        if "test" in ms:
            rec["logloss"] = ms["test"]["logloss"]
        with lock:                # appends one after the other
            rows[mod] = rec
            if results_path:
                append_result(spark.createDataFrame([rec], schema), results_path)
            if predictions_path and test is not None:
                waiting.append((mod, model))
                if len(waiting) >= save_freq:
                    flush()

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        for f in [pool.submit(inheritable_thread_target(spark)(one), g) for g in todo]:
            f.result()
    with lock:
        flush()
    return spark.createDataFrame([rows[m] for m in sorted(rows)], schema)


def results_schema(params: list[str], kind: str, nfolds: int = 0) -> str:
    """Columns of a results table: a metric may be NULL in every row of a run
    (e.g. rmsle with a prediction of -1 or less), so types are declared.
    Parameters are text, as grids differ; ``ml.saved.typed`` gives their types
    back."""
    metrics = ["r_2", "mse", "rmse"] + ([] if kind == "frequency" else ["rmsle", "mae"])
    kinds = ("", "_valid", "_cv") if nfolds else ("", "_valid")
    return ", ".join(["mod_num int", "time_to_create double", *[f"`{p}` string" for p in params],
                      *[f"{m}{v} double" for m in metrics for v in kinds], *(["logloss double"] if kind == "frequency" else [])])


def done_models(spark: SparkSession, results_path: str) -> set[int]:
    """SNK4: model numbers already present in a results table."""
    try:
        table = spark.read.parquet(results_path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":        # no table yet
            return set()
        raise
    return {r.mod_num for r in table.select("mod_num").distinct().collect()}


def cross_validate(train: DataFrame, fit: Callable, params: dict, kind: str, label: str, k: int = 5,
                   key: str = "row_num", seed: int = 16) -> list[dict]:
    """ML12: k folds by hashed row id (deterministic, no driver sampling);
    returns the per-fold validation metrics and sizes."""
    fold = (hash_int(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))) % k).cast("int")
    d = train.withColumn("_fold", fold)
    out = []
    for i in range(k):
        model = fit(d.where(F.col("_fold") != i), params)
        part = d.where(F.col("_fold") == i)
        out.append({"fold": i, "n_valid": part.count(), **_metrics(model, part, kind, label)})
    return out
