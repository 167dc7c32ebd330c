"""Two-part (frequency × severity) evaluation: PRJ8, PRJ10, JON1, JON7,
AGG11, ML14 and the top-1 selections SRT3/SRT4.

The all-pairs comparison (every severity model with every frequency model)
is the one operator whose naive plan explodes: joining predictions on the
row id and grouping by pair materialises rows × S × F.  The blocked form
keeps the shuffle at rows × (S + F):

1. per frequency model: w = p1 + 2·p2 + 3·p3 (expected claim count), since
   s·p1 + 2s·p2 + 3s·p3 = s·w;
2. per policy row: arrays s[S], w[F] and the actual amount y (one shuffle
   on the row id, array length bounded by the number of models);
3. ``mapInPandas`` block step: |y − s wᵀ| and its square summed over a block
   of rows → partial S×F sums (memory per step capped by ``max_cells``);
4. partial sums added up per pair with a grouped aggregate, divided by n.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import back_transform, claim_weight, expected_amount



def back_transform_predictions(sev: DataFrame) -> DataFrame:
    """PRJ8: exp() the predictions of log-severity models."""
    return sev.withColumn("predict", back_transform("predict", F.col("response") == "log_severity"))


def combine_predictions(freq: DataFrame, sev: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """JON1: frequency rows left-joined with severity predictions on the row
    id; the frequency class prediction is dropped."""
    keys = (keys or []) + ["row_num"]
    return freq.drop("predict").join(sev.select(*keys, "predict"), keys, "left")


def add_expected_cost(df: DataFrame, actual: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """PRJ10 (+ JON7 with the test actuals): amounts for 1, 2, 3 claims and
    the expected ultimate amount."""
    s = F.col("predict")
    out = (df.withColumn("amount_1_claim", s)
             .withColumn("amount_2_claim", 2 * s)
             .withColumn("amount_3_claim", 3 * s)
             .withColumn("expected_ultimate_amount", expected_amount("predict")))
    if actual is not None:
        k = (keys or []) + ["row_num"]
        out = out.join(actual.select(*k, F.col("ULTIMATE_AMOUNT").alias("actual_ultimate_amount")), k, "left")
    return out


def cost_error(combined: DataFrame, by: list[str]) -> DataFrame:
    """AGG11: MAE and MSE of expected vs actual amount."""
    err = F.col("actual_ultimate_amount") - F.col("expected_ultimate_amount")
    return combined.groupBy(*by).agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"))


def _model_index(pred: DataFrame, keys: list[str], idx: str) -> DataFrame:
    models = pred.select(*keys, "file", "mod_num").distinct()
    w = Window.partitionBy(*keys).orderBy("file", "mod_num")
    return models.withColumn(idx, (F.dense_rank().over(w) - 1).cast("int"))


def _gather(pred: DataFrame, index: DataFrame, keys: list[str], idx: str, value: str, out: str) -> DataFrame:
    """Per (keys, row_num): parallel arrays of model index and ``value``
    (models missing for a row are simply absent).  One shuffle on the row
    id; the arrays hold at most one entry per model."""
    d = pred.join(F.broadcast(index), [*keys, "file", "mod_num"], "inner")       # a row for each model
    g = d.groupBy(*keys, "row_num").agg(F.collect_list(F.struct(idx, value)).alias("_e"))
    return g.select(*keys, "row_num", F.col(f"_e.{idx}").alias(f"{out}_i"), F.col(f"_e.{value}").alias(f"{out}_v"))


def compare_models(sev: DataFrame, freq: DataFrame, actual: DataFrame, keys: list[str] | None = None,
                   max_cells: int = 4_000_000) -> DataFrame:
    """ML14 (blocked): one row per (keys, severity model, frequency model) with
    ``mae`` and ``mse`` of the expected amount s·(p1+2p2+3p3) against the
    actual amount, over the rows present in ``actual`` (left join semantics
    of the reference: frequency rows without a severity prediction are NULL
    and skipped by the mean).

    No driver round trip: the model indexes are small per-model tables
    that are broadcast; the block step sizes its
    matrices from each Arrow batch and emits one block of sums per key and
    partition.
    """
    keys = keys or []
    sev = back_transform_predictions(sev)
    s_idx = _model_index(sev, keys, "_si")
    f_idx = _model_index(freq, keys, "_fi")
    sa = _gather(sev, s_idx, keys, "_si", "predict", "s")
    wa = _gather(freq.withColumn("_w", claim_weight()), f_idx, keys, "_fi", "_w", "w")
    y = actual.select(*keys, "row_num", F.col("ULTIMATE_AMOUNT").cast("double").alias("y"))
    # rows of the data on both sides: merged, never broadcast by an estimate
    rows = y.join(wa.hint("merge"), [*keys, "row_num"], "inner").join(sa.hint("merge"), [*keys, "row_num"], "left")

    key_schema = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    schema = (key_schema + ", " if keys else "") + "_si int, _fi int, sum_abs double, sum_sq double, n long"

    def block(batches):
        held: dict = {}         # one S x F block of sums per key and partition
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for kv, g in groups:
                sums = _block_sums(g, max_cells)
                held[kv] = _added(held.get(kv), sums)
        for kv, sums in held.items():
            yield _block_rows(sums, keys, kv)

    partial = rows.mapInPandas(block, schema)
    sums = partial.groupBy(*keys, "_si", "_fi").agg(
        F.sum("sum_abs").alias("_sa"), F.sum("sum_sq").alias("_ss"), F.sum("n").alias("_n"))
    res = (sums.where(F.col("_n") > 0)
               .select(*keys, "_si", "_fi", (F.col("_sa") / F.col("_n")).alias("mae"),
                       (F.col("_ss") / F.col("_n")).alias("mse")))
    si = s_idx.select(*keys, "_si", F.col("file").alias("sev_mod_file"), F.col("mod_num").alias("sev_mod_num"))
    fi = f_idx.select(*keys, "_fi", F.col("file").alias("freq_mod_file"), F.col("mod_num").alias("freq_mod_num"))
    res = res.join(si, [*keys, "_si"]).join(fi, [*keys, "_fi"])
    return res.select(*keys, "sev_mod_file", "sev_mod_num", "freq_mod_file", "freq_mod_num", "mae", "mse")


def _dense(idx_col: pd.Series, val_col: pd.Series) -> np.ndarray:
    """Scatter per-row (index, value) arrays into a dense rows x models
    matrix (NaN where a model has no prediction) — vectorised per batch."""
    n = len(idx_col)
    lens = np.fromiter((0 if a is None else len(a) for a in idx_col), dtype=np.int64, count=n)
    if lens.sum() == 0:
        return np.full((n, 0), np.nan)
    flat_i = np.concatenate([np.asarray(a, dtype=np.int64) for a in idx_col if a is not None and len(a)])
    flat_v = np.concatenate([np.asarray(a, dtype=float) for a in val_col if a is not None and len(a)])
    out = np.full((n, int(flat_i.max()) + 1), np.nan)
    out[np.repeat(np.arange(n), lens), flat_i] = flat_v
    return out


def _block_sums(g: pd.DataFrame, max_cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S x F sums of |error|, error² and the number of errors over the rows."""
    y = g["y"].to_numpy(dtype=float)
    s, w = _dense(g["s_i"], g["s_v"]), _dense(g["w_i"], g["w_v"])
    S, Fn = s.shape[1], w.shape[1]
    acc_abs, acc_sq = np.zeros((S, Fn)), np.zeros((S, Fn))
    cnt = np.zeros((S, Fn), dtype=np.int64)
    if S == 0 or Fn == 0:
        return acc_abs, acc_sq, cnt
    step = max(1, max_cells // (S * Fn))
    for a in range(0, len(g), step):
        b = min(len(g), a + step)
        r = y[a:b, None, None] - s[a:b, :, None] * w[a:b, None, :]
        ok = ~np.isnan(r)
        r0 = np.where(ok, r, 0.0)
        acc_abs += np.abs(r0).sum(axis=0)
        acc_sq += (r0 * r0).sum(axis=0)
        cnt += ok.sum(axis=0)
    return acc_abs, acc_sq, cnt


def _added(held, sums):
    """The sum of two blocks; a batch may know fewer models than another."""
    if held is None:
        return sums
    shape = tuple(max(x) for x in zip(held[0].shape, sums[0].shape))
    grown = [tuple(np.pad(m, [(0, shape[i] - m.shape[i]) for i in (0, 1)]) for m in x) for x in (held, sums)]
    return tuple(a + b for a, b in zip(*grown))


def _block_rows(sums, keys, kv) -> pd.DataFrame:
    acc_abs, acc_sq, cnt = sums
    si, fi = np.meshgrid(np.arange(cnt.shape[0]), np.arange(cnt.shape[1]), indexing="ij")
    out = pd.DataFrame({"_si": si.ravel().astype("int32"), "_fi": fi.ravel().astype("int32"),
                        "sum_abs": acc_abs.ravel(), "sum_sq": acc_sq.ravel(), "n": cnt.ravel()})
    cols = list(out.columns)
    for k, v in zip(keys, kv if isinstance(kv, tuple) else (kv,)):
        out.insert(0, k, v)
    return out[[*keys, *cols]]


def compare_models_join(sev: DataFrame, freq: DataFrame, actual: DataFrame,
                        keys: list[str] | None = None) -> DataFrame:
    """ML14 reference form for small inputs and tests: the row-level join of
    every frequency model with every severity model.  Materialises
    rows × S × F — use ``compare_models`` on real data."""
    keys = keys or []
    sev = back_transform_predictions(sev)
    f = freq.select(*keys, "row_num", F.col("file").alias("freq_mod_file"),
                    F.col("mod_num").alias("freq_mod_num"), "p1", "p2", "p3")
    s = sev.select(*keys, "row_num", F.col("file").alias("sev_mod_file"),
                   F.col("mod_num").alias("sev_mod_num"), "predict")
    y = actual.select(*keys, "row_num", F.col("ULTIMATE_AMOUNT").alias("actual_ultimate_amount"))
    j = f.join(s, [*keys, "row_num"]).join(y, [*keys, "row_num"])
    j = j.withColumn("expected_ultimate_amount", expected_amount("predict"))
    return cost_error(j, [*keys, "sev_mod_file", "sev_mod_num", "freq_mod_file", "freq_mod_num"])


def best_pair(cmp: DataFrame, metric: str = "mae", by: list[str] | None = None,
              where=None) -> DataFrame:
    """SRT3/SRT4: the top-1 pair by ``metric`` per ``by`` group (ties broken
    by the model keys).  The comparison table has one row per model pair,
    so the window is bounded by the grid sizes, not the data."""
    by = by or []
    d = cmp.where(where) if where is not None else cmp
    order = [F.col(metric).asc_nulls_last(), "sev_mod_file", "sev_mod_num", "freq_mod_file", "freq_mod_num"]
    if not by:
        return d.orderBy(*order).limit(1)
    w = Window.partitionBy(*by).orderBy(*order)
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
