"""L5 model tests: planted signal is learned; SHAP additivity."""
import itertools
import math
import re
import threading
import time

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ratewise.ml import models as M
from ratewise.ml.tune import done_models, run_grid
from ratewise.ml.treeshap import node_table, tree_shap


def _data(spark, n=400):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        a, b, c = rng.integers(0, 5), rng.integers(0, 3), rng.normal()
        y = 3.0 * a - 2.0 * b + 0.1 * c
        label = int(a >= 3) + int(b == 2)
        rows.append((i, Vectors.dense([float(a), float(b), float(c)]), float(y), label, 1.0 + (i % 3)))
    return spark.createDataFrame(rows, ["row_num", "features", "y", "label", "w"])


def _mse(df, pcol):
    return df.select(F.avg(F.pow(F.col("y") - F.col(pcol), 2))).first()[0]


def test_boosting_losses_learn(spark):
    d = _data(spark)
    var = d.select(F.var_pop("y")).first()[0]
    for loss in ("huber",):
        m = M.fit_boosted(d, "y", {"ntrees": 10, "max_depth": 3, "learn_rate": 0.3}, loss, checkpoint_every=4)
        assert _mse(m.transform(d), "prediction") < 0.3 * var
    pos = d.withColumn("y", F.col("y") + 20)
    g = M.fit_boosted(pos, "y", {"ntrees": 10, "max_depth": 3, "learn_rate": 0.3}, "gamma")
    assert _mse(g.transform(pos), "prediction") < 0.3 * var
    mn = M.fit_boosted(d, "label", {"ntrees": 5, "max_depth": 3, "learn_rate": 0.5}, "multinomial")
    out = M.class_probabilities(mn.transform(d))
    acc = out.select(F.avg((F.col("predict") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.8
    s = out.select(F.max(F.abs(F.col("p0") + F.col("p1") + F.col("p2") + F.col("p3") - 1))).first()[0]
    assert s < 1e-9


def _trees(model):
    return [t.toDebugString for o in model.outputs for t in o.trees]


def test_boosting_parameters_change_the_trees(spark):
    d = _data(spark, 200)
    base = {"ntrees": 2, "max_depth": 3, "learn_rate": 0.3}
    plain = _trees(M.fit_boosted(d, "y", base, "gaussian"))
    for more in ({"col_sample_rate_per_tree": 0.34}, {"nbins": 2}, {"min_split_improvement": 5.0}, {"sample_rate": 0.3}, {"max_depth": 1}):
        assert _trees(M.fit_boosted(d, "y", base | more, "gaussian")) != plain
    used = {int(f) for t in _trees(M.fit_boosted(d, "y", base | {"col_sample_rate_per_tree": 0.34, "ntrees": 1}, "gaussian"))
            for f in re.findall(r"feature (\d+)", t)}
    assert len(used) == 1


def test_boosting_stops_on_validation_rows(spark):
    d = _data(spark, 200)
    noise = d.withColumn("y", F.rand(3))
    params = {"ntrees": 12, "max_depth": 3, "learn_rate": 0.5, "stopping_rounds": 2, "stopping_tolerance": 0.001}
    stopped = M.fit_boosted(d.withColumn("y", F.rand(1)), "y", params, "gaussian", valid=noise)
    assert 3 <= len(stopped.outputs[0].trees) < 12
    assert len(M.fit_boosted(d, "y", params | {"ntrees": 3}, "gaussian").outputs[0].trees) == 3


@pytest.mark.parametrize("loss,label", [("huber", "y"), ("laplace", "y"), ("multinomial", "label")])
def test_boosted_model_reload(spark, tmp_path, loss, label):
    d = _data(spark, 150)
    m = M.fit_boosted(d, label, {"ntrees": 3, "max_depth": 3, "learn_rate": 0.5}, loss)
    m.save(str(tmp_path / "m"))
    again = M.BoostedModel.load(spark, str(tmp_path / "m"))
    names = ["prediction"] + (["p0", "p1", "p2", "p3"] if loss == "multinomial" else [])
    assert ([tuple(r) for r in m.transform(d).orderBy("row_num").select(*names).collect()]
            == [tuple(r) for r in again.transform(d).orderBy("row_num").select(*names).collect()])
    assert again.loss == loss and again.init == m.init


def _gap(spark, model, d, classification, output=None):
    """Largest distance of the contributions plus expectation from the model."""
    shap, ev = tree_shap(d, model, ["a", "b", "c"], ["row_num"], classification=classification)
    assert shap.count() == d.count() * 3 * ev.count()
    tot = shap.groupBy("row_num", "output").agg(F.sum("shap").alias("s")).join(ev, "output")
    if output is not None:
        pred = output
    elif classification:
        pred = model.transform(d).select("row_num", F.posexplode(vector_to_array("probability")).alias("output", "p"))
    else:
        pred = model.transform(d).select("row_num", F.lit(0).alias("output"), F.col("prediction").alias("p"))
    j = tot.join(pred, ["row_num", "output"])
    return j.select(F.max(F.abs(F.col("s") + F.col("expected_value") - F.col("p")))).first()[0]


def test_treeshap_additivity(spark):
    d = _data(spark, 150)
    assert _gap(spark, M.fit_rf_reg(d, "y", {"ntrees": 4, "max_depth": 7}), d, False) < 1e-9
    assert _gap(spark, M.fit_rf_cls(d, "label", {"ntrees": 3, "max_depth": 3}, weight="w"), d, True) < 1e-9
    assert _gap(spark, M.fit_gbt_reg(d, "y", {"ntrees": 3, "max_depth": 2, "learn_rate": 0.5}), d, False) < 1e-9
    boosted = M.fit_boosted(d, "label", {"ntrees": 2, "max_depth": 2, "learn_rate": 0.5}, "multinomial")
    scores = boosted.raw(d).select("row_num", F.posexplode(F.array(*[F.col(f"_f{c}") - boosted.init[c] for c in range(4)])).alias("output", "p"))
    assert _gap(spark, boosted, d, False, scores) < 1e-9


def test_treeshap_of_a_constant_model(spark):
    d = _data(spark, 40).withColumn("y", F.lit(3.0))
    assert _gap(spark, M.fit_rf_reg(d, "y", {"ntrees": 2, "max_depth": 3}), d, False) < 1e-9


def _shapley(trees, x, p):
    """Shapley values of the path-dependent expectation, over all subsets."""
    def expect(tree, node, known):
        left, right, f, at, cover, value, _ = tree[node]
        if left < 0:
            return value
        if f in known:
            return expect(tree, left if x[f] <= at else right, known)
        return sum(expect(tree, c, known) * tree[c][4] for c in (left, right)) / cover

    out = [0.0] * p
    for tree in trees:
        for i in range(p):
            rest = [j for j in range(p) if j != i]
            for n in range(p):
                for s in itertools.combinations(rest, n):
                    w = math.factorial(n) * math.factorial(p - n - 1) / math.factorial(p)
                    out[i] += tree[0][6] * w * (expect(tree, 0, {*s, i}) - expect(tree, 0, set(s)))
    return out


def test_treeshap_equals_shapley_values_over_all_subsets(spark):
    d = _data(spark, 120)
    model = M.fit_rf_reg(d, "y", {"ntrees": 3, "max_depth": 5, "mtries": 2})
    nodes, _ = node_table(spark, model, False)
    trees = {}
    for r in nodes.collect():
        trees.setdefault(r.tree, {})[r.node] = (r.left, r.right, r.f, r["at"], r.cover, r.value[0], r.weight)
    shap, _ = tree_shap(d.limit(12), model, ["a", "b", "c"], ["row_num"], classification=False)
    got = {(r.row_num, r.feature): r.shap for r in shap.collect()}
    for r in d.limit(12).collect():
        for name, want in zip("abc", _shapley(trees.values(), r.features.toArray().tolist(), 3)):
            assert abs(got[r.row_num, name] - want) < 1e-9


def test_grid_runs_models_together_and_survives_failures(spark, tmp_path):
    d = _data(spark, 120).cache()
    at_work, most, lock = [0], [0], threading.Lock()

    def fit(rows, params):
        with lock:
            at_work[0] += 1
            most[0] = max(most[0], at_work[0])
        try:
            if params["max_depth"] == 99:
                rows.select(F.raise_error(F.lit("bad model"))).collect()
            time.sleep(0.5)
            return M.fit_rf_reg(rows, "y", params)
        finally:
            with lock:
                at_work[0] -= 1

    grid = [{"mod_num": i, "ntrees": 2, "max_depth": m} for i, m in enumerate((1, 2, 99, 3), 1)]
    results, preds = str(tmp_path / "r"), str(tmp_path / "p")
    out = run_grid(spark, grid, fit, d, d, d, "severity", "y", results, preds, at_once=3, save_freq=2, nfolds=2)
    assert most[0] >= 2
    rows = out.collect()
    assert [r.mod_num for r in rows] == [1, 2, 4] and all(r.mse_cv > 0 for r in rows)
    assert {r.mod_num for r in spark.read.parquet(results).collect()} == {1, 2, 4}
    assert spark.read.parquet(preds).groupBy("mod_num").count().collect().__len__() == 3
    again = run_grid(spark, grid, lambda r, p: M.fit_rf_reg(r, "y", p | {"max_depth": 2}), d, d, d, "severity", "y", results, preds,
                     done=done_models(spark, results), nfolds=2)
    assert [r.mod_num for r in again.collect()] == [3]
    d.unpersist()


def test_attributions_store_no_row_values(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    from ratewise.ml import treeshap
    from ratewise.ml.models import fit_rf_reg
    made, stage = {}, treeshap.stage
    monkeypatch.setattr(treeshap, "stage", lambda df, name: made.setdefault(name, df.columns) and stage(df, name))
    d = spark.range(60).select(F.col("id").alias("row_num"), (F.col("id") % 7).cast("double").alias("y"),
                               array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 4).cast("double"))).alias("features"))
    model = fit_rf_reg(d, "y", {"ntrees": 2, "max_depth": 3})
    shap, ev = treeshap.tree_shap(d, model, ["a", "b"], ["row_num"], classification=False)
    total = shap.groupBy("row_num").agg(F.sum("shap").alias("s")).join(model.transform(d), "row_num")
    mean = ev.first()["expected_value"]
    assert total.where(F.abs(F.col("s") + mean - F.col("prediction")) > 1e-9).count() == 0
    assert made["tree-patterns"] == ["row_num", "tree", "pattern"] and made["patterns"] == ["tree", "pattern", "below"]


@pytest.mark.parametrize("kind,params", [("rf", {"ntrees": 3, "max_depth": 4}), ("cls", {"ntrees": 3, "max_depth": 4}), ("deep", {"ntrees": 2, "max_depth": 14})])
def test_attributions_in_place_equal_those_by_joins(spark, monkeypatch, kind, params):
    """A model that is given to the tasks: no row is written or exchanged, and
    missing numbers go where the splits send them."""
    from ratewise.ml import treeshap
    rng = np.random.default_rng(5)
    rows = [(i, Vectors.dense([float(rng.integers(0, 6)), float("nan") if i % 11 == 0 else float(rng.normal()), *map(float, rng.normal(size=6))]),
             float(rng.normal() + (i % 5)), i % 4) for i in range(160)]
    d = spark.createDataFrame(rows, ["row_num", "features", "y", "label"])
    names, cls = list("abcdefgh"), kind == "cls"
    whole = d.where("row_num % 11 != 0")            # MLlib fits no missing numbers
    model = M.fit_rf_cls(whole, "label", params) if cls else M.fit_rf_reg(whole, "y", params)
    by_joins, ev = tree_shap(d, model, names, ["row_num"], cls)
    want = {(r.row_num, r.output, r.feature): r.shap for r in by_joins.collect()}
    staged, stage = [], treeshap.stage
    monkeypatch.setattr(treeshap, "stage", lambda df, name: staged.append(name) or stage(df, name))
    monkeypatch.setattr(treeshap, "ROWS", 50)
    if kind == "deep":
        monkeypatch.setattr(treeshap, "OUTCOME_BYTES", 0)          # outcomes are worked out as they are met
    in_place, ev_in_place = tree_shap(d, model, names, ["row_num"], cls, broadcast_nodes=treeshap.BROADCAST_NODES)
    got = {(r.row_num, r.output, r.feature): r.shap for r in in_place.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert staged == ["tree-nodes"] and "Exchange" not in in_place._jdf.queryExecution().executedPlan().toString()
    a, b = ({r.output: r.expected_value for r in e.collect()} for e in (ev, ev_in_place))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9
