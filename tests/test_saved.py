"""Best models: dispatch on the winning file, refit, save, reload, score."""
import os
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SMALL_SF
from ratewise.ml import models as M
from ratewise.ml.saved import Winner, load_fitted, refit, save_best_pair, typed, winner
from ratewise.plans.stages import split_table
from ratewise.session import ensure_checkpoint_dir
from ratewise.sources.results import read_predictions, read_results, read_tuning_results, table_path
from ratewise.sources.sinks import append_result


@pytest.fixture(scope="module")
def split(spark):
    s = split_table(spark, SMALL_SF).where("coverage = 'coll'")
    return s.where("split = 'train'"), s.where("split = 'validate'"), s.where("split = 'test'")


@pytest.fixture
def root(spark):
    return os.path.join(ensure_checkpoint_dir(spark), f"saved-{uuid.uuid4().hex}")


def write_results(spark, root, part, algo, response, **params):
    names = list(params)
    row = spark.createDataFrame([(1, *map(str, params.values()), 0.5)], ", ".join(["mod_num int", *[f"`{n}` string" for n in names], "mse double"]))
    append_result(row, table_path(root, "coll", part, algo, response, "tuning_results"))
    return f"coll_{algo}_{response}_predictions"


@pytest.mark.parametrize("sev,freq,classes", [
    (("gb", "severity", {"distribution": "huber", "ntrees": 2, "max_depth": 2}), ("gb", {"distribution": "multinomial", "ntrees": 1, "max_depth": 2}),
     (M.BoostedModel, M.BoostedModel)),
    (("rf", "log_severity", {"ntrees": 2, "max_depth": 2, "mtries": 7}), ("rf", {"ntrees": 2, "max_depth": 2, "categorical_encoding": "EnumLimited"}),
     ("RandomForestRegressionModel", "RandomForestClassificationModel")),
    (("baseline", "severity", {}), ("baseline", {}), ("LinearRegressionModel", "LogisticRegressionModel")),
])
def test_any_family_can_win(spark, split, root, sev, freq, classes):
    train, valid, test = split
    best = {"sev_mod_file": write_results(spark, root, "sev", sev[0], sev[1], **sev[2]), "sev_mod_num": 1,
            "freq_mod_file": write_results(spark, root, "freq", freq[0], "ultimate_claim_count", **freq[1]), "freq_mod_num": 1}
    paths = save_best_pair(spark, root, best, {"sev": train, "freq": train}, valid)
    n = test.count()
    for part, kind in zip(("sev", "freq"), classes):
        fitted = load_fitted(spark, paths[part])
        assert type(fitted.model).__name__ == (kind if isinstance(kind, str) else kind.__name__)
        out = fitted.predict(test)
        assert out.where(F.col("predict").isNotNull() & ~F.isnan(F.col("predict").cast("double"))).count() == n
        if part == "sev" and sev[1] == "log_severity":
            assert out.agg(F.min("predict")).first()[0] >= 1.0            # back-transformed
        if part == "freq":
            assert out.agg(F.max(F.abs(F.col("p0") + F.col("p1") + F.col("p2") + F.col("p3") - 1))).first()[0] < 1e-9
    assert fitted.origin == winner(spark, root, "freq", best["freq_mod_file"], 1)


def test_three_encodings_give_three_models(spark, split):
    train, _, test = split
    found = set()
    for name in ("ordinal", "EnumLimited", "Eigen"):
        fitted = refit(Winner("coll", "sev", "rf", "severity", 1, {"ntrees": 1, "max_depth": 4, "mtries": 42, "categorical_encoding": name}), train)
        found.add(tuple(r[0] for r in fitted.predict(test).orderBy("row_num").select("predict").collect()))
    assert len(found) == 3


def test_unknown_winner(spark, root):
    with pytest.raises(ValueError):
        winner(spark, root, "sev", "nonsense", 1)
    file = write_results(spark, root, "sev", "gb", "severity", ntrees=5)
    with pytest.raises(ValueError):
        winner(spark, root, "sev", file, 7)
    assert read_results(spark, root, "coll", "sev", "rf", "severity") is None
    assert read_results(spark, root, "coll", "sev", "gb", "severity").first()["ntrees"] == "5"


def test_last_write_of_a_model_counts(spark, root):
    for value in (1.0, 2.0):
        append_result(spark.createDataFrame([(1, r, value) for r in range(4)], "mod_num int, row_num long, predict double"),
                      table_path(root, "coll", "sev", "gb", "severity", "predictions"))
        write_results(spark, root, "sev", "gb", "severity", ntrees=int(value))
    append_result(spark.createDataFrame([(2, 0, 9.0)], "mod_num int, row_num long, predict double"),
                  table_path(root, "coll", "sev", "gb", "severity", "predictions"))
    rows = spark.createDataFrame([("coll", r) for r in range(3)], "coverage string, row_num long")
    got = {(r.mod_num, r.row_num): r.predict for r in read_predictions(spark, root, "sev", rows=rows).collect()}
    assert got == {(1, 0): 2.0, (1, 1): 2.0, (1, 2): 2.0, (2, 0): 9.0}
    assert [r.ntrees for r in read_tuning_results(spark, root, "sev").collect()] == ["2"]


def test_typed_parameters():
    assert [typed(x) for x in ("3", "0.01", "True", "100,100", "[200, 200]", "huber", None)] == [3, 0.01, True, [100, 100], [200, 200], "huber", None]


@pytest.mark.parametrize("part,algo,response", [("sev", "gb", "severity"), ("freq", "rf", "ultimate_claim_count")])
def test_a_refit_has_all_parameters_of_the_tuned_model(spark, split, root, part, algo, response):
    """What the results table does not hold would get the family's default: a
    frequency forest tuned at depth 4 was refitted at depth 20."""
    from ratewise.ml.features import fit_features
    from ratewise.ml.saved import training_rows
    from ratewise.ml.tune import run_grid
    from ratewise.operators.grid import grid_rows
    from ratewise.plans.q_models import _CHAIN_GRIDS
    train, valid, test = split
    kind, label, tuned = ("severity", "y", []) if part == "sev" else ("frequency", "label", [])
    rows, fs = training_rows(train, part, response), fit_features(train, numeric=["EARNED_EXPOSURE"] if part == "freq" else [])

    def fit(d, p):
        tuned.append(M.fit_gbt_reg(d, "y", p) if part == "sev" else M.fit_rf_cls(d, "label", p))
        return tuned[-1]

    made = fs.transform(rows)
    run_grid(spark, grid_rows(_CHAIN_GRIDS[part])[:1], fit, made, made, None, kind, label,
             table_path(root, "coll", part, algo, response, "tuning_results"))
    again = refit(winner(spark, root, part, f"coll_{algo}_{response}_predictions", 1), train).model
    names = ["maxDepth", "maxBins", "minInfoGain", "subsamplingRate", "seed"] + (["stepSize", "maxIter", "lossType"] if part == "sev" else [])
    assert [again.getOrDefault(n) for n in names] == [tuned[0].getOrDefault(n) for n in names]
    assert again.getNumTrees == tuned[0].getNumTrees and again.totalNumNodes == tuned[0].totalNumNodes


def test_both_models_of_the_best_pair_are_refitted(spark, monkeypatch):
    """The frequency model alone was chosen (by its own loss, of no pair) and
    refitted, on validation rows too."""
    from ratewise.ml import saved
    from ratewise.plans import q_models
    monkeypatch.setattr(q_models, "COVERAGES", ["coll"])
    chosen, fitted, best_pair, fit_again = [], [], q_models.best_pair, saved.refit
    monkeypatch.setattr(q_models, "best_pair", lambda pairs, metric, **k: chosen.append((metric, pairs.count())) or best_pair(pairs, metric, **k))

    def spy(best, train, valid=None):
        fitted.append((best, {r[0] for r in train.select("split").distinct().collect()}, valid is not None))
        return fit_again(best, train, valid)

    monkeypatch.setattr(saved, "refit", spy)
    out = q_models.q_refit_best(spark, SMALL_SF)
    assert chosen == [("mse", 4)]
    assert [(w.part, rows, held) for w, rows, held in fitted] == [("sev", {"train"}, True), ("freq", {"train"}, True)]
    assert [w.params["max_depth"] in (3, 6) and w.params["ntrees"] == 10 and w.params["categorical_encoding"] == "EnumLimited" for w, _, _ in fitted] == [True, True]
    n = split_table(spark, SMALL_SF).where("coverage = 'coll' and split = 'test'").count()
    assert out.where("predicted and sev_predicted and p_sum = 1.0").count() == out.count() == n
