import pytest

from ratewise.ml.features import FeatureSpace, fit_features
from ratewise.operators.encode import top_levels


def coded(space, rows):
    return [tuple(r["features"].toArray().tolist()) for r in space.transform(rows).select("features").collect()]


def test_ordinal_numeric_order_and_unknown(spark):
    train = spark.createDataFrame([("2", "b"), ("10", "a"), ("1", None)], "n string, t string")
    space = fit_features(train, ["n", "t"])
    assert coded(space, train) == [(1, 1), (2, 0), (0, 2)]        # numeric order, not text order; null after the last
    test = spark.createDataFrame([("10", "z"), ("3", None)], "n string, t string")
    assert coded(space, test) == [(2, 2), (3, 2)]


def test_encodings_and_reload(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0)] * 6 + [("b", 2.0)] * 3 + [("c", 3.0), (None, 4.0)], "f string, e double")
    found = {}
    for name in ("ordinal", "EnumLimited", "Eigen"):
        space = fit_features(rows, ["f"], ["e"], encoding=name, top=1)
        found[name] = coded(space, rows)
        space.save(str(tmp_path / name))
        assert coded(FeatureSpace.load(spark, str(tmp_path / name)), rows) == found[name]
        assert space.names == ["f", "e"]
    assert [x for x, _ in found["ordinal"]] == [0] * 6 + [1] * 3 + [2, 3]
    assert [x for x, _ in found["EnumLimited"]] == [0] * 6 + [1] * 5
    eigen = [x for x, _ in found["Eigen"]]
    assert eigen[-1] == 0 and abs(sum(eigen)) < 1e-9 and len(set(eigen)) == 4
    assert [e for _, e in found["Eigen"]][-1] == 4.0
    with pytest.raises(ValueError):
        fit_features(rows, ["f"], encoding="OneOfAKind")


def test_no_levels_in_the_plan(spark):
    rows = spark.createDataFrame([(f"level{i}",) for i in range(300)], "f string")
    plan = fit_features(rows, ["f"]).transform(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "level17" not in plan


def test_factor_without_levels(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b")], "n string, t string")
    assert coded(fit_features(rows, ["n", "t"]), rows) == [(1, 0), (1, 1)]


def test_top_levels_two_stage_equals_global(spark):
    rows = [(f"L{i % 37}",) for i in range(2000)] + [("HOT",)] * 500
    df = spark.createDataFrame(rows, "f string")
    got = [(r.level, r.n) for r in top_levels(df, ["f"], 5, buckets=8).orderBy("rank").collect()]
    counts = {}
    for (x,) in rows:
        counts[x] = counts.get(x, 0) + 1
    want = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    assert got == want


def test_eigen_codes_two_levels(spark):
    from ratewise.operators.encode import eigen_codes
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "f string")
    c = eigen_codes(df, ["f"])["f"]
    # two levels: the component separates them; centred projection has mean 0 over rows
    assert c["a"] * c["b"] < 0
    assert abs(3 * c["a"] + c["b"]) < 1e-9
