import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratewise.operators.quantiles import type7_quantile
from ratewise.operators.reshape import unpivot_factors, unpivot_probs
from ratewise.operators.summarize import (factor_sketches, factor_summary, gaussian_kde, level_counts, level_histogram, roll_up,
                                          sketch_error, sketch_misses, sketch_summary)


def _df(spark):
    pdf = pd.DataFrame({
        "EARNED_EXPOSURE": [1.0, 2.0, 3.0, 4.0, 0.5],
        "ULTIMATE_AMOUNT": [0.0, 10.0, 0.0, 30.0, 5.0],
        "ULTIMATE_CLAIM_COUNT": [0.0, 1.0, 0.0, 2.0, 1.0],
        "A": ["x", "x", "y", None, "y"],
        "B": ["2", "10", "2", "2", "10"],
    })
    return spark.createDataFrame(pdf), pdf


def test_unpivot_keeps_nulls(spark):
    df, pdf = _df(spark)
    long = unpivot_factors(df, ["EARNED_EXPOSURE"], ["A", "B"])
    assert long.count() == len(pdf) * 2
    assert long.where("level IS NULL").count() == 1


def test_factor_summary_exact_matches_pandas(spark):
    df, pdf = _df(spark)
    out = {(r.variable, r.level): r for r in factor_summary(df, factors=["A", "B"]).collect()}
    for f in ["A", "B"]:
        for lvl, g in pdf.groupby(f, dropna=False):
            key = (f, None if pd.isna(lvl) else lvl)
            r = out[key]
            assert r["count"] == len(g)
            for m, s in [("EARNED_EXPOSURE", "earned_exposure"), ("ULTIMATE_AMOUNT", "ultimate_amount")]:
                assert r[f"min_{s}"] == g[m].min() and r[f"max_{s}"] == g[m].max()
                assert abs(r[f"avg_{s}"] - g[m].mean()) < 1e-12 and abs(r[f"tot_{s}"] - g[m].sum()) < 1e-12
                for q, p in (("q1", .25), ("med", .5), ("q3", .75)):
                    assert abs(r[f"{q}_{s}"] - g[m].quantile(p)) < 1e-12


def test_factor_summary_paths_agree(spark):
    df, _ = _df(spark)
    key = lambda t: tuple("" if x is None else str(x) for x in t[:2])
    fast = sorted((tuple(r) for r in factor_summary(df, factors=["A", "B"]).collect()), key=key)
    for size in (1, 2):     # values over several buckets
        slow = sorted((tuple(r) for r in factor_summary(df, factors=["A", "B"], per_bucket=size).collect()), key=key)
        assert len(fast) == len(slow)
        for a, b in zip(fast, slow):
            assert a[:3] == b[:3]
            assert all(abs(x - y) < 1e-9 for x, y in zip(a[3:], b[3:]))


def test_sketches_of_small_groups_are_exact_and_roll_up(spark):
    df, pdf = _df(spark)
    rows = sketch_summary(factor_sketches(df, factors=["B"])).collect()
    assert {r.level for r in rows} == {"2", "10"}
    for r in rows:
        g = pdf[pdf.B == r.level]
        assert r["count"] == len(g) and r.q1_earned_exposure in set(g.EARNED_EXPOSURE)
        assert abs(r.avg_ultimate_amount - g.ULTIMATE_AMOUNT.mean()) < 1e-12 and r.max_ultimate_amount == g.ULTIMATE_AMOUNT.max()


def test_sketch_rank_error_and_roll_up(spark):
    rng = random.Random(4)
    rows = [("day%d" % (i % 5), "all", "g%d" % (i % 3), rng.lognormvariate(0, 3) if i % 50 else None, float(rng.randint(0, 3)), 1.0) for i in range(30_000)]
    df = spark.createDataFrame(rows, "day string, A string, B string, EARNED_EXPOSURE double, ULTIMATE_CLAIM_COUNT double, ULTIMATE_AMOUNT double")
    stored = factor_sketches(df, by=["day"], factors=["A", "B"], k=200)
    assert stored.agg(F.max(F.length("sketch_earned_exposure"))).first()[0] < 10_000        # bounded, whatever the group
    daily = sketch_misses(df, sketch_summary(stored), by=["day"], factors=["A", "B"])
    whole = sketch_misses(df, sketch_summary(roll_up(stored, ["variable", "level"])), factors=["A", "B"])
    for found, n in ((daily, 5 * 4 * 9), (whole, 4 * 9)):
        r = found.agg(F.count("*"), F.max("miss")).first()
        assert r[0] == n and 0 < r[1] <= sketch_error(200)
    nothing = spark.createDataFrame([("a", None, 1.0, 1.0)], "A string, EARNED_EXPOSURE double, ULTIMATE_CLAIM_COUNT double, ULTIMATE_AMOUNT double")
    r = sketch_summary(factor_sketches(nothing, factors=["A"])).first()
    assert r["count"] == 1 and r.med_earned_exposure is None and r.med_ultimate_amount == 1.0


def test_rows_are_read_once(spark, tmp_path):
    df, _ = _df(spark)
    df.write.parquet(str(tmp_path / "rows"))
    plan = factor_summary(spark.read.parquet(str(tmp_path / "rows")), factors=["A", "B"])._jdf.queryExecution().optimizedPlan().toString()
    assert "EARNED_EXPOSURE" not in plan           # what is left reads the stored value frequencies


def test_level_counts_and_histogram(spark):
    df, _ = _df(spark)
    counts = {(r.variable, r.level): r.n for r in level_counts(df, factors=["B"]).collect()}
    assert counts == {("B", "2"): 3, ("B", "10"): 2}
    h = level_histogram(df, "ULTIMATE_AMOUNT", bins=3, factors=["B"]).collect()
    assert sum(r.n for r in h) == 5
    assert max(r.bucket for r in h) == 3          # the maximum lands in the last bucket


def test_kde_integrates_to_about_one(spark):
    df = spark.createDataFrame([(float(x),) for x in range(100)], "v double")
    pts = sorted(gaussian_kde(df, "v", grid_points=200).collect(), key=lambda r: r.x)
    step = pts[1].x - pts[0].x
    area = sum(r.density for r in pts) * step
    assert 0.85 < area < 1.01


def test_unpivot_probs(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 0.3, 0.4)], "row_num long, p0 double, p1 double, p2 double, p3 double")
    out = {r.num_claims: r.prediction for r in unpivot_probs(df, ["row_num"]).collect()}
    assert out == {0: 0.1, 1: 0.2, 2: 0.3, 3: 0.4}


def test_rank_check_exchanges_counts_not_values(spark, monkeypatch):
    from ratewise.operators import summarize
    df, _ = _df(spark)
    summary = sketch_summary(factor_sketches(df, factors=["A", "B"]))
    found = [sorted(map(str, sketch_misses(df, summary, factors=["A", "B"]).collect()))]
    plan = sketch_misses(df, summary, factors=["A", "B"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(summarize, "BROADCAST_LEVELS", 2)           # A has three levels, NULL being one
    found.append(sorted(map(str, sketch_misses(df, summary, factors=["A", "B"]).collect())))
    assert found[0] == found[1] and len(found[0]) == 5 * 3 * 3


@pytest.mark.parametrize("least,broadcast_cells", [(2, 100_000), (2, 0), (64, 100_000)])
def test_cells_give_exact_statistics_of_every_level(spark, monkeypatch, least, broadcast_cells):
    """Few points, so that ranks fall inside cells; many tasks and chunks, rare
    and frequent levels, NULL levels, NULL, missing and repeated values."""
    from ratewise.operators import factor_cells
    monkeypatch.setattr(factor_cells, "DENSE", 500)
    rng = random.Random(3)
    rows = [(rng.choice(["bi", "pd", None]), rng.choice(["x", "y", None, "x"]), str(rng.randrange(200)),
             rng.choice([None, 0.0, 0.0, 7.5, rng.random() * 100, -rng.random()]), float(rng.randrange(4)), None) for _ in range(3000)]
    names = ["cov", "A", "B", "m0", "m1", "m2"]
    df = spark.createDataFrame(rows, "cov string, A string, B string, m0 double, m1 double, m2 double").repartition(5)
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75}
    out = factor_cells.factor_statistics(df, ["cov"], ["A", "B"], ["m0", "m1", "m2"], probs, 1_000, least, broadcast_cells)
    got = {(r.cov, r._vi, r.level, r._mi): r for r in out.collect()}
    want = {}
    for row in rows:
        for vi in (0, 1):
            for mi in (0, 1, 2):
                want.setdefault((row[0], vi, row[1 + vi], mi), []).append(row[3 + mi])
    assert got.keys() == want.keys()
    for k, values in want.items():
        r, xs = got[k], [x for x in values if x is not None]
        assert (r._rows, r._n) == (len(values), len(xs))
        if not xs:
            assert (r._min, r._max, r._tot, r.q1, r.med, r.q3) == (None,) * 6
            continue
        assert (r._min, r._max) == (min(xs), max(xs)) and abs(r._tot - sum(xs)) < 1e-9
        for q, p in probs.items():
            assert abs(r[q] - type7_quantile(xs, p)) < 1e-9


def test_factor_summary_exchanges_cells_not_rows(spark):
    """Rows, factors and measures were multiplied before anything was counted:
    what is exchanged is bounded by levels and cells now."""
    from ratewise.operators import factor_cells
    written, stage = {}, factor_cells.stage
    df = spark.range(0, 60_000, 1, 2).select(*[(F.col("id") * k % 50_021).cast("double").alias(m) for k, m in ((3, "m0"), (7, "m1"))],
                                             *[(F.col("id") % k).cast("string").alias(f"F{k}") for k in (2, 3, 5)])
    try:
        factor_cells.stage = lambda d, name: written.setdefault(name, stage(d, name))
        out = factor_cells.factor_statistics(df, [], ["F2", "F3", "F5"], ["m0", "m1"], {"med": 0.5}, 1_000_000)
        assert out.count() == 2 * (2 + 3 + 5)
    finally:
        factor_cells.stage = stage
    assert written["factor-cells"].count() <= 10 * 2 * (2 * 129 + 2) and written["cell-values"].count() < 0.05 * 60_000 * 6


def test_cells_of_several_chunks_add_up(monkeypatch):
    """Codes are given anew in each chunk of a task."""
    import pyarrow as pa
    from ratewise.operators import factor_cells
    rng = random.Random(8)
    rows = [(rng.choice(["bi", "pd", None]), rng.choice([None, rng.random()]), rng.choice(["x", None]), str(rng.randrange(90))) for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.string(), pa.string()))],
                                       names=["cov", "m", "A", "B"])
    batches = [batch.slice(a, 60) for a in range(0, 700, 60)]
    wanted = {(i, 0): {(("bi",), level): [2, 4] for level in ("x", None, "7", "8")} for i in (0, 1)}

    def added(made, n):
        total = {}
        for b in made:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                total[r[:n]] = total.get(r[:n], 0) + r[5 if n == 5 else 6]
        return total

    found = []
    for size in (100, 10_000):
        monkeypatch.setattr(factor_cells, "CHUNK", size)
        found.append((added(factor_cells.count_cells(1, 2, [[0.2, 0.5, 0.8]])(iter(batches)), 5),
                      added(factor_cells.values_of_cells(1, 2, [[0.2, 0.5, 0.8]], wanted)(iter(batches)), 6)))
    assert found[0] == found[1] and sum(found[0][0].values()) == 1400
    inside = [r for r in rows if r[0] == "bi" and r[1] is not None and 0.2 < r[1] < 0.8]
    assert sum(found[0][1].values()) == len([r for r in inside]) + len([r for r in inside if r[3] in ("7", "8")])
