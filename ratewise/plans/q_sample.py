"""Registered queries: splitting, balancing, sampling, encodings
(SMP1–SMP3, SET1, WIN5, JON6, ML1, ML2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.encode import eigen_codes, eigen_transform, enum_limited, ordinal_codes, top_levels, transform_join
from ..operators.reshape import unpivot_factors
from ..operators.sample import balance_classes, sample_n
from ..schema import COVERAGES, MODEL_FEATURES
from .registry import query
from .sqlparts import SPLIT, with_
from .stages import SEED, split_table

_FEATS = ", ".join(MODEL_FEATURES)


@query("stratified_split",
       with_(SPLIT, "SELECT policy_id, coverage, label, split, split_rank FROM split"),
       "SMP1 WIN5 WIN1 JON6 PRJ7", headline=True)
def q_stratified_split(spark, sf):
    return split_table(spark, sf).select("policy_id", "coverage", "label", "split", "split_rank")


@query("split_class_counts",
       with_(SPLIT, "SELECT coverage, label, split, count(*) AS n FROM split GROUP BY 1, 2, 3"),
       "SMP1 (quota check)")
def q_split_class_counts(spark, sf):
    return (split_table(spark, sf).groupBy("coverage", "label", "split")
            .agg(F.count(F.lit(1)).alias("n")))


_BALANCE_SQL = with_(SPLIT, f""",
_train AS (SELECT * FROM split WHERE split = 'train'),
_sizes AS (SELECT coverage, label, count(*) AS sz FROM _train GROUP BY 1, 2),
_targets AS (SELECT coverage, CAST(ceil(count(*) / 4) AS BIGINT) AS n_target FROM _train GROUP BY 1),
_draws AS (
  SELECT s.coverage, s.label, s.sz, unnest(range(1, t.n_target + 1)) AS d
  FROM _sizes s JOIN _targets t USING (coverage)
),
_idx AS (
  SELECT coverage, label,
         ('0x' || substr(md5(coverage || '|' || CAST(label AS VARCHAR) || '|' || CAST(d AS VARCHAR) || '|{SEED}'), 1, 15))::BIGINT % sz + 1 AS idx
  FROM _draws
)
SELECT t.policy_id, t.coverage, t.label
FROM _idx i JOIN _train t ON t.coverage = i.coverage AND t.label = i.label AND t.split_rank = i.idx""")


@query("balance_classes", _BALANCE_SQL, "SMP2 SET1 FLT5 (exact-size draws with replacement, per class)")
def q_balance_classes(spark, sf):
    train = split_table(spark, sf).where(F.col("split") == "train")
    # Balanced train as large as the unbalanced one: a quarter per class.
    targets = train.groupBy("coverage").agg(F.ceil(F.count(F.lit(1)) / 4).alias("n_target"))
    bal = balance_classes(train, "label", targets, strata=["coverage"], seed=SEED, rank_col="split_rank")
    return bal.select("policy_id", "coverage", "label")


_SAMPLE_N = 1000
_SAMPLE_SQL = with_(SPLIT, f"""
SELECT policy_id, coverage, label FROM (
  SELECT *, row_number() OVER (PARTITION BY coverage
                               ORDER BY md5(CAST(policy_id AS VARCHAR) || '{SEED}'), policy_id) AS _r
  FROM split WHERE split = 'train') WHERE _r <= {_SAMPLE_N}""")


@query("sample_n", _SAMPLE_SQL, "SMP3 (hashed top-k sample per coverage)")
def q_sample_n(spark, sf):
    train = split_table(spark, sf).where(F.col("split") == "train").select("policy_id", "coverage", "label")
    return sample_n(train, _SAMPLE_N, key="policy_id", seed=SEED, by="coverage", by_values=COVERAGES)


_ORDINAL_SQL = with_(SPLIT, f""",
_lv AS (SELECT DISTINCT variable, level FROM (SELECT {_FEATS} FROM split WHERE split = 'train')
        UNPIVOT (level FOR variable IN ({_FEATS}))),
_num AS (SELECT variable, bool_and(TRY_CAST(level AS DOUBLE) IS NOT NULL) AS isnum FROM _lv GROUP BY variable),
_codes AS (
  SELECT variable, level,
         CAST(dense_rank() OVER (PARTITION BY variable
                                 ORDER BY CASE WHEN isnum THEN TRY_CAST(level AS DOUBLE) END NULLS LAST, level) - 1
              AS INTEGER) AS code
  FROM _lv JOIN _num USING (variable)
),
_tl AS (SELECT policy_id, variable, level FROM (SELECT policy_id, {_FEATS} FROM split WHERE split = 'test')
        UNPIVOT INCLUDE NULLS (level FOR variable IN ({_FEATS})))
SELECT policy_id, variable, coalesce(code, -1) AS code FROM _tl LEFT JOIN _codes USING (variable, level)""")


@query("ordinal_encode", _ORDINAL_SQL, "ML1 (fit on train, unknown → -1)")
def q_ordinal_encode(spark, sf):
    s = split_table(spark, sf)
    codes = ordinal_codes(s.where(F.col("split") == "train"), MODEL_FEATURES)
    return transform_join(s.where(F.col("split") == "test"), codes, "policy_id", MODEL_FEATURES)


_TOPK = 5
_ENUM_SQL = with_(SPLIT, f""",
_cnt AS (SELECT variable, level, count(*) AS n FROM (SELECT {_FEATS} FROM split WHERE split = 'train')
         UNPIVOT (level FOR variable IN ({_FEATS})) GROUP BY 1, 2),
_kept AS (SELECT variable, level FROM (
            SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, level) AS r FROM _cnt)
          WHERE r <= {_TOPK}),
_tl AS (SELECT policy_id, variable, level FROM (SELECT policy_id, {_FEATS} FROM split WHERE split = 'test')
        UNPIVOT INCLUDE NULLS (level FOR variable IN ({_FEATS})))
SELECT t.policy_id, t.variable, CASE WHEN k.level IS NOT NULL THEN t.level ELSE 'other' END AS level
FROM _tl t LEFT JOIN _kept k ON t.variable = k.variable AND t.level = k.level""")


@query("enum_limited", _ENUM_SQL, "ML2 EnumLimited (top-k levels, rest lumped)")
def q_enum_limited(spark, sf):
    s = split_table(spark, sf)
    top = top_levels(s.where(F.col("split") == "train"), MODEL_FEATURES, _TOPK)
    return enum_limited(s.where(F.col("split") == "test"), top, "policy_id", MODEL_FEATURES)


_EIGEN_SQL = with_(SPLIT, f"""
SELECT policy_id, variable, true AS encoded, true AS centred, true AS component, true AS first_one, true AS sign_ok
FROM (SELECT policy_id, {_FEATS} FROM split WHERE split = 'test') UNPIVOT INCLUDE NULLS (level FOR variable IN ({_FEATS}))""")


@query("eigen_encode", _EIGEN_SQL, "ML2 Eigen (first principal component of each factor's one-hot)")
def q_eigen_encode(spark, sf):
    """Test rows encoded, next to what makes a factor's values the centred
    projections on the first component of diag(p) - p p': with the variance l
    and the offset c of the loadings v = value + c they have mean 0, solve
    p value = l v for all levels, l lies between the two largest shares, and
    the largest loading is positive."""
    s = split_table(spark, sf)
    train = s.where(F.col("split") == "train")
    codes = eigen_codes(train, MODEL_FEATURES)
    values = spark.createDataFrame([(f, lv, x) for f, m in codes.items() for lv, x in m.items()], "variable string, level string, x double")
    counts = unpivot_factors(train.select(*MODEL_FEATURES), [], MODEL_FEATURES).where("level is not null").groupBy("variable", "level").count()
    known = (counts.join(values, ["variable", "level"]).groupBy("variable").agg(F.collect_list(F.struct("count", "x")).alias("v"), F.sum("count").alias("n"))
             .withColumn("v", F.reverse(F.array_sort(F.transform("v", lambda r: F.struct((r["count"] / F.col("n")).alias("p"), r["x"].alias("x")))))))
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda acc, r: acc + f(r))
    found = (known.withColumns({"mean": total(lambda r: r["p"] * r["x"]), "l": total(lambda r: r["p"] * r["x"] * r["x"])})
             .withColumn("c", F.try_divide(F.col("v")[0]["p"] * F.col("v")[0]["x"], F.col("l")) - F.col("v")[0]["x"]))
    one = F.size("v") == 1                       # a constant factor has nothing to project
    loadings = F.transform("v", lambda r: r["x"] + F.col("c"))
    found = found.select(
        "variable", (F.abs("mean") < 1e-9).alias("centred"),
        (one | F.forall("v", lambda r: F.abs(r["p"] * r["x"] - F.col("l") * (r["x"] + F.col("c"))) < 1e-9)).alias("component"),
        (one | (F.col("l") <= F.col("v")[0]["p"] + 1e-9) & (F.col("l") >= F.get("v", F.lit(1))["p"] - 1e-9)).alias("first_one"),
        (one | (F.array_max(loadings) >= -F.array_min(loadings) - 1e-9)).alias("sign_ok"))
    out = eigen_transform(s.where(F.col("split") == "test"), codes, "policy_id")
    return out.join(found, "variable").select("policy_id", "variable", F.col("value").isNotNull().alias("encoded"),
                                              "centred", "component", "first_one", "sign_ok")
