"""Explanations: ML19 mSHAP (explaining a product of two models), ML20
expected-cost explanation, ML21 check, ML22 global summary, ML23 local
top-k explanation.

SHAP values are long rows (keys, row_num, [num_claims,] feature, shap).  A
feature's values of all classes become one row of fixed width, and those are
gathered into an array per row id (groups bounded by the number of features;
no exchange of inputs that lie by row id); the algebra runs on the arrays,
with one partial aggregate per class for the expectations.  Expected
values of the models are one number (list) for all rows, or small tables with
one per key group.

mSHAP for f = g·h with expectations μg, μh, contributions g_j, h_j,
G = Σg_j, H = Σh_j:  d_j = μg·h_j + μh·g_j + ½(g_j·H + h_j·G), so
Σd_j = g·h − μg·μh.  With E = mean of g·h over the explained rows,
α = μg·μh − E is spread over the features by |d_j| / Σ|d_j| (uniformly when
Σ|d_j| = 0), which gives Σ shap_j + E = g·h for every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage

#: Rows of an expectation table that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def _small_join(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(table) if few else table, on)


def _with_severity_mean(df: DataFrame, expected, keys: list[str]) -> DataFrame:
    """``_mg``: the severity model's expectation, a number or per ``keys``."""
    if not isinstance(expected, DataFrame):
        return df.withColumn("_mg", F.lit(float(expected)))
    return _small_join(df, expected.select(*keys, F.col("expected_value").alias("_mg")), keys)


def _with_class_means(df: DataFrame, expected, keys: list[str]) -> DataFrame:
    """``_mh``: the class expectation of a row's ``num_claims``, from a list
    or per ``keys`` and class."""
    if not isinstance(expected, DataFrame):
        means = F.array(*[F.lit(float(v)) for v in expected])
        return df.withColumn("_mh", F.element_at(means, F.col("num_claims") + 1))
    return _small_join(df, expected.select(*keys, "num_claims", F.col("expected_value").alias("_mh")), [*keys, "num_claims"])


def _classes(freq_expected) -> list[int]:
    """The classes of the frequency model, by its expectations."""
    if not isinstance(freq_expected, DataFrame):
        return list(range(len(freq_expected)))
    return sorted(r["num_claims"] for r in freq_expected.select("num_claims").distinct().collect())      # a row for each class


def _side_by_side(sev_shap: DataFrame, freq_shap: DataFrame, keys: list[str], freq_expected) -> tuple[DataFrame, list[int]]:
    """Long rows of both models with a column for the severity value (``_g``)
    and one for each class (``_h0``, ...), and the classes.  Of classes without
    an expectation a table leaves the rows out, a list raises."""
    classes = _classes(freq_expected)
    ids = [*keys, "row_num", "feature"]
    none, shap, known = F.lit(None).cast("double"), F.col("shap").cast("double"), F.col("num_claims").isin(classes)
    if not isinstance(freq_expected, DataFrame):
        known = F.when(known, True).otherwise(F.raise_error("a class without an expectation").cast("boolean"))
    g = sev_shap.select(*ids, shap.alias("_g"), *[none.alias(f"_h{i}") for i in range(len(classes))])
    h = freq_shap.where(known).select(*ids, none.alias("_g"), *[F.when(F.col("num_claims") == c, shap).alias(f"_h{i}") for i, c in enumerate(classes)])
    return g.unionByName(h), classes


def _sums(n: int) -> list:
    return [F.sum("_g").alias("_gsum"), F.array(*[F.sum(f"_h{i}") for i in range(n)]).alias("_hsums")]


def _gathered(long: DataFrame, keys: list[str], n: int) -> DataFrame:
    """One row per (keys, row_num): ``_x`` array of (feature, severity value,
    class values) and the sums ``_gsum``, ``_hsums``.  A feature's values meet in
    sums of fixed width first, so one row for each feature is gathered, not one
    for each value.  Inputs that lie by ``row_num`` are not exchanged."""
    values = ["_g", *[f"_h{i}" for i in range(n)]]
    each = long.groupBy(*keys, "row_num", "feature").agg(*[F.sum(v).alias(v) for v in values])
    entry = F.struct("feature", "_g", F.array(*values[1:]).alias("_h"))
    return each.groupBy(*keys, "row_num").agg(F.collect_list(entry).alias("_x"), *_sums(n))


def _per_class(rows: DataFrame, classes: list[int]) -> DataFrame:
    """A row per class that the policy has values of: ``num_claims``, its
    position ``_i`` in the arrays and the sum ``_hsum``."""
    of = F.filter(F.array(*[F.struct(F.lit(c).cast("int").alias("num_claims"), F.lit(i).alias("_i"), F.col("_hsums")[i].alias("_hsum"))
                            for i, c in enumerate(classes)]), lambda x: x["_hsum"].isNotNull())
    return rows.where(F.col("_gsum").isNotNull()).select("*", F.inline(of)).drop("_hsums")


def mshap(sev_shap: DataFrame, freq_shap: DataFrame, sev_expected, freq_expected,
          keys: list[str] | None = None, weight: str = "abs") -> tuple[DataFrame, DataFrame]:
    """ML19: returns (shap rows (keys, row_num, num_claims, feature, shap),
    expected values (keys, num_claims, expected_value)).

    ``sev_expected`` is a number or a table (keys, expected_value),
    ``freq_expected`` a list by class or a table (keys, num_claims,
    expected_value), as ``tree_shap`` gives them for each coverage."""
    keys = keys or []
    long, classes = _side_by_side(sev_shap, freq_shap, keys, freq_expected)
    rows = stage(_gathered(long, keys, len(classes)), "mshap-rows")          # once, for the expectation and for the rows
    rows = _with_class_means(_with_severity_mean(_per_class(rows, classes), sev_expected, keys), freq_expected, keys)
    mu_g, mu_h = F.col("_mg"), F.col("_mh")
    E = rows.groupBy(*keys, "num_claims").agg(F.avg((mu_g + F.col("_gsum")) * (mu_h + F.col("_hsum"))).alias("expected_value"))
    rows = _small_join(rows, E, [*keys, "num_claims"])
    of_class = lambda x: x["_h"][F.col("_i")]
    both = F.filter("_x", lambda x: x["_g"].isNotNull() & of_class(x).isNotNull())
    d = F.transform(both, lambda x: F.struct(
        x["feature"].alias("feature"),
        (mu_g * of_class(x) + mu_h * x["_g"] + F.lit(0.5) * (x["_g"] * F.col("_hsum") + of_class(x) * F.col("_gsum"))).alias("d")))
    rows = (rows.withColumn("_d", d).withColumn("_alpha", mu_g * mu_h - F.col("expected_value"))
            .withColumn("_sabs", F.aggregate("_d", F.lit(0.0), lambda acc, x: acc + F.abs(x["d"]))))
    even = F.col("_alpha") / F.size("_d")
    share = (lambda x: even) if weight != "abs" else (
        lambda x: F.when(F.col("_sabs") == 0, even).otherwise(F.col("_alpha") * F.abs(x["d"]) / F.col("_sabs")))
    out = (rows.select(*keys, "row_num", "num_claims", F.explode(F.transform("_d", lambda x: F.struct(
        x["feature"].alias("feature"), (x["d"] + share(x)).alias("shap")))).alias("_s"))
        .select(*keys, "row_num", "num_claims", "_s.feature", "_s.shap"))
    return out, E


def ev_explained(mshap_rows: DataFrame, expected: DataFrame, keys: list[str] | None = None
                 ) -> tuple[DataFrame, DataFrame]:
    """ML20: explanation of the expected cost Σ_c c·(product for class c):
    per (row, feature) Σ c·shap_c, and Σ c·E_c per key group."""
    keys = keys or []
    vals = mshap_rows.groupBy(*keys, "row_num", "feature").agg(
        F.sum(F.col("num_claims") * F.col("shap")).alias("shap"))
    ev = expected.groupBy(*keys).agg(F.sum(F.col("num_claims") * F.col("expected_value")).alias("expected_value"))
    return vals, ev


def shap_check(sev_shap: DataFrame, freq_shap: DataFrame, sev_expected, freq_expected,
               expected: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ML21: mean two-part prediction s·(p1 + 2p2 + 3p3) (predictions implied
    by the SHAP rows: expectation + Σ contributions) next to Σ c·E_c."""
    keys = keys or []
    long, classes = _side_by_side(sev_shap, freq_shap, keys, freq_expected)
    rows = _per_class(long.groupBy(*keys, "row_num").agg(*_sums(len(classes))), classes)       # sums alone: no features are gathered
    rows = _with_class_means(_with_severity_mean(rows, sev_expected, keys), freq_expected, keys)
    # the mean over rows of s * sum(c * p_c) is the sum over classes of the means, as every row has every class
    part = F.avg((F.col("_mg") + F.col("_gsum")) * F.col("num_claims") * (F.col("_mh") + F.col("_hsum")))
    pred = rows.groupBy(*keys, "num_claims").agg(part.alias("_m")).groupBy(*keys).agg(F.sum("_m").alias("mean_prediction"))
    ev = expected.groupBy(*keys).agg(
        F.sum(F.col("num_claims") * F.col("expected_value")).alias("shap_expected_value"))
    if keys:
        return pred.join(ev, keys)
    return pred.select("*", ev.select("shap_expected_value").scalar().alias("shap_expected_value"))


def shap_summary(vals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ML22: global importance per feature (mean |shap|) plus its spread."""
    keys = keys or []
    return vals.groupBy(*keys, "feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs_shap"), F.min("shap").alias("min_shap"),
        F.max("shap").alias("max_shap"), F.count(F.lit(1)).alias("n"))


def ith_rows(ids: DataFrame, positions: list[int], by: str, by_values: list, key: str = "row_num") -> DataFrame:
    """SRT5: the rows at the given 1-based positions by ``key`` of each ``by``
    value: a top-k of ids (k = the largest position), then numbers."""
    k = max(positions)
    first = reduce(DataFrame.unionByName, [ids.where(F.col(by) == v).select(by, key).distinct().orderBy(key).limit(k) for v in by_values])
    return (first.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(key)))
            .where(F.col("position").isin(positions)))


def shap_local(vals: DataFrame, k: int = 10, keys: list[str] | None = None, row_nums: list | None = None,
               digits: int = 6) -> DataFrame:
    """ML23 (+SRT5 when ``row_nums`` is given): the k features with the
    largest |shap| of each observation (ties by feature name; ranked on
    values rounded to ``digits``), the rest summed into one 'other' row."""
    keys = keys or []
    rk = [*keys, "row_num"]
    d = vals.where(F.col("row_num").isin(row_nums)) if row_nums is not None else vals
    d = d.withColumn("shap", F.round("shap", digits))
    w = Window.partitionBy(*rk).orderBy(F.desc(F.abs("shap")), "feature")
    r = d.withColumn("rank", F.row_number().over(w))
    top = r.where(F.col("rank") <= k)
    rest = (r.where(F.col("rank") > k).groupBy(*rk)
             .agg(F.sum("shap").alias("shap"))
             .select(*rk, F.lit("other").alias("feature"), "shap", F.lit(k + 1).alias("rank")))
    return top.select(*rk, "feature", "shap", "rank").unionByName(rest)
