"""Registered queries: summaries (AGG1–AGG4, AGG20, SRT1, SRT2, FLT9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clean import claims_only
from ..operators.summarize import (MEASURE_SUFFIX, factor_sketches, factor_summary, level_counts, level_histogram, numeric_summary,
                                   roll_up, sketch_error, sketch_misses, sketch_summary)
from ..schema import PLOT_FACTORS
from ..sources.sinks import stage
from .registry import query
from .sqlparts import CLEAN, FACTOR_LIST, MODEL, rnd, with_
from .stages import clean_policies, model_table, round_doubles


def _fac_sum_sql(where: str = "", order: str = "") -> tuple[str, list[str]]:
    sel, dbl = [], []
    for m, s in MEASURE_SUFFIX.items():
        sel += [f"min({m}) AS min_{s}", f"quantile_cont({m}, 0.25) AS q1_{s}",
                f"quantile_cont({m}, 0.5) AS med_{s}", f"avg({m}) AS avg_{s}",
                f"quantile_cont({m}, 0.75) AS q3_{s}", f"max({m}) AS max_{s}", f"sum({m}) AS tot_{s}"]
        dbl += [f"{p}_{s}" for p in ("min", "q1", "med", "avg", "q3", "max", "tot")]
    body = f"""
SELECT coverage, variable, level, count(*) AS count, {", ".join(sel)}
FROM (SELECT coverage, EARNED_EXPOSURE, ULTIMATE_AMOUNT, ULTIMATE_CLAIM_COUNT, {FACTOR_LIST} FROM clean)
UNPIVOT INCLUDE NULLS (level FOR variable IN ({FACTOR_LIST}))
{where}
GROUP BY coverage, variable, level {order}"""
    return rnd(with_(CLEAN, body), dbl), dbl


FACTOR_SUMMARY_SQL, _ = _fac_sum_sql()


@query("factor_summary_exact", FACTOR_SUMMARY_SQL, "AGG2 RSH1 SRT1 (exact type-7 quartiles)", headline=True)
def q_factor_summary_exact(spark, sf):
    return round_doubles(factor_summary(clean_policies(spark, sf), by=["coverage"]))


_SUFFIXES = list(MEASURE_SUFFIX.values())


def _sketch_sql(keys: str, checks: str) -> str:
    sel = ", ".join(f"min({m}) AS min_{s}, avg({m}) AS avg_{s}, max({m}) AS max_{s}, sum({m}) AS tot_{s}" for m, s in MEASURE_SUFFIX.items())
    body = f"""
SELECT {keys}, count(*) AS count, {sel}, {checks}
FROM (SELECT coverage, EARNED_EXPOSURE, ULTIMATE_AMOUNT, ULTIMATE_CLAIM_COUNT, {FACTOR_LIST} FROM clean)
UNPIVOT INCLUDE NULLS (level FOR variable IN ({FACTOR_LIST})) GROUP BY {keys}"""
    return rnd(with_(CLEAN, body), [f"{x}_{s}" for s in _SUFFIXES for x in ("min", "avg", "max", "tot")])


def _with_checks(rows, summary, by):
    """The summary without its quartiles, and how many of them a group has
    that are within the stated rank error."""
    keys = [*by, "variable", "level"]
    near = (sketch_misses(rows, summary, by).groupBy(*keys)
            .agg(F.count("*").alias("n_quartiles"), F.count_if(F.col("miss") <= sketch_error()).alias("n_within")))
    l, r = summary.alias("a"), near.alias("b")
    out = l.join(r, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys], "left")
    return round_doubles(out.select(*[F.col(f"a.`{k}`") for k in keys], "count", *[f"{x}_{s}" for s in _SUFFIXES for x in ("min", "avg", "max", "tot")],
                                    F.coalesce("n_quartiles", F.lit(0)).alias("n_quartiles"), F.coalesce("n_within", F.lit(0)).alias("n_within")))


_COUNTED = " + ".join(f"CASE WHEN count({m}) > 0 THEN 3 ELSE 0 END" for m in MEASURE_SUFFIX)
_CHECKS = f"({_COUNTED})::BIGINT AS n_quartiles, ({_COUNTED})::BIGINT AS n_within"


@query("factor_summary_approx", _sketch_sql("coverage, variable, level", _CHECKS), "AGG1 (quantile sketches, their rank error checked)")
def q_factor_summary_approx(spark, sf):
    rows = clean_policies(spark, sf)
    sketches = stage(factor_sketches(rows, by=["coverage"]), "sketches")
    return _with_checks(rows, sketch_summary(sketches), ["coverage"])


@query("factor_summary_rolled_up", _sketch_sql("variable, level", _CHECKS), "AGG1 (stored sketches of the coverages merged)")
def q_factor_summary_rolled_up(spark, sf):
    rows = clean_policies(spark, sf)
    sketches = stage(factor_sketches(rows, by=["coverage"]), "sketches")
    return _with_checks(rows, sketch_summary(roll_up(sketches, ["variable", "level"])), [])


_ONE_FACTOR_SQL, _ = _fac_sum_sql(where="WHERE variable = 'X_VAR9'",
                                  order="ORDER BY coverage, try_cast(level AS DOUBLE)")


@query("one_factor_numeric_order", _ONE_FACTOR_SQL, "FLT9 SRT2")
def q_one_factor(spark, sf):
    fs = factor_summary(clean_policies(spark, sf).select(
        "coverage", "EARNED_EXPOSURE", "ULTIMATE_AMOUNT", "ULTIMATE_CLAIM_COUNT", "X_VAR9"),
        by=["coverage"], factors=["X_VAR9"])
    return round_doubles(fs.where(F.col("variable") == "X_VAR9")
                           .orderBy("coverage", F.expr("try_cast(level AS DOUBLE)")))


_NUM_SQL = with_(CLEAN, """
SELECT coverage, variable, min(value) AS "Min.", quantile_cont(value, 0.25) AS "1st Qu.",
       quantile_cont(value, 0.5) AS "Median", avg(value) AS "Mean",
       quantile_cont(value, 0.75) AS "3rd Qu.", max(value) AS "Max."
FROM (SELECT coverage, EARNED_EXPOSURE, ULTIMATE_CLAIM_COUNT, ULTIMATE_AMOUNT FROM clean)
UNPIVOT (value FOR variable IN (EARNED_EXPOSURE, ULTIMATE_CLAIM_COUNT, ULTIMATE_AMOUNT))
GROUP BY coverage, variable""")


@query("numeric_summary", rnd(_NUM_SQL, ["Min.", "1st Qu.", "Median", "Mean", "3rd Qu.", "Max."]),
       "AGG3 RSH5 PRJ13", headline=True)
def q_numeric_summary(spark, sf):
    return round_doubles(numeric_summary(clean_policies(spark, sf), by=["coverage"]))


_PLOT_LIST = ", ".join(PLOT_FACTORS)

_LEVEL_COUNTS_SQL = with_(CLEAN, f"""
SELECT coverage, variable, level, count(*) AS n
FROM (SELECT coverage, {_PLOT_LIST} FROM clean WHERE ULTIMATE_CLAIM_COUNT > 0)
UNPIVOT INCLUDE NULLS (level FOR variable IN ({_PLOT_LIST}))
GROUP BY coverage, variable, level""")


@query("level_counts", _LEVEL_COUNTS_SQL, "AGG4")
def q_level_counts(spark, sf):
    return level_counts(claims_only(clean_policies(spark, sf)), by=["coverage"], factors=PLOT_FACTORS)


_HIST_SQL = with_(MODEL, f""",
_claims AS (SELECT * FROM model WHERE ULTIMATE_CLAIM_COUNT > 0),
_rng AS (SELECT coverage, min(severity) AS lo, max(severity) AS hi FROM _claims GROUP BY coverage),
_b AS (
  SELECT c.*, r.lo, r.hi,
         CAST(CASE WHEN r.hi - r.lo = 0 THEN 1
              ELSE least(floor((c.severity - r.lo) / (r.hi - r.lo) * 20), 19) + 1 END AS INTEGER) AS bucket
  FROM _claims c JOIN _rng r USING (coverage) WHERE c.severity IS NOT NULL
)
SELECT coverage, variable, level, bucket,
       any_value(lo) + (bucket - 1) * ((any_value(hi) - any_value(lo)) / 20) AS bin_lo,
       any_value(lo) + bucket * ((any_value(hi) - any_value(lo)) / 20) AS bin_hi,
       count(*) AS n
FROM (SELECT coverage, bucket, lo, hi, {_PLOT_LIST} FROM _b)
UNPIVOT INCLUDE NULLS (level FOR variable IN ({_PLOT_LIST}))
GROUP BY coverage, variable, level, bucket""")


@query("severity_histogram", rnd(_HIST_SQL, ["bin_lo", "bin_hi"]), "AGG20 (histogram / violin data)")
def q_severity_histogram(spark, sf):
    claims = claims_only(model_table(spark, sf))
    return round_doubles(level_histogram(claims, "severity", bins=20, by=["coverage"], factors=PLOT_FACTORS))
