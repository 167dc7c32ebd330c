"""Registered queries: scans, cleaning, filters, projections (SRC, FLT, PRJ,
AGG14, AGG16, RSH1)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators.clean import claims_only, distinct_rows, drop_null_rows, exposure_audit, min_severity
from ..operators.reshape import unpivot_factors
from ..schema import FACTORS, MODEL_FEATURES
from ..session import ensure_checkpoint_dir
from ..sources.policies import read_policies, read_raw
from ..sources.results import read_indexed_csv
from ..sources.sinks import write_table
from .registry import query
from .sqlparts import CLEAN, FACTOR_LIST, MODEL, POLICIES, rnd, with_
from .stages import clean_policies, model_table, policies, round_doubles

MEAS = "EARNED_EXPOSURE, ULTIMATE_AMOUNT, ULTIMATE_CLAIM_COUNT"


@query("scan_policies", with_(POLICIES, "SELECT * FROM policies"), "(policy view scan)")
def scan_policies(spark, sf):
    return policies(spark, sf)


@query("clean_policies", with_(CLEAN, "SELECT * FROM clean"), "FLT1 PRJ1 PRJ2 PRJ3")
def q_clean_policies(spark, sf):
    return clean_policies(spark, sf)


_AUDIT_SQL = with_(POLICIES, """
SELECT coverage, exposure_class, n_rows, sum_exposure, sum_amount, sum_claims,
       round(100.0 * n_rows / r.n, 6) AS pct_of_raw, round(100.0 * sum_amount / r.amount, 6) AS pct_amount,
       round(100.0 * sum_claims / r.claims, 6) AS pct_claims
FROM (
  SELECT coverage,
         CASE WHEN grouping(EARNED_EXPOSURE_CLASS) = 1 THEN 'raw' ELSE EARNED_EXPOSURE_CLASS END AS exposure_class,
         count(*) AS n_rows, sum(EARNED_EXPOSURE) AS sum_exposure,
         sum(ULTIMATE_AMOUNT) AS sum_amount, sum(ULTIMATE_CLAIM_COUNT) AS sum_claims
  FROM (SELECT *, CASE WHEN EARNED_EXPOSURE IS NULL THEN 'null' WHEN EARNED_EXPOSURE > 0 THEN 'positive'
                       WHEN EARNED_EXPOSURE = 0 THEN 'zero' ELSE 'negative' END AS EARNED_EXPOSURE_CLASS FROM policies)
  GROUP BY GROUPING SETS ((coverage), (coverage, EARNED_EXPOSURE_CLASS))
) t JOIN (SELECT coverage, count(*) AS n, sum(ULTIMATE_AMOUNT) AS amount, sum(ULTIMATE_CLAIM_COUNT) AS claims
          FROM policies GROUP BY coverage) r USING (coverage)""")


@query("exposure_audit", rnd(_AUDIT_SQL, ["sum_exposure", "sum_amount", "sum_claims", "pct_of_raw", "pct_amount", "pct_claims"]), "AGG14")
def q_exposure_audit(spark, sf):
    return round_doubles(exposure_audit(policies(spark, sf)))


_SEV_COLS = ["policy_id", "coverage", "ULTIMATE_AMOUNT", "ULTIMATE_CLAIM_COUNT", "severity", "log_severity"]


@query("claims_severity",
       rnd(with_(MODEL, f"SELECT {', '.join(_SEV_COLS)} FROM model WHERE ULTIMATE_CLAIM_COUNT > 0"),
           ["severity", "log_severity"]),
       "FLT2 PRJ4 PRJ5 PRJ6 PRJ7")
def q_claims_severity(spark, sf):
    return round_doubles(claims_only(model_table(spark, sf)).select(*_SEV_COLS))


@query("log_severity_gt1",
       rnd(with_(MODEL, "SELECT policy_id, coverage, ln(severity) AS log_response FROM model "
                        "WHERE ULTIMATE_CLAIM_COUNT > 0 AND severity > 1"), ["log_response"]),
       "FLT3 PRJ20")
def q_log_severity_gt1(spark, sf):
    df = min_severity(claims_only(model_table(spark, sf)), 1.0)
    return round_doubles(df.select("policy_id", "coverage", F.log("severity").alias("log_response")))


@query("drop_null_rows",
       rnd(with_(MODEL, f"SELECT policy_id, coverage, {MEAS}, severity, log_severity FROM model "
                        f"WHERE COLUMNS(*) IS NOT NULL"), ["severity", "log_severity"]),
       "FLT4")
def q_drop_null_rows(spark, sf):
    df = drop_null_rows(model_table(spark, sf))
    return round_doubles(df.select("policy_id", "coverage", *MEAS.split(", "), "severity", "log_severity"))


_DISTINCT_COLS = ["coverage", "ULTIMATE_CLAIM_COUNT"] + MODEL_FEATURES


@query("distinct_policies",
       with_(MODEL, f"SELECT DISTINCT {', '.join(_DISTINCT_COLS)} FROM model"),
       "AGG16 SMP4")
def q_distinct_policies(spark, sf):
    return distinct_rows(model_table(spark, sf).select(*_DISTINCT_COLS))


@query("unpivot_factors",
       with_(CLEAN, f"SELECT policy_id, coverage, variable, level FROM "
                    f"(SELECT policy_id, coverage, {FACTOR_LIST} FROM clean) "
                    f"UNPIVOT INCLUDE NULLS (level FOR variable IN ({FACTOR_LIST}))"),
       "RSH1 RSH2 UDF1 SET4")
def q_unpivot_factors(spark, sf):
    return unpivot_factors(clean_policies(spark, sf), ["policy_id", "coverage"], FACTORS)


@query("policies_table", with_(POLICIES, "SELECT * FROM policies"),
       "SRC3 SRC4 SNK1 (table written, scanned with the declared schema, queried by its name)")
def q_policies_table(spark, sf):
    base = os.path.join(ensure_checkpoint_dir(spark), f"policies-{uuid.uuid4().hex}")
    read_policies(spark, write_table(policies(spark, sf), base), name="ratewise_policies")
    return spark.sql("SELECT * FROM ratewise_policies")


@query("indexed_csv", with_(POLICIES, "SELECT policy_id, coverage, EARNED_EXPOSURE, ULTIMATE_CLAIM_COUNT FROM policies"),
       "SRC8 SNK1 (CSV with a row index, dropped on reading)")
def q_indexed_csv(spark, sf):
    base = os.path.join(ensure_checkpoint_dir(spark), f"indexed-{uuid.uuid4().hex}")
    cols = ["policy_id", "coverage", "EARNED_EXPOSURE", "ULTIMATE_CLAIM_COUNT"]
    indexed = policies(spark, sf).select(F.monotonically_increasing_id().alias("_c0"), *cols)
    write_table(indexed, base, fmt="csv")
    return read_indexed_csv(spark, base, "_c0 long, policy_id long, coverage string, EARNED_EXPOSURE double, ULTIMATE_CLAIM_COUNT double")


_RAW_COLS = ["EARNED_EXPOSURE", "ULTIMATE_AMOUNT", "ULTIMATE_CLAIM_COUNT"] + FACTORS
_FORM = {"bi": "1_bi", "pd": "2_pd", "coll": "3_coll"}


@query("raw_scan_form",
       with_(POLICIES, "SELECT CASE coverage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FORM.items())
             + f" END AS form_name, {', '.join(_RAW_COLS)} FROM policies"),
       "SRC1 SRC2 SET3 SNK1 UDF3 (raw files written per coverage, one multi-file scan)")
def q_raw_scan_form(spark, sf):
    base = os.path.join(ensure_checkpoint_dir(spark), f"raw-{uuid.uuid4().hex}")
    # one raw file set per coverage, as delivered, in one pass over the policies
    forms = F.create_map(*[F.lit(x) for k, v in _FORM.items() for x in (k, f"CAS_RAW_{v}")])
    write_table(policies(spark, sf).select(forms[F.col("coverage")].alias("form"), *_RAW_COLS), base, fmt="csv", header=False,
                partition_by=["form"])
    raw = read_raw(spark, base)
    name = F.regexp_extract("form", r"/form=([^/]+)/[^/]+$", 1)
    return raw.select(name.alias("form_name"), *_RAW_COLS)
