"""DuckDB SQL fragments for the oracle check: the policy view and the
stage tables derived from it, written independently of the Spark code (same
meaning, different engine).  Used only by ``oracle_sql()``."""

from __future__ import annotations

from ..schema import FACTORS

_SPECIAL = {
    "X_VAR1": "o_orderpriority",
    "X_VAR2": "'K'",
    "X_VAR3": "o_orderstatus",
    "X_VAR4": "c_mktsegment",
    "X_VAR5": "r_name",
    "X_VAR6": "CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderkey % 5 AS VARCHAR) END",
    "X_VAR9": "CAST(o_orderkey % 12 AS VARCHAR)",
    "X_VAR19": "CAST(o_custkey AS VARCHAR)",
    "X_VAR27": "n_name",
    "X_VAR34": "CAST(o_orderkey % 1000 AS VARCHAR)",
    "X_VAR41": "CAST(year(o_orderdate) AS VARCHAR)",
    "X_VAR46": "CAST(o_custkey % 700 AS VARCHAR)",
}


def _factor_sql(f: str) -> str:
    if f in _SPECIAL:
        return f"{_SPECIAL[f]} AS {f}"
    k = int(f[5:])
    return f"CAST((o_orderkey * {k}) % {3 + k % 11} AS VARCHAR) AS {f}"


FACTOR_LIST = ", ".join(FACTORS)

POLICIES = f"""
_ret AS (
  SELECT l_orderkey, count(*) AS n_ret,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS amt_ret
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
),
_base AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority,
         coalesce(r.n_ret, 0) AS n_ret, coalesce(r.amt_ret, 0) AS amt_ret,
         c.c_mktsegment, n.n_name, g.r_name
  FROM orders o
  LEFT JOIN _ret r ON o.o_orderkey = r.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region g ON n.n_regionkey = g.r_regionkey
),
policies AS (
  SELECT o_orderkey AS policy_id,
         CASE o_orderkey % 3 WHEN 0 THEN 'bi' WHEN 1 THEN 'pd' ELSE 'coll' END AS coverage,
         (CAST((o_orderkey * 7) % 10 AS DOUBLE) - 2) / 8 AS EARNED_EXPOSURE,
         CASE WHEN n_ret = 0 THEN CAST(0 AS DOUBLE)
              WHEN o_orderkey % 97 = 0 THEN CAST(-100 AS DOUBLE)
              ELSE CAST(amt_ret - amt_ret % 1250 AS DOUBLE) / 10000 END AS ULTIMATE_AMOUNT,
         CAST(n_ret AS DOUBLE) / 2 AS ULTIMATE_CLAIM_COUNT,
         {", ".join(_factor_sql(f) for f in FACTORS)}
  FROM _base
)"""

CLEAN = POLICIES + """,
clean AS (
  SELECT * REPLACE (round_even(ULTIMATE_CLAIM_COUNT, 0) AS ULTIMATE_CLAIM_COUNT)
  FROM policies WHERE EARNED_EXPOSURE > 0
)"""

MODEL = CLEAN + """,
model AS (
  SELECT * REPLACE (CASE WHEN ULTIMATE_CLAIM_COUNT > 3 THEN CAST(3 AS DOUBLE) ELSE ULTIMATE_CLAIM_COUNT END AS ULTIMATE_CLAIM_COUNT),
         CASE WHEN ULTIMATE_CLAIM_COUNT > 0 THEN ULTIMATE_AMOUNT / ULTIMATE_CLAIM_COUNT ELSE CAST(0 AS DOUBLE) END AS severity,
         CASE WHEN ULTIMATE_CLAIM_COUNT > 0 THEN
                CASE WHEN ULTIMATE_AMOUNT / ULTIMATE_CLAIM_COUNT > 0 THEN ln(ULTIMATE_AMOUNT / ULTIMATE_CLAIM_COUNT) END
              ELSE CAST(0 AS DOUBLE) END AS log_severity
  FROM clean
)"""


def with_(cte: str, body: str) -> str:
    return f"WITH {cte}\n{body}"


def rnd(sql: str, cols: list[str], digits: int = 6, keep_star: bool = True) -> str:
    """Wrap ``sql`` rounding the named double columns."""
    repl = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) AS _q"

SPLIT = MODEL + """,
_lab AS (SELECT *, CAST(ULTIMATE_CLAIM_COUNT AS INTEGER) AS label FROM model),
_rk AS (
  SELECT *, row_number() OVER (PARTITION BY coverage, label
                               ORDER BY md5(CAST(policy_id AS VARCHAR) || '42'), policy_id) AS rk,
         count(*) OVER (PARTITION BY coverage, label) AS n
  FROM _lab
),
split AS (
  SELECT * EXCLUDE (rk, n),
         CASE WHEN rk <= ceil(n * 0.5) THEN 'train'
              WHEN rk <= ceil(n * 0.5) + ceil((n - ceil(n * 0.5)) * 0.5) THEN 'test'
              ELSE 'validate' END AS split,
         rk AS split_rank, policy_id AS row_num
  FROM _rk
)"""
