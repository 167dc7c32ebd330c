"""L2: a sample of registered queries equals its DuckDB oracle at sf0.001."""
import pytest

import __spark_entry__ as E
from conftest import SMALL_SF
from tools.oracle_check import duck, table_hash

SAMPLE = ["clean_policies", "exposure_audit", "factor_summary_exact", "numeric_summary", "stratified_split",
          "balance_classes", "compare_models_blocked", "regression_metrics", "time_by_family", "mshap",
          "shap_local", "ordinal_encode"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    df = E.queries()[name](spark, SMALL_SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck(SMALL_SF).execute(E.oracle_sql()[name])
    drows = res.fetchall()
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert table_hash(df.columns, rows)[0] == table_hash(dcols, drows)[0]
