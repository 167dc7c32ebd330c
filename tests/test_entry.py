import glob
import os

from ratewise.sources.policies import read_raw

import __spark_entry__ as E

from conftest import SMALL_SF


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"variable", "level", "count", "q1_ultimate_amount"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_read_raw_form_provenance(spark, tmp_path):
    line = ",".join(["1.0", "2.0", "0.5"] + ["a"] * 46)
    for name in ("CAS_RAW_1_a.txt", "CAS_RAW_2_b.txt", "other.txt"):
        (tmp_path / name).write_text(line + "\n" + line + "\n")
    df = read_raw(spark, str(tmp_path))
    forms = sorted({r.form.split("/")[-1] for r in df.collect()})
    assert df.count() == 4 and forms == ["1_a.txt", "2_b.txt"]
