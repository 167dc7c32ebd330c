"""Result and prediction tables of model runs (SRC6–SRC8, SRC10, FLT10).

A run's tables are folders ``<root>/<coverage>_<part>_tuning/<coverage>_<algo>_
<response>_{tuning_results,predictions}``; one append per finished model.  The
folder name is the model file that comparisons carry as ``file``.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = {"sev": ("severity", "log_severity"), "freq": ("ultimate_claim_count",)}


def table_path(root: str, coverage: str, part: str, algo: str, response: str, kind: str) -> str:
    if part not in PARTS or kind not in ("tuning_results", "predictions"):
        raise ValueError(f"no such table: {part} {kind}")
    return os.path.join(root, f"{coverage}_{part}_tuning", f"{coverage}_{algo}_{response}_{kind}")


def _named(df: DataFrame) -> DataFrame:
    """``coverage``, ``file`` and ``response`` from the folder of each row."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    found: Column = F.regexp_extract(folder, r"^([^_]+)_([^_]+)_(.*)_(?:tuning_results|predictions)$", 1)
    return df.select(found.alias("coverage"), folder.alias("file"),
                     F.regexp_extract(folder, r"^([^_]+)_([^_]+)_(.*)_(?:tuning_results|predictions)$", 3).alias("response"), "*")


def _last_written(rows: DataFrame) -> DataFrame:
    """Rows of the last append of each model.  The appends of a table are as
    many as its models, so what is joined back is grid-sized."""
    last = rows.groupBy("coverage", "file", "mod_num").agg(F.max("written").alias("written"))
    return rows.join(F.broadcast(last), ["coverage", "file", "mod_num", "written"]).select(*rows.columns).drop("written")


def read_tuning_results(spark: SparkSession, root: str, part: str, coverage: str = "*") -> DataFrame:
    """SRC6: all results tables of a part below ``root``, one union by column
    name (algorithms have parameters of their own), with the model file.  Of a
    model written twice the last append counts."""
    rows = spark.read.option("mergeSchema", True).parquet(os.path.join(root, f"{coverage}_{part}_tuning", "*_tuning_results"))
    return _last_written(_named(rows))


def read_predictions(spark: SparkSession, root: str, part: str, coverage: str = "*", rows: DataFrame | None = None) -> DataFrame:
    """SRC7: all prediction tables of a part, log-severity ones included; of a
    model written twice the last append counts.  With ``rows`` (the test rows:
    coverage, row_num), FLT10: predictions of other rows are dropped."""
    p = _last_written(_named(spark.read.parquet(os.path.join(root, f"{coverage}_{part}_tuning", "*_predictions"))))
    if rows is None:
        return p
    # as many rows as the data has: never broadcast, whatever the size estimate of a well compressed table
    return p.join(rows.select("coverage", "row_num").hint("merge"), ["coverage", "row_num"], "left_semi")


def read_results(spark: SparkSession, root: str, coverage: str, part: str, algo: str, response: str) -> DataFrame | None:
    """SRC10: one named results table, None when it was not written yet."""
    try:
        return _last_written(_named(spark.read.parquet(table_path(root, coverage, part, algo, response, "tuning_results"))))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_indexed_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC8: a CSV written with its row index as a nameless first column,
    which is dropped."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.drop(df.columns[0]) if df.columns[0] in ("_c0", "", "Unnamed: 0", "...1") else df
