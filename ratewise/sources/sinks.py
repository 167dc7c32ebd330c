"""Sinks: SNK1 table write, SNK2/SNK3 append-only result tables, SNK6
bounded driver hand-off.  (SNK4 resume lives in ``operators.grid.pending``,
SNK5 model save in ``ml.saved``.)"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, header: bool = True) -> str:
    """SNK1: write a stage table.  Parquet between stages (column pruning and
    predicate push-down for the next stage); CSV only at the edges.  One
    directory of part files — no single-file coalesce of large tables."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", header)
    w.save(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared checkpoint folder and read back: computed
    once, whatever reads it, and re-read instead of recomputed when executors
    are lost."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"stage-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_result(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """SNK2/SNK3: append the rows of one finished model to a results or
    predictions table; anything appended before a failure stays.  ``written``
    numbers the appends of all runs in their order, so that readers take the
    last one of a model that was written twice."""
    return write_table(df.withColumn("written", F.lit(time.time_ns())), path, "parquet", "append", partition_by)


def to_driver(df: DataFrame, max_rows: int = 1_000_000):
    """SNK6: bring a *result* (summary-sized) to the driver as pandas; refuses
    anything larger than ``max_rows``."""
    n = df.count()
    if n > max_rows:
        raise ValueError(f"{n} rows is not a result-sized table (limit {max_rows})")
    return df.toPandas()
