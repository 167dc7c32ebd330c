"""Hyper-parameter grids (JON5, D8) and resumable result tables (SNK4).

A grid is the Cartesian product of small driver-side parameter lists — a
few hundred rows at most — so it is built on the driver and shipped as a
DataFrame; it never depends on data size.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nn_num_layers, nn_total_nodes


def grid_rows(params: dict[str, list]) -> list[dict]:
    """Cartesian product; ``mod_num`` = 1-based position, the first parameter
    varying fastest.  An empty grid is one parameter-free row (baseline)."""
    if not params:
        return [{"mod_num": 1}]
    names = list(params)
    combos = itertools.product(*reversed(params.values()))
    return [{"mod_num": i, **dict(zip(names, reversed(combo)))} for i, combo in enumerate(combos, start=1)]


def _spark_type(values: list):
    v = values[0]
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.IntegerType()
    if isinstance(v, float):
        return T.DoubleType()
    if isinstance(v, (list, tuple)):
        return T.ArrayType(T.IntegerType())
    return T.StringType()


def grid_frame(spark: SparkSession, params: dict[str, list]) -> DataFrame:
    """JON5 as a DataFrame with typed columns; a ``hidden`` layer list becomes
    ``array<int>`` plus PRJ17 ``total_nodes`` / ``num_layers``."""
    fields = [T.StructField("mod_num", T.IntegerType(), False)]
    for name, values in params.items():
        typ = _spark_type(values)
        if isinstance(typ, T.DoubleType):
            values = [float(x) for x in values]
        fields.append(T.StructField(name, typ, True))
    rows = grid_rows(params)
    df = spark.createDataFrame([tuple(r[f.name] for f in fields) for r in rows], T.StructType(fields))
    if "hidden" in params:
        df = df.withColumn("total_nodes", nn_total_nodes("hidden")).withColumn("num_layers", nn_num_layers("hidden"))
    return df


def fmt_value(v) -> str:
    """Canonical text of a parameter value (long parameter tables)."""
    if isinstance(v, (list, tuple)):
        return ",".join(str(x) for x in v)
    return str(v)


def grid_long_rows(params: dict[str, list]) -> list[tuple[int, str, str]]:
    """(mod_num, param, value-as-text) rows of a grid."""
    out = []
    for r in grid_rows(params):
        for k, v in r.items():
            if k != "mod_num":
                out.append((r["mod_num"], k, fmt_value(v)))
    return out


def pending(grid: DataFrame, done: DataFrame, params: list[str] | None = None) -> DataFrame:
    """SNK4: grid rows not yet present in the results (resume without
    redoing a model): a left-anti join on the parameter columns (or
    ``mod_num`` when none are given)."""
    keys = params or ["mod_num"]
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")
