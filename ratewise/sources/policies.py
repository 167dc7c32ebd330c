"""Policy tables: the raw multi-file scan (SRC1/SRC2), the clean-table scan
(SRC3/SRC4/SRC5) and the deterministic policy view over the driver tables.

The policy view is the stand-in for the (unpublished) raw policy files: one
policy per order, measures and 46 factors computed with expressions that
mean the same in Spark and in the DuckDB oracle (see ``plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FACTORS, POLICY, RAW
from .tables import read_table

# Coverage codes by policy id modulo 3.
COVERAGE_BY_MOD3 = {0: "bi", 1: "pd", 2: "coll"}


def _returns_per_order(lineitem: DataFrame) -> DataFrame:
    """Returned line count and exact integer returned amount per order.

    Pre-aggregated before the join with ``orders`` (partial aggregation on the
    map side), so the join shuffles one row per order, not per line.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    pct = F.lit(100) - F.round(F.col("l_discount") * 100).cast("bigint")
    return (lineitem.where(F.col("l_returnflag") == "R")
            .groupBy("l_orderkey")
            .agg(F.count(F.lit(1)).alias("n_ret"), F.sum(cents * pct).alias("amt_ret")))


def _other_factor(k: int) -> Column:
    key = F.col("o_orderkey")
    return ((key * k) % (3 + k % 11)).cast("string")


def policy_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy per order with ``policy_id``, ``coverage``, 3 measures, 46 factors."""
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    lineitem = read_table(spark, sf_dir, "lineitem",
                          ["l_orderkey", "l_returnflag", "l_extendedprice", "l_discount"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    # nation (25 rows) and region (5 rows) are fixed-size dimension tables.
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])

    geo = (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left")
           .select("n_nationkey", "n_name", "r_name"))
    cust = (customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey, "left")
            .select("c_custkey", "c_mktsegment", "n_name", "r_name"))
    ret = _returns_per_order(lineitem)

    base = (orders.join(ret, orders.o_orderkey == ret.l_orderkey, "left")
            .join(cust, orders.o_custkey == cust.c_custkey, "left"))

    key = F.col("o_orderkey")
    n_ret = F.coalesce(F.col("n_ret"), F.lit(0))
    amt_ret = F.coalesce(F.col("amt_ret"), F.lit(0))
    coverage = F.try_element_at(F.create_map(*[F.lit(x) for kv in COVERAGE_BY_MOD3.items() for x in kv]),
                                (key % 3).cast("int"))
    amount = (F.when(n_ret == 0, F.lit(0.0))
              .when(key % 97 == 0, F.lit(-100.0))
              .otherwise((amt_ret - amt_ret % 1250).cast("double") / 10000))
    special = {
        "X_VAR1": F.col("o_orderpriority"),
        "X_VAR2": F.lit("K"),
        "X_VAR3": F.col("o_orderstatus"),
        "X_VAR4": F.col("c_mktsegment"),
        "X_VAR5": F.col("r_name"),
        "X_VAR6": F.when(key % 5 == 4, F.lit(None).cast("string")).otherwise((key % 5).cast("string")),
        "X_VAR9": (key % 12).cast("string"),
        "X_VAR19": F.col("o_custkey").cast("string"),
        "X_VAR27": F.col("n_name"),
        "X_VAR34": (key % 1000).cast("string"),
        "X_VAR41": F.year("o_orderdate").cast("string"),
        "X_VAR46": (F.col("o_custkey") % 700).cast("string"),
    }
    factors = [special.get(f, _other_factor(int(f[5:]))).alias(f) for f in FACTORS]
    return base.select(
        key.alias("policy_id"),
        coverage.alias("coverage"),
        ((((key * 7) % 10).cast("double") - 2) / 8).alias("EARNED_EXPOSURE"),
        amount.alias("ULTIMATE_AMOUNT"),
        (n_ret.cast("double") / 2).alias("ULTIMATE_CLAIM_COUNT"),
        *factors,
    )


# --------------------------------------------------------------------------
# File scans
# --------------------------------------------------------------------------

def read_raw(spark: SparkSession, path_glob: str, sep: str = ",", header: bool = False, prefix: str = "CAS_RAW_") -> DataFrame:
    """SRC1+SRC2: read every raw delimited file under ``path_glob`` whose path
    contains ``prefix`` in one scan with the declared schema (names by
    position), and add ``form``: the source path with the *first* ``prefix``
    removed.

    One multi-path read replaces the per-file loop + row-bind; the file list
    is expanded by the data source, not the driver.
    """
    df = (spark.read.schema(RAW).option("sep", sep).option("header", header)
          .option("recursiveFileLookup", True).csv(path_glob))
    path = F.col("_metadata.file_path")
    return (df.where(path.contains(prefix))
              .withColumn("form", F.regexp_replace(path, rf"^(.*?)\Q{prefix}\E", "$1")))


def read_policies(spark: SparkSession, path: str, fmt: str = "parquet", name: str | None = None,
                  sep: str = ",") -> DataFrame:
    """SRC3/SRC4: scan a clean policy table with the declared schema; optionally
    register it as a temp view (the cluster-side table name)."""
    reader = spark.read.schema(POLICY)
    if fmt == "csv":
        df = reader.option("header", True).option("sep", sep).option("nullValue", "NA").csv(path)
    else:
        df = reader.format(fmt).load(path)
    if name:
        df.createOrReplaceTempView(name)
    return df


def from_local(spark: SparkSession, rows, schema=None) -> DataFrame:
    """SRC5: copy a small driver-side table (list of rows / pandas) to the cluster."""
    return spark.createDataFrame(rows, schema=schema)
