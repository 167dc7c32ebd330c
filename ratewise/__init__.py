"""ratewise — two-part (frequency x severity) insurance ratemaking on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from the
DataFrame/SQL API (plus MLlib for model fitting).  Sub-packages:

* ``sources``   – scans, the policy view over the driver tables, sinks
* ``functions`` – column expressions (severity, expected cost, recodes ...)
* ``operators`` – cleaning, reshaping, summaries, sampling, metrics,
                  two-part comparison, tuning analysis, explanations
* ``ml``        – MLlib model jobs, grid search, TreeSHAP
* ``plans``     – the query registry and its DuckDB oracle SQL
"""

__version__ = "0.1.0"
