"""Column expressions (PRJ*): all built-in, JVM-side, codegen-friendly.

Each helper returns a ``Column``; NULL in → NULL out unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(x, digits: int = 0) -> Column:
    """PRJ1: R's ``round`` is half-to-even; Spark's ``round`` is half-up."""
    return F.bround(_c(x), digits)


def severity(amount="ULTIMATE_AMOUNT", count="ULTIMATE_CLAIM_COUNT") -> Column:
    """PRJ4: amount / count when count > 0, else 0; NULL count → NULL."""
    a, n = _c(amount), _c(count)
    return F.when(n.isNull(), F.lit(None).cast("double")).when(n > 0, a / n).otherwise(F.lit(0.0))


def log_severity(sev="severity", count="ULTIMATE_CLAIM_COUNT") -> Column:
    """PRJ5: ln(severity) when count > 0, else 0; ln of a non-positive severity
    is NULL (R would give NaN / -Inf)."""
    s, n = _c(sev), _c(count)
    return (F.when(n.isNull(), F.lit(None).cast("double"))
            .when(n > 0, F.when(s > 0, F.log(s)).otherwise(F.lit(None).cast("double")))
            .otherwise(F.lit(0.0)))


def cap(x, upper: float) -> Column:
    """PRJ6: min(x, upper), NULL-preserving."""
    c = _c(x)
    return F.when(c.isNull(), c).otherwise(F.least(c, F.lit(upper).cast("double")))


def back_transform(pred="predict", is_log="is_log") -> Column:
    """PRJ8: exp() the predictions of log-severity models."""
    return F.when(_c(is_log), F.exp(_c(pred))).otherwise(_c(pred))


def residual(response, prediction) -> Column:
    """PRJ9."""
    return _c(response) - _c(prediction)


def claim_weight(p1="p1", p2="p2", p3="p3") -> Column:
    """Expected claim count of one frequency prediction: p1 + 2 p2 + 3 p3."""
    return _c(p1) + 2 * _c(p2) + 3 * _c(p3)


def expected_amount(sev="predict", p1="p1", p2="p2", p3="p3") -> Column:
    """PRJ10: s·p1 + 2s·p2 + 3s·p3 (amount for 1, 2 and 3 claims weighted)."""
    s = _c(sev)
    return s * _c(p1) + (2 * s) * _c(p2) + (3 * s) * _c(p3)


def model_type(text) -> Column:
    """PRJ14: model family from a file name; first match wins, else 'lm'."""
    t = _c(text)
    return (F.when(t.contains("nn"), F.lit("nn"))
            .when(t.contains("rf"), F.lit("rf"))
            .when(t.contains("gb"), F.lit("gb"))
            .otherwise(F.lit("lm")))


def results_path(pred_path, folder: str | None = None) -> Column:
    """PRJ15: prediction-file path → tuning-results path (first match only);
    with ``folder`` also ``output`` → ``output/<folder>``, e.g. bi_freq_tuning."""
    p = F.regexp_replace(_c(pred_path), r"^(.*?)predictions", "$1tuning_results")
    return F.regexp_replace(p, r"^(.*?)output", f"$1output/{folder}") if folder else p


def recode(x, mapping: dict, default=None) -> Column:
    """PRJ16: value recoding with a literal map; unmapped → ``default``
    (or the value itself when default is None)."""
    c = _c(x)
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(m[c], F.lit(default) if default is not None else c.cast("string"))


def nn_total_nodes(hidden="hidden") -> Column:
    """PRJ17: total hidden units of a layer list."""
    return F.aggregate(_c(hidden), F.lit(0), lambda acc, x: acc + x)


def nn_num_layers(hidden="hidden") -> Column:
    """PRJ17: number of hidden layers."""
    return F.size(_c(hidden))


def hours_label(seconds, suffix: str = " hrs") -> Column:
    """PRJ21: seconds → hours rounded to 2 decimals with a unit suffix."""
    return F.concat(F.bround(_c(seconds) / 3600.0, 2).cast("string"), F.lit(suffix))


def hash_key(key, seed) -> Column:
    """Order-free deterministic ordering key: md5(key || seed) (hex text).
    The same text is produced by DuckDB's ``md5``."""
    return F.md5(F.concat(_c(key).cast("string"), F.lit(str(seed))))


def hash_int(text: Column, digits: int = 15) -> Column:
    """Leading ``digits`` hex digits of md5(text) as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")
