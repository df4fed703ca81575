"""Order statistics and probabilities over arrays, with the reference definitions (no interpolation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def upper_median(values: Column, empty: float = 0.0) -> Column:
    """The upper median of an array: the element at floor(n / 2) in order."""
    return F.coalesce(F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int")), F.lit(float(empty)))


def floor_percentile(values: Column, fraction: float, empty: float = 0.0) -> Column:
    """The element at floor((n - 1) * fraction) in order."""
    return F.coalesce(F.get(F.sort_array(values), F.floor((F.size(values) - 1) * F.lit(float(fraction))).cast("int")), F.lit(float(empty)))


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, where a lambda would compute an expression for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_softmax(logits: Column) -> Column:
    """Log-softmax of an array. Other than finite values get minus infinity; none finite gives a flat distribution."""
    values = F.transform(logits, lambda v: v.cast("double"))

    def shifted(x: Column) -> Column:
        total = F.aggregate(x["v"], F.lit(0.0), lambda s, v: s + F.when(is_finite(v), F.exp(v - x["top"])).otherwise(F.lit(0.0)))
        scores = lambda y: F.transform(y["v"], lambda v: F.when(is_finite(v), v - y["top"] - y["log_total"]).otherwise(F.lit(float("-inf"))))
        flat = F.transform(x["v"], lambda v: -F.log(F.size(x["v"]).cast("double")))
        whole = F.struct(x["v"].alias("v"), x["top"].alias("top"), F.log(F.greatest(total, F.lit(FLOOR))).alias("log_total"))
        return F.when(x["top"].isNull(), flat).otherwise(let(whole, scores))

    return let(values, lambda v: let(F.struct(v.alias("v"), F.array_max(F.filter(v, is_finite)).alias("top")), shifted))


def probability(log_p: Column) -> Column:
    return F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), F.exp(log_p)))


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(float(otherwise)))
