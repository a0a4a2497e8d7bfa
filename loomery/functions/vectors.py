"""Vector expressions over array columns: distances, similarities and 8-bit quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _zero(), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), _zero(), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, _zero(), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def quantise(a: Column) -> Column:
    """Elements of -1 to 1 as -127 to 127."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") * 127))).cast("tinyint"))


def dequantise(q: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") / 127.0)


def errors(a: Column, b: Column) -> Column:
    """(greatest, mean, root mean square) of the elements' differences."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    n = F.size(a)
    return F.struct(
        F.array_max(gaps).alias("max_error"),
        (F.aggregate(gaps, _zero(), lambda s, x: s + x) / n).alias("mean_error"),
        F.sqrt(F.aggregate(gaps, _zero(), lambda s, x: s + x * x) / n).alias("rmse"),
    )
