"""Vector functions: quantization to bytes and products."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def peak(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))


def quantize(v: Column) -> Column:
    """Codes -127..127, rounded half away from zero; zeros for a zero vector."""
    m = peak(v)
    return F.transform(v, lambda x: F.when(m == 0, F.lit(0)).otherwise(F.round(x.cast("double") * 127 / m)).cast("int"))


def scale(v: Column) -> Column:
    return peak(v) / 127


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("bigint") * y), F.lit(0).cast("bigint"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
