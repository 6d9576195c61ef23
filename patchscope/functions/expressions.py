"""Scalar expressions: units, wind shear, skill scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchscope.functions.hashing import as_column


def to_hectopascal(pressure) -> Column:
    return as_column(pressure) * 0.01


def to_grams(mixing_ratio) -> Column:
    return as_column(mixing_ratio) * 1000


def clip_negative(value) -> Column:
    return F.when(as_column(value) < 0, F.lit(0.0)).otherwise(as_column(value))


def wind_shear(u_low, v_low, u_high, v_high) -> Column:
    du = as_column(u_high) - as_column(u_low)
    dv = as_column(v_high) - as_column(v_low)
    return F.sqrt(du * du + dv * dv)


def ratio(numerator, denominator) -> Column:
    """NULL on a zero denominator."""
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double"))


def ratio_or_zero(numerator, denominator) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def csi_from(success_ratio, pod) -> Column:
    sr, pod = as_column(success_ratio), as_column(pod)
    return F.try_divide(F.lit(1.0), F.try_divide(F.lit(1.0), sr) + F.try_divide(F.lit(1.0), pod) - 1)


def bias_from(success_ratio, pod) -> Column:
    return ratio(pod, success_ratio)


def no_skill(forecast, climatology) -> Column:
    return as_column(forecast) * 0.5 + as_column(climatology) * 0.5
