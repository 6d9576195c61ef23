"""Expressions on patches stored as row-major arrays.

Missing pixels are NULL: ``clean`` turns NaN and the cloud-free fill into NULL at
ingest, because Spark orders NaN above every number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchscope.functions.hashing import as_column

# Fixed value: fill written where a column holds no cloud.
NO_CLOUD_FILL = 9.969e36


def clean(values, fill: float = NO_CLOUD_FILL) -> Column:
    """NaN and fill values become NULL; infinities stay."""
    return F.transform(
        as_column(values),
        lambda v: F.when(F.isnan(v) | ((v >= fill * 0.999) & (v <= fill * 1.001)), None).otherwise(v),
    )


def has_missing(values) -> Column:
    return F.exists(as_column(values), lambda v: v.isNull() | F.isnan(v))


def inside(values, mask, fill=None) -> Column:
    """Keep in-mask pixels, put ``fill`` (NULL by default) elsewhere."""
    return F.zip_with(
        as_column(values), as_column(mask), lambda v, m: F.when(m.cast("int") != 0, v).otherwise(F.lit(fill))
    )


def infinite_to_zero(values) -> Column:
    return F.transform(as_column(values), lambda v: F.when(F.abs(v) == F.lit(float("inf")), 0.0).otherwise(v))


def pixel_max(values) -> Column:
    return F.array_max(as_column(values))


def pixel_min(values) -> Column:
    return F.array_min(as_column(values))


def pixel_mean(values) -> Column:
    """Mean over present pixels, NULL when there is none."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        as_column(values),
        start,
        lambda acc, v: F.when(v.isNull(), acc).otherwise(
            F.struct((acc["s"] + v.cast("double")).alias("s"), (acc["n"] + 1).alias("n"))
        ),
        lambda acc: F.try_divide(acc["s"], acc["n"]),
    )


def exceeds(values, threshold: float, mask=None) -> Column:
    """Patch maximum strictly above the threshold.

    Over the whole patch one missing pixel makes the answer false; inside a mask
    missing pixels are skipped.
    """
    if mask is None:
        return F.coalesce(~has_missing(values) & (pixel_max(values) > threshold), F.lit(False))
    return F.coalesce(pixel_max(inside(values, mask)) > threshold, F.lit(False))


def standardise(values, mean, std) -> Column:
    mean, std = as_column(mean), as_column(std)
    return F.transform(as_column(values), lambda v: (v.cast("double") - mean) / std)


def destandardise(values, mean, std) -> Column:
    mean, std = as_column(mean), as_column(std)
    return F.transform(as_column(values), lambda v: v.cast("double") * std + mean)


def destagger(values) -> Column:
    """Mean of neighbouring levels: n staggered values give n-1."""
    v = as_column(values)
    n = F.size(v)
    return F.zip_with(F.slice(v, F.lit(1), n - 1), F.slice(v, F.lit(2), n - 1), lambda a, b: (a + b) * 0.5)


def argmax_pixel(values, width: int) -> Column:
    """Row-major first position of the maximum as ``struct<y, x>``."""
    v = as_column(values)
    position = F.array_position(v, F.array_max(v)) - 1
    return F.struct(
        F.floor(position / width).cast("int").alias("y"),
        (position % width).cast("int").alias("x"),
    )


def joint_max(a, b) -> Column:
    """Larger of the two patch maxima."""
    return F.greatest(pixel_max(a), pixel_max(b))
