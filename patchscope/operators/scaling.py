"""Fit and apply z-score statistics over all pixels of all patches."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchscope.functions import arrays as A
from patchscope.operators.relational import GROUP, names, small_side, with_group

# Features that get special care.
MASK_FEATURE = "mask"
INFINITE_FEATURES = ("uh03",)


def fit_scaler(df: DataFrame, keys: Iterable[str] | None, features: Sequence[str], infinite: Sequence[str] = INFINITE_FEATURES) -> DataFrame:
    """Mean and population deviation per feature, missing pixels skipped.

    All features share one pass over exploded pixels; partial aggregation merges
    (n, mean, M2) states, so only one row per task and key is shuffled. The mask passes
    through unscaled with zeros recorded.
    """
    keys = names(keys)
    for feature in set(infinite) & set(features):
        df = df.withColumn(feature, A.infinite_to_zero(feature))
    scaled = [f for f in features if f != MASK_FEATURE]
    missing = F.lit(None).cast("double")
    pixels = df.select(*keys, F.explode(F.arrays_zip(*scaled)).alias("__px"))
    pixels = pixels.select(*keys, *[F.nanvl(F.col(f"__px.{f}").cast("double"), missing).alias(f) for f in scaled])
    wide = pixels.groupBy(*keys).agg(
        *[F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"), F.count(f).alias("n")).alias(f) for f in scaled]
    )
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"{f}.mean"), F.col(f"{f}.std"), F.col(f"{f}.n")) for f in scaled]
    if MASK_FEATURE in features:
        zero, none = F.lit(0.0), F.lit(None).cast("bigint")
        rows.append(F.struct(F.lit(MASK_FEATURE).alias("feature"), zero.alias("mean"), zero.alias("std"), none.alias("n")))
    return wide.select(*keys, F.inline(F.array(*rows)))


def scaler_row(scaler: DataFrame, keys: Iterable[str] | None, features: Sequence[str]) -> DataFrame:
    """One row per key with ``<feature>__mean`` and ``<feature>__std`` columns."""
    wanted = scaler.filter(F.col("feature").isin(list(features)))
    aggregates = []
    for f in features:
        for stat in ("mean", "std"):
            aggregates.append(F.max(F.when(F.col("feature") == f, F.col(stat))).alias(f"{f}__{stat}"))
    return wanted.groupBy(*names(keys)).agg(*aggregates)


def scaler_of(scaler: DataFrame, feature: str) -> DataFrame:
    """Statistics of one feature for de-standardising."""
    return scaler.filter(F.col("feature") == feature)


def _apply(df, scaler, features, keys, function, infinite):
    keys = names(keys)
    scaled = [f for f in features if f != MASK_FEATURE]
    for feature in set(infinite) & set(scaled):
        df = df.withColumn(feature, A.infinite_to_zero(feature))
    if not keys:
        # one row of statistics becomes constants: nothing to join
        row = scaler_row(scaler, keys, scaled).first()
        return df.withColumns({f: function(f, F.lit(row[f"{f}__mean"]), F.lit(row[f"{f}__std"])) for f in scaled})
    left = with_group(df, keys)
    right = small_side(with_group(scaler_row(scaler, keys, scaled), keys).drop(*keys))
    expressions = {f: function(f, f"{f}__mean", f"{f}__std") for f in scaled}
    extra = [f"{f}__{s}" for f in scaled for s in ("mean", "std")]
    return left.join(right, GROUP).withColumns(expressions).drop(GROUP, *extra)


def apply_scaler(df, scaler, features: Sequence[str], keys: Iterable[str] | None = None, infinite: Sequence[str] = INFINITE_FEATURES) -> DataFrame:
    """Standardise patch arrays with statistics from any training set.

    ``keys`` match rows to statistics; leave a key out to use another climate's scaler.
    The statistics are one row per key; they are broadcast after their row count is checked.
    """
    return _apply(df, scaler, features, keys, A.standardise, infinite)


def invert_scaler(df, scaler, features: Sequence[str], keys: Iterable[str] | None = None) -> DataFrame:
    return _apply(df, scaler, features, keys, A.destandardise, ())


def standardise_split(df: DataFrame, features: Sequence[str], keys: Iterable[str] | None = None, split: str = "split") -> DataFrame:
    """Standardise train and test rows with the statistics of the train rows."""
    return apply_scaler(df, fit_scaler(df.filter(F.col(split) == "train"), keys, features), features, keys)
