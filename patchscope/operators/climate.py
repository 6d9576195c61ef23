"""Current-versus-future comparisons of patch statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchscope.operators.ranking import head_n
from patchscope.operators.relational import names

CLIMATES = ("current", "future")


def storm_counts(df: DataFrame, keys: Iterable[str], value: str | None = None, thresholds: Sequence[float] = ()) -> DataFrame:
    """Storms per key (climate, year, month), and how many exceed each threshold."""
    counts = [F.count(F.lit(1)).alias("n_storms")]
    counts += [F.count_if(F.col(value) > t).alias(f"n_over_{t:g}") for t in thresholds]
    return df.groupBy(*names(keys)).agg(*counts)


def by_month(counts: DataFrame, keys: Iterable[str] = ("climate", "month"), columns: Sequence[str] = ("n_storms",)) -> DataFrame:
    """Sum over years per calendar month."""
    return counts.groupBy(*names(keys)).agg(*[F.sum(c).alias(c) for c in columns])


def mean_where(df: DataFrame, keys: Iterable[str], value: str, gate: str, threshold: float, out: str = "mean_value") -> DataFrame:
    """Mean of ``value`` over rows whose ``gate`` exceeds the threshold; NULL for a key without any."""
    return df.groupBy(*names(keys)).agg(F.avg(F.when(F.col(gate) > threshold, F.col(value))).alias(out))


def mean_of_means(df: DataFrame, inner: Iterable[str], outer: Iterable[str], value: str, out: str = "mean_value") -> DataFrame:
    """Unweighted mean of the inner means; empty inner groups are skipped."""
    first = df.groupBy(*names(inner)).agg(F.avg(value).alias("__m"))
    return first.groupBy(*names(outer)).agg(F.avg("__m").alias(out))


def climate_delta(df: DataFrame, key: Iterable[str], value: str) -> DataFrame:
    """Columns ``current``, ``future`` and their difference per key."""
    wide = df.groupBy(*names(key)).pivot("climate", list(CLIMATES)).agg(F.sum(value))
    return wide.withColumn("delta", F.col("future") - F.col("current"))


def climate_pairs(current: DataFrame, future: DataFrame, key: Iterable[str]) -> DataFrame:
    """Full outer pairing; value columns get the suffixes ``_c`` and ``_f``."""
    key = names(key)
    suffix = lambda df, s: df.select(*key, *[F.col(c).alias(f"{c}{s}") for c in df.columns if c not in key])
    return suffix(current, "_c").join(suffix(future, "_f"), key, "full_outer")


def climate_scatter(df: DataFrame, group: str, n: dict[str, int], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First rows of each outcome group and climate, paired by position.

    ``n`` maps a group to its head size. The heads are at most the requested sizes, so the
    position within a head is a small window.
    """
    heads = None
    for name, size in n.items():
        head = head_n(df.filter(F.col(group) == name), [group, "climate"], size, order)
        heads = head if heads is None else heads.unionByName(head)
    place = F.row_number().over(Window.partitionBy(group, "climate").orderBy(*order))
    heads = heads.select(group, "climate", place.alias("position"), *columns)
    aggregates = [F.max(F.when(F.col("climate") == c, F.col(v))).alias(f"{v}_{c[0]}") for v in columns for c in CLIMATES]
    return heads.groupBy(group, "position").agg(*aggregates)


def medians(df: DataFrame, keys: Iterable[str], columns: Sequence[str]) -> DataFrame:
    """Medians of head samples (a few hundred rows per key)."""
    return df.groupBy(*names(keys)).agg(*[F.median(c).alias(f"{c}_median") for c in columns])
