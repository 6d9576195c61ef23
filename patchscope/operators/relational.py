"""Small relational helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchscope.session import checkpointed

GROUP = "__g"
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 32 << 20


def names(keys: str | Iterable[str] | None) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def with_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pack the keys into one never-NULL struct column.

    Plain equality on it also matches NULL keys, and windows, aggregates and joins that
    use the same column share one shuffle.
    """
    parts = [F.col(k).alias(k) for k in keys] or [F.lit(1).alias("one")]
    return df.withColumn(GROUP, F.struct(*parts))


def group_keys(keys: list[str]) -> list[Column]:
    return [F.col(f"{GROUP}.{k}").alias(k) for k in keys]


def keyed_join(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key equals a NULL key; the keys of ``left`` are kept."""
    keys = names(keys)
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def spread(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Spread a slim table evenly over all shuffle partitions before its rows multiply.

    A forecast table fits in one file split; without this, one task would unfold every
    replicate. The explicit count keeps adaptive execution from merging partitions again.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *names(keys))


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a table meant to be tiny; hint a broadcast only if its row count allows."""
    table = checkpointed(df)
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table


def hashed_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint how the side that is not multiplied joins one that is: the large side is never sorted.

    Broadcast if the planner's size (that of the files, for a stored table) allows, otherwise
    hashed partition by partition; its keys must be spread, so that its partitions are small.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= max_bytes else df.hint("shuffle_hash")
