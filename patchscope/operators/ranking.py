"""Exact global ranks without a global window.

``row_number`` over a whole table, or over a class that holds a third of it, runs in
one task. Here the order is a hash, so its leading digits cut the rows into even
buckets: rank = rows in lower buckets + rank inside the bucket. Bucket sizes are a
small aggregate with at most 16**digits rows per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchscope.functions.hashing import draw_token
from patchscope.operators.relational import GROUP, names, with_group

BUCKET_DIGITS = 3


def seeded_rank(
    df: DataFrame,
    ids: str | Iterable[str],
    seed,
    by: str | Iterable[str] | None = None,
    out: str = "rank",
    size_out: str | None = None,
    extend_sizes: Callable[[DataFrame], DataFrame] | None = None,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """1-based rank of each row in the random order that ``seed`` gives its group.

    ``ids`` name the row uniquely inside its group. ``seed`` may be a column.
    ``size_out`` adds the group size. ``extend_sizes`` may add columns to the small table
    of bucket sizes (``__g`` struct of the keys, hex ``__bucket``, ``__n``); every row gets them.
    """
    ids, by = names(ids), names(by)
    staged = with_group(df, by).withColumn("__token", draw_token(seed, *ids))
    staged = staged.withColumn("__bucket", F.substring("__token", 1, digits))
    # half the bytes, in the same order
    staged = staged.withColumn("__token", F.unhex("__token"))
    # a number in front of the true keys decides nearly all comparisons of the sort
    staged = staged.withColumn("__cell", F.xxhash64(GROUP, "__bucket"))
    cell = ["__cell", GROUP, "__bucket"]

    sizes = staged.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(GROUP)
    below = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(below), F.lit(0)))
    if size_out:
        sizes = sizes.withColumn(size_out, F.sum("__n").over(whole))
    if extend_sizes:
        sizes = extend_sizes(sizes)

    inside = Window.partitionBy(*cell).orderBy("__token", *ids)
    ranked = staged.withColumn("__local", F.row_number().over(inside)).join(sizes, cell)
    ranked = ranked.withColumn(out, (F.col("__local") + F.col("__offset")).cast("bigint"))
    return ranked.drop(GROUP, "__cell", "__token", "__bucket", "__n", "__offset", "__local")


def head_n(df: DataFrame, keys: str | Iterable[str], n: int, order: Iterable) -> DataFrame:
    """First ``n`` rows of each key; Spark prunes to n per task before the shuffle."""
    w = Window.partitionBy(*names(keys)).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def nth(df: DataFrame, keys: str | Iterable[str], position: int, order: Iterable) -> DataFrame:
    """Row at 0-based ``position`` of each key."""
    w = Window.partitionBy(*names(keys)).orderBy(*order)
    ranked = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= position + 1)
    return ranked.filter(F.col("__rn") == position + 1).drop("__rn")
