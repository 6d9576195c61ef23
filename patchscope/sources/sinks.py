"""Sinks. Keys become partition folders instead of file names."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchscope.operators.ranking import seeded_rank
from patchscope.session import shared_folder


def write_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet partitioned by keys. Only the partitions present in ``df`` are replaced, so a shard can be rerun.

    Rows are rebalanced by the keys first: small folders get one file, adaptive execution splits large ones.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: Sequence[str], path: str | None = None) -> None:
    """Table bucketed and sorted on join keys: gather joins on them need no shuffle.

    Rows are spread by the same hash first, so a bucket is one sorted file. ``path`` puts the
    files there instead of the warehouse. Bucket count, key order and key types must agree
    between tables that are joined.
    """
    spread = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    writer = spread.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def bucketed(df: DataFrame, buckets: int, keys: Sequence[str]) -> DataFrame:
    """The same rows as a bucketed table in the shared folder, under a name of its own."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    write_bucketed(df, name, buckets, keys, f"{shared_folder(spark)}/{name}")
    return spark.table(name)


def morton(columns: Sequence[Column | str], bits: int = 20) -> Column:
    """Position on the Z curve: the low ``bits`` bits of non-negative integer columns, interleaved (63 bits in all at most).

    The first column gives the lowest bit of each group. NULL if any column is.
    """
    n = len(columns)
    if n * bits > 63:
        raise ValueError(f"{n} columns of {bits} bits do not fit 63 bits")
    whole = [(F.col(c) if isinstance(c, str) else c).cast("bigint") for c in columns]
    parts = [F.shiftleft(c.bitwiseAND(F.lit(1 << b)), b * (n - 1) + i) for b in range(bits) for i, c in enumerate(whole)]
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], bits: int = 20, row_group_bytes: int = 8 << 20, mode: str = "overwrite") -> None:
    """Parquet in Z-curve order of ``columns``: a box in all of them touches few files and row groups.

    One range shuffle by the curve; files and row groups then hold compact boxes, whose column
    statistics let a crop skip the rest, whichever of the columns it limits. Values beyond
    ``bits`` bits are stored as they are and only cluster less well; NULL sorts first.
    """
    code = "__curve"
    ordered = df.withColumn(code, morton(columns, bits)).repartitionByRange(code).sortWithinPartitions(code)
    ordered.drop(code).write.mode(mode).option("parquet.block.size", row_group_bytes).parquet(path)


def write_metrics(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.csv(path)


def write_tabular(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def chunk_ids(df: DataFrame, ids: Sequence[str], rows_per_part: int, seed=0) -> DataFrame:
    """Adds ``part``: 0-based chunk of exactly ``rows_per_part`` rows (the last one shorter)."""
    ranked = seeded_rank(df, ids, seed, out="__rank")
    return ranked.withColumn("part", F.floor((F.col("__rank") - 1) / rows_per_part).cast("int")).drop("__rank")


def write_chunked(df: DataFrame, path: str, ids: Sequence[str], rows_per_part: int, seed=0) -> None:
    """Parts with a fixed row count, one folder per part."""
    write_dataset(chunk_ids(df, ids, rows_per_part, seed), path, ["part"])


def write_limited(df: DataFrame, path: str, rows_per_file: int) -> None:
    """Files of at most ``rows_per_file`` rows without any ordering or shuffle."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
