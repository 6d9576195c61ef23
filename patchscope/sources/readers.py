"""Partitioned scans. Every filter here is on partition columns, so it prunes folders."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchscope.sources.schema import FIELD2D, GRID, TERRAIN


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The dataset, or an empty one with the schema when the path is absent."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _partitioned(schema: T.StructType, names: Sequence[str]) -> T.StructType:
    present = set(schema.fieldNames())
    return T.StructType([*schema.fields, *[T.StructField(n, T.IntegerType()) for n in names if n not in present]])


def read_field(
    spark: SparkSession, root: str, climate: str, var: str, years: Iterable[int], months: Iterable[int], schema: T.StructType = FIELD2D
) -> DataFrame:
    """One variable of one climate for some years and months; absent months yield no rows."""
    df = read_if_exists(spark, root, _partitioned(schema, ["year", "month"]))
    picked = (F.col("climate") == climate) & (F.col("var") == var)
    return df.filter(picked & F.col("year").isin(list(years)) & F.col("month").isin(list(months)))


def read_terrain(spark: SparkSession, path: str) -> DataFrame:
    """Terrain height per grid cell of the fixed domain; where a file repeats cells by time (``ts``), the first time counts."""
    df = spark.read.parquet(path)
    height = F.min_by("hgt_m", "ts") if "ts" in df.columns else F.min("hgt_m")
    rows = df.groupBy("row", "col").agg(height.alias("hgt_m"))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in TERRAIN])


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRID).parquet(path)


def read_patches(spark: SparkSession, root: str, climate: str, months: Iterable[int], years: Iterable[int] | None = None) -> DataFrame:
    """Patches of the given calendar months: one pruned scan instead of a union of month files."""
    df = spark.read.parquet(root).filter((F.col("climate") == climate) & F.col("month").isin(list(months)))
    return df.filter(F.col("year").isin(list(years))) if years is not None else df


def read_members(spark: SparkSession, root: str, climate: str, members: Iterable[int]) -> DataFrame:
    return spark.read.parquet(root).filter((F.col("climate") == climate) & F.col("member").isin(list(members)))


def read_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Stack datasets along the patch axis by column name; missing columns become NULL."""
    first, *rest = [spark.read.parquet(p) for p in paths]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


# Parts of a metric file name, with the key column each one fills.
NAME_PARTS = {
    "model": (r"model(\d+)", "int"),
    "member": (r"random(\d+)", "int"),
    "pfi_var": (r"pfivar([^_.]+)", "string"),
    "perm": (r"perm(\d+)", "int"),
    "rep": (r"boot(\d+)", "int"),
}


def read_metrics(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """Stack metric CSV files; keys held in the last two parts of their paths become columns (NULL when absent).

    Columns are taken by the names in each file's own header, so their order does not matter,
    further ones (a leading index) are passed over, and absent ones are NULL.
    """
    whole = spark.read.text(glob, wholetext=True)
    heads = whole.select(F.trim(F.translate(F.substring_index("value", "\n", 1), '\r"', "")).alias("head"), F.col("_metadata.file_path").alias("path"))
    layouts = heads.groupBy("head").agg(F.collect_list("path").alias("paths")).collect()  # file names only
    parts = []
    for layout in layouts:
        columns = [c.strip() or f"__blank{i}" for i, c in enumerate(layout["head"].split(","))]
        rows = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv([unquote(p) for p in layout["paths"]], header=True)
        taken = [(F.col(f"`{f.name}`") if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        parts.append(rows.select(*taken, "_metadata"))
    df = reduce(DataFrame.unionAll, parts)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*/[^/]+)$", 1)
    found = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    keys = {key: found(pattern).cast(kind) for key, (pattern, kind) in NAME_PARTS.items() if key not in df.columns}
    return df.withColumns(keys).drop("_metadata")
