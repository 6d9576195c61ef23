"""Table schemas, the variables dimension and column documentation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FIELD2D = T.StructType([
    T.StructField("climate", T.StringType()), T.StructField("var", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.FloatType()),
])
FIELD3D = T.StructType([*FIELD2D.fields[:3], T.StructField("level", T.IntegerType()), *FIELD2D.fields[3:]])
FIELD_LEVELS = T.StructType([*FIELD2D.fields[:3], T.StructField("level_m", T.IntegerType()), *FIELD2D.fields[3:]])
TERRAIN = T.StructType([
    T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("hgt_m", T.FloatType()),
])
GRID = T.StructType([*TERRAIN.fields[:2], T.StructField("lat", T.FloatType()), T.StructField("lon", T.FloatType())])

METRIC_KEYS = T.StructType([
    T.StructField("climate", T.StringType()), T.StructField("model", T.IntegerType()), T.StructField("member", T.IntegerType()),
    T.StructField("method", T.StringType()), T.StructField("rep", T.IntegerType()), T.StructField("pfi_var", T.StringType()),
])

# Model variables, their short codes, patch column stems and number of levels.
VARIABLES = [
    ("TK", "temp", "tk", 4),
    ("EV", "evwd", "ev", 4),
    ("EU", "euwd", "eu", 4),
    ("QVAPOR", "qvap", "qv", 4),
    ("PRESS", "pres", "pr", 4),
    ("W", "wwnd", "w", 4),
    ("WMAX", "maxw", "wmax", 1),
    ("DBZ", "dbzs", "dbz", 1),
    ("CTT", "ctts", "ctt", 1),
    ("UH25", "uh25", "uh25", 1),
    ("UH03", "uh03", "uh03", 1),
    ("MASK", "mask", "mask", 1),
]
# Output heights in km, in level order, and simulation prefixes.
LEVELS_KM = (1, 3, 5, 7)
SIMULATIONS = {"current": "CTRL", "future": "PGW"}


def variables(spark: SparkSession) -> DataFrame:
    """The variables dimension: ``code``, ``column_stem``, ``short_name``, ``n_levels``."""
    return spark.createDataFrame(VARIABLES, "code string, column_stem string, short_name string, n_levels int")


def feature_columns() -> list[str]:
    """Patch columns of every variable and level, e.g. ``temp_1`` or ``uh25``."""
    return [f"{stem}_{km}" if n == 4 else stem for _, stem, _, n in VARIABLES for km in (LEVELS_KM if n == 4 else (0,))]


def level_index(name: str) -> int:
    """0-based level of a feature name that ends in its height, e.g. ``temp_5`` is 2."""
    return LEVELS_KM.index(int(name.rsplit("_", 1)[-1]))


def rename_variables(df: DataFrame) -> DataFrame:
    """Model codes to patch column names, also with a height suffix: ``TK1`` to ``temp_1``."""
    mapping = {}
    for code, stem, _, n in VARIABLES:
        mapping[code] = stem
        if n == 4:
            mapping.update({f"{code}{km}": f"{stem}_{km}" for km in LEVELS_KM})
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def with_comments(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """Attach descriptions as column metadata; Parquet keeps them."""
    for name, text in comments.items():
        if name in df.columns:
            df = df.withMetadata(name, {**df.schema[name].metadata, "comment": text})
    return df


def comments(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["comment"] for f in df.schema.fields if "comment" in f.metadata}
