"""Stored layouts: matching buckets and the Z curve."""

import re

import pyarrow.parquet as pq
from conftest import SMALL
from pyspark.sql import functions as F

from patchscope.operators import fields
from patchscope.operators import patches as PA
from patchscope.plans import all_queries
from patchscope.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_gather_has_no_exchange(spark):
    text = plan(all_queries()[0]["environment_bucketed"](spark, SMALL))
    assert text.count("SortMergeJoin") == 2 and "Exchange" not in text


def test_bucketed_gather_keeps_pixels_without_field(spark):
    pixels = sinks.bucketed(spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 0, 6.0), (2, 0, 1, 7.0)], "ts int, row int, col int, value double"), 4, ["ts", "row", "col"])
    field = sinks.bucketed(spark.createDataFrame([(1, 0, 0, 50.0), (9, 9, 9, 1.0)], "ts int, row int, col int, value double"), 4, ["ts", "row", "col"])
    got = PA.gather_bucketed(pixels, {"a": field}, ["ts", "row", "col"]).orderBy("value").collect()
    assert [r["a"] for r in got] == [50.0, 50.0, None]


def test_curve_interleaves_bits(spark):
    cells = [(a, b, c) for a in range(4) for b in range(4) for c in range(4)]
    got = spark.createDataFrame(cells, "a int, b int, c int").withColumn("m", sinks.morton(["a", "b", "c"], bits=2)).collect()
    spread = lambda v, i: ((v & 1) << i) | ((v >> 1 & 1) << (3 + i))
    assert all(r["m"] == spread(r["a"], 0) | spread(r["b"], 1) | spread(r["c"], 2) for r in got)


def _groups_in_reach(path, box):
    total = met = 0
    for file in path.glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {c.path_in_schema: c.statistics for c in (meta.row_group(g).column(i) for i in range(meta.num_columns))}
            total += 1
            met += all(stats[c].min < high and stats[c].max >= low for c, (low, high) in box.items())
    return met, total


def test_crop_reads_few_row_groups(spark, tmp_path):
    axis = lambda shift: F.shiftright("id", shift).bitwiseAND(F.lit(63)).cast("int")
    cube = spark.range(1 << 18).select(axis(12).alias("ts"), axis(6).alias("row"), axis(0).alias("col"), F.col("id").cast("double").alias("value"))
    path = tmp_path / "cube"
    sinks.write_clustered(cube, str(path), ["ts", "row", "col"], row_group_bytes=32 << 10)
    met, total = _groups_in_reach(path, {"ts": (16, 32), "row": (16, 32), "col": (32, 48)})
    assert total >= 40 and met * 4 <= total
    stored = spark.read.parquet(str(path))
    assert stored.columns == cube.columns and stored.exceptAll(cube).count() == 0 and stored.count() == 1 << 18
    got = fields.crop(stored.filter("ts >= 16 AND ts < 32"), 16, 32, 32, 48)
    assert got.count() == 16 ** 3 and re.search(r"PushedFilters: .*GreaterThanOrEqual\(ts,16\)", plan(got))


def test_curve_takes_missing_and_large_values(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), (1 << 40, 2), (3, None)], "a long, b int")
    sinks.write_clustered(rows, str(tmp_path / "odd"), ["a", "b"])
    assert spark.read.parquet(str(tmp_path / "odd")).exceptAll(rows).count() == 0


def test_label_of_long_patches(spark):
    rows = [("p", 80.0), ("p", None), ("q", 75.0), ("q", float("nan")), ("r", None)]
    got = PA.label_pixels(spark.createDataFrame(rows, "patch_id string, uh double"), "uh").groupBy("patch_id").agg(F.max("label").alias("l")).collect()
    assert {r["patch_id"]: r["l"] for r in got} == {"p": 1, "q": 0, "r": 0}
