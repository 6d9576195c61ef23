"""Physical plans: shuffles, columns and filters that reach the scan.

The check for cross joins and global windows runs on every query in test_oracle.
"""

import re

from conftest import SMALL
from pyspark.sql import functions as F

from patchscope.operators import fields
from patchscope.operators import verification as V
from patchscope.plans import views
from patchscope.sources import readers, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sweep_shuffles_once(spark):
    text = plan(V.threshold_sweep(views.forecast(spark, SMALL), ["climate", "member"]))
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 2
    assert "Join" not in text


def test_confusion_reads_its_columns_only(spark):
    text = plan(V.confusion(views.forecast(spark, SMALL), ["climate"]))
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_tax" not in read and "l_discount" not in read and "l_shipdate" not in read


def test_crop_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "grid")
    views.grid(spark, SMALL).write.parquet(path)
    text = plan(fields.crop(spark.read.parquet(path), 1, 3, 2, 4))
    assert "GreaterThanOrEqual(row,1)" in text and "LessThan(col,4)" in text


def test_field_scan_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "field")
    g = views.grid(spark, SMALL).select(
        F.lit("current").alias("climate"), F.lit("UH25").alias("var"), F.timestamp_seconds("ts").alias("ts"), "row", "col",
        F.col("value").cast("float").alias("value"), F.lit(2001).alias("year"), (F.col("ts") % 12 + 1).cast("int").alias("month"),
    )
    sinks.write_dataset(g, path, ["climate", "var", "year", "month"])
    text = plan(readers.read_field(spark, path, "current", "UH25", [2001], [3]))
    assert re.search(r"PartitionFilters: \[[^\]]*month", text) and re.search(r"PartitionFilters: \[[^\]]*climate", text)


def test_helicity_shuffles_the_field_once(spark):
    text = plan(fields.updraft_helicity(views.levels(spark, SMALL), ["ts"]))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
