"""Readers and sinks on small files."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchscope.sources import readers, schema, sinks


def patch_table(spark):
    ids = spark.range(24).select(F.col("id").alias("patch_id"), (F.col("id") % 6 + 1).cast("int").alias("month"))
    return ids.select(
        "patch_id", F.when(F.col("patch_id") < 12, "current").otherwise("future").alias("climate"),
        F.lit(2005).alias("year"), "month", (F.col("patch_id") % 3 + 1).cast("int").alias("member"),
    )


def test_read_patches_and_members(spark, tmp_path):
    path = str(tmp_path / "patches")
    sinks.write_dataset(patch_table(spark), path, ["climate", "year", "month"])
    got = readers.read_patches(spark, path, "current", [1, 2], [2005])
    assert {r["patch_id"] for r in got.collect()} == {0, 1, 6, 7}
    path = str(tmp_path / "members")
    sinks.write_dataset(patch_table(spark), path, ["climate", "member"])
    assert {r["patch_id"] % 3 for r in readers.read_members(spark, path, "future", [1, 3]).collect()} == {0, 2}


def test_terrain_and_grid(spark, tmp_path):
    cells = spark.range(4).select((F.col("id") / 2).cast("int").alias("row"), (F.col("id") % 2).cast("int").alias("col"))
    cells.withColumn("hgt_m", F.lit(1.5).cast("float")).write.parquet(str(tmp_path / "t"))
    cells.withColumn("lat", F.lit(1.0).cast("float")).withColumn("lon", F.lit(2.0).cast("float")).write.parquet(str(tmp_path / "g"))
    assert readers.read_terrain(spark, str(tmp_path / "t")).count() == 4
    assert readers.read_grid(spark, str(tmp_path / "g")).schema == schema.GRID


def test_exclusive_chunks_keep_all_rows(spark, tmp_path):
    path = str(tmp_path / "chunks")
    sinks.write_chunked(spark.range(25), path, ["id"], 10)
    sizes = {r["part"]: r["count"] for r in spark.read.parquet(path).groupBy("part").count().collect()}
    assert sizes == {0: 10, 1: 10, 2: 5}


def test_tabular_formats(spark, tmp_path):
    for fmt, reader in (("parquet", spark.read.parquet), ("csv", lambda p: spark.read.csv(p, header=True))):
        path = str(tmp_path / fmt)
        sinks.write_tabular(patch_table(spark), path, fmt)
        assert reader(path).count() == 24


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    keys = ["hour_idx", "row", "col"]
    cells = spark.range(64).select(F.lit(0).alias("hour_idx"), (F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("gather_left", "gather_right"):
            sinks.write_bucketed(cells, name, 4, keys)
        joined = spark.table("gather_left").join(spark.table("gather_right").withColumnRenamed("id", "other"), keys)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.filter("id = other").count() == 64
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.sql("DROP TABLE IF EXISTS gather_left")
        spark.sql("DROP TABLE IF EXISTS gather_right")


def test_metric_names_fill_keys(spark, tmp_path):
    path = tmp_path / "scores_model25_random3_pfivarTK1_perm7.csv"
    path.write_text("TP,FP\n5,6\n")
    counts = T.StructType([T.StructField(c, T.LongType()) for c in ("TP", "FP")])
    row = readers.read_metrics(spark, str(tmp_path / "*.csv"), counts).first()
    assert (row["model"], row["member"], row["pfi_var"], row["perm"], row["rep"]) == (25, 3, "TK1", 7, None)
