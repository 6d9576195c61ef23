"""Scoring, calibration, and source/sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchscope.functions import arrays as A
from patchscope.operators import patches as PA
from patchscope.operators import scoring as M
from patchscope.operators import verification as V
from patchscope.plans import views
from patchscope.plans.catalog import SCALAR_COLUMNS, counts_sql, query, r
from patchscope.session import shared_folder
from patchscope.sources import readers, sinks
from patchscope.sources.schema import FIELD2D, comments, with_comments

FEAT = f"WITH {views.FEATURES_SQL}"


def _linear(rows):
    """(rows, features) to probabilities with fixed weights."""
    import numpy as np

    return np.clip(rows[:, 0] / 50.0 * 0.6 + rows[:, 1] * 3.0 + rows[:, 2] * 1.0, 0.0, 1.0)


def _mean_logit(stacked):
    """(rows, pixels, features) to probabilities."""
    import numpy as np

    return 1.0 / (1.0 + np.exp(-(stacked[:, :, 0].mean(axis=1) * 4.0 + stacked[:, :, 1].max(axis=1))))


@query(f"{FEAT} SELECT row_key, climate, label, {r(views.SCORER_SQL, 'prob')} FROM v_features")
def scored_rows(spark, sf):
    """A plug-in model applied to Arrow batches."""
    return M.score(views.features(spark, sf), _linear, views.SCORED_FEATURES, ["row_key", "climate", "label"])


@query(f"WITH {views.PATCHES_SQL} SELECT patch_id, climate, {r('1 / (1 + exp(-(avg(v) * 4.0 + max(r))))', 'prob')} FROM v_px GROUP BY patch_id, climate")
def scored_patches(spark, sf):
    """The same on patch arrays; diagnostics are withheld from the model."""
    inputs = M.model_inputs(["values", "mirror", "mask"])
    return M.score(views.patches(spark, sf), _mean_logit, inputs, ["patch_id", "climate"])


@query(f"{FEAT}, s AS (SELECT climate, member, label, {views.SCORER_SQL} AS prob FROM v_features) SELECT climate, {SCALAR_COLUMNS} FROM ({counts_sql('s', 'climate')})")
def scored_evaluation(spark, sf):
    """Score, then verify."""
    scored = M.score(views.features(spark, sf), _linear, views.SCORED_FEATURES, ["climate", "label"])
    return V.scalar_scores(V.confusion(scored, ["climate"]))


@query(f"""{FEAT}, d AS (SELECT CAST(round(discount * 100) AS INT) AS k, sum(label) AS s, count(*) AS n FROM v_features GROUP BY ALL),
c AS (SELECT k, sum(s) OVER (ORDER BY k) AS cs, sum(n) OVER (ORDER BY k) AS cn, s, n FROM d),
ab AS (SELECT i.k, a.k AS lo, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)::DOUBLE AS mean FROM c i JOIN c a ON a.k <= i.k JOIN c b ON b.k >= i.k),
iso AS (SELECT k, max(m) AS g FROM (SELECT k, lo, min(mean) AS m FROM ab GROUP BY k, lo) GROUP BY k)
SELECT row_key, label, {r('g', 'calibrated')} FROM v_features JOIN iso ON iso.k = CAST(round(discount * 100) AS INT)""")
def calibrated_rows(spark, sf):
    """Isotonic calibration of an eleven-valued forecast; the SQL uses the max-min formula."""
    rows = views.features(spark, sf).select("row_key", "label", (F.round(F.col("discount") * 100) / 100.0).alias("prob"))
    return M.calibrate(rows, M.calibrate_fit(rows)).select("row_key", "label", "calibrated")


@query()
def classified_patches(spark, sf):
    """Logistic regression on patch features, applied to the same patches."""
    p = views.patches(spark, sf)
    table = p.select(
        "patch_id", A.pixel_mean("values").alias("mean"), A.pixel_min("values").alias("low"), (A.pixel_max("mirror") > 0.3).cast("int").alias("label")
    )
    model = M.fit_classifier(table, ["mean", "low"])
    return M.classify(model, table).select("patch_id", "label", "prob")


@query(f"WITH {views.PATCHES_SQL}, {views.GRID_SQL} SELECT ts, row, col, {r('value', 'value')} FROM v_grid WHERE ts % 2 = 0 AND ts % 12 + 1 IN (1, 2, 12)")
def partitioned_field_scan(spark, sf):
    """A field written by climate, variable, year and month, then read back pruned."""
    g = views.grid(spark, sf)
    month = (F.col("ts") % 12 + 1).cast("int")
    field = g.select(
        F.when(F.col("ts") % 2 == 0, "current").otherwise("future").alias("climate"), F.lit("UH25").alias("var"),
        F.timestamp_seconds(F.col("ts") * 3600).alias("ts"), "row", "col", F.col("value").cast("float").alias("value"), F.lit(2001).alias("year"), month.alias("month"),
    )
    path = f"{shared_folder(spark)}/field-{uuid.uuid4().hex}"
    sinks.write_dataset(field, path, ["climate", "var", "year", "month"])
    read = readers.read_field(spark, path, "current", "UH25", [2001], [12, 1, 2])
    absent = readers.read_if_exists(spark, path + "-absent", FIELD2D)
    both = read.select(absent.columns).unionByName(absent)
    return both.select((F.unix_timestamp("ts") / 3600).cast("bigint").alias("ts"), "row", "col", "value")


METRIC_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("TP", "FP", "FN", "TN")])


@query(f"WITH {views.FORECAST_SQL} SELECT TP, FP, FN, TN, member FROM ({counts_sql('v_forecast', 'member')})")
def metric_files(spark, sf):
    """Metric CSV files whose names hold the member, stacked with the key restored."""
    counts = V.confusion(views.forecast(spark, sf), ["member"])
    folder = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    sinks.write_metrics(counts.withColumn("key", F.concat(F.lit("random"), F.col("member").cast("string"))).drop("member"), folder, ["key"])
    read = readers.read_metrics(spark, f"{folder}/*/*.csv", METRIC_SCHEMA)
    return read.select("TP", "FP", "FN", "TN", "member")


@query(f"WITH {views.PATCHES_SQL} SELECT patch_id, {r('max(v)', 'w_max')} FROM v_px GROUP BY patch_id")
def documented_table(spark, sf):
    """A Parquet table whose column comments survive the round trip."""
    table = views.patches(spark, sf).select("patch_id", A.pixel_max("values").alias("w_max"))
    path = f"{shared_folder(spark)}/tabular-{uuid.uuid4().hex}"
    sinks.write_tabular(with_comments(table, {"w_max": "maximum vertical wind speed"}), path)
    read = spark.read.parquet(path)
    if comments(read) != {"w_max": "maximum vertical wind speed"}:
        raise AssertionError("column comments were lost")
    return read


@query("""SELECT doc_id, lang, CAST(NULL AS BIGINT) AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels""")
def stacked_tables(spark, sf):
    """Datasets with different columns stacked by name."""
    both = readers.read_many(spark, [f"{sf}/documents.parquet", f"{sf}/labels.parquet"])
    return both.select("doc_id", "lang", F.col("quality").cast("bigint").alias("quality"))


@query("SELECT vec_id AS patch_id, count(*) AS n FROM (SELECT vec_id, unnest(embedding) FROM embeddings) GROUP BY vec_id")
def limited_files(spark, sf):
    """Files capped at 100 rows hold all rows."""
    path = f"{shared_folder(spark)}/limited-{uuid.uuid4().hex}"
    sinks.write_limited(views.patches(spark, sf).select("patch_id", "values"), path, 100)
    long = PA.unpack_patches(spark.read.parquet(path), ["patch_id"], ["values"], views.WIDTH)
    return long.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"))
