"""Split, member and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchscope.functions import arrays as A
from patchscope.functions.hashing import draw_token
from patchscope.operators import ranking, scaling, splits
from patchscope.plans import views
from patchscope.plans.catalog import query, r
from patchscope.sources import sinks

FEAT = f"WITH {views.FEATURES_SQL}"


def ranked_sql(seed: int, part: str = "", source: str = "v_features") -> str:
    p = f"PARTITION BY {part}" if part else ""
    return f"(SELECT *, row_number() OVER ({p} ORDER BY md5('{seed}:'||row_key), row_key) AS rk, count(*) OVER ({p}) AS sz FROM {source})"


CLASS_RANKS = f"""{FEAT}, cr AS (SELECT *, sum(label) OVER (PARTITION BY climate) AS np, sum(1 - label) OVER (PARTITION BY climate) AS nn
  FROM {ranked_sql(0, 'climate, label')})"""


def _labelled(spark, sf):
    return views.features(spark, sf).select("row_key", "climate", "label")


@query(f"{FEAT} SELECT row_key, climate, label, rk AS rank FROM {ranked_sql(5, 'climate')}")
def seeded_rank(spark, sf):
    return ranking.seeded_rank(_labelled(spark, sf), "row_key", 5, by=["climate"])


@query(f"""{CLASS_RANKS} SELECT row_key, climate, label, split FROM (
  SELECT *, CASE WHEN rk <= floor(np * 0.6::DOUBLE) THEN 'train'
     WHEN label = 1 OR rk <= floor(np * (1 - 0.6::DOUBLE) * nn / np + np * (1 - 0.6::DOUBLE)) THEN 'test' END AS split FROM cr)
WHERE split IS NOT NULL""")
def split_balanced(spark, sf):
    return splits.split(_labelled(spark, sf), "balanced", "row_key", p=0.6, by=["climate"])


@query(f"{CLASS_RANKS} SELECT row_key, climate, label, CASE WHEN rk <= floor(sz * 0.6::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM cr")
def split_stratified(spark, sf):
    return splits.split(_labelled(spark, sf), "stratified", "row_key", p=0.6, by=["climate"])


@query(f"""{FEAT} SELECT row_key, climate, label, fold, CASE WHEN fold = 2 THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, CAST(ntile(5) OVER (PARTITION BY climate, label ORDER BY md5('0:'||row_key), row_key) - 1 AS INT) AS fold FROM v_features)""")
def split_kfold(spark, sf):
    return splits.split(_labelled(spark, sf), "kfold", "row_key", k=5, fold=2, by=["climate"])


@query(f"{FEAT} SELECT row_key, climate, label, CASE WHEN rk <= floor(sz * 0.2::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM {ranked_sql(0, 'climate')}")
def split_validation(spark, sf):
    return splits.split_validation(_labelled(spark, sf), "row_key", 0.2, by=["climate"])


@query(f"{FEAT} SELECT row_key, climate, label, rk AS position FROM {ranked_sql(10)}")
def shuffle(spark, sf):
    """Position of every row in one shuffle of the whole table."""
    return splits.shuffle(_labelled(spark, sf), "row_key")


@query(f"{FEAT} SELECT row_key, climate, label, CAST((rk - 1) // 1000 + 1 AS INT) AS member, (rk - 1) % 1000 AS row_no FROM {ranked_sql(0, 'climate')}")
def evaluation_members(spark, sf):
    return splits.to_members(_labelled(spark, sf), "row_key", 1000, by=["climate"])


@query(f"{FEAT} SELECT row_key, CAST((rk - 1) // 450 AS INT) AS part FROM {ranked_sql(0)}")
def fixed_size_parts(spark, sf):
    """Chunk number of every row when parts hold exactly 450 rows."""
    return sinks.chunk_ids(_labelled(spark, sf).select("row_key"), ["row_key"], 450)


@query(f"""{FEAT} SELECT row_key, climate, label FROM v_features""")
def stack_labels(spark, sf):
    rows = views.features(spark, sf)
    above, below = (rows.filter(F.col("label") == c).select("row_key", "climate") for c in (1, 0))
    return splits.stack_labels(above, below)


@query(f"""{FEAT} SELECT row_key, climate, label, quantity FROM (SELECT *, row_number() OVER (PARTITION BY climate, label ORDER BY md5('3:'||row_key)) AS rk FROM v_features) WHERE rk <= 30""")
def group_heads(spark, sf):
    """First 30 rows of each group in a seeded order, for a balanced scatter."""
    rows = views.features(spark, sf).select("row_key", "climate", "label", "quantity")
    return ranking.head_n(rows, ["climate", "label"], 30, [draw_token(3, "row_key")])


@query(f"""{FEAT} SELECT row_key, climate, label FROM (SELECT *, row_number() OVER (PARTITION BY climate, label ORDER BY price DESC, row_key) AS rk FROM v_features) WHERE rk = 8""")
def nth_case(spark, sf):
    rows = views.features(spark, sf)
    return ranking.nth(rows, ["climate", "label"], 7, [F.desc("price"), F.asc("row_key")]).select("row_key", "climate", "label")


# --- scaling on patches ---------------------------------------------------------------------

PX = f"WITH {views.PATCHES_SQL}"
STATS = """sc AS (SELECT climate, feature, avg(v) AS mean, stddev_pop(v) AS std, count(v) AS n FROM (
  SELECT climate, 'values' AS feature, v FROM v_px UNION ALL SELECT climate, 'gappy', g FROM v_px UNION ALL SELECT climate, 'mirror', r FROM v_px)
  GROUP BY climate, feature)"""
FEATURES = ["values", "gappy", "mirror"]


@query(f"{PX}, {STATS} SELECT climate, feature, {r('mean', 'mean')}, {r('std', 'std')}, n FROM sc")
def fit_scaler(spark, sf):
    return scaling.fit_scaler(views.patches(spark, sf), ["climate"], FEATURES)


@query(f"{PX}, {STATS} SELECT climate, feature, {r('mean', 'mean')}, {r('std', 'std')} FROM sc WHERE feature = 'gappy'")
def scaler_of_feature(spark, sf):
    scaler = scaling.fit_scaler(views.patches(spark, sf), ["climate"], FEATURES)
    return scaling.scaler_of(scaler, "gappy").select("climate", "feature", "mean", "std")


def _long(df, column="values"):
    return df.select("patch_id", F.posexplode(column).alias("i", "z"))


@query(f"{PX}, {STATS} SELECT patch_id, CAST(i AS INT) AS i, {r('(g - mean) / std', 'z')} FROM v_px JOIN sc ON sc.climate = v_px.climate AND feature = 'gappy'")
def standardise(spark, sf):
    """Patches in units of their own climate's mean and deviation."""
    patches = views.patches(spark, sf)
    scaled = scaling.apply_scaler(patches, scaling.fit_scaler(patches, ["climate"], ["gappy"]), ["gappy"], ["climate"])
    return _long(scaled, "gappy")


@query(f"{PX}, {STATS} SELECT patch_id, CAST(i AS INT) AS i, {r('(v - mean) / std', 'z')} FROM v_px JOIN sc ON sc.climate = 'current' AND feature = 'values'")
def standardise_other_climate(spark, sf):
    """Both climates standardised with the current climate's statistics."""
    patches = views.patches(spark, sf)
    scaler = scaling.fit_scaler(patches.filter("climate = 'current'"), None, ["values"])
    return _long(scaling.apply_scaler(patches, scaler, ["values"]))


@query(f"{PX}, {STATS} SELECT patch_id, CAST(i AS INT) AS i, {r('v', 'z')} FROM v_px")
def invert_standardise(spark, sf):
    """Standardise, then invert: the original values."""
    patches = views.patches(spark, sf)
    scaler = scaling.fit_scaler(patches, ["climate"], ["values"])
    scaled = scaling.apply_scaler(patches, scaler, ["values"], ["climate"])
    return _long(scaling.invert_scaler(scaled, scaler, ["values"], ["climate"]))


@query(f"""{PX}, sp AS (SELECT patch_id, climate, row_number() OVER (ORDER BY md5('0:'||patch_id), patch_id) <= floor(count(*) OVER () * 0.6::DOUBLE) AS train
  FROM v_patch),
st AS (SELECT avg(v) AS mean, stddev_pop(v) AS std FROM v_px JOIN sp USING (patch_id) WHERE train)
SELECT patch_id, CASE WHEN train THEN 'train' ELSE 'test' END AS split, {r('max((v - mean) / std)', 'z_max')}, {r('min((v - mean) / std)', 'z_min')}
FROM v_px JOIN sp USING (patch_id), st GROUP BY patch_id, train""")
def standardise_split(spark, sf):
    """Train and test standardised with train statistics; one extreme pair per patch."""
    patches = views.patches(spark, sf).select("patch_id", "values").withColumn("label", F.lit(1))
    marked = splits.split_stratified(patches.select("patch_id", "label"), "patch_id", 0.6)
    scaled = scaling.standardise_split(patches.drop("label").join(marked, "patch_id"), ["values"])
    return scaled.select("patch_id", "split", A.pixel_max("values").alias("z_max"), A.pixel_min("values").alias("z_min"))


@query(f"""{PX}, w AS (SELECT patch_id, i, CASE WHEN patch_id % 50 = 0 AND i = 5 THEN 0 ELSE v END AS v FROM v_px)
SELECT 'uh03' AS feature, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, count(v) AS n FROM w
UNION ALL SELECT 'mask', 0.0::DOUBLE, 0.0::DOUBLE, NULL""")
def fit_scaler_infinite(spark, sf):
    """Infinities of the 0-3 km helicity become zero before the statistics; the mask is not scaled."""
    patches = views.patches(spark, sf)
    broken = F.transform("values", lambda v, i: F.when((F.col("patch_id") % 50 == 0) & (i == 5), float("inf")).otherwise(v))
    return scaling.fit_scaler(patches.select(broken.alias("uh03"), "mask"), None, ["uh03", "mask"])
