"""Domain tables derived from the given tables, as DataFrames and as SQL text.

The same rules are stated twice on purpose: the SQL feeds the independent oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchscope.functions.hashing import draw_int
from patchscope.functions.mixing import with_closed
from patchscope.operators.ranking import seeded_rank

WIDTH = 8
PIXELS = WIDTH * WIDTH


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_if_few_splits(df: DataFrame) -> DataFrame:
    """Spread a table of fewer file splits than cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def blend(label: Column, key: Column) -> Column:
    """Probability in steps of 0.0001 that leans towards the label; integer arithmetic until the end."""
    u = draw_int(1, key) % 10001
    return F.floor((u * 7 + label * 30000) / 10) / F.lit(10000.0)


BLEND_SQL = "(((('0x'||substr(md5('1:'||{key}),1,15))::BIGINT % 10001) * 7 + {label} * 30000) // 10) / 10000.0"


# --- forecasts on lineitem --------------------------------------------------------------


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scalar features with keys, one row per line item."""
    li = spread_if_few_splits(table(spark, sf_dir, "lineitem"))
    whole = lambda c: F.floor(c + 0.5).cast("string")
    key = F.concat_ws(
        ":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", whole(F.col("l_quantity")), whole(F.col("l_extendedprice") * 100)
    )
    return li.select(
        key.alias("row_key"),
        F.when(F.col("l_linestatus") == "F", "current").otherwise("future").alias("climate"),
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("member"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


FEATURES_SQL = """
v_features AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity) AS BIGINT),
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_key,
         CASE WHEN l_linestatus = 'F' THEN 'current' ELSE 'future' END AS climate,
         CAST(l_suppkey % 5 + 1 AS INT) AS member, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
         CAST(l_returnflag = 'R' AS INT) AS label,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
  FROM lineitem)"""


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = features(spark, sf_dir).select("row_key", "climate", "member", "year", "month", "label")
    # closed, as scores use the probability many times and would draw it anew each time
    return with_closed(base, "prob", blend(F.col("label"), F.col("row_key")))


FORECAST_SQL = FEATURES_SQL + """,
v_forecast AS (
  SELECT row_key, climate, member, year, month, label, """ + BLEND_SQL.format(key="row_key", label="label") + """ AS prob
  FROM v_features)"""


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts with ``row_no`` 0..n-1 and ``n_rows`` per climate and member."""
    ranked = seeded_rank(forecast(spark, sf_dir), "row_key", 0, by=["climate", "member"], out="rk", size_out="n_rows")
    return ranked.withColumn("row_no", F.col("rk") - 1).drop("rk")


FORECAST_ROWS_SQL = FORECAST_SQL + """,
v_rows AS (
  SELECT *, row_number() OVER (PARTITION BY climate, member ORDER BY md5('0:'||row_key), row_key) - 1 AS row_no,
         count(*) OVER (PARTITION BY climate, member) AS n_rows
  FROM v_forecast)"""


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar features with ``row_no`` per climate and member."""
    base = features(spark, sf_dir)
    ranked = seeded_rank(base, "row_key", 0, by=["climate", "member"], out="rk")
    return ranked.withColumn("row_no", F.col("rk") - 1).drop("rk")


FEATURE_ROWS_SQL = FEATURES_SQL + """,
v_frows AS (
  SELECT *, row_number() OVER (PARTITION BY climate, member ORDER BY md5('0:'||row_key), row_key) - 1 AS row_no
  FROM v_features)"""

SCORED_FEATURES = ["quantity", "discount", "tax"]


def linear_scorer(df: DataFrame) -> DataFrame:
    """A fixed linear model on three features, clipped to [0, 1]."""
    raw = F.col("quantity") / 50.0 * 0.6 + F.col("discount") * 3.0 + F.col("tax") * 1.0
    return df.withColumn("prob", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


SCORER_SQL = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, quantity / 50.0::DOUBLE * 0.6::DOUBLE + discount * 3.0::DOUBLE + tax * 1.0::DOUBLE))"


# --- patches on embeddings --------------------------------------------------------------


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 patches with a mask and three co-located arrays, one of them with missing pixels."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("patch_id"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("values")
    )
    patch = F.col("patch_id")
    gap = F.transform("values", lambda v, i: F.when(F.pmod(patch * PIXELS + i, F.lit(257)) == 0, None).otherwise(v))
    return e.select(
        "patch_id", "grp",
        F.when(patch % 2 == 0, "current").otherwise("future").alias("climate"),
        F.floor(patch / 2 % 5 + 1).cast("int").alias("member"),
        "values",
        F.transform("values", lambda v: v > 0).alias("mask"),
        gap.alias("gappy"),
        F.reverse("values").alias("mirror"),
    )


PATCHES_SQL = """
v_patch AS (
  SELECT vec_id AS patch_id, label AS grp, CASE WHEN vec_id % 2 = 0 THEN 'current' ELSE 'future' END AS climate,
         CAST((vec_id // 2) % 5 + 1 AS INT) AS member, CAST(embedding AS DOUBLE[]) AS vals
  FROM embeddings),
v_px AS (
  SELECT patch_id, grp, climate, member, i - 1 AS i, (i - 1) // 8 AS y, (i - 1) % 8 AS x, vals[i] AS v, vals[i] > 0 AS m,
         CASE WHEN (patch_id * 64 + i - 1) % 257 = 0 THEN NULL ELSE vals[i] END AS g, vals[65 - i] AS r
  FROM v_patch, range(1, 65) t(i))"""


def patch_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast per patch: the label is whether the patch exceeds 0.3."""
    p = patches(spark, sf_dir)
    label = (F.array_max("values") > 0.3).cast("int")
    staged = p.select("patch_id", "climate", "member", label.alias("label"))
    return staged.withColumn("prob", blend(F.col("label"), F.col("patch_id").cast("string")))


PATCH_FORECAST_SQL = PATCHES_SQL + """,
v_plab AS (SELECT patch_id, any_value(climate) AS climate, any_value(member) AS member, CAST(max(v) > 0.3 AS INT) AS label FROM v_px GROUP BY patch_id),
v_pfc AS (SELECT *, """ + BLEND_SQL.format(key="CAST(patch_id AS VARCHAR)", label="label") + """ AS prob FROM v_plab)"""


# --- grids and columns on embeddings ----------------------------------------------------


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patch as one 8x8 time slice: ts, row, col, value."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ts"), F.posexplode("embedding").alias("i", "v"))
    return e.select(
        "ts", F.floor(F.col("i") / WIDTH).cast("int").alias("row"), (F.col("i") % WIDTH).cast("int").alias("col"),
        F.col("v").cast("double").alias("value"),
    )


GRID_SQL = """
v_grid AS (
  SELECT vec_id AS ts, CAST((i - 1) // 8 AS INT) AS row, CAST((i - 1) % 8 AS INT) AS col, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, range(1, 65) t(i))"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 levels x 4 rows x 4 columns: u, v, w, z and cloud columns per (ts, level, row, col)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ts"), F.col("embedding").cast("array<double>").alias("a"))
    px = e.select("ts", "a", F.posexplode("a").alias("i", "u"))
    i, at = F.col("i"), lambda k: F.get("a", k)
    return px.select(
        "ts", F.floor(i / 16).cast("int").alias("level"), (F.floor(i / 4) % 4).cast("int").alias("row"), (i % 4).cast("int").alias("col"),
        "u", at(63 - i).alias("v"), at((i * 7) % 64).alias("w"),
        (F.floor(i / 16) * 1500.0 + 500.0 + F.abs("u") * 100.0).alias("z"),
        (F.col("u") * 10.0 - F.floor(i / 16) * 20.0 + 290.0).alias("tk"),
        (F.abs("u") * 0.001).alias("qcloud"), (F.abs(at(63 - i)) * 0.001).alias("qice"),
        (F.lit(100000.0) - F.floor(i / 16) * 20000.0).alias("p"),
    )


LEVELS_SQL = """
v_lev AS (
  SELECT vec_id AS ts, CAST(i // 16 AS INT) AS level, CAST((i // 4) % 4 AS INT) AS row, CAST(i % 4 AS INT) AS col, u, v, w,
         (i // 16) * 1500.0::DOUBLE + 500.0::DOUBLE + abs(u) * 100.0::DOUBLE AS z,
         u * 10.0::DOUBLE - (i // 16) * 20.0::DOUBLE + 290.0::DOUBLE AS tk,
         abs(u) * 0.001::DOUBLE AS qcloud, abs(v) * 0.001::DOUBLE AS qice, 100000.0::DOUBLE - (i // 16) * 20000.0::DOUBLE AS p
  FROM (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS u, CAST(embedding[64 - i] AS DOUBLE) AS v,
               CAST(embedding[(i * 7) % 64 + 1] AS DOUBLE) AS w
        FROM embeddings, range(0, 64) t(i)))"""


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain height of the 4x4 domain: the lowest 500 m of the columns that cross it, cell by cell."""
    lev = levels(spark, sf_dir)
    return lev.filter("level = 0").groupBy("row", "col").agg((F.min("z") * 0.5).alias("hgt_m"))


TERRAIN_SQL = "v_terrain AS (SELECT row, col, min(z) * 0.5::DOUBLE AS hgt_m FROM v_lev WHERE level = 0 GROUP BY row, col)"


# --- hourly series on events ------------------------------------------------------------


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type").isin("view", "click"), "current").otherwise("future").alias("climate"),
        F.col("user_id"), F.col("value"),
    )


HOURLY_SQL = """
v_hourly AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_type IN ('view', 'click') THEN 'current' ELSE 'future' END AS climate,
         user_id, value
  FROM events)"""


# --- storms on orders: many years and months --------------------------------------------


def storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One storm per order: peak rotation ``max_uh`` in [0, 120), coldest top ``min_ctt``."""
    o = table(spark, sf_dir, "orders")
    u = draw_int(7, F.col("o_orderkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("patch_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(F.col("o_custkey") % 2 == 0, "current").otherwise("future").alias("climate"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        ((u % 12000) / 100.0).alias("max_uh"), (-(u % 7000) / 100.0).alias("min_ctt"),
    )


STORMS_SQL = """
v_storm AS (
  SELECT patch_id, ts, climate, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month,
         (u % 12000) / 100.0 AS max_uh, -(u % 7000) / 100.0 AS min_ctt
  FROM (SELECT o_orderkey AS patch_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
               CASE WHEN o_custkey % 2 = 0 THEN 'current' ELSE 'future' END AS climate,
               ('0x'||substr(md5('7:'||CAST(o_orderkey AS VARCHAR)),1,15))::BIGINT AS u
        FROM orders))"""


# --- points and polygons ----------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers hashed to a 0..100 square."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    coordinate = lambda seed: (draw_int(seed, key) % 10000) / 100.0
    return c.select(F.col("c_custkey").alias("point_id"), coordinate(11).alias("px"), coordinate(12).alias("py"))


POINTS_SQL = """
v_point AS (
  SELECT c_custkey AS point_id, (('0x'||substr(md5('11:'||CAST(c_custkey AS VARCHAR)),1,15))::BIGINT % 10000) / 100.0 AS px,
         (('0x'||substr(md5('12:'||CAST(c_custkey AS VARCHAR)),1,15))::BIGINT % 10000) / 100.0 AS py
  FROM customer)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One star-shaped hexagon per supplier, as edges around a hashed centre."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    centre = lambda seed: (draw_int(seed, key) % 10000) / 100.0
    radius = (draw_int(15, key) % 900) / 100.0 + 1.0
    base = s.select(F.col("s_suppkey").alias("poly_id"), centre(13).alias("cx"), centre(14).alias("cy"), radius.alias("r"))
    corners = F.array(*[F.struct(F.lit(a).alias("ax"), F.lit(b).alias("ay"), F.lit(c).alias("bx"), F.lit(d).alias("by")) for a, b, c, d in HEXAGON])
    edges = base.select("poly_id", "cx", "cy", "r", F.inline(corners))
    at = lambda c, d: F.col(c) + F.col("r") * F.col(d)
    return edges.select("poly_id", at("cx", "ax").alias("x0"), at("cy", "ay").alias("y0"), at("cx", "bx").alias("x1"), at("cy", "by").alias("y1"))


_CORNERS = [(1.0, 0.0), (0.5, 0.875), (-0.5, 0.5), (-1.0, 0.0), (-0.25, -0.875), (0.5, -0.5)]
HEXAGON = [(*_CORNERS[i], *_CORNERS[(i + 1) % 6]) for i in range(6)]

POLYGONS_SQL = """
v_edge AS (
  SELECT poly_id, cx + r * h.ax AS x0, cy + r * h.ay AS y0, cx + r * h.cx2 AS x1, cy + r * h.cy2 AS y1
  FROM (SELECT s_suppkey AS poly_id, (('0x'||substr(md5('13:'||CAST(s_suppkey AS VARCHAR)),1,15))::BIGINT % 10000) / 100.0 AS cx,
               (('0x'||substr(md5('14:'||CAST(s_suppkey AS VARCHAR)),1,15))::BIGINT % 10000) / 100.0 AS cy,
               (('0x'||substr(md5('15:'||CAST(s_suppkey AS VARCHAR)),1,15))::BIGINT % 900) / 100.0 + 1.0 AS r
        FROM supplier),
       (VALUES """ + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in HEXAGON) + """) h(ax, ay, cx2, cy2))"""
