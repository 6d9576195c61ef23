"""Field, grid, object and time-axis queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from patchscope.functions import arrays as A
from patchscope.functions import timeidx as TI
from patchscope.functions.expressions import clip_negative
from patchscope.operators import climate as CL
from patchscope.operators import fields as O
from patchscope.operators import objects as OB
from patchscope.operators import patches as PA
from patchscope.plans import views
from patchscope.plans.catalog import query, r
from patchscope.session import shared_folder
from patchscope.sources.sinks import bucketed, write_clustered

GRID = f"WITH {views.GRID_SQL}"
LEV = f"WITH {views.LEVELS_SQL}"
HOURLY = f"WITH {views.HOURLY_SQL}"
STORMS = f"WITH {views.STORMS_SQL}"
CELL = ["ts", "row", "col"]

# --- time axis ------------------------------------------------------------------------------

HOUR_INDEX = "CAST(floor((epoch(ts) - epoch(TIMESTAMP '2000-10-01 00:00:00')) / 3600) AS BIGINT)"


@query(f"""{HOURLY} SELECT event_id, {HOUR_INDEX} AS hour_idx, hour(ts) % 3 = 0 AS step_hour, {HOUR_INDEX} % 3 = 0 AS step_index,
  strftime(ts, '%B') AS month_name, strftime(ts, '%Y%m') AS year_month, lpad(CAST(quarter(ts) * 3 - 2 AS VARCHAR), 2, '0') || '-' || lpad(CAST(quarter(ts) * 3 AS VARCHAR), 2, '0') AS quarter_file,
  strftime(TIMESTAMP '2000-10-01 00:00:00' + {HOUR_INDEX} * INTERVAL 1 HOUR, '%Y-%m-%d %H') AS hour_start, strftime(last_day(ts) + INTERVAL 23 HOUR, '%Y-%m-%d %H') AS month_end
FROM v_hourly""")
def time_axis(spark, sf):
    """Hour index and its inverse, step hours, month names and file quarters of every event."""
    ev = views.hourly(spark, sf)
    index = TI.hour_index("ts")
    return ev.select(
        "event_id", index.alias("hour_idx"), TI.is_step_hour("ts").alias("step_hour"), TI.is_step_index(index).alias("step_index"),
        TI.month_name("ts").alias("month_name"), TI.year_month("ts").alias("year_month"), TI.quarter_months("ts").alias("quarter_file"),
        F.date_format(TI.hour_timestamp(index), "yyyy-MM-dd HH").alias("hour_start"), F.date_format(TI.month_last_hour("ts"), "yyyy-MM-dd HH").alias("month_end"),
    )


@query(f"{HOURLY} SELECT event_id, {r('value', 'value')} FROM v_hourly WHERE ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-08' AND hour(ts) % 3 = 0")
def three_hourly_day(spark, sf):
    """One day, every third hour."""
    return views.hourly(spark, sf).filter(TI.on_day("ts", "2024-01-07") & TI.is_step_hour("ts")).select("event_id", "value")


@query(f"{STORMS} SELECT climate, count(*) AS n FROM v_storm WHERE month IN (12, 1, 2, 3, 4, 5) GROUP BY climate")
def season_storms(spark, sf):
    return views.storms(spark, sf).filter(TI.in_season("ts")).groupBy("climate").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{HOURLY}, d AS (SELECT min(date_trunc('day', ts)) AS lo, max(date_trunc('day', ts)) AS hi FROM v_hourly),
ax AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, count(event_id) AS n FROM ax LEFT JOIN v_hourly ON date_trunc('day', ts) = day GROUP BY day""")
def daily_axis(spark, sf):
    """Complete day sequence of the data, with event counts."""
    ev = views.hourly(spark, sf).withColumn("day", F.to_date("ts"))
    counts = ev.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    # one row: the span of the data
    span = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    axis = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    joined = axis.join(counts, "day", "left")
    return joined.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


# --- climate comparison ---------------------------------------------------------------------


@query(f"{STORMS} SELECT climate, year, month, count(*) AS n_storms, count(*) FILTER (max_uh > 75) AS n_over_75, count(*) FILTER (max_uh > 60) AS n_over_60 FROM v_storm GROUP BY ALL")
def storm_counts(spark, sf):
    return CL.storm_counts(views.storms(spark, sf), ["climate", "year", "month"], "max_uh", [75, 60])


@query(f"{STORMS} SELECT climate, month, count(*) AS n_storms, count(*) FILTER (max_uh > 75) AS n_over_75 FROM v_storm GROUP BY ALL")
def storms_by_month(spark, sf):
    counts = CL.storm_counts(views.storms(spark, sf), ["climate", "year", "month"], "max_uh", [75])
    return CL.by_month(counts, columns=["n_storms", "n_over_75"])


@query(f"{STORMS} SELECT climate, year, month, {r('avg(min_ctt) FILTER (max_uh > 110)', 'mean_value')} FROM v_storm GROUP BY climate, year, month")
def mean_cold_top(spark, sf):
    """Mean coldest top of rotating storms per year and month."""
    return CL.mean_where(views.storms(spark, sf), ["climate", "year", "month"], "min_ctt", "max_uh", 110)


@query(f"""{STORMS} SELECT climate, month, {r('avg(m)', 'mean_value')} FROM (SELECT climate, year, month, avg(min_ctt) AS m FROM v_storm WHERE max_uh > 110 GROUP BY ALL)
GROUP BY climate, month""")
def mean_of_monthly_means(spark, sf):
    rotating = views.storms(spark, sf).filter("max_uh > 110")
    return CL.mean_of_means(rotating, ["climate", "year", "month"], ["climate", "month"], "min_ctt")


@query(f"{STORMS} SELECT month, sum(n) FILTER (climate = 'current')::BIGINT AS current, sum(n) FILTER (climate = 'future')::BIGINT AS future, (sum(n) FILTER (climate = 'future') - sum(n) FILTER (climate = 'current'))::BIGINT AS delta FROM (SELECT climate, month, count(*) AS n FROM v_storm GROUP BY ALL) GROUP BY month")
def monthly_delta(spark, sf):
    counts = CL.storm_counts(views.storms(spark, sf), ["climate", "month"])
    return CL.climate_delta(counts, ["month"], "n_storms")


@query(f"""{STORMS}, c AS (SELECT year, month, count(*) AS n FROM v_storm WHERE climate = 'current' AND max_uh > 110 GROUP BY ALL),
f AS (SELECT year, month, count(*) AS n FROM v_storm WHERE climate = 'future' AND max_uh > 110 GROUP BY ALL)
SELECT year, month, c.n AS n_storms_c, f.n AS n_storms_f FROM c FULL JOIN f USING (year, month)""")
def climate_pairs(spark, sf):
    counts = CL.storm_counts(views.storms(spark, sf).filter("max_uh > 110"), ["climate", "year", "month"])
    one = lambda c: counts.filter(F.col("climate") == c).drop("climate")
    return CL.climate_pairs(one("current"), one("future"), ["year", "month"])


# --- fields ---------------------------------------------------------------------------------


@query(f"{GRID} SELECT ts, row, col, {r('value', 'value')} FROM v_grid WHERE row >= 1 AND row < 7 AND col >= 2 AND col < 8")
def crop(spark, sf):
    return O.crop(views.grid(spark, sf), 1, 7, 2, 8)


@query(f"{LEV} SELECT ts, row, col, {r('u', 'u')} FROM v_lev WHERE level = 2")
def at_level(spark, sf):
    return O.at_level(views.levels(spark, sf), 2).select("ts", "row", "col", "u")


@query(f"{LEV} SELECT ts, row, col, {r('max(w)', 'value')} FROM v_lev GROUP BY ts, row, col")
def column_maximum(spark, sf):
    return O.column_maximum(views.levels(spark, sf), CELL, "w")


@query(f"{LEV}, {views.TERRAIN_SQL} SELECT ts, level, row, col, {r('z - hgt_m', 'z')} FROM v_lev JOIN v_terrain USING (row, col)")
def height_above_ground(spark, sf):
    return O.height_agl(views.levels(spark, sf), views.terrain(spark, sf)).select("ts", "level", "row", "col", "z")


INTERP = """seg AS (SELECT ts, row, col, z AS z0, lead(z) OVER w AS z1, u AS u0, lead(u) OVER w AS u1 FROM v_lev WINDOW w AS (PARTITION BY ts, row, col ORDER BY level)),
hits AS (SELECT ts, row, col, h, u0 + (u1 - u0) * ((h - z0) / (z1 - z0)) AS value FROM seg, (VALUES (1000), (3000), (5000), (7000)) t(h) WHERE z0 <= h AND h < z1)"""


@query(f"""{LEV}, {INTERP} SELECT c.ts, c.row, c.col, t.h AS level_m, {r('hits.value', 'value')} FROM (SELECT DISTINCT ts, row, col FROM v_lev) c
CROSS JOIN (VALUES (1000), (3000), (5000), (7000)) t(h) LEFT JOIN hits ON hits.ts = c.ts AND hits.row = c.row AND hits.col = c.col AND hits.h = t.h""")
def interpolated_levels(spark, sf):
    return O.interp_levels(views.levels(spark, sf), CELL, "z", "u")


@query(f"""{LEV}, {INTERP} SELECT c.ts, c.row, c.col, {r('hits.value', 'value')} FROM (SELECT DISTINCT ts, row, col FROM v_lev) c
LEFT JOIN hits ON hits.ts = c.ts AND hits.row = c.row AND hits.col = c.col AND hits.h = 3000""")
def interpolated_column_arrays(spark, sf):
    """The same interpolation on level arrays, without a window."""
    columns = O.to_columns(views.levels(spark, sf), CELL, ["z", "u"])
    return columns.select(*CELL, O.interp_at("z", "u", 3000.0).alias("value"))


VORT = """vx AS (SELECT *, CASE WHEN lead(col) OVER wx = col + 1 AND lag(col) OVER wx = col - 1 THEN (lead(v) OVER wx - lag(v) OVER wx) / 8000.0::DOUBLE END AS dvdx,
  CASE WHEN lead(row) OVER wy = row + 1 AND lag(row) OVER wy = row - 1 THEN (lead(u) OVER wy - lag(u) OVER wy) / 8000.0::DOUBLE END AS dudy
  FROM v_lev WINDOW wx AS (PARTITION BY ts, level, row ORDER BY col), wy AS (PARTITION BY ts, level, col ORDER BY row))"""


@query(f"{LEV}, {VORT} SELECT ts, level, row, col, {r('(dvdx - dudy) * 1000', 'vort')} FROM vx")
def vertical_vorticity(spark, sf):
    spun = O.vertical_vorticity(views.levels(spark, sf), ["ts", "level"])
    return spun.select("ts", "level", "row", "col", (F.col("vort") * 1000).alias("vort"))


def _uh(low, high):
    return f"""{LEV}, {VORT}, q AS (SELECT ts, row, col, z AS z0, lead(z) OVER w AS z1, w * (dvdx - dudy) AS q0, lead(v_lev_w * (dvdx - dudy)) OVER w AS q1
  FROM (SELECT *, w AS v_lev_w FROM vx) WINDOW w AS (PARTITION BY ts, row, col ORDER BY level)),
c AS (SELECT *, greatest(z0, {low}) AS lo, least(z1, {high}) AS hi FROM q)
SELECT ts, row, col, {r('sum(CASE WHEN z1 > z0 AND hi > lo THEN (q0 + (q1 - q0) / (z1 - z0) * (lo - z0) + q0 + (q1 - q0) / (z1 - z0) * (hi - z0)) * 0.5 * (hi - lo) END)', 'value')}
FROM c GROUP BY ts, row, col"""


@query(_uh(2000, 5000))
def updraft_helicity(spark, sf):
    return O.updraft_helicity(views.levels(spark, sf), ["ts"])


@query(_uh(0, 3000))
def updraft_helicity_low(spark, sf):
    return O.updraft_helicity(views.levels(spark, sf), ["ts"], *O.UH03, tile=2)


CTT = """a AS (SELECT *, lag(p) OVER w AS pa, lag(tk) OVER w AS ta FROM v_lev WINDOW w AS (PARTITION BY ts, row, col ORDER BY level DESC)),
b AS (SELECT *, coalesce((40.0::DOUBLE * qcloud + 60.0::DOUBLE * qice) * 1000 * ((p - pa) / 9.81::DOUBLE), 0) / 1000 AS tau FROM a),
c AS (SELECT *, sum(tau) OVER (PARTITION BY ts, row, col ORDER BY level DESC) AS depth FROM b),
x AS (SELECT ts, row, col, coalesce(ta + (tk - ta) * ((1 - (depth - tau)) / tau), tk) - 273.15 AS t FROM c WHERE depth >= 1 AND depth - tau < 1)"""


@query(f"""{LEV}, {CTT} SELECT k.ts, k.row, k.col, {r('x.t', 'value')} FROM (SELECT DISTINCT ts, row, col FROM v_lev) k LEFT JOIN x ON x.ts = k.ts AND x.row = k.row AND x.col = k.col""")
def cloud_top_temperature(spark, sf):
    return O.cloud_top_temperature(views.levels(spark, sf), CELL, 0.04, 0.06)


@query(f"""{GRID}, k AS (SELECT * FROM (VALUES (-1, 0, 1.0::DOUBLE), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0), (0, 0, -4.0)) t(dr, dc, w))
SELECT a.ts, a.row, a.col, {r('CASE WHEN count(b.value) = 5 THEN sum(b.value * k.w) END', 'value')}
FROM v_grid a CROSS JOIN k LEFT JOIN v_grid b ON b.ts = a.ts AND b.row = a.row + k.dr AND b.col = a.col + k.dc GROUP BY a.ts, a.row, a.col""")
def stencil(spark, sf):
    """Five-point Laplacian, NULL on the edge."""
    weights = {(-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0, (0, 0): -4.0}
    return O.stencil(views.grid(spark, sf), ["ts"], weights)


@query(f"""{GRID}, g AS (SELECT i AS d, exp(-0.5 * i * i) AS w FROM range(-4, 5) t(i)),
k AS (SELECT a.d AS dr, b.d AS dc, a.w * b.w AS w FROM g a, g b)
SELECT a.ts, a.row, a.col, {r('sum(b.value * k.w) / sum(k.w)', 'value')}
FROM v_grid a CROSS JOIN k JOIN v_grid b ON b.ts = a.ts AND b.row = a.row + k.dr AND b.col = a.col + k.dc GROUP BY a.ts, a.row, a.col""")
def gaussian_smooth(spark, sf):
    return O.gaussian_smooth(views.grid(spark, sf), ["ts"])


@query(f"{GRID} SELECT ts, row, col, {r('greatest(value, 0)', 'clipped')} FROM v_grid")
def clip_negatives(spark, sf):
    return views.grid(spark, sf).select(*CELL, clip_negative("value").alias("clipped"))


@query(f"{GRID} SELECT ts, {r('max(value)', 'top')}, {r('median(value)', 'middle')} FROM v_grid GROUP BY ts")
def map_slices(spark, sf):
    """A pandas function per time slice."""

    def summary(pixels):
        import pandas as pd

        return pd.DataFrame({"ts": [pixels["ts"].iat[0]], "top": [pixels["value"].max()], "middle": [pixels["value"].median()]})

    return O.map_slices(views.grid(spark, sf).select("ts", "value"), summary, ["ts"], "ts long, top double, middle double")


# --- objects and patches --------------------------------------------------------------------

LOW, HIGH = 0.05, 0.15
ACTIVE = f"px AS (SELECT *, row * 1048576::BIGINT + col AS id FROM v_grid WHERE value >= {LOW})"
COMPONENTS = f"""{ACTIVE},
adj AS (SELECT a.ts, a.id AS s, b.id AS t FROM px a JOIN px b ON a.ts = b.ts AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
reach AS (SELECT ts, s, t FROM adj UNION SELECT r.ts, r.s, j.t FROM reach r JOIN adj j ON j.ts = r.ts AND j.s = r.t),
lab AS (SELECT px.*, o.obj FROM px JOIN (SELECT ts, s, min(t) AS obj FROM reach GROUP BY ts, s) o ON o.ts = px.ts AND o.s = px.id),
hyst AS (SELECT * FROM lab WHERE (ts, obj) IN (SELECT (ts, obj) FROM lab GROUP BY ts, obj HAVING max(value) >= {HIGH}))"""


@query(f"WITH RECURSIVE {views.GRID_SQL}, {COMPONENTS} SELECT ts, row, col, {r('value', 'value')}, obj FROM hyst")
def storm_objects_hysteresis(spark, sf):
    """Connected regions above the low threshold that reach the high one."""
    return OB.storm_objects(views.grid(spark, sf), ["ts"], "hyst", low=LOW, high=HIGH)


BASINS = f"""{ACTIVE},
best AS (SELECT a.ts, a.id, a.row, a.col, a.value, b.id AS nxt, row_number() OVER (PARTITION BY a.ts, a.id ORDER BY b.value DESC, b.id) AS rn
  FROM px a JOIN px b ON a.ts = b.ts AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
ptr AS (SELECT ts, id, row, col, value, nxt FROM best WHERE rn = 1),
walk AS (SELECT ts, id, nxt AS pos, 0 AS step FROM ptr UNION ALL SELECT w.ts, w.id, p.nxt, w.step + 1 FROM walk w JOIN ptr p ON p.ts = w.ts AND p.id = w.pos WHERE p.nxt <> w.pos),
fin AS (SELECT ts, id, arg_max(pos, step) AS obj FROM walk GROUP BY ts, id),
lab AS (SELECT ptr.*, fin.obj FROM ptr JOIN fin USING (ts, id))"""


@query(f"""WITH RECURSIVE {views.GRID_SQL}, {BASINS} SELECT ts, row, col, {r('value', 'value')}, obj FROM lab
WHERE (ts, obj) IN (SELECT (ts, obj) FROM lab GROUP BY ts, obj HAVING max(value) >= {HIGH})""")
def storm_objects_watershed(spark, sf):
    """Basins of steepest ascent whose peak reaches the high threshold."""
    return OB.storm_objects(views.grid(spark, sf), ["ts"], "ws", low=LOW, high=HIGH)


# one claimed pixel a step: the strongest free neighbour of the object, else the highest free peak starts the next one
MAX_PIXELS = 12
GROWTH = f"""grid AS (SELECT vec_id AS ts, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
grow AS (
  SELECT ts, v, list_transform(range(0, 64), lambda i: -1::BIGINT) AS own, -1::BIGINT AS cur, 0 AS area, 0 AS step, true AS going FROM grid
  UNION ALL
  SELECT ts, v, CASE WHEN pick IS NULL THEN own ELSE list_transform(range(0, 64), lambda i: CASE WHEN i = -pick.n THEN (CASE WHEN inside THEN cur ELSE -pick.n END) ELSE own[i + 1] END) END,
    CASE WHEN pick IS NULL OR inside THEN cur ELSE -pick.n END, CASE WHEN inside THEN area + 1 ELSE 1 END, step + 1, pick IS NOT NULL
  FROM (SELECT *, near IS NOT NULL AS inside, coalesce(near, list_max(list_transform(list_filter(range(0, 64), lambda i: own[i + 1] < 0 AND v[i + 1] >= {HIGH}), lambda i: {{'x': v[i + 1], 'n': -i}}))) AS pick
    FROM (SELECT *, CASE WHEN cur >= 0 AND area < {MAX_PIXELS} THEN list_max(list_transform(list_filter(range(0, 64), lambda i: own[i + 1] < 0 AND v[i + 1] >= {LOW}
        AND len(list_filter(range(0, 64), lambda j: own[j + 1] = cur AND abs(i // 8 - j // 8) <= 1 AND abs(i % 8 - j % 8) <= 1)) > 0), lambda i: {{'x': v[i + 1], 'n': -i}})) END AS near
      FROM grow WHERE going)))"""


@query(f"""WITH RECURSIVE {GROWTH}
SELECT ts, CAST(i // 8 AS INT) AS row, CAST(i % 8 AS INT) AS col, {r('v[i + 1]', 'value')}, (own[i + 1] // 8) * 1048576 + own[i + 1] % 8 AS obj
FROM (SELECT * FROM grow WHERE NOT going), range(0, 64) t(i) WHERE own[i + 1] >= 0""")
def storm_objects_growth(spark, sf):
    """Peaks grown by their strongest neighbours to at most twelve pixels."""
    return OB.storm_objects(views.grid(spark, sf), ["ts"], "ew", low=LOW, high=HIGH, max_area=MAX_PIXELS)


@query(f"""WITH RECURSIVE {views.GRID_SQL}, {COMPONENTS},
cen AS (SELECT ts, obj, CAST(floor(avg(row) + 0.5) AS INT) AS r0, CAST(floor(avg(col) + 0.5) AS INT) AS c0 FROM hyst GROUP BY ts, obj),
pix AS (SELECT c.ts, c.obj, g.row - c.r0 + 2 AS y, g.col - c.c0 + 2 AS x, g.row, g.col, g.value, count(*) OVER (PARTITION BY c.ts, c.obj) AS n
  FROM cen c JOIN v_grid g ON g.ts = c.ts AND g.row >= c.r0 - 2 AND g.row < c.r0 + 2 AND g.col >= c.c0 - 2 AND g.col < c.c0 + 2)
SELECT concat_ws(':', p.ts, p.obj) AS patch_id, p.ts, p.obj, p.y, p.x, p.row, p.col, {r('p.value', 'value')}, coalesce(h.obj = p.obj, false) AS in_mask
FROM pix p LEFT JOIN hyst h ON h.ts = p.ts AND h.row = p.row AND h.col = p.col WHERE p.n = 16""")
def extract_patches(spark, sf):
    """Complete 4x4 patches around hysteresis objects, with the own-object mask."""
    grid = views.grid(spark, sf)
    objects = OB.storm_objects(grid, ["ts"], "hyst", low=LOW, high=HIGH)
    return PA.extract_patches(objects, grid, ["ts"], radius=2)




@query(f"""WITH {views.GRID_SQL}, {views.LEVELS_SQL},
b AS (SELECT ts, row, col, value FROM v_grid WHERE ts % 3 = 0 AND row < 4 AND col < 4),
pk AS (SELECT ts, row, col FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY value DESC, row, col) AS rn FROM b) WHERE rn = 1),
ok AS (SELECT ts FROM pk WHERE (row + col) % 2 = 0)
SELECT CAST(b.ts AS VARCHAR) AS patch_id, b.row, b.col, {r('b.value', 'value')}, {r('l.w', 'w')}, {r('m.u', 'u')}
FROM b JOIN ok USING (ts) LEFT JOIN v_lev l ON l.ts = b.ts AND l.row = b.row AND l.col = b.col AND l.level = 1
LEFT JOIN v_lev m ON m.ts = b.ts AND m.row = b.row AND m.col = b.col AND m.level = 2""")
def environment(spark, sf):
    """Two fields gathered at the pixels of three-hourly patches whose peak lies on land."""
    box = O.crop(views.grid(spark, sf), 0, 4, 0, 4)
    pixels = box.select(F.col("ts").cast("string").alias("patch_id"), F.col("ts").alias("hour_idx"), F.col("row").alias("y"), F.col("col").alias("x"), "row", "col", "value")
    lev = views.levels(spark, sf).withColumnRenamed("ts", "hour_idx")
    field = lambda level, name: O.at_level(lev, level).select("hour_idx", "row", "col", F.col(name).alias("value"))
    land = box.select("row", "col").distinct().filter((F.col("row") + F.col("col")) % 2 == 0)
    env = PA.environment(pixels, {"w": field(1, "w"), "u": field(2, "u")}, ["hour_idx", "row", "col"], land=land)
    return env.select("patch_id", "row", "col", "value", "w", "u")


BUCKETS = 8


@query(f"""WITH {views.GRID_SQL}, {views.LEVELS_SQL}
SELECT g.ts, g.row, g.col, {r('g.value', 'value')}, {r('m.value', 'mirror')}, {r('l.w', 'w')} FROM v_grid g
JOIN v_grid m ON m.ts = g.ts AND m.row = 7 - g.row AND m.col = 7 - g.col
LEFT JOIN v_lev l ON l.ts = g.ts AND l.level = 1 AND l.row = g.row AND l.col = g.col WHERE g.ts % 3 = 0""")
def environment_bucketed(spark, sf):
    """Two fields gathered at every pixel of the three-hourly grids from matching buckets."""
    grid = views.grid(spark, sf)
    flipped = grid.select("ts", (7 - F.col("row")).alias("row"), (7 - F.col("col")).alias("col"), "value")
    upward = O.at_level(views.levels(spark, sf), 1).select(*CELL, F.col("w").alias("value"))
    fields = {name: bucketed(field, BUCKETS, CELL) for name, field in (("mirror", flipped), ("w", upward))}
    return PA.gather_bucketed(bucketed(grid.filter(TI.is_step_index("ts")), BUCKETS, CELL), fields, CELL)


@query(f"{GRID} SELECT ts, row, col, {r('value', 'value')} FROM v_grid WHERE ts >= 16 AND ts < 112 AND row >= 2 AND row < 5 AND col >= 1 AND col < 4")
def clustered_crop(spark, sf):
    """A box in time and space out of all grids, stored along a Z curve."""
    path = f"{shared_folder(spark)}/clustered-{uuid.uuid4().hex}"
    write_clustered(views.grid(spark, sf), path, CELL)
    return O.crop(spark.read.parquet(path).filter("ts >= 16 AND ts < 112"), 2, 5, 1, 4)


# level cells are twice as wide as those of the grid; the 8x8 domain spans the square of the polygons
FINE = "row, col, 12.5::DOUBLE * row + 6.25 AS lat, 12.5::DOUBLE * col + 6.25 AS lon"
LABEL_ABOVE = 0.002


def _fine(field):
    cells = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1)])
    wide = field.select("ts", "row", "col", F.round("value", 6).alias("value"), F.inline(cells))
    return wide.select("ts", (F.col("row") * 2 + F.col("dr")).alias("row"), (F.col("col") * 2 + F.col("dc")).alias("col"), "value")


@query(f"""WITH RECURSIVE {views.GRID_SQL}, {COMPONENTS}, {views.POLYGONS_SQL},
cen AS (SELECT ts, obj, CAST(floor(avg(row) + 0.5) AS INT) AS r0, CAST(floor(avg(col) + 0.5) AS INT) AS c0 FROM hyst GROUP BY ts, obj),
pix AS (SELECT c.ts, c.obj, g.row - c.r0 + 2 AS y, g.col - c.c0 + 2 AS x, g.row, g.col, g.value, count(*) OVER (PARTITION BY c.ts, c.obj) AS n
  FROM cen c JOIN v_grid g ON g.ts = c.ts AND g.row >= c.r0 - 2 AND g.row < c.r0 + 2 AND g.col >= c.c0 - 2 AND g.col < c.c0 + 2 WHERE c.ts % 3 = 0),
cells AS (SELECT {FINE} FROM (SELECT CAST(a.i AS INT) AS row, CAST(b.i AS INT) AS col FROM range(0, 8) a(i), range(0, 8) b(i))),
land AS (SELECT DISTINCT row, col FROM (
  SELECT row, col, poly_id, count(*) FILTER ((y0 > lat) <> (y1 > lat) AND lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0) AS n
  FROM cells JOIN v_edge ON lat BETWEEN least(y0, y1) AND greatest(y0, y1) GROUP BY ALL) WHERE n % 2 = 1),
peak AS (SELECT ts, obj, row, col FROM (SELECT *, row_number() OVER (PARTITION BY ts, obj ORDER BY value DESC, y, x) AS rn FROM pix WHERE n = 16) WHERE rn = 1),
uh25 AS ({_uh(2000, 5000)}), uh03 AS ({_uh(0, 3000)}),
ctt AS ({LEV}, {CTT} SELECT k.ts, k.row, k.col, {r('x.t', 'value')} FROM (SELECT DISTINCT ts, row, col FROM v_lev) k LEFT JOIN x ON x.ts = k.ts AND x.row = k.row AND x.col = k.col),
got AS (SELECT p.*, c.lat, c.lon, a.value AS uh25, b.value AS uh03, t.value AS ctt FROM pix p JOIN peak k USING (ts, obj) JOIN land d ON d.row = k.row AND d.col = k.col
  JOIN cells c ON c.row = p.row AND c.col = p.col
  LEFT JOIN uh25 a ON a.ts = p.ts AND a.row = p.row // 2 AND a.col = p.col // 2 LEFT JOIN uh03 b ON b.ts = p.ts AND b.row = p.row // 2 AND b.col = p.col // 2
  LEFT JOIN ctt t ON t.ts = p.ts AND t.row = p.row // 2 AND t.col = p.col // 2)
SELECT concat_ws(':', g.ts, g.obj) AS patch_id, g.ts, g.y, g.x, g.row, g.col, g.lat, g.lon, {r('g.value', 'value')}, coalesce(h.obj = g.obj, false) AS in_mask,
  {r('g.uh25', 'uh25')}, {r('g.uh03', 'uh03')}, {r('g.ctt', 'ctt')}, g.ts AS start_hour, g.ts AS end_hour, 0 AS x_speed, 0 AS y_speed,
  CAST(coalesce(max(g.uh25) OVER (PARTITION BY g.ts, g.obj) > {LABEL_ABOVE}, false) AS INT) AS label
FROM got g LEFT JOIN hyst h ON h.ts = g.ts AND h.row = g.row AND h.col = g.col""")
def storm_environment(spark, sf):
    """The whole storm chain on whole grids: objects, patches, three-hourly land storms, coordinates, co-located rotation and cloud tops, label."""
    grid, levels = views.grid(spark, sf), views.levels(spark, sf)
    objects = OB.storm_objects(grid, ["ts"], "hyst", low=LOW, high=HIGH)
    pixels = PA.extract_patches(objects, grid, ["ts"], radius=2)
    axis = F.explode(F.sequence(F.lit(0), F.lit(7)))
    cells = spark.range(1).select(axis.alias("row")).select("row", axis.alias("col"))
    cells = cells.select("row", "col", (F.col("row") * 12.5 + 6.25).alias("lat"), (F.col("col") * 12.5 + 6.25).alias("lon"))
    fields = {
        "uh25": _fine(O.updraft_helicity(levels, ["ts"])), "uh03": _fine(O.updraft_helicity(levels, ["ts"], *O.UH03)),
        "ctt": _fine(O.cloud_top_temperature(levels, CELL, 0.04, 0.06)),
    }
    env = PA.environment(pixels, fields, CELL, hour="ts", land=PA.land_cells(cells, views.polygons(spark, sf)))
    labelled = PA.label_pixels(PA.with_hours(PA.with_coordinates(env, cells), "ts"), "uh25", LABEL_ABOVE)
    return labelled.drop("obj")


@query(f"""{LEV} SELECT ts, row, col, {r('max(u) FILTER (level = 1)', 'temp_1')}, {r('max(u) FILTER (level = 3)', 'temp_3')} FROM v_lev GROUP BY ts, row, col""")
def attach_levels(spark, sf):
    """One variable attached at two levels."""
    lev = views.levels(spark, sf)
    pixels = O.at_level(lev, 0).select(*CELL)
    field = lev.select(*CELL, (F.col("level") * 1000).alias("level_m"), F.col("u").alias("value"))
    return PA.attach_levels(pixels, field, CELL, [1000, 3000], "temp")


@query(f"""WITH {views.POINTS_SQL}, {views.POLYGONS_SQL}
SELECT point_id, poly_id FROM (
  SELECT point_id, poly_id, count(*) FILTER ((y0 > py) <> (y1 > py) AND px < (x1 - x0) * (py - y0) / (y1 - y0) + x0) AS n
  FROM v_point JOIN v_edge ON py BETWEEN least(y0, y1) AND greatest(y0, y1) GROUP BY point_id, poly_id) WHERE n % 2 = 1""")
def points_in_polygons(spark, sf):
    return PA.points_in_polygons(views.points(spark, sf), views.polygons(spark, sf), "point_id")


@query(f"""WITH {views.POLYGONS_SQL}, cells AS (SELECT CAST(y AS INT) AS row, CAST(x AS INT) AS col, x + 0.25::DOUBLE AS lon, y + 0.25::DOUBLE AS lat FROM range(0, 100) a(x), range(0, 100) b(y))
SELECT DISTINCT row, col FROM (
  SELECT row, col, poly_id, count(*) FILTER ((y0 > lat) <> (y1 > lat) AND lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0) AS n
  FROM cells JOIN v_edge ON lat BETWEEN least(y0, y1) AND greatest(y0, y1) GROUP BY ALL) WHERE n % 2 = 1""")
def land_cells(spark, sf):
    """Cells of a 100x100 grid inside any polygon."""
    axis = F.explode(F.sequence(F.lit(0), F.lit(99)))
    cells = spark.range(1).select(axis.alias("row")).select("row", axis.alias("col"))
    grid = cells.select("row", "col", (F.col("col") + 0.25).alias("lon"), (F.col("row") + 0.25).alias("lat"))
    return PA.land_cells(grid, views.polygons(spark, sf))


@query(f"""WITH {views.PATCHES_SQL}, pk AS (SELECT patch_id, min(i) AS i FROM (SELECT *, max(v) OVER (PARTITION BY patch_id) AS mx FROM v_px) WHERE v = mx GROUP BY patch_id)
SELECT patch_id FROM pk WHERE (i // 8 + i % 8) % 3 = 0""")
def patches_on_land(spark, sf):
    """Patches whose strongest pixel is a land cell."""
    p = views.patches(spark, sf)
    index = lambda f: F.transform("values", f)
    located = p.withColumns({
        "rows": index(lambda v, i: F.floor(i / 8).cast("int")), "cols": index(lambda v, i: (i % 8).cast("int")), "dbz": F.col("values"),
    })
    land = views.grid(spark, sf).select("row", "col").distinct().filter((F.col("row") + F.col("col")) % 3 == 0)
    return PA.on_land(located, land, views.WIDTH).select("patch_id")


@query(f"{GRID} SELECT ts AS patch_id, {r('value', 'value')}, CAST(row AS INT) AS y, CAST(col AS INT) AS x FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY value DESC, row, col) AS rn FROM v_grid) WHERE rn = 1")
def strongest_pixel(spark, sf):
    g = views.grid(spark, sf).select(F.col("ts").alias("patch_id"), F.col("row").alias("y"), F.col("col").alias("x"), "value")
    return PA.strongest_pixel(g)


@query(f"WITH {views.PATCHES_SQL} SELECT patch_id, {r('max(CASE WHEN patch_id % 11 = 0 AND i = 3 THEN NULL ELSE v END)', 'top')}, count(CASE WHEN patch_id % 11 = 0 AND i = 3 THEN NULL ELSE v END) AS n FROM v_px GROUP BY patch_id")
def clean_missing(spark, sf):
    """NaN becomes missing at ingest, so maxima ignore it."""
    p = views.patches(spark, sf)
    broken = F.transform("values", lambda v, i: F.when((F.col("patch_id") % 11 == 0) & (i == 3), float("nan")).otherwise(v))
    cleaned = p.select("patch_id", A.clean(broken).alias("values"))
    return cleaned.select("patch_id", A.pixel_max("values").alias("top"), F.size(F.filter("values", lambda v: v.isNotNull())).cast("bigint").alias("n"))
