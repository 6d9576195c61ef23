"""Patch queries: labels, masks, features, extremes, maps, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchscope.functions import arrays as A
from patchscope.functions.expressions import to_grams, to_hectopascal
from patchscope.operators import climate as CL
from patchscope.operators import curves as C
from patchscope.operators import importance as P
from patchscope.operators import patches as O
from patchscope.operators import scaling
from patchscope.operators import verification as V
from patchscope.operators.relational import keyed_join
from patchscope.plans import views
from patchscope.plans.catalog import SCALAR_COLUMNS, counts_sql, query, r
from patchscope.sources import schema as S

PX = f"WITH {views.PATCHES_SQL}"
PFC = f"WITH {views.PATCH_FORECAST_SQL}"


@query(f"""{PX} SELECT patch_id, CAST(max(v) > 0.3 AS INT) AS label, CAST(count(g) = 64 AND max(g) > 0.3 AS INT) AS label_gappy,
  coalesce(max(CASE WHEN r > 0 THEN v END) > 0.3, false) AS label_masked FROM v_px GROUP BY patch_id""")
def label_patches(spark, sf):
    """Threshold labels: whole patch, patch with a missing pixel, and inside a mask."""
    p = views.patches(spark, sf).withColumn("outer", F.transform("mirror", lambda v: v > 0))
    whole = O.label_patches(p, "values", 0.3)
    return whole.select(
        "patch_id", "label", A.exceeds("gappy", 0.3).cast("int").alias("label_gappy"), A.exceeds("values", 0.3, "outer").alias("label_masked")
    )


@query(f"{PX} SELECT patch_id, climate FROM v_px GROUP BY patch_id, climate HAVING count(g) = 64 AND max(g) > 0.3")
def exceeding_patches(spark, sf):
    return O.exceeding(views.patches(spark, sf), "gappy", 0.3).select("patch_id", "climate")


@query(f"{PX} SELECT patch_id, climate FROM v_px GROUP BY patch_id, climate HAVING NOT coalesce(count(g) = 64 AND max(g) > 0.3, false)")
def not_exceeding_patches(spark, sf):
    return O.not_exceeding(views.patches(spark, sf), "gappy", 0.3).select("patch_id", "climate")


@query(f"{PX} SELECT patch_id FROM v_px GROUP BY patch_id HAVING count(g) = 64")
def drop_incomplete(spark, sf):
    return O.drop_incomplete(views.patches(spark, sf), ["values", "gappy"]).select("patch_id")


@query(f"{PX} SELECT count(*) AS incomplete FROM (SELECT patch_id FROM v_px GROUP BY patch_id HAVING count(g) < 64)")
def incomplete_patches(spark, sf):
    return O.incomplete_count(views.patches(spark, sf), ["values", "gappy"])


@query(f"{PX} SELECT patch_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {r('CASE WHEN m THEN r ELSE 0 END', 'filled')}, {r('CASE WHEN m THEN r END', 'blanked')} FROM v_px")
def masked_pixels(spark, sf):
    """Out-of-storm pixels zeroed and, separately, set missing."""
    p = views.patches(spark, sf)
    both = O.apply_mask(p.withColumns({"filled": F.col("mirror"), "blanked": F.col("mirror")}), ["filled"], "mask", 0.0)
    both = O.apply_mask(both, ["blanked"], "mask", None)
    return O.unpack_patches(both, ["patch_id"], ["filled", "blanked"], views.WIDTH)


@query(f"{PX} SELECT patch_id, {r('max(g)', 'max_value')}, {r('min(g)', 'min_value')}, {r('avg(g)', 'mean_value')} FROM v_px GROUP BY patch_id")
def patch_stats(spark, sf):
    p = views.patches(spark, sf)
    return p.select("patch_id", A.pixel_max("gappy").alias("max_value"), A.pixel_min("gappy").alias("min_value"), A.pixel_mean("gappy").alias("mean_value"))


STEMS = [f"{stem}_{km}" for stem in ("temp", "evwd", "euwd", "qvap", "pres") for km in S.LEVELS_KM] + ["maxw", "dbzs", "ctts", "uh25"]


def environment_patches(spark, sf):
    """All 24 arrays of a patch, each an affine copy of the embedding."""
    p = views.patches(spark, sf)
    affine = lambda k: F.transform("values", lambda v: v * (k + 1.0) + k * 0.5)
    return p.withColumns({name: affine(k) for k, name in enumerate(STEMS)})


_mean = lambda k: f"avg(v * ({k} + 1.0::DOUBLE) + {k} * 0.5::DOUBLE)"
_top = lambda k: f"max(v * ({k} + 1.0::DOUBLE) + {k} * 0.5::DOUBLE)"
_names = [f"{short}_{km}km" for short in ("tk", "ev", "eu", "qv", "pr") for km in S.LEVELS_KM]


@query(f"""{PX} SELECT patch_id, {', '.join(r(_mean(k), n) for k, n in enumerate(_names))}, {r(_top(20), 'w_max')}, {r(_top(21), 'dbz_max')},
  {r(_mean(21), 'dbz_mean')}, {r(_top(22), 'ctt_max')}, {r(_mean(22), 'ctt_mean')}, {r(_top(23), 'uh25_max')} FROM v_px GROUP BY patch_id""")
def tabular_features(spark, sf):
    """The 26-column feature table."""
    return O.tabular_features(environment_patches(spark, sf))


@query(f"""{PX}, t AS (SELECT patch_id, climate, sqrt((max(CASE WHEN m THEN v * 2 END) - max(CASE WHEN m THEN v END)) ** 2
    + (max(CASE WHEN m THEN r * 3 END) - max(CASE WHEN m THEN r END)) ** 2) AS shear,
  max(CASE WHEN m THEN v END) * 0.5 + 10 AS peak, min(CASE WHEN m THEN r END) AS cold FROM v_px GROUP BY patch_id, climate)
SELECT patch_id, climate, {r('shear', 'shear')}, {r('peak', 'peak')}, {r('peak * 1000', 'grams')}, {r('cold', 'ctts_extreme')} FROM t""")
def storm_extremes(spark, sf):
    """In-storm extremes in physical units, bulk shear, moisture in g/kg."""
    p = views.patches(spark, sf).withColumns({
        "u5": F.transform("values", lambda v: v * 2), "v5": F.transform("mirror", lambda v: v * 3), "ctts": F.col("mirror"),
    })
    p = O.storm_shear(p, "values", "mirror", "u5", "v5")
    p = O.storm_extreme(p, ["values", "ctts"])
    peak = F.col("values_extreme") * 0.5 + 10
    return p.select("patch_id", "climate", "shear", peak.alias("peak"), to_grams(peak).alias("grams"), "ctts_extreme")


@query(f"""{PX}, st AS (SELECT avg(v) AS mean, stddev_pop(v) AS std FROM v_px)
SELECT climate, 'values' AS feature, {r('median(v) FILTER (m)', 'median')} FROM v_px GROUP BY climate
UNION ALL SELECT climate, 'mirror', {r('median(r) FILTER (m) * 1000', 'median')} FROM v_px GROUP BY climate""")
def feature_medians(spark, sf):
    """In-storm medians per climate, scaled back to physical units."""
    p = views.patches(spark, sf)
    scaler = scaling.fit_scaler(p, None, ["values", "mirror"])
    return O.feature_medians(scaling.apply_scaler(p, scaler, ["values", "mirror"]), scaler, ["climate"], ["values", "mirror"], grams=["mirror"])


@query(f"{PX} SELECT climate, {r('median(v)', 'median')} FROM v_px GROUP BY climate")
def feature_medians_unmasked(spark, sf):
    p = views.patches(spark, sf)
    scaler = scaling.fit_scaler(p, None, ["values"])
    scaled = scaling.apply_scaler(p, scaler, ["values"])
    return O.feature_medians(scaled, scaler, ["climate"], ["values"], mask=None).select("climate", "median")


OUT = """pk AS (SELECT patch_id, any_value(climate) AS climate, any_value(member) AS member, max(CASE WHEN m THEN r END) * 2.0::DOUBLE + 5.0::DOUBLE AS peak FROM v_px GROUP BY patch_id),
outl AS (SELECT * FROM (SELECT *, quantile_cont(peak, 0.9) OVER (PARTITION BY climate, member) AS cut FROM pk WHERE peak IS NOT NULL) WHERE peak >= cut)"""


@query(f"{PX}, {OUT} SELECT patch_id, climate, member, {r('peak', 'moisture_peak')}, {r('cut', 'cut')} FROM outl")
def moisture_outliers(spark, sf):
    """Patches whose in-storm moisture peak is in their member's top tenth."""
    p = views.patches(spark, sf)
    found = O.moisture_outliers(p, ["climate", "member"], "mirror", F.lit(5.0), F.lit(2.0), percentile=90)
    return found.select("patch_id", "climate", "member", "moisture_peak", "cut")


@query(f"""{PFC}, {OUT}, fo AS (SELECT v_pfc.* FROM v_pfc SEMI JOIN outl USING (patch_id))
SELECT climate, {SCALAR_COLUMNS} FROM ({counts_sql('fo', 'climate')})""")
def outlier_evaluation(spark, sf):
    """Scores on the moisture outliers only."""
    p = views.patches(spark, sf)
    found = O.moisture_outliers(p, ["climate", "member"], "mirror", F.lit(5.0), F.lit(2.0), percentile=90)
    forecasts = views.patch_forecast(spark, sf).join(found.select("patch_id"), "patch_id", "left_semi")
    return V.scalar_scores(V.confusion(forecasts, ["climate"]))


@query(f"""WITH {views.FORECAST_SQL}, q AS (SELECT *, quantile_cont(prob, 0.99) OVER (PARTITION BY climate, member) AS cut FROM v_forecast)
SELECT row_key, climate, member, {r('prob', 'prob')}, {r('cut', 'cut')} FROM q WHERE prob >= cut""")
def top_percentile(spark, sf):
    rows = views.forecast(spark, sf).select("row_key", "climate", "member", "prob")
    return O.top_percentile(rows, ["climate", "member"], "prob")


OUTCOME = "CASE WHEN prob >= 0.5 AND label = 1 THEN 'tp' WHEN prob >= 0.5 THEN 'fp' WHEN label = 1 THEN 'fn' ELSE 'tn' END"
COMPOSED = f"""comp AS (SELECT p.patch_id, p.climate, o.outcome, o.conf, p.i, p.y, p.x, p.v, p.m, p.r
  FROM v_px p JOIN (SELECT *, {OUTCOME} AS outcome, CASE WHEN prob >= 0.5 THEN prob >= 0.9 ELSE prob < 0.1 END AS conf FROM v_pfc) o USING (patch_id))"""


def _composed(spark, sf):
    forecasts = views.patch_forecast(spark, sf).select("patch_id", "prob", "label")
    return V.composites(forecasts, views.patches(spark, sf))


@query(f"""{PFC}, e AS (SELECT patch_id, any_value(climate) AS climate, max(v) AS mx FROM v_px GROUP BY patch_id),
o AS (SELECT *, {OUTCOME} AS outcome, CASE WHEN prob >= 0.5 THEN prob >= 0.99 ELSE prob < 0.01 END AS conf FROM v_pfc),
g AS (SELECT patch_id, outcome AS grp FROM o UNION ALL SELECT patch_id, outcome || CASE WHEN outcome IN ('tp', 'fp') THEN '_99' ELSE '_01' END FROM o WHERE conf)
SELECT climate, grp AS "group", count(*) AS n, {r('max(mx)', 'max_value')} FROM g JOIN e USING (patch_id) GROUP BY climate, grp""")
def composite_groups(spark, sf):
    """Size and peak of the eight composite groups."""
    groups = V.composite_groups(_composed(spark, sf))
    return groups.groupBy("climate", "group").agg(F.count(F.lit(1)).alias("n"), F.max(A.pixel_max("values")).alias("max_value"))


@query(f"""{PFC}, {COMPOSED}, mx AS (SELECT patch_id, any_value(climate) AS climate, any_value(outcome) AS outcome, max(v) AS mx FROM comp GROUP BY patch_id),
b AS (SELECT climate, outcome, least(CAST(floor((mx - 0.0) / 0.5 * 20) AS INT), 19) AS bin FROM mx WHERE mx BETWEEN 0.0 AND 0.5)
SELECT k.climate, k.outcome, g.bin, {r('g.bin * 0.025::DOUBLE', 'bin_low')}, count(b.bin) AS n
FROM (SELECT DISTINCT climate, outcome FROM mx) k CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(0, 20)) g
LEFT JOIN b ON b.climate = k.climate AND b.outcome = k.outcome AND b.bin = g.bin GROUP BY ALL""")
def peak_distribution(spark, sf):
    """Histogram of patch maxima per climate and outcome."""
    peaks = _composed(spark, sf).select("climate", "outcome", A.pixel_max("values").alias("peak"))
    return C.histogram(peaks, ["climate", "outcome"], "peak", 0.0, 0.5, 20)


@query(f"""{PFC}, {COMPOSED}, c AS (SELECT climate, outcome, CAST(y AS INT) AS y, CAST(x AS INT) AS x, count(*) FILTER (v >= 0.2) AS n FROM comp GROUP BY ALL)
SELECT *, {r('n::DOUBLE / nullif(max(n) OVER (PARTITION BY climate, outcome), 0)', 'share')} FROM c""")
def exceed_map(spark, sf):
    return O.exceed_map(_composed(spark, sf), ["climate", "outcome"], "values", 0.2, views.WIDTH)


@query(f"{PFC}, {COMPOSED} SELECT climate, outcome, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {r('max(v)', 'value')} FROM comp GROUP BY ALL")
def max_map(spark, sf):
    return O.max_map(_composed(spark, sf), ["climate", "outcome"], "values", views.WIDTH)


SCATTER_N = {"tp": 30, "tn": 30, "fp": 24, "fn": 25}
_case = "CASE outcome " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in SCATTER_N.items()) + " END"
SCATTER = f"""{PFC}, {COMPOSED},
pp AS (SELECT patch_id, climate, outcome, max(v) * 1000 AS moisture, max(r) - min(r) AS shear FROM comp GROUP BY ALL),
hd AS (SELECT *, CAST(row_number() OVER (PARTITION BY outcome, climate ORDER BY patch_id) AS INT) AS position FROM pp)
SELECT outcome, position, max(moisture) FILTER (climate = 'current') AS mc, max(moisture) FILTER (climate = 'future') AS mf,
  max(shear) FILTER (climate = 'current') AS sc, max(shear) FILTER (climate = 'future') AS sf
FROM hd WHERE position <= {_case} GROUP BY outcome, position"""


def _scatter(spark, sf):
    rows = _composed(spark, sf).select(
        "patch_id", "climate", "outcome", to_grams(A.pixel_max("values")).alias("moisture"),
        (A.pixel_max("mirror") - A.pixel_min("mirror")).alias("shear"),
    )
    return CL.climate_scatter(rows, "outcome", SCATTER_N, ["patch_id"], ["moisture", "shear"])


@query(f"SELECT outcome, position, {r('mc', 'moisture_c')}, {r('mf', 'moisture_f')}, {r('sc', 'shear_c')}, {r('sf', 'shear_f')} FROM ({SCATTER})")
def climate_scatter(spark, sf):
    """Moisture and shear pairs by outcome, current beside future."""
    return _scatter(spark, sf)


@query(f"SELECT outcome, {r('median(mc)', 'moisture_c_median')}, {r('median(mf)', 'moisture_f_median')}, {r('median(sc)', 'shear_c_median')}, {r('median(sf)', 'shear_f_median')} FROM ({SCATTER}) GROUP BY outcome")
def scatter_medians(spark, sf):
    return CL.medians(_scatter(spark, sf), ["outcome"], ["moisture_c", "moisture_f", "shear_c", "shear_f"])


@query(f"{PX} SELECT patch_id, CAST(min(i) // 8 AS INT) AS y, CAST(min(i) % 8 AS INT) AS x FROM (SELECT *, max(v) OVER (PARTITION BY patch_id) AS mx FROM v_px) WHERE v = mx GROUP BY patch_id")
def argmax_pixel(spark, sf):
    """First maximum in row-major order."""
    return views.patches(spark, sf).select("patch_id", A.argmax_pixel("values", views.WIDTH).alias("p")).select("patch_id", "p.y", "p.x")


@query(f"{PX} SELECT patch_id, CAST(i AS INT) AS i, {r('CASE WHEN greatest(mv, mr) = 0 THEN NULL ELSE r / greatest(mv, mr) END', 'share')} FROM (SELECT *, max(v) OVER (PARTITION BY patch_id) AS mv, max(r) OVER (PARTITION BY patch_id) AS mr FROM v_px)")
def joint_normalise(spark, sf):
    """A field over the joint maximum of a pair of fields."""
    p = views.patches(spark, sf).withColumn("top", A.joint_max("values", "mirror"))
    share = F.transform("mirror", lambda v: F.try_divide(v, F.col("top")))
    return p.select("patch_id", F.posexplode(share).alias("i", "share"))


@query(f"{PX} SELECT patch_id, CAST(i AS INT) AS k, {r('(v + nxt) * 0.5', 'value')} FROM (SELECT patch_id, i, v, lead(v) OVER (PARTITION BY patch_id ORDER BY i) AS nxt FROM v_px) WHERE nxt IS NOT NULL")
def destagger(spark, sf):
    """Staggered levels to mass levels: 64 values give 63."""
    return views.patches(spark, sf).select("patch_id", F.posexplode(A.destagger("values")).alias("k", "value"))


@query(f"{PX} SELECT patch_id, climate, {r('max(v) * 0.01', 'hpa')}, {r('max(r)', 'other')} FROM v_px GROUP BY patch_id, climate HAVING count(g) = 64")
def assemble_environment(spark, sf):
    """Per-variable tables joined on the patch id, incomplete rows removed."""
    p = views.patches(spark, sf)
    sources = [p.select("patch_id", "climate", "values"), p.select("patch_id", "mirror"), p.select("patch_id", "gappy")]
    frame = O.training_frame(sources, ["values", "mirror", "gappy"])
    return frame.select("patch_id", "climate", to_hectopascal(A.pixel_max("values")).alias("hpa"), A.pixel_max("mirror").alias("other"))


@query(f"""{PX}, f AS (SELECT patch_id, i, v FROM v_px WHERE i < 60 OR patch_id % 7 <> 0) SELECT patch_id, count(*) AS n, {r('sum(v)', 'total')} FROM f GROUP BY patch_id HAVING count(*) = 64""")
def complete_patches(spark, sf):
    """Patches with all their pixels; every seventh lost four."""
    long = O.unpack_patches(views.patches(spark, sf), ["patch_id"], ["values"], views.WIDTH)
    cut = long.filter((F.col("y") * 8 + F.col("x") < 60) | (F.col("patch_id") % 7 != 0))
    return O.complete_patches(cut, "patch_id", 4).groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("values").alias("total"))


@query(f"{PX} SELECT patch_id, CAST(i AS INT) AS i, {r('v', 'value')}, m AS in_mask FROM v_px")
def pack_and_unpack(spark, sf):
    """Arrays to long pixels and back, without loss."""
    long = O.unpack_patches(views.patches(spark, sf), ["patch_id"], ["values", "mask"], views.WIDTH)
    packed = O.pack_patches(long, ["patch_id"], ["values", "mask"])
    pixels = packed.select("patch_id", F.posexplode(F.arrays_zip("values", "mask")).alias("i", "p"))
    return pixels.select("patch_id", "i", F.col("p.values").alias("value"), F.col("p.mask").alias("in_mask"))


@query("""SELECT d.doc_id, d.lang FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1""")
def rows_in_both(spark, sf):
    good = views.table(spark, sf, "labels").filter("quality = 1")
    return P.in_both(views.table(spark, sf, "documents").select("doc_id", "lang"), good, "doc_id")


@query("""SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def rows_only_in(spark, sf):
    labels = views.table(spark, sf, "labels")
    return P.only_in(views.table(spark, sf, "documents"), [labels.filter("quality = 1"), labels.filter("toxic = 1")], "doc_id")


@query(f"""WITH {views.FEATURES_SQL} SELECT quantity, row_key, {r('price', 'price')} FROM (SELECT *, row_number() OVER (PARTITION BY quantity ORDER BY price, row_key) AS rn FROM v_features) WHERE rn = 1""")
def first_occurrence(spark, sf):
    """First row of each distinct value in a given order."""
    return P.first_occurrence(views.features(spark, sf), "quantity", ["price", "row_key"], ["row_key", "price"]).select("quantity", "row_key", "price")


@query("SELECT code, column_stem, short_name, n_levels FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {n})" for a, b, c, n in S.VARIABLES) + f""") v(code, column_stem, short_name, n_levels)
WHERE code IN (SELECT DISTINCT CASE l_returnflag WHEN 'R' THEN 'TK' WHEN 'A' THEN 'QVAPOR' ELSE 'CTT' END FROM lineitem)""")
def variables_in_use(spark, sf):
    """The variables dimension joined to the variables that occur in the data."""
    flags = views.table(spark, sf, "lineitem").select("l_returnflag").distinct()
    code = F.when(F.col("l_returnflag") == "R", "TK").when(F.col("l_returnflag") == "A", "QVAPOR").otherwise("CTT")
    return keyed_join(S.variables(spark), flags.select(code.alias("code")).distinct(), ["code"])


@query(f"{PX} SELECT patch_id, {r('max(v)', 'temp_1')}, {r('max(r)', 'uh25')} FROM v_px GROUP BY patch_id")
def renamed_variables(spark, sf):
    """Model codes become patch column names."""
    p = views.patches(spark, sf).select("patch_id", A.pixel_max("values").alias("TK1"), A.pixel_max("mirror").alias("UH25"))
    return S.rename_variables(p)
