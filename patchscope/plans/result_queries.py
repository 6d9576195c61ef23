"""Queries behind the published result tables: models, outliers, calibration, checked labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchscope.functions.hashing import draw_int
from patchscope.operators import calibration as K
from patchscope.operators import curves as C
from patchscope.operators import importance as P
from patchscope.operators import patches as O
from patchscope.operators import resampling as R
from patchscope.operators import verification as V
from patchscope.operators.ranking import seeded_rank
from patchscope.plans import views
from patchscope.plans.catalog import SCALAR_RAW, brier_sql, counts_sql, curve_sql, query, r
from patchscope.plans.resampling_queries import BIN_CELLS, FEATURES, PERMS, REPS, cell_boot_sql, permuted_sql, start_sql
from patchscope.plans.verification_queries import SWEEP_RAW, sweep_sql
from patchscope.session import checkpointed

KEYS = ["climate", "member"]
# Numbers of the published models (unbalanced, balanced).
UNBALANCED, BALANCED = 25, 13

# --- skill tables: model, climate and outliers as keys ---------------------------------------

SERIES = f"""WITH {views.FORECAST_SQL},
v_cut AS (SELECT *, price >= quantile_cont(price, 0.99) OVER (PARTITION BY climate, member) AS outlier FROM v_features),
v_models AS (SELECT {UNBALANCED} AS model, c.climate, c.member, c.outlier, f.label, f.prob FROM v_cut c JOIN v_forecast f USING (row_key)
  UNION ALL SELECT {BALANCED}, climate, member, outlier, label, {views.SCORER_SQL} FROM v_cut),
v_series AS (SELECT model, climate, 'all' AS series, member, label, prob FROM v_models UNION ALL SELECT model, climate, 'outlier', member, label, prob FROM v_models WHERE outlier)"""
SERIES_KEYS = ["model", "climate", "series"]
KS = "model, climate, series"


def series(spark, sf):
    """Forecasts of two models, once for all rows and once for the outliers: rows in their member's top percentile of a feature."""
    rows = views.features(spark, sf)
    cut = O.outlier_cut(rows, KEYS, "price")
    rows = P.keyed_join(rows, P.small_side(cut), KEYS)
    key = F.col("row_key")
    models = F.array(
        F.struct(F.lit(UNBALANCED).alias("model"), views.blend(F.col("label"), key).alias("prob")),
        F.struct(F.lit(BALANCED).alias("model"), F.col("__linear").alias("prob")))
    rows = views.linear_scorer(rows).withColumnRenamed("prob", "__linear")
    groups = F.when(F.col("price") >= F.col("cut"), F.array(F.lit("all"), F.lit("outlier"))).otherwise(F.array(F.lit("all")))
    return rows.select("climate", "member", "label", groups.alias("groups"), F.inline(models)).select("model", "climate", F.explode("groups").alias("series"), "member", "label", "prob")


SCORED = f"""SELECT s.*, b.* EXCLUDE ({KS}, member) FROM (SELECT {KS}, member, {SCALAR_RAW}, POD AS HitRate FROM ({counts_sql('v_series', KS + ', member')})) s
JOIN ({brier_sql(curve_sql('v_series', KS + ', member'), KS + ', member')}) b USING ({KS}, member)"""
TABLE = ("AUC", "CSI", "HitRate", "Bias", "BSS", "resolution", "uncertainty")


@query(f"""{SERIES} SELECT {KS}, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in C.COUNTS)}, {', '.join(r(f'avg({c})', c) for c in TABLE)}
FROM ({SCORED}) GROUP BY {KS}""")
def published_skill_table(spark, sf):
    """Per model, climate and series: counts summed, scores and Brier parts averaged over members."""
    return C.published_table(series(spark, sf), SERIES_KEYS, digits=None)


# --- evaluation of outliers ------------------------------------------------------------------


@query(f"""{SERIES}, v_out AS (SELECT model * 1000 + member AS member, climate, label, prob FROM v_series WHERE series = 'outlier')
SELECT member // 1000 AS model, climate, member % 1000 AS member, {r('max(CSI)', 'max_csi')} FROM (SELECT climate, member, Threshold, {SWEEP_RAW} FROM ({sweep_sql('v_out', 'climate, member')})) GROUP BY ALL""")
def outlier_sweep(spark, sf):
    """Best CSI over 10 000 thresholds on the outliers of each model, climate and member."""
    rows = series(spark, sf).filter("series = 'outlier'")
    return C.max_csi(V.threshold_sweep(rows, ["model", *KEYS]), ["model", *KEYS])


@query(f"""{SERIES}, v_out AS (SELECT * FROM v_series WHERE series = 'outlier') SELECT model, climate, member, bin, Total_Freq, Positive_Freq, {r('rate', 'Positive_Relative_Freq')}
FROM ({curve_sql('v_out', 'model, climate, member')})""")
def outlier_reliability(spark, sf):
    rows = series(spark, sf).filter("series = 'outlier'")
    return V.reliability_curve(rows, ["model", *KEYS]).select("model", *KEYS, "bin", "Total_Freq", "Positive_Freq", "Positive_Relative_Freq")


OUT_KEYS = "climate, member, rep"
# model and climate stand where the draws expect climate and member
OUT_BOOT = cell_boot_sql(*BIN_CELLS, REPS, SERIES + ", v_source AS (SELECT model AS climate, climate AS member, prob, label FROM v_series WHERE series = 'outlier')", "v_source")
QUANTILES = ", ".join(r(f"quantile_cont({c}, {p})", f"{c}_{n}") for c in ("CSI", "BSS") for p, n in ((0.025, "low"), (0.975, "high")))


@query(f"""{OUT_BOOT} SELECT climate AS model, member AS climate, {QUANTILES} FROM (SELECT {OUT_KEYS}, {SCALAR_RAW} FROM ({counts_sql('v_boot', OUT_KEYS, weight='w')})) s
JOIN ({brier_sql(curve_sql('v_boot', OUT_KEYS, weight='w'), OUT_KEYS)}) b USING ({OUT_KEYS}) GROUP BY climate, member""")
def outlier_bootstrap(spark, sf, reps=REPS):
    """Interval of CSI and BSS over replicates of the outliers, per model and climate."""
    rows = series(spark, sf).filter("series = 'outlier'")
    scores = R.cell_bootstrap_scores(rows, ["model", "climate"], reps)
    return R.envelope(scores, ["model", "climate"], ["CSI", "BSS"], interval=R.INTERVAL)


# --- skill loss, all rows beside the outliers ------------------------------------------------

LOSS_ROWS = f"""WITH {views.FEATURES_SQL},
v_cut AS (SELECT *, price >= quantile_cont(price, 0.99) OVER (PARTITION BY climate, member) AS outlier FROM v_features),
v_frows AS (SELECT 'outlier' AS climate, 0 AS member, row_key, label, quantity, discount, tax,
  row_number() OVER (ORDER BY md5('0:'||row_key), row_key) - 1 AS row_no FROM v_cut WHERE outlier)"""
LOSS = f"""{LOSS_ROWS}, {start_sql()}{permuted_sql('v_move', 'v_start')},
v_perm AS (SELECT m.pfi_var, m.perm, b.label, {', '.join(f"CASE WHEN m.pfi_var = '{f}' THEN d.{f} ELSE b.{f} END AS {f}" for f in FEATURES)}
  FROM v_move m JOIN v_frows b ON b.row_no = m.row_no JOIN v_frows d ON d.row_no = m.orig_row_no),
v_out AS (SELECT *, {views.SCORER_SQL} AS prob FROM v_perm), v_orig AS (SELECT 1 AS one, *, {views.SCORER_SQL} AS prob FROM v_frows),
v_base AS (SELECT {SCALAR_RAW} FROM ({counts_sql('v_orig', '')}))"""


@query(f"""{LOSS} SELECT 'outlier' AS series, p.pfi_var, p.perm, m.metric, {r("greatest(CASE m.metric WHEN 'AUC' THEN b.AUC - p.AUC ELSE b.CSI - p.CSI END, 0)", 'loss')}
FROM (SELECT pfi_var, perm, {SCALAR_RAW} FROM ({counts_sql('v_out', 'pfi_var, perm')})) p, v_base b, (VALUES ('AUC'), ('CSI')) m(metric)""")
def outlier_skill_loss(spark, sf, perms=PERMS):
    """Skill loss by permutation among the outliers only, taken as one member."""
    rows = views.features(spark, sf)
    top = O.top_percentile(rows, KEYS, "price").select("row_key", "label", *FEATURES)
    numbered = seeded_rank(top, "row_key", 0, out="rk").withColumn("row_no", F.col("rk") - 1).drop("rk", "row_key")
    numbered = checkpointed(numbered.withColumns({"climate": F.lit("outlier"), "member": F.lit(0)}))
    original = V.evaluate(views.linear_scorer(numbered), KEYS)
    outcomes = P.permutation_outcomes(numbered, KEYS, "row_no", FEATURES, perms, views.linear_scorer, donors=False)
    scores = P.permutation_scores(outcomes, KEYS).select(*KEYS, "pfi_var", "perm", "AUC", "CSI")
    loss = P.skill_loss(original, scores, ["climate"], ("AUC", "CSI"))
    return loss.select(F.col("climate").alias("series"), "pfi_var", "perm", "metric", "loss")


# --- calibration on one split, evaluation on the other ----------------------------------------

VALID = "('0x'||substr(md5('21:'||row_key),1,15))::BIGINT % 5 = 0"
CALIBRATED = f"""WITH {views.FORECAST_SQL},
v_split AS (SELECT climate, label, floor(prob * 2000) / 2000.0 AS prob, CAST(floor(prob * 2000) AS INT) AS k, {VALID} AS valid FROM v_forecast),
pt AS MATERIALIZED (SELECT climate, k, any_value(prob) AS prob, sum(label)::BIGINT AS s, count(*) AS n, row_number() OVER (PARTITION BY climate ORDER BY k) AS i FROM v_split WHERE valid GROUP BY climate, k),
cum AS MATERIALIZED (SELECT climate, i, prob, sum(s) OVER w AS cs, sum(n) OVER w AS cn, s, n FROM pt WINDOW w AS (PARTITION BY climate ORDER BY i)),
ab AS (SELECT a.climate, a.i AS a, b.i AS b, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS mean FROM cum a JOIN cum b ON a.climate = b.climate AND b.i >= a.i),
low AS (SELECT climate, a, b, min(mean) OVER (PARTITION BY climate, a ORDER BY b DESC) AS m FROM ab),
iso AS MATERIALIZED (SELECT climate, b AS i, max(m) AS g FROM low GROUP BY climate, b),
knot AS (SELECT c.climate, c.prob, i.g, lead(c.prob) OVER w AS p1, lead(i.g) OVER w AS g1, row_number() OVER w AS rn FROM cum c JOIN iso i USING (climate, i) WINDOW w AS (PARTITION BY c.climate ORDER BY c.i)),
test AS (SELECT v.climate, v.label, v.prob, CASE WHEN k.p1 IS NULL OR v.prob <= k.prob THEN k.g ELSE k.g + (k.g1 - k.g) * ((v.prob - k.prob) / (k.p1 - k.prob)) END AS cal
  FROM v_split v JOIN knot k ON k.climate = v.climate AND (v.prob >= k.prob OR k.rn = 1) AND (v.prob < k.p1 OR k.p1 IS NULL) WHERE NOT v.valid)"""


@query(f"""{CALIBRATED} SELECT climate, count(*) AS n, {r('avg(prob)', 'mean_raw')}, {r('avg(cal)', 'mean_calibrated')}, {r('avg((prob - label) ** 2)', 'BS_raw')}, {r('avg((cal - label) ** 2)', 'BS_calibrated')}
FROM test GROUP BY climate""")
def calibrated_evaluation(spark, sf):
    """Isotonic fit on a validation split, applied to the other rows: Brier scores before and after."""
    rows = views.forecast(spark, sf).select("climate", "label", (F.floor(F.col("prob") * 2000) / 2000.0).alias("prob"), (draw_int(21, "row_key") % 5 == 0).alias("valid"))
    rows = checkpointed(rows)
    blocks = K.isotonic_blocks(rows.filter("valid"), ["climate"])
    test = K.calibrated(rows.filter("NOT valid"), blocks, ["climate"])
    error = lambda p: F.avg((F.col(p) - F.col("label")) * (F.col(p) - F.col("label")))
    return test.groupBy("climate").agg(
        F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_raw"), F.avg("calibrated").alias("mean_calibrated"), error("prob").alias("BS_raw"), error("calibrated").alias("BS_calibrated"))


# --- training frame with its label --------------------------------------------------------------


@query(f"WITH {views.PATCHES_SQL} SELECT patch_id, CAST(max(v) > 0.3 AS INT) AS label, {r('max(v)', 'top')}, {r('max(r)', 'other')} FROM v_px GROUP BY patch_id HAVING count(g) = 64")
def training_frame(spark, sf):
    """Variables joined per patch; the label comes with each and must be the same in all."""
    p = O.label_patches(views.patches(spark, sf), "values", 0.3)
    sources = [p.select("patch_id", "label", v) for v in ("values", "mirror", "gappy")]
    frame = O.training_frame(sources, ["values", "mirror", "gappy"], label="label")
    return frame.select("patch_id", "label", F.array_max("values").alias("top"), F.array_max("mirror").alias("other"))
