"""Verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchscope.operators import curves as C
from patchscope.operators import verification as V
from patchscope.operators.quantiles import rank_auc as rank_auc_of
from patchscope.plans import views
from patchscope.plans.catalog import (
    BRIER_COLUMNS, CSI, FAR, POD, POFD, SCALAR_COLUMNS, SCALAR_RAW, brier_sql, counts_sql, curve_sql, div, query, r,
)
from patchscope.plans.views import FORECAST_SQL

KEYS = ["climate", "member"]
K = "climate, member"
FC = f"WITH {FORECAST_SQL}"


@query(f"{FC} {counts_sql('v_forecast', K)}")
def confusion_counts(spark, sf):
    return V.confusion(views.forecast(spark, sf), KEYS)


@query(f"{FC} SELECT {K}, {SCALAR_COLUMNS} FROM ({counts_sql('v_forecast', K)})")
def scalar_scores(spark, sf):
    return V.scalar_scores(V.confusion(views.forecast(spark, sf), KEYS))


def sweep_sql(source: str, keys: str, n: int = 10000) -> str:
    """Sweep by a sorted union of thresholds and forecasts."""
    part = f"PARTITION BY {keys}"
    return f"""SELECT {keys}, thr AS Threshold, CAST(coalesce(tp, 0) AS BIGINT) AS TP, CAST(coalesce(fp, 0) AS BIGINT) AS FP,
       CAST(allp - coalesce(tp, 0) AS BIGINT) AS FN, CAST(alln - coalesce(fp, 0) AS BIGINT) AS TN
  FROM (SELECT {keys}, thr, kind,
          sum(pos) OVER ({part} ORDER BY thr DESC RANGE UNBOUNDED PRECEDING) AS tp,
          sum(neg) OVER ({part} ORDER BY thr DESC RANGE UNBOUNDED PRECEDING) AS fp,
          sum(pos) OVER ({part}) AS allp, sum(neg) OVER ({part}) AS alln
        FROM (SELECT {keys}, prob AS thr, 0 AS kind, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY {keys}, prob
              UNION ALL
              SELECT k.*, t.thr, 1, 0, 0 FROM (SELECT DISTINCT {keys} FROM {source}) k,
                (SELECT CASE WHEN i = {n} THEN 2.0::DOUBLE WHEN i = {n} - 1 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / ({n} - 1)) END AS thr
                 FROM range(0, {n} + 1) g(i)) t))
  WHERE kind = 1"""


SWEEP_COLUMNS = f"TP, FP, FN, TN, {r(f'coalesce({POD}, 0)', 'POD')}, {r(f'coalesce({POFD}, 0)', 'POFD')}, {r(f'coalesce({FAR}, 0)', 'FAR')}, {r(CSI, 'CSI')}"
SWEEP_RAW = f"TP, FP, FN, TN, coalesce({POD}, 0) AS POD, coalesce({POFD}, 0) AS POFD, coalesce({FAR}, 0) AS FAR, {CSI} AS CSI"


@query(f"{FC} SELECT {K}, {r('Threshold', 'Threshold')}, {SWEEP_COLUMNS} FROM ({sweep_sql('v_forecast', K)})")
def threshold_sweep(spark, sf):
    return V.threshold_sweep(views.forecast(spark, sf), KEYS)


TIES = "v_ties AS (SELECT climate, label, discount * 10 AS prob FROM v_features)"


@query(f"{FC}, {TIES} SELECT climate, {r('Threshold', 'Threshold')}, {SWEEP_COLUMNS} FROM ({sweep_sql('v_ties', 'climate', 101)})")
def threshold_sweep_tied(spark, sf):
    """Forecasts on 11 values only: ties sit on thresholds."""
    ties = views.features(spark, sf).select("climate", "label", (F.col("discount") * 10).alias("prob"))
    return V.threshold_sweep(ties, ["climate"], n=101)


@query(f"""{FC} SELECT climate, {r('(sum(CASE WHEN label = 1 THEN rk END) - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n)', 'auc_rank')}
FROM (SELECT climate, label, rank() OVER (PARTITION BY climate ORDER BY prob) + (count(*) OVER (PARTITION BY climate, prob) - 1) / 2.0::DOUBLE AS rk,
      sum(label) OVER (PARTITION BY climate) AS p, sum(1 - label) OVER (PARTITION BY climate) AS n FROM v_forecast)
GROUP BY climate, p, n""")
def rank_auc(spark, sf):
    return rank_auc_of(views.forecast(spark, sf), ["climate"])


@query(f"""{FC} SELECT climate, label AS observed, count(*) FILTER (prob < 0.5) AS forecast_no, count(*) FILTER (prob >= 0.5) AS forecast_yes
FROM v_forecast GROUP BY climate, label""")
def contingency_matrix(spark, sf):
    return V.contingency(views.forecast(spark, sf), ["climate"])


@query(f"""{FC} SELECT {K}, bin, {r('Bin_Start', 'Bin_Start')}, Total_Freq, Positive_Freq
FROM ({curve_sql('v_forecast', K, bins=22)})""")
def reliability_frequencies(spark, sf):
    return V.reliability_frequencies(views.forecast(spark, sf), KEYS)


CURVE_COLUMNS = f"bin, {r('Bin_Start', 'Bin_Start')}, {r('Bin_Center', 'Bin_Center')}, Total_Freq, Positive_Freq, {r('rate', 'Positive_Relative_Freq')}"


@query(f"{FC} SELECT {K}, {CURVE_COLUMNS} FROM ({curve_sql('v_forecast', K)})")
def reliability_curve(spark, sf):
    return V.reliability_curve(views.forecast(spark, sf), KEYS)


@query(f"{FC} SELECT {K}, {CURVE_COLUMNS} FROM ({curve_sql('v_forecast', K, '0.1', 10)})")
def reliability_curve_wide_bins(spark, sf):
    return V.reliability_curve(views.forecast(spark, sf), KEYS, width=0.1)


@query(f"{FC} SELECT {K}, {BRIER_COLUMNS} FROM ({brier_sql(curve_sql('v_forecast', K), K)})")
def brier_components(spark, sf):
    return V.brier_components(V.reliability_curve(views.forecast(spark, sf), KEYS), KEYS)


@query(f"{FC} SELECT {K}, {r('avg((prob - label) * (prob - label))', 'BS_exact')} FROM v_forecast GROUP BY {K}")
def brier_exact(spark, sf):
    return V.brier_score(views.forecast(spark, sf), KEYS)


OUTCOME = "CASE WHEN prob >= 0.5 AND label = 1 THEN 'tp' WHEN prob >= 0.5 THEN 'fp' WHEN label = 1 THEN 'fn' ELSE 'tn' END"


@query(f"""WITH {views.FORECAST_ROWS_SQL} SELECT {K}, row_no, row_key, outcome,
  CASE WHEN outcome IN ('tp', 'fp') THEN prob >= 0.99 ELSE prob < 0.01 END AS confident
FROM (SELECT *, {OUTCOME} AS outcome FROM v_rows)""")
def outcome_rows(spark, sf):
    """Outcome class and row number of every forecast."""
    return V.outcomes(views.forecast_rows(spark, sf)).select(*KEYS, "row_no", "row_key", "outcome", "confident")


EVALUATION = f"""SELECT s.*, b.* EXCLUDE ({K}) FROM (SELECT {K}, {SCALAR_RAW} FROM ({counts_sql('v_forecast', K)})) s
JOIN ({brier_sql(curve_sql('v_forecast', K), K)}) b USING ({K})"""


@query(f"""{FC} SELECT s.*, {BRIER_COLUMNS} FROM (SELECT {K}, {SCALAR_COLUMNS} FROM ({counts_sql('v_forecast', K)})) s
JOIN ({brier_sql(curve_sql('v_forecast', K), K)}) b USING ({K})""")
def member_evaluation(spark, sf):
    return V.evaluate(views.forecast(spark, sf), KEYS)


SKILL_MEANS = ", ".join(r(f"avg({c})", c) for c in ("POD", "POFD", "FAR", "CSI", "ProportionCorrect", "Bias", "AUC", "BS", "BSS"))


@query(f"""{FC} SELECT climate, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in C.COUNTS)}, {SKILL_MEANS}
FROM ({EVALUATION}) GROUP BY climate""")
def skill_table(spark, sf):
    """Counts summed, scores averaged over the five members, per climate."""
    return C.skill_table(views.forecast(spark, sf), ["climate"], digits=None)


@query(f"""{FC} SELECT climate, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in C.COUNTS)}
FROM ({counts_sql('v_forecast', K)}) GROUP BY climate""")
def member_totals(spark, sf):
    return C.member_totals(V.confusion(views.forecast(spark, sf), KEYS), ["climate"])


@query(f"""{FC} SELECT climate, {', '.join(r(f'round_even(avg({c}), 2)', c) for c in ('POD', 'POFD', 'CSI', 'AUC'))}
FROM (SELECT {K}, {SCALAR_RAW} FROM ({counts_sql('v_forecast', K)})) GROUP BY climate""")
def member_means(spark, sf):
    scores = V.scalar_scores(V.confusion(views.forecast(spark, sf), KEYS))
    return C.member_means(scores, ["climate"], ["POD", "POFD", "CSI", "AUC"])


@query(f"""{FC} SELECT climate, {r('Threshold', 'Threshold')}, {r('avg(POD)', 'POD')}, {r('avg(FAR)', 'FAR')}
FROM (SELECT {K}, Threshold, {SWEEP_RAW} FROM ({sweep_sql('v_forecast', K)})) GROUP BY climate, Threshold""")
def curve_mean(spark, sf):
    sweep = V.threshold_sweep(views.forecast(spark, sf), KEYS)
    return C.curve_mean(sweep, ["climate", "Threshold"], ["POD", "FAR"])


@query(f"{FC} SELECT climate, {r('max(CSI)', 'max_csi')} FROM (SELECT {K}, Threshold, {SWEEP_RAW} FROM ({sweep_sql('v_forecast', K)})) GROUP BY climate")
def max_csi(spark, sf):
    return C.max_csi(V.threshold_sweep(views.forecast(spark, sf), KEYS), ["climate"])


_inv = lambda x: f"CASE WHEN {x} = 0 THEN NULL ELSE 1 / {x} END"


@query(f"""{FC} SELECT climate, {r('Threshold', 'Threshold')}, {r('sr', 'success_ratio')}, {r('pod', 'POD')},
  {r(f"CASE WHEN ({_inv('sr')}) + ({_inv('pod')}) - 1 = 0 THEN NULL ELSE 1 / (({_inv('sr')}) + ({_inv('pod')}) - 1) END", 'csi')}, {r(div('pod', 'sr'), 'bias')},
  Threshold <= 1 AND round(Threshold * 9999) IN (9000, 7000, 5000, 3000, 1000) AS marked
FROM (SELECT climate, Threshold, avg(1 - FAR) AS sr, avg(POD) AS pod
      FROM (SELECT {K}, Threshold, {SWEEP_RAW} FROM ({sweep_sql('v_forecast', K)})) GROUP BY climate, Threshold)""")
def performance_diagram(spark, sf):
    sweep = V.threshold_sweep(views.forecast(spark, sf), KEYS)
    return C.performance_diagram(sweep, ["climate"])


@query(f"""{FC}, cur AS ({curve_sql('v_forecast', K)}),
cl AS (SELECT climate, avg(c) AS climo FROM (SELECT {K}, sum(Positive_Freq) / sum(Total_Freq) AS c FROM cur GROUP BY {K}) GROUP BY climate)
SELECT climate, bin, {r('any_value(Bin_Start)', 'Bin_Start')}, {r('any_value(Bin_Center)', 'Bin_Center')}, {r('avg(rate)', 'observed')},
  {r('avg(Total_Freq)', 'frequency')}, {r('any_value(climo)', 'climo')}, {r('any_value(0.5 * Bin_Center + 0.5 * climo)', 'no_skill')}
FROM cur JOIN cl USING (climate) GROUP BY climate, bin""")
def attributes_diagram(spark, sf):
    return C.attributes_diagram(V.reliability_curve(views.forecast(spark, sf), KEYS), ["climate"])


@query(f"""{FC}, pts AS (SELECT climate, avg(1 - FAR) AS x, avg(POD) AS y FROM (SELECT {K}, Threshold, {SWEEP_RAW} FROM ({sweep_sql('v_forecast', K)}))
        GROUP BY climate, Threshold),
seg AS (SELECT climate, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS rn FROM pts WINDOW w AS (PARTITION BY climate ORDER BY x, y)),
grid AS (SELECT i * 0.01::DOUBLE AS gx FROM range(0, 100) t(i))
SELECT climate, {r('gx', 'grid_x')}, {r('CASE WHEN x1 IS NULL OR gx <= x THEN y ELSE y + (y1 - y) * ((gx - x) / (x1 - x)) END', 'grid_y')}
FROM grid, seg WHERE (gx >= x OR rn = 1) AND (gx < x1 OR x1 IS NULL)""")
def interpolated_curve(spark, sf):
    """POD on an even grid of success ratios, clamped at the ends."""
    sweep = V.threshold_sweep(views.forecast(spark, sf), KEYS)
    mean = sweep.groupBy("climate", "Threshold").agg(F.avg(1 - F.col("FAR")).alias("sr"), F.avg("POD").alias("pod"))
    return C.interpolate_curve(mean, ["climate"], "sr", "pod", 0.0, 1.0, 0.01)


@query(f"""WITH {views.FEATURES_SQL}, b AS (SELECT climate, least(CAST(floor((price / 1000.0::DOUBLE - 10) / 80 * 40) AS INT), 39) AS bin FROM v_features
  WHERE price / 1000.0::DOUBLE BETWEEN 10 AND 90)
SELECT k.climate, g.bin, {r('10.0::DOUBLE + g.bin * 2.0', 'bin_low')}, count(b.bin) AS n
FROM (SELECT DISTINCT climate FROM v_features) k CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(0, 40)) g
LEFT JOIN b ON b.climate = k.climate AND b.bin = g.bin GROUP BY k.climate, g.bin""")
def histogram(spark, sf):
    scaled = views.features(spark, sf).select("climate", (F.col("price") / 1000.0).alias("v"))
    return C.histogram(scaled, ["climate"], "v", 10.0, 90.0, 40)


@query(f"""WITH {views.FEATURES_SQL}, vals AS (SELECT climate, quantity AS v, count(*) AS n FROM v_features GROUP BY ALL),
tot AS (SELECT climate, sum(n) AS total FROM vals GROUP BY climate),
grid AS (SELECT CAST(i AS INT) AS point, 0.0::DOUBLE + i * (60.0::DOUBLE / 60) AS gx FROM range(0, 61) t(i))
SELECT climate, point, {r('gx', 'grid')}, {r('sum(n * exp(-0.5 * ((gx - v) / 2.0::DOUBLE) * ((gx - v) / 2.0::DOUBLE))) / (any_value(total) * 2.0::DOUBLE * sqrt(2 * pi()))', 'density')}
FROM grid, vals JOIN tot USING (climate) GROUP BY climate, point, gx""")
def density(spark, sf):
    """Gaussian kernel density of a feature per climate."""
    return C.kde(views.features(spark, sf), ["climate"], "quantity", 0.0, 60.0, 61, 2.0)


@query(f"""WITH {views.STORMS_SQL}, vals AS (SELECT climate, year, max_uh AS v FROM v_storm),
tot AS (SELECT climate, year, count(*) AS total FROM vals GROUP BY ALL),
grid AS (SELECT CAST(i AS INT) AS point, 100.0::DOUBLE + i AS gx FROM range(0, 101) t(i))
SELECT climate, year, point, {r('gx', 'grid')}, {r('sum(exp(-0.5 * ((gx - v) / 0.5::DOUBLE) * ((gx - v) / 0.5::DOUBLE))) / (any_value(total) * 0.5::DOUBLE * sqrt(2 * pi()))', 'density')}
FROM grid, vals JOIN tot USING (climate, year) GROUP BY climate, year, point, gx""")
def density_sparse(spark, sf):
    """Density of peak rotation per climate and year on a grid that reaches far beyond the values, with a narrow kernel."""
    return C.kde(views.storms(spark, sf), ["climate", "year"], "max_uh", 100.0, 200.0, 101, 0.5)
