"""Bootstrap and permutation-importance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchscope.functions.mixing import ADD, OTHER, PRIME, ROUNDS, SPREAD, SQUARE, text_seed
from patchscope.operators import curves as C
from patchscope.operators import importance as P
from patchscope.operators import resampling as R
from patchscope.operators import scaling
from patchscope.operators import verification as V
from patchscope.operators.ranking import seeded_rank
from patchscope.plans import views
from patchscope.plans.catalog import BRIER_COLUMNS, SCALAR_COLUMNS, SCALAR_RAW, brier_sql, counts_sql, curve_sql, query, r
from patchscope.plans.verification_queries import CURVE_COLUMNS, SWEEP_RAW, sweep_sql
from patchscope.session import checkpointed, stored_tables

KEYS = ["climate", "member"]
K = "climate, member"
#: Replicates of the registered queries: on cells, on threshold cells, gathered row by row. The operators default to the published 1 000.
REPS, SWEPT, GATHERED = 100, 20, 5
#: Permutations of the registered queries.
PERMS = 8

# draws of rows: hash(seed : rep : climate : member : slot) mod n
WEIGHTS = f"""v_draw AS (
  SELECT climate, member, rep, ('0x'||substr(md5(concat_ws(':', '0', rep, climate, member, row_no)),1,15))::BIGINT % n_rows AS row_no
  FROM v_rows, range(1, {GATHERED + 1}) t(rep)),
v_weight AS (SELECT climate, member, rep, row_no, count(*) AS w FROM v_draw GROUP BY ALL),
v_gather AS (SELECT f.climate, f.member, CAST(w.rep AS INT) AS rep, f.row_no, f.prob, f.label, w.w FROM v_rows f JOIN v_weight w USING (climate, member, row_no))"""
GATHER = f"WITH {views.FORECAST_ROWS_SQL}, {WEIGHTS}"
KR = "climate, member, rep"


def mixed_sql(t: str) -> str:
    return f"(((({t}) * ({t})) % {PRIME}) * {SQUARE} + {ADD}) % {PRIME}"


def cell_boot_sql(cell: str, prob: str, label: str, reps: int, views_sql: str = f"WITH {views.FORECAST_SQL}", source: str = "v_forecast") -> str:
    """Draws on numbered cells: v_boot has climate, member (the keys), rep, cell, w, and prob and label of the cell."""
    draws = f"""SELECT *, unnest(range(total)) AS slot FROM (
      SELECT *, {mixed_sql(f"({mixed_sql('ks')} + rep * {SPREAD}) % {PRIME}")} AS s
      FROM (SELECT DISTINCT climate, member, total, ('0x'||substr(md5(concat_ws(':', '0', climate, member)),1,15))::BIGINT % {PRIME} AS ks FROM v_cum), range(1, {reps + 1}) t(rep))"""
    draws = f"SELECT *, (slot % {PRIME} * {SPREAD} + s + {OTHER}) % {PRIME} AS h, (slot % {PRIME} * {OTHER} + s + {2 * OTHER}) % {PRIME} AS l FROM ({draws})"
    for _ in range(2):
        draws = f"SELECT * REPLACE ({mixed_sql('h')} AS h, {mixed_sql('l')} AS l) FROM ({draws})"
    return f"""{views_sql},
v_cells AS (SELECT climate, member, {cell} AS cell, count(*) AS n FROM {source} GROUP BY ALL),
v_cum AS (SELECT climate, member, cell, CAST(sum(n) OVER (PARTITION BY climate, member ORDER BY cell) AS BIGINT) - n AS lo,
                 CAST(sum(n) OVER (PARTITION BY climate, member) AS BIGINT) AS total FROM v_cells),
v_drawn AS (SELECT climate, member, rep, (h * {1 << 31} + l) % total AS draw FROM ({draws})),
v_boot AS MATERIALIZED (SELECT *, {prob} AS prob, {label} AS label FROM (
  SELECT d.climate, d.member, CAST(d.rep AS INT) AS rep, c.cell, count(*) AS w
  FROM v_drawn d ASOF JOIN v_cum c ON d.climate = c.climate AND d.member = c.member AND d.draw >= c.lo GROUP BY ALL))"""


# cells: reliability bin * 4 + outcome (tp, fp, fn, tn)
BIN_CELLS = (
    "least(CAST(floor(round(prob / 0.05::DOUBLE, 9)) AS INT), 20) * 4 + CASE WHEN prob >= 0.5 THEN 1 - label ELSE 3 - label END",
    # the centre of the bin, but just under 0.5 (in the same bin, by its slack) for what was not forecast there
    "CASE WHEN cell // 4 = 10 AND cell % 4 >= 2 THEN 0.49999999999::DOUBLE ELSE (cell // 4) * 0.05::DOUBLE + 0.025::DOUBLE END", "CAST(cell % 4 IN (0, 2) AS INT)")
BOOT = cell_boot_sql(*BIN_CELLS, REPS)


def _threshold_cell_sql(n: int) -> str:
    """Cells: (index of the largest threshold not above the probability + 1) * 2 + event."""
    at = lambda k: f"(CASE WHEN {k} = {n - 1} THEN 1.0::DOUBLE ELSE ({k}) * (1.0::DOUBLE / {n - 1}) END)"
    near = f"CAST(floor(prob * {n - 1}) AS INT)"
    index = f"CASE WHEN {near} < {n - 1} AND prob >= {at(near + ' + 1')} THEN {near} + 1 WHEN prob < {at(near)} THEN {near} - 1 ELSE {near} END"
    return f"(({index}) + 1) * 2 + label"


SWEEP_BOOT = cell_boot_sql(
    _threshold_cell_sql(V.SWEEP), f"CASE WHEN cell // 2 = {V.SWEEP} THEN 1.0::DOUBLE ELSE (cell // 2 - 1) * (1.0::DOUBLE / {V.SWEEP - 1}) END", "CAST(cell % 2 AS INT)", SWEPT)


def _cells(spark, sf):
    return views.forecast(spark, sf).select(*KEYS, "prob", "label")


@query(f"{GATHER} SELECT climate, member, rep, row_no, w FROM v_gather")
def bootstrap_weights(spark, sf):
    rows = views.forecast_rows(spark, sf)
    return R.bootstrap_weights(rows, KEYS, "row_no", GATHERED, size="n_rows")


@query(f"""{GATHER} SELECT climate, member, rep, {SCALAR_COLUMNS} FROM ({counts_sql('v_gather', KR, weight='w')})""")
def bootstrap_gather(spark, sf):
    """Scores of replicates whose rows are gathered by number, as patches would be."""
    rows = checkpointed(views.forecast_rows(spark, sf).select(*KEYS, "row_no", "n_rows", "prob", "label"))
    return V.scalar_scores(V.confusion(R.bootstrap_forecasts(rows, KEYS, "row_no", GATHERED, size="n_rows"), [*KEYS, "rep"], weight="w"))


@query(f"""{BOOT} SELECT s.*, {BRIER_COLUMNS} FROM (SELECT {KR}, {SCALAR_COLUMNS} FROM ({counts_sql('v_boot', KR, weight='w')})) s
JOIN ({brier_sql(curve_sql('v_boot', KR, weight='w'), KR)}) b USING ({KR})""")
def bootstrap_scores(spark, sf, reps=REPS):
    return R.cell_bootstrap_scores(_cells(spark, sf), KEYS, reps)


WEIGHTED = "v_bw AS (SELECT climate, rep * 100 + member AS rep, prob, label FROM v_boot, range(0, w) t(i))"


@query(f"""{SWEEP_BOOT}, {WEIGHTED} SELECT climate, {r('Threshold', 'Threshold')}, {r('min(FAR)', 'FAR_min')}, {r('max(FAR)', 'FAR_max')},
  {r('min(POD)', 'POD_min')}, {r('max(POD)', 'POD_max')}
FROM (SELECT climate, rep, Threshold, {SWEEP_RAW} FROM ({sweep_sql('v_bw', 'climate, rep')})) GROUP BY climate, Threshold""")
def bootstrap_sweep_envelope(spark, sf, reps=SWEPT):
    sweep = R.cell_bootstrap_sweep(_cells(spark, sf), KEYS, reps)
    return R.envelope(sweep, ["climate", "Threshold"], ["FAR", "POD"])


@query(f"""{BOOT} SELECT climate, bin, {r('min(rate)', 'Positive_Relative_Freq_min')}, {r('max(rate)', 'Positive_Relative_Freq_max')}
FROM ({curve_sql('v_boot', KR, weight='w')}) GROUP BY climate, bin""")
def bootstrap_reliability_envelope(spark, sf, reps=REPS):
    curves = R.cell_bootstrap_reliability(_cells(spark, sf), KEYS, reps)
    return R.envelope(curves, ["climate", "bin"], ["Positive_Relative_Freq"])


@query(f"""{BOOT} SELECT climate, {r('quantile_cont(CSI, 0.025)', 'CSI_low')}, {r('quantile_cont(CSI, 0.975)', 'CSI_high')}
FROM (SELECT {KR}, {SCALAR_RAW} FROM ({counts_sql('v_boot', KR, weight='w')})) GROUP BY climate""")
def bootstrap_score_interval(spark, sf, reps=REPS):
    scores = R.cell_bootstrap_scores(_cells(spark, sf), KEYS, reps)
    return R.envelope(scores, ["climate"], ["CSI"], interval=R.INTERVAL)


MEDIAN_BOOT = f"""WITH {views.PATCHES_SQL},
v_pr AS (SELECT patch_id, climate, vals, row_number() OVER (PARTITION BY climate ORDER BY md5('0:'||patch_id), patch_id) - 1 AS row_no, count(*) OVER (PARTITION BY climate) AS n FROM v_patch),
v_pd AS (SELECT climate, rep, ('0x'||substr(md5(concat_ws(':', '0', rep, climate, row_no)),1,15))::BIGINT % n AS row_no FROM v_pr, range(1, {GATHERED + 1}) t(rep)),
v_med AS (SELECT d.climate, d.rep, median(x.v) AS median FROM v_pd d JOIN v_pr p USING (climate, row_no), unnest(p.vals) x(v) GROUP BY d.climate, d.rep)"""


def _numbered_patches(spark, sf):
    p = views.patches(spark, sf).select("patch_id", "climate", "values")
    return seeded_rank(p, "patch_id", 0, by=["climate"], out="rk").withColumn("row_no", F.col("rk") - 1).drop("rk")


@query(f"{MEDIAN_BOOT} SELECT climate, CAST(rep AS INT) AS rep, {r('median', 'median')} FROM v_med")
def bootstrap_medians(spark, sf):
    """Median over all pixels of the resampled patches, per replicate."""
    return R.bootstrap_medians(_numbered_patches(spark, sf), ["climate"], "row_no", "values", GATHERED)


@query(f"{MEDIAN_BOOT} SELECT climate, {r('quantile_cont(median, 0.025)', 'q2_5')}, {r('quantile_cont(median, 0.975)', 'q97_5')} FROM v_med GROUP BY climate")
def bootstrap_median_interval(spark, sf):
    return R.bootstrap_median_interval(_numbered_patches(spark, sf), ["climate"], "row_no", "values", GATHERED)


@query(f"""WITH {views.PATCHES_SQL},
v_pr AS (SELECT patch_id, climate, row_number() OVER (PARTITION BY climate ORDER BY md5('0:'||patch_id), patch_id) - 1 AS row_no, count(*) OVER (PARTITION BY climate) AS n FROM v_patch),
v_pd AS (SELECT climate, rep, feature, ('0x'||substr(md5(concat_ws(':', '0', rep, climate, feature, row_no)),1,15))::BIGINT % n AS row_no
  FROM v_pr, range(1, {GATHERED + 1}) t(rep), (VALUES ('values'), ('mirror')) f(feature)),
v_med AS (SELECT d.climate, d.feature, d.rep, median(CASE d.feature WHEN 'values' THEN x.v ELSE x.r * 1000 END) AS median
  FROM v_pd d JOIN v_pr p USING (climate, row_no) JOIN v_px x ON x.patch_id = p.patch_id WHERE x.m GROUP BY ALL)
SELECT climate, feature, {r('quantile_cont(median, 0.025)', 'q2_5')}, {r('quantile_cont(median, 0.975)', 'q97_5')} FROM v_med GROUP BY climate, feature""")
def feature_median_intervals(spark, sf, reps=GATHERED):
    """Resampled in-storm medians per climate and feature, from standardised arrays back to physical units."""
    p = views.patches(spark, sf).select("patch_id", "climate", "values", "mirror", "mask")
    scaler = scaling.fit_scaler(p, None, ["values", "mirror"])
    numbered = seeded_rank(scaling.apply_scaler(p, scaler, ["values", "mirror"]), "patch_id", 0, by=["climate"], out="rk").withColumn("row_no", F.col("rk") - 1)
    return R.feature_median_intervals(numbered, scaler, ["climate"], "row_no", ["values", "mirror"], reps, mask="mask", grams=["mirror"])


# --- permutation importance ---------------------------------------------------------------


def permuted_sql(out: str, source: str) -> str:
    """The bijection of ``with_permutation``, a subselect a step: columns of the source plus row_no."""
    step = f"SELECT *, CAST(floor(sqrt(n::DOUBLE)) AS BIGINT) + 1 AS wide FROM {source}"
    step = f"SELECT *, (n + wide - 1) // wide AS high FROM ({step})"
    step = f"SELECT *, n - (high - 1) * wide AS last, orig_row_no % wide AS x, orig_row_no // wide AS y FROM ({step})"
    for turn in range(2 * ROUNDS):
        value = "x" if turn % 2 else "y"
        step = f"SELECT *, ({value} * {SPREAD} + s + {turn * OTHER}) % {PRIME} AS t FROM ({step})"
        step = f"SELECT * REPLACE ({mixed_sql('t')} AS t) FROM ({step})"
        step = f"SELECT * REPLACE ({mixed_sql('t')} AS t) FROM ({step})"
        moved = "(y + t) % (CASE WHEN x < last THEN high ELSE high - 1 END) AS y" if turn % 2 else "(x + t) % (CASE WHEN y = high - 1 THEN last ELSE wide END) AS x"
        step = f"SELECT * EXCLUDE (t) REPLACE ({moved}) FROM ({step})"
    return f"{out} AS MATERIALIZED (SELECT climate, member, pfi_var, perm, orig_row_no, y * wide + x AS row_no FROM ({step}))"


FEATURES = views.SCORED_FEATURES


def start_sql() -> str:
    """v_start: every (row, feature, permutation) of v_frows with its seed and the size of its key."""
    return f"""v_start AS (
  SELECT climate, member, pfi_var, CAST(perm AS INT) AS perm, row_no AS orig_row_no, n,
         {mixed_sql(f"({mixed_sql('(fs + ks) % ' + str(PRIME))} + perm * {SPREAD}) % {PRIME}")} AS s
  FROM (SELECT climate, member, row_no, count(*) OVER (PARTITION BY climate, member) AS n,
               ('0x'||substr(md5(concat_ws(':', '0', climate, member)),1,15))::BIGINT % {PRIME} AS ks FROM v_frows),
       (VALUES {', '.join(f"('{f}', {text_seed(0, f)}::BIGINT)" for f in FEATURES)}) v(pfi_var, fs), range(1, {PERMS + 1}) t(perm)),
"""


PERM = f"""WITH {views.FEATURE_ROWS_SQL},
v_id AS MATERIALIZED (SELECT *, concat_ws(':', climate, member, row_no) AS gid FROM v_frows),
{start_sql()}{permuted_sql("v_move", "v_start")},
v_perm AS (
  SELECT m.climate, m.member, m.pfi_var, m.perm, m.row_no, m.orig_row_no, b.row_key, b.label,
         {', '.join(f"CASE WHEN m.pfi_var = '{f}' THEN d.{f} ELSE b.{f} END AS {f}" for f in FEATURES)}
  FROM v_move m JOIN v_id b ON b.gid = concat_ws(':', m.climate, m.member, m.row_no)
  JOIN v_id d ON d.gid = concat_ws(':', m.climate, m.member, m.orig_row_no)),
v_out AS MATERIALIZED (SELECT *, {views.SCORER_SQL} AS prob FROM v_perm),
v_orig AS (SELECT *, {views.SCORER_SQL} AS prob FROM v_frows)"""
KP = "climate, member, pfi_var, perm"


def _rows(spark, sf, *more):
    """The numbered feature table, stored once: donors, receivers and originals read it."""
    return checkpointed(views.feature_rows(spark, sf).select(*KEYS, "row_no", *more, "label", *FEATURES))


def _outcomes(rows):
    return P.permutation_outcomes(rows, KEYS, "row_no", FEATURES, PERMS, views.linear_scorer, donors=False)


def _scores(spark, sf):
    return P.permutation_scores(_outcomes(_rows(spark, sf)), KEYS)


@query(f"{PERM} SELECT climate, member, row_no, row_key, orig_row_no, {r('discount', 'discount')}, {r('tax', 'tax')} FROM v_perm WHERE pfi_var = 'discount' AND perm = 1")
def permute_feature(spark, sf):
    rows = _rows(spark, sf, "row_key").select(*KEYS, "row_no", "row_key", "discount", "tax")
    return P.permute_feature(rows, KEYS, "row_no", "discount")


PERM_SCORES = f"""SELECT s.*, b.* EXCLUDE ({KP}) FROM (SELECT {KP}, {{columns}} FROM ({counts_sql('v_out', KP)})) s
JOIN ({brier_sql(curve_sql('v_out', KP), KP)}) b USING ({KP})"""


@query(f"""{PERM} SELECT s.*, {BRIER_COLUMNS} FROM (SELECT {KP}, {SCALAR_COLUMNS} FROM ({counts_sql('v_out', KP)})) s
JOIN ({brier_sql(curve_sql('v_out', KP), KP)}) b USING ({KP})""")
def permutation_scores(spark, sf):
    return _scores(spark, sf)


@query(f"{PERM} SELECT {KP}, {r('max(CSI)', 'max_csi')} FROM (SELECT {KP}, Threshold, {SWEEP_RAW} FROM ({sweep_sql('v_out', KP)})) GROUP BY {KP}")
def permutation_sweep(spark, sf):
    """Best CSI over all thresholds of every permutation."""
    return C.max_csi(P.permutation_sweep(_outcomes(_rows(spark, sf)), KEYS), [*KEYS, "pfi_var", "perm"])


@query(f"{PERM} SELECT {KP}, {CURVE_COLUMNS} FROM ({curve_sql('v_out', KP)})")
def permutation_reliability(spark, sf):
    return P.permutation_reliability(_outcomes(_rows(spark, sf)), KEYS)


ORIG_SCORES = f"""SELECT s.*, b.* EXCLUDE (climate, member) FROM (SELECT {K}, {SCALAR_RAW} FROM ({counts_sql('v_orig', K)})) s
JOIN ({brier_sql(curve_sql('v_orig', K), K)}) b USING ({K})"""
METRICS = ("AUC", "CSI", "BSS")
LOSS = f"""v_ps AS ({PERM_SCORES.format(columns=SCALAR_RAW)}),
v_base AS (SELECT climate, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM ({ORIG_SCORES}) GROUP BY climate),
v_loss AS ({' UNION ALL '.join(f"SELECT p.climate, p.member, p.pfi_var, p.perm, '{m}' AS metric, greatest(b.{m} - p.{m}, 0) AS loss FROM v_ps p JOIN v_base b USING (climate)" for m in METRICS)})"""


def _loss(spark, sf):
    rows = _rows(spark, sf)
    original = V.evaluate(views.linear_scorer(rows), KEYS)
    permuted = P.permutation_scores(_outcomes(rows), KEYS).select(*KEYS, "pfi_var", "perm", *METRICS)
    return P.skill_loss(original, permuted, ["climate"], METRICS)


@query(f"{PERM}, {LOSS} SELECT climate, member, pfi_var, perm, metric, {r('loss', 'loss')} FROM v_loss")
def skill_loss(spark, sf):
    return _loss(spark, sf)


BOX_COLUMNS = ", ".join(r(f"quantile_cont(rel, {p})", f"q{int(p * 100)}") for p in P.BOX)


@query(f"""{PERM}, {LOSS}, v_rel AS (SELECT *, loss / nullif(max(loss) OVER (PARTITION BY climate, metric), 0) AS rel FROM v_loss)
SELECT *, CAST(row_number() OVER (PARTITION BY climate, metric ORDER BY q50 DESC, pfi_var) AS INT) AS importance_rank
FROM (SELECT climate, metric, pfi_var, {BOX_COLUMNS} FROM v_rel GROUP BY climate, metric, pfi_var)""")
def importance(spark, sf):
    """Box statistics of normalised skill loss and the ranking of features."""
    return P.importance(_loss(spark, sf), ["climate", "metric"])


BANDS = f"""v_ps AS ({PERM_SCORES.format(columns=SCALAR_RAW)}),
v_long AS ({' UNION ALL '.join(f"SELECT climate, member, pfi_var, perm, '{m}' AS metric, round({m}, 12) AS value FROM v_ps" for m in METRICS)}),
v_q AS (SELECT *, quantile_cont(value, 0.2) OVER w AS lo, quantile_cont(value, 0.8) OVER w AS hi FROM v_long WHERE value IS NOT NULL
        WINDOW w AS (PARTITION BY climate, member, pfi_var, metric)),
v_band AS (SELECT *, 'bottom' AS band FROM v_q WHERE value <= lo UNION ALL SELECT *, 'top' FROM v_q WHERE value >= hi
           UNION ALL SELECT *, 'middle' FROM v_q WHERE value > lo AND value < hi)"""


def _bands(scores):
    return P.permutation_bands(scores, [*KEYS, "pfi_var"], METRICS, 0.2, 0.8)


@query(f"{PERM}, {BANDS} SELECT climate, member, pfi_var, perm, metric, {r('value', 'metric_value')}, band FROM v_band")
def permutation_bands(spark, sf):
    return _bands(_scores(spark, sf))


@query(f"{PERM}, {BANDS} SELECT climate, member, pfi_var, perm, metric, {r('value', 'metric_value')}, band FROM v_band WHERE band <> 'middle'")
def tail_permutations(spark, sf):
    return P.tail_permutations(_bands(_scores(spark, sf)))


def _case_sql(after: str, before: str) -> str:
    yes_after = {"fn": "prob < 0.5 AND label = 1", "fp": "prob >= 0.5 AND label = 0"}[after]
    yes_before = {"tp": "prob >= 0.5 AND label = 1", "tn": "prob < 0.5 AND label = 0"}[before]
    group = "climate, member, pfi_var, metric, row_no"
    return f"""{PERM}, {BANDS},
v_wrong AS (SELECT o.climate, o.member, o.pfi_var, b.metric, b.band, o.row_no, o.perm, o.orig_row_no
  FROM v_out o JOIN v_band b USING (climate, member, pfi_var, perm) WHERE {yes_after}),
v_set AS (SELECT {group}, band, row_number() OVER (PARTITION BY {group}, band ORDER BY perm) AS rn, perm, orig_row_no FROM v_wrong)
SELECT {group}, band, perm, orig_row_no FROM v_set s WHERE rn = 1 AND band IN ('top', 'bottom')
  AND NOT EXISTS (SELECT 1 FROM v_wrong w WHERE w.climate = s.climate AND w.member = s.member AND w.pfi_var = s.pfi_var AND w.metric = s.metric
                  AND w.row_no = s.row_no AND w.band <> s.band)
  AND EXISTS (SELECT 1 FROM v_orig q WHERE q.climate = s.climate AND q.member = s.member AND q.row_no = s.row_no AND {yes_before})"""


def _cases(rows, kind):
    # rescoring is the expensive part and is read twice, for the bands and for the cases: stored as words, 64 rows' cells in one row;
    # the cases alone look up their donors
    group = [*KEYS, "pfi_var", "perm"]
    words = checkpointed(P.cell_words(_outcomes(rows).select(*group, "row_no", V.forecast_cell().cast("byte").alias("cell")), group))
    bands = _bands(V.evaluate_cells(P.counts_of_words(words, group), group))
    original = views.linear_scorer(rows).withColumn("outcome", V.outcome_class())
    return P.with_donors(P.permutation_cases(words, bands, original, KEYS, kind), rows, KEYS, FEATURES)


@query(_case_sql("fn", "tp"))
def permutation_misses(spark, sf):
    """Hits that turned into misses only in the best or only in the worst permutations."""
    with stored_tables() as store:
        return store.hand_out(_cases(_rows(spark, sf), "misses"))


@query(_case_sql("fp", "tn"))
def permutation_false_alarms(spark, sf):
    with stored_tables() as store:
        return store.hand_out(_cases(_rows(spark, sf), "false_alarms"))


@query(f"""WITH c AS ({_case_sql('fn', 'tp')}), {views.FEATURE_ROWS_SQL},
v_id AS MATERIALIZED (SELECT *, concat_ws(':', climate, member, row_no) AS gid FROM v_frows)
SELECT c.climate, c.member, c.pfi_var, c.metric, c.band, c.row_no, c.perm, c.orig_row_no, {r('o.discount', 'discount_orig')}, {r('d.discount', 'discount_donor')}
FROM c JOIN v_id o ON o.gid = concat_ws(':', c.climate, c.member, c.row_no) JOIN v_id d ON d.gid = concat_ws(':', c.climate, c.member, c.orig_row_no)""")
def permutation_case_rows(spark, sf):
    """The mined cases with their own and their donors' values."""
    with stored_tables() as store:
        rows = _rows(spark, sf)
        return store.hand_out(P.case_patches(_cases(rows, "misses"), rows, KEYS, ["discount"]))
