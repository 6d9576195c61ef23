"""Forecast verification: contingency scores, threshold sweep, reliability, Brier parts.

Input is a forecast table with ``prob`` and ``label`` plus any key columns. Every
operator takes an optional integer ``weight`` column, which is how bootstrap replicates
are scored without copying forecasts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchscope.functions.expressions import ratio, ratio_or_zero
from patchscope.operators.relational import GROUP, group_keys, names, with_group

# Decision threshold, bin width, number of swept thresholds, confident cuts.
DECISION = 0.5
BIN_WIDTH = 0.05
SWEEP = 10_000
NEVER = 2.0
CONFIDENT_YES = 0.99
CONFIDENT_NO = 0.01
BIN_RANGE = 1.1
OBSERVED = 0.5
# Half a unit of the ninth digit: floor after this is floor after rounding to nine digits.
BIN_SLACK = 5e-10


def _weight(weight: str | None) -> Column:
    return F.lit(1).cast("bigint") if weight is None else F.col(weight)


def _prob(prob: str) -> Column:
    return F.nanvl(F.col(prob).cast("double"), F.lit(None).cast("double"))


def _sum_if(condition: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("bigint")


def confusion(
    df: DataFrame, keys: str | Iterable[str] | None = None, threshold: float = DECISION,
    prob: str = "prob", label: str = "label", weight: str | None = None,
) -> DataFrame:
    """TP, FP, FN, TN per key: yes-forecast is ``prob >= threshold``, yes-event ``label >= 0.5``."""
    yes, event, w = _prob(prob) >= threshold, F.col(label) >= OBSERVED, _weight(weight)
    return df.groupBy(*names(keys)).agg(
        _sum_if(yes & event, w).alias("TP"),
        _sum_if(yes & ~event, w).alias("FP"),
        _sum_if(~yes & event, w).alias("FN"),
        _sum_if(~yes & ~event, w).alias("TN"),
    )


def auc_binary(tp="TP", fp="FP", fn="FN", tn="TN") -> Column:
    """ROC area of the thresholded forecast; NULL when a class is absent."""
    tp, fp, fn, tn = (F.col(c) for c in (tp, fp, fn, tn))
    return (ratio(tp, tp + fn) + 1 - ratio(fp, fp + tn)) / 2


def scalar_scores(counts: DataFrame, threshold: float = DECISION) -> DataFrame:
    """The scalar score table from confusion counts.

    POD, POFD and FAR are 0 on an empty denominator, the other ratios NULL.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    return counts.withColumns({
        "Threshold": F.lit(float(threshold)),
        "POD": ratio_or_zero(tp, tp + fn),
        "POFD": ratio_or_zero(fp, fp + tn),
        "FAR": ratio_or_zero(fp, fp + tp),
        "CSI": ratio(tp, tp + fp + fn),
        "ProportionCorrect": ratio(tp + tn, tp + fp + fn + tn),
        "Bias": ratio(tp + fp, tp + fn),
        "HitRate": ratio(tp, tp + fn),
        "FalseAlarmRate": ratio(fp, fp + tn),
        "AUC": auc_binary(),
    })


def sweep_index(prob: Column, n: int = SWEEP) -> Column:
    """Index of the largest of n even thresholds on [0, 1] not above ``prob``; -1 below all."""
    step = 1.0 / (n - 1)
    near = F.least(F.greatest(F.floor(prob * (n - 1)), F.lit(-1)), F.lit(n - 1))
    at = lambda k: _threshold(k, n, step)
    fixed = F.when((near < n - 1) & (prob >= at(near + 1)), near + 1).when((near >= 0) & (prob < at(near)), near - 1)
    # least and greatest skip NULL, so a missing probability needs its own rule
    return F.when(prob.isNotNull(), fixed.otherwise(near)).cast("int")


def _threshold(k: Column, n: int, step: float) -> Column:
    return F.when(k == n - 1, 1.0).otherwise(k * F.lit(step))


def thresholds(spark, n: int = SWEEP) -> DataFrame:
    """The swept thresholds: 2.0, then n even values from 1 down to 0."""
    k = F.col("id")
    value = F.when(k == n, NEVER).otherwise(_threshold(k, n, 1.0 / (n - 1)))
    return spark.range(n + 1).select(k.cast("int").alias("k"), value.alias("Threshold"))


def threshold_sweep(
    df: DataFrame, keys: str | Iterable[str] | None = None, n: int = SWEEP,
    prob: str = "prob", label: str = "label", weight: str | None = None,
) -> DataFrame:
    """Counts and scores at 2.0 and n even thresholds, per key.

    Each forecast is reduced to its threshold index, so what is shuffled is at most n
    rows per key and task, and a reverse running sum over those gives all counts.
    A stretch of thresholds that no forecast separates shares one running sum and is
    unfolded from it; nothing is joined.
    """
    keys = names(keys)
    event, w = F.col(label) >= OBSERVED, _weight(weight)
    cells = (
        with_group(df, keys)
        .withColumn("__k", sweep_index(_prob(prob), n))
        .filter("__k IS NOT NULL")
        .groupBy(GROUP, "__k")
        .agg(_sum_if(event, w).alias("__pos"), _sum_if(~event, w).alias("__neg"))
    )
    return _sweep_of_cells(cells, keys, n)


def _sweep_of_cells(cells: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Counts and scores at all thresholds from events (``__pos``) and non-events (``__neg``) per threshold index ``__k``."""
    group = Window.partitionBy(GROUP)
    down = group.orderBy(F.col("__k").desc())
    running = down.rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({
        "__tp": F.sum("__pos").over(running),
        "__fp": F.sum("__neg").over(running),
        "__allpos": F.sum("__pos").over(group),
        "__allneg": F.sum("__neg").over(group),
        "__next": F.lead("__k").over(down),
        "__first": F.row_number().over(down) == 1,
    })
    low = F.greatest(F.coalesce(F.col("__next") + 1, F.lit(0)), F.lit(0))
    high = F.when(F.col("__first"), F.lit(n)).otherwise(F.col("__k"))
    cells = cells.filter(low <= high).withColumn("__t", F.explode(F.sequence(low, high)))
    above = F.col("__t") > F.col("__k")
    tp = F.when(above, F.lit(0)).otherwise(F.col("__tp"))
    fp = F.when(above, F.lit(0)).otherwise(F.col("__fp"))
    value = F.when(F.col("__t") == n, NEVER).otherwise(_threshold(F.col("__t"), n, 1.0 / (n - 1)))
    counts = cells.select(
        *group_keys(keys), value.alias("Threshold"), tp.alias("TP"), fp.alias("FP"),
        (F.col("__allpos") - tp).alias("FN"), (F.col("__allneg") - fp).alias("TN"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    return counts.withColumns({
        "POD": ratio_or_zero(tp, tp + fn),
        "POFD": ratio_or_zero(fp, fp + tn),
        "FAR": ratio_or_zero(fp, fp + tp),
        "CSI": ratio(tp, tp + fp + fn),
    })


def sweep_cells(df: DataFrame, keys: str | Iterable[str], n: int = SWEEP) -> DataFrame:
    """Rows per (threshold index, event): keys, ``cell`` (2 * (index + 1) + event), ``w``. Needs probability and label."""
    cell = (sweep_index(_prob("prob"), n) + 1) * 2 + (F.col("label") >= OBSERVED).cast("int")
    return df.withColumn("cell", cell).filter("cell IS NOT NULL").groupBy(*names(keys), "cell").agg(F.count(F.lit(1)).alias("w"))


def sweep_of_cells(cells: DataFrame, keys: str | Iterable[str], n: int = SWEEP) -> DataFrame:
    """The threshold sweep from the cells of ``sweep_cells``."""
    keys = names(keys)
    event = F.col("cell") % 2 == 1
    index = (F.expr("cell div 2") - 1).cast("int")
    summed = with_group(cells, keys).groupBy(GROUP, index.alias("__k")).agg(_sum_if(event, F.col("w")).alias("__pos"), _sum_if(~event, F.col("w")).alias("__neg"))
    return _sweep_of_cells(summed, keys, n)


def contingency(df: DataFrame, keys: str | Iterable[str] | None = None, threshold: float = DECISION, prob: str = "prob", label: str = "label") -> DataFrame:
    """2x2 matrix: one row per observed class, a column per forecast class."""
    classes = df.withColumns({"observed": F.col(label).cast("int"), "__yes": (_prob(prob) >= threshold).cast("int")})
    matrix = classes.groupBy(*names(keys), "observed").pivot("__yes", [0, 1]).count()
    return matrix.select(
        *names(keys), "observed", F.coalesce(F.col("0"), F.lit(0)).alias("forecast_no"), F.coalesce(F.col("1"), F.lit(0)).alias("forecast_yes")
    )


def reliability_bins(width: float = BIN_WIDTH) -> int:
    """Number of bins on the edges 0, width, ... below 1.1."""
    return int(-(-(BIN_RANGE - 1e-9) // width)) - 1


def bin_index(prob: Column, width: float) -> Column:
    """Integer bin of a probability; NULL stays NULL, values outside the edges go to the first or last bin."""
    bin_id = F.floor(prob / F.lit(width) + BIN_SLACK).cast("int")
    return F.when(prob.isNotNull(), F.greatest(F.least(bin_id, F.lit(reliability_bins(width) - 1)), F.lit(0)))


def reliability_frequencies(
    df: DataFrame, keys: str | Iterable[str] | None = None, width: float = BIN_WIDTH,
    prob: str = "prob", label: str = "label", weight: str | None = None,
) -> DataFrame:
    """Total and positive counts for every edge, empty ones included; one row more than the curve.

    Bin ids are integers, ``prob / width`` rounded at the ninth digit and floored, so edges such as 0.15 are exact;
    the last curve bin is closed, so no forecast drops out. Rows without probability or label do not count.
    """
    keys = names(keys)
    last = reliability_bins(width)
    event, w = F.col(label) >= OBSERVED, _weight(weight)
    counted = (
        with_group(df, keys)
        .withColumn("__b", bin_index(_prob(prob), width))
        .filter(F.col("__b").isNotNull() & F.col(label).isNotNull())
        .groupBy(GROUP, "__b")
        .agg(F.sum(w).cast("bigint").alias("__n"), _sum_if(event, w).alias("__pos"))
    )
    # at most `last + 1` entries per key
    per_key = counted.groupBy(GROUP).agg(F.collect_list(F.struct("__b", "__n", "__pos")).alias("__cells"))
    rows = per_key.select(GROUP, "__cells", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("bin"))
    cell = F.get(F.filter("__cells", lambda c: c["__b"] == F.col("bin")), 0)
    count = lambda field: F.coalesce(cell[field], F.lit(0)).cast("bigint")
    return rows.select(
        *group_keys(keys), "bin",
        (F.col("bin") * F.lit(width)).alias("Bin_Start"),
        count("__n").alias("Total_Freq"), count("__pos").alias("Positive_Freq"),
    )


def reliability_of_cells(cells: DataFrame, keys: str | Iterable[str], width: float = BIN_WIDTH) -> DataFrame:
    """The reliability curve from the cells of ``forecast_cells``."""
    centre = F.expr(f"cell div {len(OUTCOMES)}") * F.lit(width) + F.lit(width / 2)
    event = (F.col("cell") % len(OUTCOMES)).isin(OUTCOMES.index("tp"), OUTCOMES.index("fn")).cast("int")
    return reliability_curve(cells.select(*names(keys), centre.alias("prob"), event.alias("label"), "w"), keys, width, weight="w")


def reliability_curve(df: DataFrame, keys=None, width: float = BIN_WIDTH, prob="prob", label="label", weight: str | None = None) -> DataFrame:
    """Observed relative frequency per probability bin, NULL for an empty bin."""
    rows = reliability_frequencies(df, keys, width, prob, label, weight).filter(F.col("bin") < reliability_bins(width))
    return rows.select(
        *names(keys), "bin", "Bin_Start",
        (F.col("Bin_Start") + F.lit(width / 2)).alias("Bin_Center"),
        "Total_Freq", "Positive_Freq",
        ratio("Positive_Freq", "Total_Freq").alias("Positive_Relative_Freq"),
    )


def brier_components(curve: DataFrame, keys: str | Iterable[str] | None = None, representative: str = "Bin_Center") -> DataFrame:
    """Murphy's decomposition from a reliability curve: BS, BSS, reliability, resolution, uncertainty, climo."""
    keys = names(keys)
    n, o, f = F.col("Total_Freq"), F.col("Positive_Relative_Freq"), F.col(representative)
    # reliability and resolution as moments, so one aggregate is enough
    sums = curve.groupBy(*keys).agg(
        F.sum("Total_Freq").alias("__n"), F.sum("Positive_Freq").alias("__p"),
        F.sum(n * (f - o) * (f - o)).alias("__rel"), F.sum(n * o * o).alias("__oo"),
    )
    climo = ratio("__p", "__n")
    parts = sums.select(
        *keys, climo.alias("climo"), ratio("__rel", "__n").alias("reliability"),
        (ratio("__oo", "__n") - climo * climo).alias("resolution"), (climo * (1 - climo)).alias("uncertainty"),
    )
    bs = F.col("reliability") - F.col("resolution") + F.col("uncertainty")
    bss = F.try_divide(F.col("resolution") - F.col("reliability"), F.col("uncertainty"))
    return parts.select(*keys, bs.alias("BS"), bss.alias("BSS"), "reliability", "resolution", "uncertainty", "climo")


def brier_score(df: DataFrame, keys=None, prob="prob", label="label") -> DataFrame:
    """Mean squared error of the probabilities, without binning."""
    error = _prob(prob) - F.col(label)
    return df.groupBy(*names(keys)).agg(F.avg(error * error).alias("BS_exact"))


def outcome_class(threshold: float = DECISION, prob: str = "prob", label: str = "label") -> Column:
    """Class of a forecast; NULL if the probability or the label is missing."""
    yes, event = _prob(prob) >= threshold, F.col(label) >= OBSERVED
    known = yes.isNotNull() & event.isNotNull()
    return F.when(known, F.when(yes & event, "tp").when(yes, "fp").when(event, "fn").otherwise("tn"))


def outcomes(df: DataFrame, threshold: float = DECISION, prob: str = "prob", label: str = "label") -> DataFrame:
    """Adds ``outcome`` and ``confident`` (yes at 0.99 and more, no below 0.01); both NULL without a class."""
    outcome = outcome_class(threshold, prob, label)
    p = _prob(prob)
    confident = F.when(outcome.isin("tp", "fp"), p >= CONFIDENT_YES).when(outcome.isNotNull(), p < CONFIDENT_NO)
    return df.withColumns({"outcome": outcome, "confident": confident})


def composites(forecasts: DataFrame, patches: DataFrame, on: str | Iterable[str] = "patch_id", threshold: float = DECISION) -> DataFrame:
    """Patch features of each outcome group; the confident subsets are a flag, not copies."""
    return outcomes(forecasts, threshold).where("outcome IS NOT NULL").join(patches, names(on))


def composite_groups(composed: DataFrame) -> DataFrame:
    """Long form with the eight group names ``tp, tp_99, fp, fp_99, fn, fn_01, tn, tn_01``."""
    suffix = F.when(F.col("outcome").isin("tp", "fp"), "_99").otherwise("_01")
    groups = F.when(F.col("confident"), F.array(F.col("outcome"), F.concat("outcome", suffix))).otherwise(F.array("outcome"))
    return composed.withColumn("group", F.explode(groups))


#: Outcomes in the order of their cell numbers.
OUTCOMES = ("tp", "fp", "fn", "tn")


def forecast_cell(width: float = BIN_WIDTH, threshold: float = DECISION) -> Column:
    """Reliability bin * 4 + place of the outcome in OUTCOMES; NULL without probability or label."""
    yes, event, at = _prob("prob") >= threshold, F.col("label") >= OBSERVED, OUTCOMES.index
    outcome = F.when(yes, F.when(event, at("tp")).otherwise(at("fp"))).otherwise(F.when(event, at("fn")).otherwise(at("tn")))
    return bin_index(_prob("prob"), width) * len(OUTCOMES) + F.when(yes.isNotNull() & event.isNotNull(), outcome)


def forecast_cells(df: DataFrame, keys: str | Iterable[str], width: float = BIN_WIDTH, threshold: float = DECISION, weight: str | None = None) -> DataFrame:
    """Rows per (reliability bin, outcome): keys, ``cell``, ``w``.

    Confusion counts, curve and Brier parts all follow from these cells. Rows without
    probability or label do not count.
    """
    cells = df.withColumn("cell", forecast_cell(width, threshold)).filter("cell IS NOT NULL")
    return cells.groupBy(*names(keys), "cell").agg(F.sum(_weight(weight)).cast("bigint").alias("w"))


def evaluate(df: DataFrame, keys: str | Iterable[str], width: float = BIN_WIDTH, threshold: float = DECISION, weight: str | None = None) -> DataFrame:
    """Scalar scores and Brier parts of every member, or replicate, in one pass over the forecasts."""
    return evaluate_cells(forecast_cells(df, keys, width, threshold, weight), keys, width, threshold)


def evaluate_cells(cells: DataFrame, keys: str | Iterable[str], width: float = BIN_WIDTH, threshold: float = DECISION) -> DataFrame:
    """Scores and Brier parts from the cells of ``forecast_cells``."""
    keys = names(keys)
    place = F.col("cell") % len(OUTCOMES)
    total = lambda *o: F.coalesce(F.sum(F.when(place.isin(*[OUTCOMES.index(x) for x in o]), F.col("w"))), F.lit(0)).cast("bigint")
    curve = cells.groupBy(*keys, F.expr(f"cell div {len(OUTCOMES)}").alias("__b")).agg(
        total("tp").alias("TP"), total("fp").alias("FP"), total("fn").alias("FN"), total("tn").alias("TN"),
        F.sum("w").alias("Total_Freq"), total("tp", "fn").alias("Positive_Freq"),
    )
    center = F.col("__b") * F.lit(width) + F.lit(width / 2)
    n, rate = F.col("Total_Freq"), F.col("Positive_Freq") / F.col("Total_Freq")
    sums = curve.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("TP", "FP", "FN", "TN")],
        F.sum(n * (center - rate) * (center - rate)).alias("__rel"), F.sum(n * rate * rate).alias("__oo"),
        F.sum(n).alias("__n"), F.sum("Positive_Freq").alias("__p"),
    )
    scored = scalar_scores(sums, threshold)
    climo = ratio("__p", "__n")
    scored = scored.withColumns({
        "climo": climo,
        "reliability": ratio("__rel", "__n"),
        "resolution": ratio("__oo", "__n") - climo * climo,
        "uncertainty": climo * (1 - climo),
    })
    scored = scored.withColumns({
        "BS": F.col("reliability") - F.col("resolution") + F.col("uncertainty"),
        "BSS": F.try_divide(F.col("resolution") - F.col("reliability"), F.col("uncertainty")),
    })
    return scored.drop("__rel", "__oo", "__n", "__p")
