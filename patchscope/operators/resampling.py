"""Bootstrap: draws with replacement as integer weights, scored in one plan.

A model maps each row to a probability on its own, so resampled predictions are gathered
predictions: nothing is predicted again, and only slim forecast rows meet the draws.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchscope.functions.arrays import inside
from patchscope.functions.hashing import draw_below, draw_int
from patchscope.functions.mixing import PRIME, combined, draw_array
from patchscope.operators import verification as V
from patchscope.operators.quantiles import PARTS, SKETCH, percentiles_of_replicates, with_value_bucket
from patchscope.operators.relational import GROUP, group_keys, keyed_join, names, small_side, spread, with_group

# Interval reported by the median table, replicates of the published results.
INTERVAL = (0.025, 0.975)
PUBLISHED_REPS = 1000
# draws made by one row of work
STRETCH = 1 << 16


def replicate_ids(start: int, n: int):
    """Array of replicate ids ``start .. start+n-1``, so shards add up without overlap."""
    return F.sequence(F.lit(start), F.lit(start + n - 1))


def bootstrap_weights(
    df: DataFrame, keys: str | Iterable[str] | None, row_no: str, reps: int, seed=0, first_rep: int = 1,
    size: str | None = None,
) -> DataFrame:
    """How often each row is drawn in each replicate: keys, ``rep``, ``row_no``, ``w``.

    ``row_no`` counts 0..n-1 inside a key. Row s of a key makes draw s of every replicate,
    so the draws are created where the rows are, and they shuffle once, on
    (key, row_no, rep). A draw is ``hash(seed, rep, keys, slot) mod n``. ``size`` names a
    column that already holds n; otherwise the rows of each key are counted first, and
    numbers that do not end at n-1 fail.
    """
    keys = names(keys)
    grouped = with_group(spread(df.select(*keys, row_no, *names(size)), [*keys, row_no]), keys)
    if size:
        sized = grouped.select(GROUP, F.col(row_no).alias("__slot"), F.col(size).alias("__n"))
    else:
        slots = grouped.select(GROUP, F.col(row_no).alias("__slot"))
        n = F.count(F.lit(1))
        gap = F.raise_error(F.lit("row numbers must count 0..n-1 inside each key")).cast("bigint")
        sized = slots.join(small_side(slots.groupBy(GROUP).agg(F.when(F.max("__slot") == n - 1, n).otherwise(gap).alias("__n"))), GROUP)
    sized = sized.withColumn("rep", F.explode(replicate_ids(first_rep, reps)))
    parts = [F.col(f"{GROUP}.{k}") for k in keys]
    drawn = sized.select(GROUP, "rep", draw_below("__n", seed, "rep", *parts, "__slot").alias(row_no))
    weights = drawn.groupBy(GROUP, row_no, "rep").agg(F.count(F.lit(1)).alias("w"))
    return weights.select(*group_keys(keys), "rep", row_no, "w")


def bootstrap_sample(df: DataFrame, keys, row_no: str, reps: int, seed=0, first_rep: int = 1, size: str | None = None) -> DataFrame:
    """Every row with its replicate and weight; rows of weight 0 are absent."""
    keys = names(keys)
    weights = bootstrap_weights(df, keys, row_no, reps, seed, first_rep, size)
    left = with_group(df, keys)
    right = with_group(weights, keys).select(GROUP, row_no, "rep", "w")
    return left.join(right, [GROUP, row_no]).drop(GROUP)


def bootstrap_forecasts(df: DataFrame, keys, row_no: str, reps: int, seed=0, first_rep: int = 1, size: str | None = None) -> DataFrame:
    """Slim weighted forecasts for the score operators: use key ``rep`` and weight ``w``."""
    keys = names(keys)
    slim = df.select(*keys, row_no, "prob", "label", *names(size))
    return bootstrap_sample(slim, keys, row_no, reps, seed, first_rep, size)


def bootstrap_scores(
    df: DataFrame, keys, row_no: str, reps: int, seed=0, first_rep: int = 1,
    width: float = V.BIN_WIDTH, threshold: float = V.DECISION, size: str | None = None,
) -> DataFrame:
    """Scalar and Brier scores of every replicate.

    One pass: forecasts collapse to (bin, class) cells per replicate, from which both the
    confusion counts and the reliability curve follow.
    """
    keys = names(keys)
    sample = bootstrap_forecasts(df, keys, row_no, reps, seed, first_rep, size)
    return V.evaluate(sample, [*keys, "rep"], width, threshold, weight="w")


def bootstrap_sweep(df: DataFrame, keys, row_no: str, reps: int, seed=0, first_rep: int = 1, n: int = V.SWEEP, size: str | None = None) -> DataFrame:
    """Threshold sweep of every replicate."""
    keys = names(keys)
    return V.threshold_sweep(bootstrap_forecasts(df, keys, row_no, reps, seed, first_rep, size), [*keys, "rep"], n, weight="w")


def bootstrap_reliability(df: DataFrame, keys, row_no: str, reps: int, seed=0, first_rep: int = 1, width: float = V.BIN_WIDTH, size: str | None = None) -> DataFrame:
    """Reliability curve of every replicate."""
    keys = names(keys)
    return V.reliability_curve(bootstrap_forecasts(df, keys, row_no, reps, seed, first_rep, size), [*keys, "rep"], width, weight="w")


def count_draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the draws of each stretch hit each cell: group, ``rep``, ``cell``, ``w``."""
    for batch in batches:
        row, cell, w = [], [], []
        numbers = zip(*(batch[c].to_pylist() for c in ("__seed", "__from", "__n")))
        for i, (seed, start, n) in enumerate(numbers):
            draws = draw_array(np.arange(start, min(start + STRETCH, n), dtype=np.int64), seed, n)
            hits = np.bincount(np.searchsorted(batch["__upto"][i].values.to_numpy(), draws, side="right"))
            hit = np.flatnonzero(hits)
            row.append(np.full(len(hit), i))
            cell.append(batch["__names"][i].values.to_numpy()[hit])
            w.append(hits[hit])
        if row:
            at = pa.array(np.concatenate(row))
            kind = batch.schema.field("__names").type.value_type
            columns = [batch[GROUP].take(at), batch["rep"].take(at), pa.array(np.concatenate(cell), kind), pa.array(np.concatenate(w), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [GROUP, "rep", "cell", "w"])


def drawn_cells(cells: DataFrame, keys, reps: int, n_cells: int, seed=0, first_rep: int = 1) -> DataFrame:
    """Bootstrap on counted rows: how often each cell is drawn in each replicate, keys, ``rep``, ``cell``, ``w``.

    ``cells`` has keys, ``cell`` in [0, n_cells) and ``w``, its rows. Rows are thought of as
    numbered cell by cell, so each cell is one range of numbers, and a draw below n finds its
    cell by binary search in the running sums. What is spread is one row per (key, replicate,
    stretch of draws), draws are counted where they are made, and nothing is joined.
    """
    keys = names(keys)
    below = Window.partitionBy(GROUP).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    summed = with_group(cells, keys).withColumn("__upto", F.sum("w").over(below))
    counted = summed.groupBy(GROUP).agg(F.sort_array(F.collect_list(F.struct("cell", "__upto"))).alias("__cells"))
    counted = counted.select(GROUP, F.col("__cells.cell").alias("__names"), F.col("__cells.__upto").alias("__upto"))
    parts = [F.col(f"{GROUP}.{k}") for k in keys]
    counted = counted.withColumns({"__n": F.element_at("__upto", -1), "__key_seed": draw_int(seed, *parts) % PRIME})
    each = counted.withColumn("rep", F.explode(replicate_ids(first_rep, reps)))
    each = each.withColumn("__seed", combined(F.col("__key_seed"), F.col("rep").cast("bigint")))
    each = each.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(STRETCH).cast("bigint"))))
    partitions = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = each.repartition(partitions, GROUP, "rep", "__from")
    kinds = {f.name: f.dataType for f in each.schema}
    schema = T.StructType([T.StructField(GROUP, kinds[GROUP]), T.StructField("rep", kinds["rep"]), T.StructField("cell", kinds["__names"].elementType), T.StructField("w", T.LongType())])
    counts = each.select(GROUP, "rep", "__seed", "__from", "__n", "__names", "__upto").mapInArrow(count_draws, schema)
    drawn = counts.groupBy(GROUP, "rep", "cell").agg(F.sum("w").alias("w"))
    return drawn.select(*group_keys(keys), "rep", "cell", "w")


def cell_bootstrap_scores(
    df: DataFrame, keys, reps: int = PUBLISHED_REPS, seed=0, first_rep: int = 1, width: float = V.BIN_WIDTH, threshold: float = V.DECISION,
) -> DataFrame:
    """Scalar and Brier scores of every replicate, drawn on (bin, outcome) cells."""
    keys = names(keys)
    cells = V.forecast_cells(df, keys, width, threshold)
    drawn = drawn_cells(cells, keys, reps, V.reliability_bins(width) * len(V.OUTCOMES), seed, first_rep)
    return V.evaluate_cells(drawn, [*keys, "rep"], width, threshold)


def cell_bootstrap_reliability(df: DataFrame, keys, reps: int = PUBLISHED_REPS, seed=0, first_rep: int = 1, width: float = V.BIN_WIDTH) -> DataFrame:
    """Reliability curve of every replicate, drawn on (bin, outcome) cells."""
    keys = names(keys)
    drawn = drawn_cells(V.forecast_cells(df, keys, width), keys, reps, V.reliability_bins(width) * len(V.OUTCOMES), seed, first_rep)
    return V.reliability_of_cells(drawn, [*keys, "rep"], width)


def cell_bootstrap_sweep(df: DataFrame, keys, reps: int = PUBLISHED_REPS, seed=0, first_rep: int = 1, n: int = V.SWEEP) -> DataFrame:
    """Threshold sweep of every replicate, drawn on (threshold index, event) cells."""
    keys = names(keys)
    return V.sweep_of_cells(drawn_cells(V.sweep_cells(df, keys, n), keys, reps, 2 * n + 2, seed, first_rep), [*keys, "rep"], n)


def bootstrap_medians(
    df: DataFrame, keys, row_no: str, values: str, reps: int, seed=0, first_rep: int = 1,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Median over all pixels of the drawn patches, per replicate: keys, ``rep``, ``median``.

    Patches enter as value histograms over split points that a sketch gives. They locate the two
    buckets that hold the middle ranks of each replicate; only pixels of those buckets
    are then weighted and ordered. Exact for any split points.
    """
    keys = names(keys)
    missing = F.lit(None).cast("double")
    patches = with_group(df, keys).select(GROUP, row_no, values)
    pixels = patches.select(GROUP, row_no, F.explode(values).alias("__v"))
    pixels = pixels.withColumn("__v", F.nanvl(F.col("__v").cast("double"), missing)).filter("__v IS NOT NULL")
    if splits is None:
        splits = middle_splits(pixels)
    pixels = with_value_bucket(pixels, "__v", splits)
    counted = pixels.groupBy(GROUP, row_no, "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    weights = with_group(bootstrap_weights(df, keys, row_no, reps, seed, first_rep), keys).select(GROUP, row_no, "rep", "w")

    cells = counted.join(weights, [GROUP, row_no]).groupBy(GROUP, "rep", "__bucket")
    cells = cells.agg(F.sum(F.col("__c") * F.col("w")).alias("__cell"))
    replicate = Window.partitionBy(GROUP, "rep")
    below = replicate.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({
        "__start": F.coalesce(F.sum("__cell").over(below), F.lit(0)),
        "__total": F.sum("__cell").over(replicate),
    })
    lo, hi = F.floor((F.col("__total") - 1) / 2), F.ceil((F.col("__total") - 1) / 2)
    end = F.col("__start") + F.col("__cell")
    holds = ((lo >= F.col("__start")) & (lo < end)) | ((hi >= F.col("__start")) & (hi < end))
    needed = cells.filter(holds).select(GROUP, "rep", "__bucket", "__start", lo.alias("__lo"), hi.alias("__hi"))

    # narrow the weights to the needed buckets before they meet pixels
    drawn = needed.join(counted.join(weights, [GROUP, row_no]), [GROUP, "rep", "__bucket"])
    near = drawn.join(pixels, [GROUP, row_no, "__bucket"])
    near = near.groupBy(GROUP, "rep", "__bucket", "__start", "__lo", "__hi", "__v").agg(F.sum("w").alias("__w"))
    inside = Window.partitionBy(GROUP, "rep", "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__upto", F.sum("__w").over(inside) + F.col("__start"))
    start = F.col("__upto") - F.col("__w")
    at = lambda rank: F.max(F.when((F.col(rank) >= start) & (F.col(rank) < F.col("__upto")), F.col("__v")))
    medians = near.groupBy(GROUP, "rep").agg(at("__lo").alias("__a"), at("__hi").alias("__b"))
    return medians.select(*group_keys(keys), "rep", ((F.col("__a") + F.col("__b")) / 2).alias("median"))


def middle_splits(pixels: DataFrame, value: str = "__v") -> list[float]:
    """Split points from sketches: coarse in the tails, 0.2 % of all values apart around the median, where the replicates' medians lie.

    Pools the groups, as any split points give the exact result; a few hundred numbers reach the driver.
    """
    ranks = sorted({*np.round(np.linspace(0.02, 0.98, 49), 3).tolist(), *np.round(np.linspace(0.4, 0.6, 101), 3).tolist()})
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("__part")
    sketches = pixels.groupBy(part).agg(F.kll_sketch_agg_double(value, F.lit(SKETCH)).alias("__s"))
    row = sketches.agg(F.kll_merge_agg_double("__s").alias("__s")).select(F.kll_sketch_get_n_double("__s").alias("n"), "__s")
    found = row.filter("n > 0").select(F.kll_sketch_get_quantile_double("__s", F.array(*[F.lit(q) for q in ranks])).alias("q")).first()
    return sorted({float(v) for v in (found["q"] if found else []) if abs(v) != float("inf")})


def bootstrap_median_interval(df: DataFrame, keys, row_no, values, reps, seed=0, interval=INTERVAL, splits=None) -> DataFrame:
    """Percentile interval of the resampled median."""
    medians = bootstrap_medians(df, keys, row_no, values, reps, seed, splits=splits)
    return percentiles_of_replicates(medians, keys, "median", interval)


def feature_median_intervals(
    patches: DataFrame, scaler: DataFrame, keys, row_no: str, features: Sequence[str], reps: int = PUBLISHED_REPS, seed=0,
    mask: str | None = None, grams: Sequence[str] = (), interval=INTERVAL,
) -> DataFrame:
    """Interval of the resampled median of each feature in physical units: keys, ``feature``, ``q2_5``, ``q97_5``.

    Patches hold standardised arrays; with ``mask`` only pixels in storms count. The ends are mapped
    back by the scaler (``feature``, ``mean``, ``std``), features in ``grams`` times 1000.
    Each feature is resampled on its own.
    """
    keys = names(keys)
    values = lambda f: inside(f, mask, None) if mask else F.col(f)
    long = patches.select(*keys, row_no, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), values(f).alias("__values")) for f in features])))
    ends = bootstrap_median_interval(long, [*keys, "feature"], row_no, "__values", reps, seed, interval)
    ends = keyed_join(ends, scaler.select("feature", "mean", "std"), ["feature"])
    unit = F.when(F.col("feature").isin(list(grams)), 1000.0).otherwise(1.0)
    quantiles = [c for c in ends.columns if c not in (*keys, "feature", "mean", "std")]
    return ends.select(*keys, "feature", *[((F.col(q) * F.col("std") + F.col("mean")) * unit).alias(q) for q in quantiles])


def envelope(df: DataFrame, keys: str | Iterable[str], columns: Sequence[str], interval: Sequence[float] | None = None) -> DataFrame:
    """Minimum and maximum of each column over replicates, or percentile bounds."""
    aggregates = []
    for c in columns:
        if interval is None:
            aggregates += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
        else:
            low, high = interval
            aggregates += [
                F.percentile(c, F.lit(float(low))).alias(f"{c}_low"),
                F.percentile(c, F.lit(float(high))).alias(f"{c}_high"),
            ]
    return df.groupBy(*names(keys)).agg(*aggregates)
