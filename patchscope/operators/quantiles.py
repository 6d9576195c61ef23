"""Exact order statistics that never gather a group in one task.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. That is
fine for a few hundred replicates (``percentiles_of_replicates``), not for all pixels of
a climate. ``exact_percentiles`` asks a mergeable sketch of each group between which values
the wanted ranks must lie; values below are only counted, those between are shuffled and
ordered, the rest is dropped in the task that reads it. Weighted percentiles and ``rank_auc``
cut the value axis at split points. Sketches and splits only steer the work, any choice gives
the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchscope.operators.relational import GROUP, group_keys, names, small_side, with_group
from patchscope.session import checkpointed

SPLITS = 1024
SAMPLE_ROWS = 1_000_000
# size of a sketch; its rank error is about 0.1 %
SKETCH = 4096
# share of the ranks that a bracket reaches beyond the wanted ones, on each side
REACH = 0.002
# steps of the ranks at which a sketch is asked
GRID = 2000
# rows in a bracket that are ordered without narrowing it again
ORDERED_ROWS = 4_000_000
# parts in which the sketches of a group are merged before they meet
PARTS = 64


def split_points(df: DataFrame, column: str, n: int = SPLITS) -> list[float]:
    """About ``n`` increasing values that cut ``column`` into similar shares.

    Works on a sample of bounded size, and at most ``n`` numbers reach the driver. ``df``
    should be a stored table, whose row count is known from its files.
    """
    rows = df.count()
    if rows > SAMPLE_ROWS:
        df = df.sample(SAMPLE_ROWS / rows, seed=0)
    probabilities = [i / n for i in range(1, n)]
    values = df.select(F.col(column).cast("double").alias(column))
    row = values.agg(F.percentile_approx(column, probabilities, F.lit(10 * n)).alias("q")).first()
    return sorted({float(v) for v in (row["q"] or []) if v is not None and abs(v) != float("inf")})


def with_value_bucket(df: DataFrame, column: str, splits: Sequence[float], out: str = "__bucket") -> DataFrame:
    """Monotone bucket id of ``column`` between the split points."""
    if not splits:
        return df.withColumn(out, F.lit(0.0))
    edges = [-float("inf"), *splits, float("inf")]
    return Bucketizer(splits=edges, inputCol=column, outputCol=out, handleInvalid="keep").transform(df)


def value_counts(df: DataFrame, keys: list[str], column: str, weight: Column | None = None) -> DataFrame:
    """Weight of each distinct value; ties collapse before anything is ordered."""
    weight = F.lit(1).cast("bigint") if weight is None else weight
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    return (
        with_group(df, keys)
        .select(GROUP, value.alias("__v"), weight.alias("__w"))
        .filter("__v IS NOT NULL AND __w > 0")
        .groupBy(GROUP, "__v")
        .agg(F.sum("__w").alias("__w"))
    )


def exact_percentiles(
    df: DataFrame, keys: str | Iterable[str] | None, column: str, probabilities: Sequence[float], weight: Column | None = None,
    splits: Sequence[float] | None = None, reach: float = REACH, ordered_rows: int = ORDERED_ROWS,
) -> DataFrame:
    """Linear-interpolated percentiles per key: columns keys, ``p``, ``value``.

    NULL and NaN are skipped. With ``weight`` each value counts that many times. Runs jobs
    when called: one pass of sketches (more only while a bracket holds over ``ordered_rows``)
    and one that orders what lies in the brackets. If a bracket misses its ranks, which the
    counts show, the work is repeated with a wider one.
    """
    if weight is not None or splits is not None:
        return percentiles_of_counts(df, keys, column, probabilities, weight, splits)
    keys = names(keys)
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    rows = with_group(df, keys).select(GROUP, value.alias("__v")).filter("__v IS NOT NULL")
    brackets = _brackets(rows, probabilities, reach, ordered_rows)
    at = lambda rank: F.max(F.when((F.col(rank) >= F.col("__from")) & (F.col(rank) < F.col("__upto")), F.col("__v")))
    inside = Window.partitionBy(GROUP, "p").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0)
    counted = bracketed(rows, brackets).withColumn("__upto", F.sum("__w").over(inside)).withColumn("__from", F.col("__upto") - F.col("__w"))
    counted = counted.join(brackets.select(GROUP, "p", "__lo", "__hi", "__at"), [GROUP, "p"])
    found = checkpointed(counted.groupBy(GROUP, "p", "__lo", "__hi", "__at").agg(at("__lo").alias("__a"), at("__hi").alias("__b")))
    if found.filter("__a IS NULL OR __b IS NULL").take(1):
        return exact_percentiles(df, keys, column, probabilities, reach=4 * reach, ordered_rows=ordered_rows)
    fraction = F.greatest(F.col("__at") - F.col("__lo"), F.lit(0.0))
    between = F.col("__a") + (F.col("__b") - F.col("__a")) * fraction
    return found.select(*group_keys(keys), "p", F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(between).alias("value"))


def bracketed(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Weights of the distinct values inside each bracket, and of all below together (a NULL value); above nothing is kept."""
    met = rows.join(brackets.select(GROUP, "p", "__low", "__high"), GROUP).filter("__v <= __high")
    kept = F.when(F.col("__v") >= F.col("__low"), F.col("__v"))
    return met.groupBy(GROUP, "p", kept.alias("__v")).agg(F.count(F.lit(1)).alias("__w"))


def _brackets(rows: DataFrame, probabilities: Sequence[float], reach: float, ordered_rows: int) -> DataFrame:
    """Per group and probability: ranks ``__lo``, ``__hi``, ``__at`` and values ``__low``, ``__high`` around them. Stored."""
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
    sketched = lambda grouped, v: grouped.agg(F.kll_sketch_agg_double(v, F.lit(SKETCH)).alias("__s"), F.count(v).alias("__m"))
    whole = sketched(rows.groupBy(GROUP, part.alias("__part")), F.col("__v"))
    whole = whole.groupBy(GROUP).agg(F.kll_merge_agg_double("__s").alias("__s"), F.sum("__m").alias("__m"))
    wanted = F.explode(F.array(*[
        F.struct(
            F.lit(float(p)).alias("p"), F.floor((F.col("__m") - 1) * p + 1e-9).alias("__lo"), F.ceil((F.col("__m") - 1) * p - 1e-9).alias("__hi"),
            ((F.col("__m") - 1) * F.lit(float(p))).alias("__at"))
        for p in probabilities]))
    state = whole.withColumn("__t", wanted).select(GROUP, "__t.*", "__s", "__m", F.lit(0).cast("bigint").alias("__below"))
    infinite = float("inf")
    state = state.withColumns({"__low": F.lit(-infinite), "__high": F.lit(infinite)})
    for _ in range(4):
        first, last = F.col("__lo") - F.col("__below"), F.col("__hi") - F.col("__below") + 1
        missed = (first < 0) | (last > F.col("__m"))
        low, high = first / F.col("__m") - reach, last / F.col("__m") + reach
        quantile = lambda place: F.get("__grid", F.greatest(F.least(place.cast("int"), F.lit(GRID)), F.lit(0)))
        # an end that the reach passes stays where it was, a bracket that missed opens again
        state = state.withColumn("__grid", F.kll_sketch_get_quantile_double("__s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])))
        state = state.withColumns({
            "__low": F.when(missed, -infinite).when(low > 0, quantile(F.floor(low * GRID))).otherwise(F.col("__low")),
            "__high": F.when(missed, infinite).when(high < 1, quantile(F.ceil(high * GRID))).otherwise(F.col("__high")),
        })
        state = small_side(state.drop("__s", "__grid"))
        wide = state.filter((F.col("__m") * F.lit(min(2 * reach, 1.0)) > ordered_rows) & (F.col("__low") < F.col("__high")))
        if not wide.take(1):
            break
        met = rows.join(state, GROUP).filter("__v <= __high").withColumn("__in", F.when(F.col("__v") >= F.col("__low"), F.col("__v")))
        again = met.groupBy(GROUP, "p", part.alias("__part")).agg(
            F.kll_sketch_agg_double("__in", F.lit(SKETCH)).alias("__s"), F.count("__in").alias("__m"), F.count_if(F.col("__in").isNull()).alias("__below"))
        again = again.groupBy(GROUP, "p").agg(F.kll_merge_agg_double("__s").alias("__s"), F.sum("__m").alias("__m"), F.sum("__below").alias("__below"))
        state = state.drop("__m", "__below").join(again, [GROUP, "p"])
    return state


def percentiles_of_counts(
    df: DataFrame,
    keys: str | Iterable[str] | None,
    column: str,
    probabilities: Sequence[float],
    weight: Column | None = None,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Percentiles of weighted values. Distinct values are counted and stored, and ordered where a wanted rank lies."""
    keys = names(keys)
    # the only pass over the rows; everything below reads distinct values
    counts = checkpointed(value_counts(df, keys, column, weight))
    if splits is None:
        splits = split_points(counts, "__v")
    counts = with_value_bucket(counts, "__v", splits)

    cells = counts.groupBy(GROUP, "__bucket").agg(F.sum("__w").alias("__cell"))
    below = Window.partitionBy(GROUP).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__start", F.coalesce(F.sum("__cell").over(below), F.lit(0)))
    cells = cells.withColumn("__total", F.sum("__cell").over(Window.partitionBy(GROUP)))

    wanted = F.explode(
        F.array(*[
            F.struct(
                F.lit(float(p)).alias("p"),
                F.floor((F.col("__total") - 1) * p + 1e-9).alias("lo"),
                F.ceil((F.col("__total") - 1) * p - 1e-9).alias("hi"),
                ((F.col("__total") - 1) * F.lit(float(p))).alias("at"),
            )
            for p in probabilities
        ])
    )
    targets = cells.withColumn("__t", wanted).select(GROUP, "__bucket", "__start", "__cell", "__t.*")
    end = F.col("__start") + F.col("__cell")
    holds = lambda rank: (F.col(rank) >= F.col("__start")) & (F.col(rank) < end)
    targets = targets.filter(holds("lo") | holds("hi"))

    needed = targets.groupBy(GROUP, "__bucket").agg(
        F.first("__start").alias("__start"), F.collect_list(F.struct("p", "lo", "hi", "at")).alias("__ranks")
    )
    inside = Window.partitionBy(GROUP, "__bucket").orderBy("__v")
    near = counts.join(needed, [GROUP, "__bucket"])
    near = near.withColumn("__upto", F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("__upto", F.col("__upto") + F.col("__start"))
    near = near.withColumn("__from", F.col("__upto") - F.col("__w"))
    near = near.withColumn(
        "__ranks",
        F.filter(
            "__ranks",
            lambda r: ((r["lo"] >= F.col("__from")) & (r["lo"] < F.col("__upto")))
            | ((r["hi"] >= F.col("__from")) & (r["hi"] < F.col("__upto"))),
        ),
    ).filter(F.size("__ranks") > 0)
    picked = near.withColumn("__r", F.explode("__ranks"))
    at = lambda rank: F.max(
        F.when((F.col(f"__r.{rank}") >= F.col("__from")) & (F.col(f"__r.{rank}") < F.col("__upto")), F.col("__v"))
    )
    picked = picked.groupBy(GROUP, F.col("__r.p").alias("p")).agg(
        at("lo").alias("__lo"), at("hi").alias("__hi"), F.first("__r.at").alias("__at"), F.first("__r.lo").alias("__k")
    )
    fraction = F.greatest(F.col("__at") - F.col("__k"), F.lit(0.0))
    value = F.when(F.col("__hi") == F.col("__lo"), F.col("__lo")).otherwise(
        F.col("__lo") + (F.col("__hi") - F.col("__lo")) * fraction
    )
    return picked.select(*group_keys(keys), "p", value.alias("value"))


def percentiles_of_replicates(
    df: DataFrame, keys: str | Iterable[str], column: str, probabilities: Sequence[float], prefix: str = "q"
) -> DataFrame:
    """Percentiles of groups that hold one value per replicate, hence a few thousand rows."""
    aggregates = [F.percentile(column, F.lit(float(p))).alias(f"{prefix}{_label(p)}") for p in probabilities]
    return df.groupBy(*names(keys)).agg(*aggregates)


def _label(p: float) -> str:
    text = f"{p * 100:g}"
    return text.replace(".", "_")


def rank_auc(
    df: DataFrame,
    keys: str | Iterable[str] | None,
    prob: str = "prob",
    label: str = "label",
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Area under the ROC curve of the probabilities (Mann-Whitney, ties count one half).

    NULL when a class is absent. This is the true rank AUC, unlike ``auc_binary``.
    """
    keys = names(keys)
    positive = F.col(label) >= 0.5
    value = F.nanvl(F.col(prob).cast("double"), F.lit(None).cast("double"))
    counts = (
        with_group(df, keys)
        .select(GROUP, value.alias("__v"), positive.alias("__pos"))
        .filter("__v IS NOT NULL")
        .groupBy(GROUP, "__v")
        .agg(F.count_if("__pos").alias("__np"), F.count_if(~F.col("__pos")).alias("__nn"))
    )
    counts = checkpointed(counts)
    if splits is None:
        splits = split_points(counts, "__v")
    counts = with_value_bucket(counts, "__v", splits)
    cells = counts.groupBy(GROUP, "__bucket").agg(F.sum("__nn").alias("__cell"))
    below = Window.partitionBy(GROUP).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__start", F.coalesce(F.sum("__cell").over(below), F.lit(0))).drop("__cell")
    inside = Window.partitionBy(GROUP, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    lower = counts.withColumn("__lower", F.coalesce(F.sum("__nn").over(inside), F.lit(0)))
    lower = lower.join(cells, [GROUP, "__bucket"])
    wins = F.col("__np") * (F.col("__start") + F.col("__lower") + F.col("__nn") * 0.5)
    totals = lower.groupBy(GROUP).agg(
        F.sum(wins).alias("__wins"), F.sum("__np").alias("__pos"), F.sum("__nn").alias("__neg")
    )
    auc = F.try_divide(F.col("__wins"), F.col("__pos").cast("double") * F.col("__neg"))
    return totals.select(*group_keys(keys), auc.alias("auc_rank"))
