"""Permutation importance: permute, rescore, compare, and mine the cases that flip."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchscope.functions.expressions import clip_negative
from patchscope.functions.hashing import draw_int
from patchscope.functions.mixing import PRIME, combined, text_seed, with_grid, with_inverse, with_permutation
from patchscope.operators import packed
from patchscope.operators import verification as V
from patchscope.operators.quantiles import percentiles_of_replicates
from patchscope.operators.relational import GROUP, group_keys, hashed_side, keyed_join, names, small_side, spread, with_group
from patchscope.operators.resampling import replicate_ids
from patchscope.session import checkpointed

# Whiskers and quartiles of the importance boxes.
BOX = (0.05, 0.25, 0.5, 0.75, 0.95)
NOISE_DIGITS = 12
# Band rows that may be broadcast, under 100 bytes each.
BAND_ROWS = 1_000_000


def key_grids(grouped: DataFrame, keys: Sequence[str], row_no: str, seed=0) -> DataFrame:
    """Size, number, grid and seed of every key, stored; fails unless its row numbers count 0..n-1."""
    n = F.count(F.lit(1))
    gap = F.raise_error(F.lit("row numbers must count 0..n-1 inside each key")).cast("bigint")
    sizes = grouped.groupBy(GROUP).agg(F.when(F.max(row_no) == n - 1, n).otherwise(gap).alias("__n"))
    parts = [F.col(f"{GROUP}.{k}") for k in keys]
    sizes = with_grid(sizes, "__n").withColumn("__key_seed", draw_int(seed, *parts) % PRIME)
    return small_side(sizes.withColumn("__id", F.monotonically_increasing_id()))


def permutations(
    df: DataFrame, keys, row_no: str, features: Sequence[str], reps: int, seed=0, first_rep: int = 1, carry: bool = False,
) -> DataFrame:
    """Receiver of every donor: keys, ``pfi_var``, ``perm``, ``row_no``, ``orig_row_no``.

    ``row_no`` must count 0..n-1 inside a key. Row d gives its feature to the row that a
    bijection of 0..n-1 names, one for each (key, feature, replicate); it is worked out from
    the row number, so nothing is ranked or sorted. ``carry`` lets each donor bring its
    feature along as ``donated``.
    """
    keys = names(keys)
    grouped = with_group(spread(df, [*keys, row_no]), keys)
    donated = lambda f: [F.col(f).alias("donated")] if carry else []
    variants = F.array(*[F.struct(F.lit(f).alias("pfi_var"), F.lit(text_seed(seed, f)).cast("bigint").alias("__seed"), *donated(f)) for f in features])
    # few, huge keys: broadcast where their number allows, so that no key lands in one task
    each = grouped.select(GROUP, F.col(row_no).cast("bigint").alias("orig_row_no"), *(features if carry else [])).join(key_grids(grouped, keys, row_no, seed), GROUP)
    each = each.select(GROUP, "orig_row_no", "__key_seed", "__wide", "__high", "__last", F.inline(variants))
    each = each.withColumn("perm", F.explode(replicate_ids(first_rep, reps)))
    each = each.withColumn("__seed", combined((F.col("__seed") + F.col("__key_seed")) % PRIME, F.col("perm").cast("bigint")))
    moved = with_permutation(each, "orig_row_no", "__seed", "row_no")
    return moved.select(*group_keys(keys), "pfi_var", "perm", "row_no", "orig_row_no", *(["donated"] if carry else []))


def permute_features(
    df: DataFrame, keys, row_no: str, features: Sequence[str], reps: int, seed=0, first_rep: int = 1, donors: bool = True,
) -> DataFrame:
    """Every (feature, replicate) copy of the rows, with that one feature replaced by its donor's.

    The feature travels with its donor to the receiver, and the receiver's other columns meet it
    there: plain numbers packed (see ``packed``), a whole patch array row by row. Without
    ``donors`` the donor's ``orig_row_no`` is left out; ``with_donors`` finds it again.
    """
    keys = names(keys)
    base = df.withColumnRenamed(row_no, "row_no") if row_no != "row_no" else df
    if all(packed.travels(base.schema[f].dataType) for f in features):
        grouped = with_group(base, keys)
        return packed.permuted_rows(grouped, key_grids(grouped, keys, "row_no", seed), keys, features, reps, seed, first_rep, donors)
    moved = permutations(df, keys, row_no, features, reps, seed, first_rep, carry=True)
    joined = keyed_join(moved, hashed_side(base), [*keys, "row_no"])
    replaced = {f: F.when(F.col("pfi_var") == f, F.col("donated")).otherwise(F.col(f)) for f in features}
    return joined.withColumns(replaced).drop("donated", *([] if donors else ["orig_row_no"]))


def with_donors(cases: DataFrame, rows: DataFrame, keys, features: Sequence[str], seed=0, feature: str = "pfi_var") -> DataFrame:
    """Adds ``orig_row_no``, the donor of each case (keys, feature, ``perm``, ``row_no``), by the inverse of its permutation."""
    keys = names(keys)
    grids = key_grids(with_group(rows, keys), keys, "row_no", seed)
    seeds = F.coalesce(*[F.when(F.col(feature) == f, F.lit(text_seed(seed, f)).cast("bigint")) for f in features])
    placed = with_group(cases, keys).join(grids, GROUP)
    placed = placed.withColumn("__seed", combined((seeds + F.col("__key_seed")) % PRIME, F.col("perm").cast("bigint")))
    return with_inverse(placed, "row_no", "__seed", "orig_row_no").select(*cases.columns, "orig_row_no")


def permute_feature(df: DataFrame, keys, row_no: str, feature: str, seed=0, rep: int = 1) -> DataFrame:
    """One permutation of one feature."""
    return permute_features(df, keys, row_no, [feature], 1, seed, rep).drop("pfi_var", "perm")


def permutation_outcomes(
    df: DataFrame, keys, row_no: str, features: Sequence[str], reps: int,
    scorer: Callable[[DataFrame], DataFrame], seed=0, first_rep: int = 1, threshold: float = V.DECISION, donors: bool = True,
) -> DataFrame:
    """Permute, score, classify: keys, ``pfi_var``, ``perm``, ``row_no``, ``orig_row_no`` (with ``donors``), ``prob``, ``label``, ``outcome``."""
    scored = scorer(permute_features(df, keys, row_no, features, reps, seed, first_rep, donors))
    scored = scored.withColumn("outcome", V.outcome_class(threshold))
    return scored.select(*names(keys), "pfi_var", "perm", "row_no", *(["orig_row_no"] if donors else []), "prob", "label", "outcome")


def permutation_scores(outcomes: DataFrame, keys, width: float = V.BIN_WIDTH, threshold: float = V.DECISION) -> DataFrame:
    """Scalar and Brier scores of every permutation."""
    return V.evaluate(outcomes, [*names(keys), "pfi_var", "perm"], width, threshold)


def permutation_sweep(outcomes: DataFrame, keys, n: int = V.SWEEP) -> DataFrame:
    """Contingency counts and scores of every permutation at every threshold."""
    return V.threshold_sweep(outcomes, [*names(keys), "pfi_var", "perm"], n=n)


def permutation_reliability(outcomes: DataFrame, keys, width: float = V.BIN_WIDTH) -> DataFrame:
    """Reliability curve of every permutation."""
    return V.reliability_curve(outcomes, [*names(keys), "pfi_var", "perm"], width)


def skill_loss(original: DataFrame, permuted: DataFrame, keys, metrics: Sequence[str] = ("AUC", "CSI", "BSS")) -> DataFrame:
    """Mean original skill over members minus permuted skill, clipped at 0.

    ``keys`` group the originals (their rows are members). Long form with ``metric``.
    """
    keys = names(keys)
    base = original.groupBy(*keys).agg(*[F.avg(m).alias(f"__{m}") for m in metrics])
    joined = keyed_join(permuted, base, keys)
    loss = F.array(*[
        F.struct(F.lit(m).alias("metric"), clip_negative(F.col(f"__{m}") - F.col(m)).alias("loss")) for m in metrics
    ])
    kept = [c for c in permuted.columns if c not in metrics]
    return joined.select(*kept, F.inline(loss))


def normalised_loss(loss: DataFrame, keys) -> DataFrame:
    """Loss over the largest loss of its block (all features and replicates of the keys)."""
    keys = names(keys)
    top = loss.groupBy(*keys).agg(F.max("loss").alias("__top"))
    return keyed_join(loss, top, keys).withColumn("relative_loss", F.try_divide("loss", "__top")).drop("__top")


def importance(loss: DataFrame, keys) -> DataFrame:
    """Box statistics of the normalised loss per feature, and the feature ranking by median."""
    keys = names(keys)
    boxes = percentiles_of_replicates(normalised_loss(loss, keys), [*keys, "pfi_var"], "relative_loss", BOX)
    order = Window.partitionBy(*keys).orderBy(F.desc("q50"), F.asc("pfi_var"))
    return boxes.withColumn("importance_rank", F.row_number().over(order))


def box_stats(df: DataFrame, keys, column: str) -> DataFrame:
    """Median, quartiles and 5/95 whiskers of replicate values."""
    return percentiles_of_replicates(df, keys, column, BOX)


def quantile_bounds(scores: DataFrame, keys, metric: str, low: float, high: float) -> DataFrame:
    """Two quantiles of a metric over the permutations of each key."""
    bounds = [F.percentile(metric, F.lit(float(low))).alias("q_low"), F.percentile(metric, F.lit(float(high))).alias("q_high")]
    return scores.groupBy(*names(keys)).agg(*bounds)


def permutation_bands(scores: DataFrame, keys, metrics: Sequence[str] = ("AUC", "CSI", "BSS"), low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Band of every permutation: ``bottom`` at or under the low quantile, ``top`` at or over the high one, else ``middle``.

    Long form: keys, ``perm``, ``metric``, ``metric_value``, ``band``. When both quantiles
    coincide a permutation can be in both bands. Metrics are rounded to 12 digits, so that
    summation noise cannot break ties.
    """
    keys = names(keys)
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, NOISE_DIGITS).alias("metric_value")) for m in metrics])
    long = scores.select(*keys, "perm", F.inline(values)).filter("metric_value IS NOT NULL")
    bounds = quantile_bounds(long, [*keys, "metric"], "metric_value", low, high)
    joined = keyed_join(long, bounds, [*keys, "metric"])
    v = F.col("metric_value")
    bands = F.filter(
        F.array(
            F.when(v <= F.col("q_low"), "bottom"),
            F.when(v >= F.col("q_high"), "top"),
            F.when((v > F.col("q_low")) & (v < F.col("q_high")), "middle"),
        ),
        lambda b: b.isNotNull(),
    )
    return joined.select(*keys, "perm", "metric", "metric_value", F.explode(bands).alias("band"))


def tail_permutations(bands: DataFrame) -> DataFrame:
    """Best and worst permutations only."""
    return bands.filter(F.col("band").isin("bottom", "top"))


# Outcome after permutation and the outcome required before it.
CASE_KINDS = {"misses": ("fn", "tp"), "false_alarms": ("fp", "tn")}


WORD = 64


def row_words(df: DataFrame, groups: Sequence[str], row_no: str = "row_no", **flags: Column) -> DataFrame:
    """Sets of row numbers as bits: groups, ``word`` (row_no div 64) and a 64-bit number per flag, its rows' bits set."""
    bit = F.expr(f"shiftleft(1L, cast({row_no} % {WORD} as int))")
    return df.groupBy(*groups, F.expr(f"{row_no} div {WORD}").alias("word")).agg(
        *[F.coalesce(F.bit_or(F.when(flag, bit)), F.lit(0).cast("bigint")).alias(name) for name, flag in flags.items()])


def rows_of_words(df: DataFrame, bits: str, row_no: str = "row_no") -> DataFrame:
    """One row per set bit, in place of ``word`` and the bits."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.col(bits).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), k)) != 0)
    return df.withColumn("__place", F.explode(places)).withColumn(row_no, F.col("word") * WORD + F.col("__place")).drop("word", "__place", bits)


#: Bits of a forecast's cell: bins times outcomes.
CELL_BITS = (V.reliability_bins() * len(V.OUTCOMES) - 1).bit_length()
PLANES = [f"__p{j}" for j in range(CELL_BITS)]


def cell_words(cells: DataFrame, groups: Sequence[str], row_no: str = "row_no") -> DataFrame:
    """The cells (see ``verification.forecast_cell``) of 64 rows as one row: groups, ``word``, ``__known`` with the bits of the rows that have a cell, and each bit of their cells.

    A row number must not come twice in a group.
    """
    place = F.expr(f"cast({row_no} % {WORD} as int)")
    at = lambda bit: F.call_function("shiftleft", bit.cast("bigint"), place)
    cell = F.col("cell").cast("int")
    planes = [F.bit_or(at(F.shiftright(cell, j).bitwiseAND(F.lit(1)))).alias(name) for j, name in enumerate(PLANES)]
    words = cells.filter("cell IS NOT NULL").groupBy(*groups, F.expr(f"{row_no} div {WORD}").alias("word")).agg(
        F.bit_or(at(F.lit(1))).alias("__known"), F.count(F.lit(1)).alias("__n"), *planes)
    twice = F.raise_error(F.lit("row numbers must not repeat inside a permutation")).cast("bigint")
    return words.withColumn("__known", F.when(F.bit_count("__known") == F.col("__n"), F.col("__known")).otherwise(twice)).drop("__n")


def counts_of_words(words: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows per cell, as ``verification.forecast_cells`` counts them, from ``cell_words``."""
    groups = list(groups)
    schema = T.StructType([*[words.schema[g] for g in groups], T.StructField("cell", T.IntegerType()), T.StructField("w", T.LongType())])

    def unpacked(column) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).astype("<i8").view(np.uint8), bitorder="little")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in (batch.column(g) for g in groups)]
            first, group = np.unique(np.stack(codes), axis=1, return_index=True, return_inverse=True)[1:] if groups else (np.zeros(1, int), np.zeros(batch.num_rows, int))
            cell = np.zeros(batch.num_rows * WORD, np.int64)
            for j, name in enumerate(PLANES):
                cell |= unpacked(batch.column(name)).astype(np.int64) << j
            cell += np.repeat(group.ravel() << CELL_BITS, WORD)
            counts = np.bincount(cell[unpacked(batch.column("__known")).view(bool)], minlength=len(first) << CELL_BITS)
            at = np.flatnonzero(counts)
            owner = pa.array(first[at >> CELL_BITS])
            found = [*[batch.column(g).take(owner) for g in groups], pa.array((at & ((1 << CELL_BITS) - 1)).astype(np.int32)), pa.array(counts[at].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(found, names=schema.names)

    return words.select(*groups, "__known", *PLANES).mapInArrow(run, schema).groupBy(*groups, "cell").agg(F.sum("w").alias("w"))


def outcome_words(words: DataFrame, outcome: str) -> Column:
    """The bits of the rows of ``cell_words`` with one outcome."""
    place = V.OUTCOMES.index(outcome)
    low, high = (F.col(PLANES[j]) if place >> j & 1 else F.bitwise_not(F.col(PLANES[j])) for j in (0, 1))
    return F.col("__known").bitwiseAND(low).bitwiseAND(high)


def permutation_cases(
    outcomes: DataFrame, bands: DataFrame, original: DataFrame, keys, kind: str = "misses", feature: str = "pfi_var"
) -> DataFrame:
    """Rows that turned wrong only in top-band (or only in bottom-band) permutations.

    ``misses``: hits in the unpermuted forecast that became misses; ``false_alarms``:
    correct negatives that became false alarms. Each case keeps the donor of its first
    occurrence, ordered by (perm, row_no). ``original`` has keys, ``row_no``, ``outcome``.
    Returns keys, feature, ``metric``, ``band``, ``row_no``, ``perm``, ``orig_row_no``.

    Sets of rows are 64-bit words, so what is shuffled for difference and intersection is one
    row per word that a task has seen; only the rows that are left look up their donors.
    ``outcomes`` is read twice: store it, as ``cell_words`` for its 64 rows in one; else it has
    ``row_no`` and ``outcome``. Where it has no ``orig_row_no``, neither has the result;
    ``with_donors`` adds it for the cases alone.
    """
    keys = names(keys)
    donor = [c for c in ("orig_row_no",) if c in outcomes.columns]
    after, before = CASE_KINDS[kind]
    hits = row_words(original.filter(F.col("outcome") == before), keys, __before=F.lit(True))
    packed_rows = "word" in outcomes.columns
    if packed_rows:
        wrong = outcomes.select(*keys, feature, "perm", "word", outcome_words(outcomes, after).alias("__wrong")).filter("__wrong != 0")
    else:
        wrong = outcomes.filter(F.col("outcome") == after).select(*keys, feature, "perm", "row_no", *donor)
    # few, huge keys: broadcast where the row count allows, so that no key lands in one task
    marks = small_side(bands.select(*keys, feature, "perm", "metric", "band"), BAND_ROWS)
    placed = wrong.join(marks, [*keys, feature, "perm"])
    in_band = {f"__{b}": F.col("band") == b for b in ("top", "bottom", "middle")}
    if packed_rows:
        joint = [F.coalesce(F.bit_or(F.when(flag, F.col("__wrong"))), F.lit(0).cast("bigint")).alias(name) for name, flag in in_band.items()]
        sets = placed.groupBy(*keys, feature, "metric", "word").agg(*joint)
    else:
        sets = row_words(placed, [*keys, feature, "metric"], **in_band)
    sets = sets.join(hits, [*keys, "word"])
    top, bottom, middle = (F.col(f"__{b}") for b in ("top", "bottom", "middle"))
    without = lambda a, b: a.bitwiseAND(F.bitwise_not(b.bitwiseOR(middle))).bitwiseAND(F.col("__before"))
    both = F.array(*[F.struct(F.lit(b).alias("band"), without(x, y).alias("__alone")) for b, x, y in (("top", top, bottom), ("bottom", bottom, top))])
    alone = sets.select(*keys, feature, "metric", "word", F.inline(F.filter(both, lambda s: s["__alone"] != 0)))
    if packed_rows:
        met = placed.join(hashed_side(checkpointed(alone)), [*keys, feature, "metric", "band", "word"])
        met = met.withColumn("__alone", F.col("__alone").bitwiseAND(F.col("__wrong"))).filter("__alone != 0").drop("__wrong")
        return rows_of_words(met, "__alone").groupBy(*keys, feature, "metric", "row_no", "band").agg(F.min("perm").alias("perm"))
    alone = checkpointed(rows_of_words(alone, "__alone"))
    marked = wrong.join(hashed_side(alone), [*keys, feature, "row_no"]).join(marks, [*keys, feature, "perm", "metric", "band"], "left_semi")
    first = marked.groupBy(*keys, feature, "metric", "row_no", "band").agg(F.min(F.struct("perm", *donor)).alias("__first"))
    return first.select(*keys, feature, "metric", "row_no", "band", "__first.perm", *[f"__first.{c}" for c in donor])


def case_patches(cases: DataFrame, patches: DataFrame, keys, columns: Sequence[str]) -> DataFrame:
    """Original and donor columns of each case: ``<c>_orig`` and ``<c>_donor``."""
    keys = names(keys)
    own = patches.select(*keys, "row_no", *[F.col(c).alias(f"{c}_orig") for c in columns])
    donor = patches.select(*keys, F.col("row_no").alias("orig_row_no"), *[F.col(c).alias(f"{c}_donor") for c in columns])
    return cases.join(own, [*keys, "row_no"]).join(donor, [*keys, "orig_row_no"])


def only_in(a: DataFrame, others: Iterable[DataFrame], on) -> DataFrame:
    """Distinct keys of ``a`` that none of the others has."""
    on = names(on)
    result = a.select(*on).distinct()
    for other in others:
        result = result.join(other.select(*on), on, "left_anti")
    return result


def in_both(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Rows of ``a`` whose keys ``b`` also has."""
    return a.join(b.select(*names(on)), names(on), "left_semi")


def first_occurrence(df: DataFrame, keys, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Payload of the first row of each distinct key, as a map-side aggregate."""
    first = F.min(F.struct(*dict.fromkeys([*order, *payload]))).alias("__first")
    return df.groupBy(*names(keys)).agg(first).select(*names(keys), *[F.col(f"__first.{c}") for c in payload])
