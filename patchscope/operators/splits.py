"""Reproducible train/test splits, folds and evaluation members.

Every split returns the slim rows it was given plus split columns. Join the wide patch
arrays on ``patch_id`` afterwards, once, so that ranking never moves pixels.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchscope.operators.ranking import seeded_rank
from patchscope.operators.relational import GROUP, names

# Seeds of the two shuffles and rows per evaluation member.
CLASS_SEED = 0
MERGE_SEED = 10
MEMBER_ROWS = 100_000


def stack_labels(above: DataFrame, below: DataFrame) -> DataFrame:
    """Exceeding rows get label 1, the others 0."""
    return above.withColumn("label", F.lit(1)).unionByName(below.withColumn("label", F.lit(0)))


def _class_ranks(df, ids, label, by, seed):
    """Rank in its class, class size and both class sizes on every row."""
    by = names(by)

    def totals(sizes: DataFrame) -> DataFrame:
        w = Window.partitionBy(*[F.col(f"{GROUP}.{k}") for k in by] or [F.lit(1)])
        for value, name in ((1, "__n_pos"), (0, "__n_neg")):
            of_class = F.when(F.col(f"{GROUP}.{label}") == value, F.col("__n"))
            sizes = sizes.withColumn(name, F.coalesce(F.sum(of_class).over(w), F.lit(0)))
        return sizes

    return seeded_rank(df, ids, seed, by=[*by, label], out="__rank", size_out="__size", extend_sizes=totals)


def split_balanced(
    df: DataFrame, ids, p: float = 0.6, label: str = "label", by: Iterable[str] | None = None, seed=CLASS_SEED
) -> DataFrame:
    """Train on equally many rows of both classes; test on the rest with population-like negatives.

    Negatives beyond the test quota belong to neither set and are left out. A key without
    positives has no ratio to keep and fails.
    """
    ranked = _class_ranks(df, ids, label, by, seed)
    pos, neg = F.col("__n_pos"), F.col("__n_neg")
    rest = pos * F.lit(1 - p)
    cut = F.floor(pos * F.lit(p))
    last = F.floor(F.coalesce(F.try_divide(rest * neg, pos.cast("double")), F.lit(0.0)) + rest)
    split = F.when(F.col("__rank") <= cut, "train").when((F.col(label) == 1) | (F.col("__rank") <= last), "test")
    empty = F.raise_error(F.lit("a key without positives cannot be balanced")).cast("string")
    return _drop_rank(ranked.withColumn("split", F.when(pos == 0, empty).otherwise(split)).filter("split IS NOT NULL"))


def split_stratified(
    df: DataFrame, ids, p: float = 0.6, label: str = "label", by: Iterable[str] | None = None, seed=CLASS_SEED
) -> DataFrame:
    """The share ``p`` of each class trains, the rest tests."""
    ranked = _class_ranks(df, ids, label, by, seed)
    train = F.col("__rank") <= F.floor(F.col("__size") * F.lit(p))
    return _drop_rank(ranked.withColumn("split", F.when(train, "train").otherwise("test")))


def split_kfold(
    df: DataFrame, ids, k: int = 5, fold: int | None = None, label: str = "label",
    by: Iterable[str] | None = None, seed=CLASS_SEED,
) -> DataFrame:
    """Stratified folds 0..k-1; the first n mod k folds of a class hold one row more.

    With ``fold`` given, adds ``split``: that fold tests, the others train.
    """
    ranked = _class_ranks(df, ids, label, by, seed)
    position = F.col("__rank") - 1
    small = F.floor(F.col("__size") / k)
    extra = F.col("__size") % k
    big_rows = extra * (small + 1)
    in_big = F.floor(position / (small + 1))
    in_small = extra + F.floor(F.try_divide((position - big_rows).cast("double"), small.cast("double")))
    folded = ranked.withColumn("fold", F.when(position < big_rows, in_big).otherwise(in_small).cast("int"))
    if fold is not None:
        folded = folded.withColumn("split", F.when(F.col("fold") == fold, "test").otherwise("train"))
    return _drop_rank(folded)


def split(df: DataFrame, kind: str, ids, **options) -> DataFrame:
    """One call for all variables and levels: ``balanced``, ``stratified`` or ``kfold``."""
    kinds = {"balanced": split_balanced, "stratified": split_stratified, "kfold": split_kfold}
    return kinds[kind](df, ids, **options)


def split_validation(df: DataFrame, ids, fraction: float, by: Iterable[str] | None = None, seed=CLASS_SEED) -> DataFrame:
    """Move a seeded fraction of the rows to a validation split."""
    ranked = seeded_rank(df, ids, seed, by=by, out="__rank", size_out="__size")
    held_out = F.col("__rank") <= F.floor(F.col("__size") * F.lit(fraction))
    return _drop_rank(ranked.withColumn("split", F.when(held_out, "valid").otherwise("train")))


def shuffle(df: DataFrame, ids, by: Iterable[str] | None = None, seed=MERGE_SEED, out: str = "position") -> DataFrame:
    """Position of each row in the merged, shuffled set."""
    return seeded_rank(df, ids, seed, by=by, out=out)


def to_members(
    df: DataFrame, ids, size: int = MEMBER_ROWS, by: Iterable[str] | None = None, seed=CLASS_SEED
) -> DataFrame:
    """Cut the shuffled rows into members of ``size``; ``row_no`` is the 0-based place in the member."""
    ranked = seeded_rank(df, ids, seed, by=by, out="__rank")
    place = F.col("__rank") - 1
    return ranked.withColumn("member", (F.floor(place / size) + 1).cast("int")).withColumn("row_no", place % size).drop("__rank")


def _drop_rank(df: DataFrame) -> DataFrame:
    return df.drop("__rank", "__size", "__n_pos", "__n_neg")
