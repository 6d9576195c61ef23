"""Isotonic calibration without gathering the forecasts.

The fit pools neighbours that violate the order (equivalently, takes the greatest convex
minorant of the cumulative points). Pooling may be done piece by piece: the blocks of each
piece of the probability axis are pooled where the piece is, and blocks of neighbouring pieces
are pooled again, a few pieces at a time, until one list of blocks is left.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchscope.operators.quantiles import split_points, with_value_bucket
from patchscope.operators.relational import GROUP, group_keys, names, small_side, with_group
from patchscope.session import checkpointed

# pieces that are merged by one task
FAN = 32
BLOCKS = "low double, high double, weight double, total double"


def pooled(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list[list[float]]:
    """Blocks, in order, pooled until their means increase: [low, high, weight, total] each."""
    out: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist()):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, end, w, t = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = end, out[-1][2] + w, out[-1][3] + t
    return out


def isotonic_blocks(df: DataFrame, keys: str | Iterable[str] | None = None, prob: str = "prob", label: str = "label") -> DataFrame:
    """Blocks of the isotonic fit of label on probability: keys, ``low``, ``high``, ``weight``, ``total``.

    Rows without probability or label do not count. Equal probabilities are pooled first. The
    axis is cut at split points of a bounded sample, which steer the work only. No task holds
    more than one piece, or the blocks of FAN pieces, of one key.
    """
    keys = names(keys)
    value, event = F.nanvl(F.col(prob).cast("double"), F.lit(None).cast("double")), F.col(label).cast("double")
    rows = with_group(df, keys).select(GROUP, value.alias("low"), event.alias("__y")).filter("low IS NOT NULL AND __y IS NOT NULL")
    points = checkpointed(rows.groupBy(GROUP, "low").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sum("__y").alias("total")))
    splits = split_points(points, "low")
    pieces = with_value_bucket(points.withColumn("high", F.col("low")), "low", splits, "__piece").withColumn("__piece", F.col("__piece").cast("int"))
    left = len(splits) + 1
    while True:

        def merge(held: pd.DataFrame) -> pd.DataFrame:
            held = held.sort_values("low")
            blocks = pooled(*(held[c].to_numpy() for c in ("low", "high", "weight", "total")))
            out = pd.DataFrame(blocks, columns=["low", "high", "weight", "total"])
            out["__key"], out["__piece"] = held["__key"].iloc[0], held["__piece"].iloc[0]
            return out

        named = pieces.select(F.to_json(GROUP).alias("__key"), "__piece", "low", "high", "weight", "total") if GROUP in pieces.columns else pieces
        merged = checkpointed(named.groupBy("__key", "__piece").applyInPandas(merge, f"{BLOCKS}, __key string, __piece int"))
        if left == 1:
            break
        left = -(-left // FAN)
        pieces = merged.withColumn("__piece", F.expr(f"__piece div {FAN}").cast("int"))
    known = checkpointed(points.select(GROUP).distinct().withColumn("__key", F.to_json(GROUP)))
    return merged.join(small_side(known), "__key").select(*group_keys(keys), "low", "high", "weight", "total")


def calibrated(df: DataFrame, blocks: DataFrame, keys: str | Iterable[str] | None = None, prob: str = "prob", out: str = "calibrated") -> DataFrame:
    """Adds the calibrated probability: a block's mean, linear between blocks, clamped outside; NULL for a NULL or a key without fit.

    Blocks meet the rows in even stretches of the probability axis (one equi-join), so a row sees
    only the few blocks of its own stretch.
    """
    keys = names(keys)
    order = Window.partitionBy(GROUP).orderBy("low")
    knots = with_group(blocks, keys).select(GROUP, "low", "high", (F.col("total") / F.col("weight")).alias("__mean"))
    infinite = float("inf")
    knots = knots.withColumns({
        "__until": F.coalesce(F.lead("low").over(order), F.lit(infinite)), "__next": F.lead("__mean").over(order),
        "__from": F.when(F.row_number().over(order) == 1, -infinite).otherwise(F.col("low"))})
    stretch = lambda v: F.floor(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)) * STRETCHES).cast("int")
    knots = knots.withColumn("__s", F.explode(F.sequence(stretch(F.col("__from")), stretch(F.col("__until")))))
    knots = small_side(knots.drop("low"), KNOTS)
    value = F.nanvl(F.col(prob).cast("double"), F.lit(None).cast("double"))
    rows = with_group(df, keys).withColumn("__v", value).withColumn("__s", stretch(F.col("__v")))
    same = (rows[GROUP] == knots[GROUP]) & (rows["__s"] == knots["__s"]) & (F.col("__v") >= F.col("__from")) & (F.col("__v") < F.col("__until"))
    met = rows.join(knots.select(knots[GROUP], knots["__s"], "high", "__mean", "__until", "__next", "__from"), same, "left")
    share = (F.col("__v") - F.col("high")) / (F.col("__until") - F.col("high"))
    between = F.col("__mean") + (F.col("__next") - F.col("__mean")) * share
    fitted = F.when((F.col("__v") <= F.col("high")) | F.col("__next").isNull(), F.col("__mean")).otherwise(between)
    return met.withColumn(out, fitted).select(*df.columns, out)


# stretches of the probability axis, and knots that may be broadcast
STRETCHES = 1024
KNOTS = 1_000_000
