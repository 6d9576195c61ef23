"""Storm objects in gridded intensity fields.

Time slices are independent; ``keys`` name the slice. Rounds of neighbour aggregation and
pointer jumping run on all slices at once, on the pixels above the low threshold only, and
are checkpointed so that lost executors do not restart the loop.

* ``hyst``: connected pixels >= low that hold at least one pixel >= high.
* ``ws``: every pixel >= low follows the steepest ascent to a local maximum; basins whose
  peak is >= high are kept.
* ``ew``: peaks in descending order grow by their strongest neighbour up to a maximum area.
"""

from __future__ import annotations

import itertools
import heapq
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchscope.operators.relational import keyed_join, names
from patchscope.session import checkpointed, stored_tables

# Intensity thresholds (dBZ) and object area limits (pixels).
LOW_DBZ, HIGH_DBZ = 20.0, 40.0
MIN_AREA, MAX_AREA = 1, 100
# Column stride inside a pixel id; any value above the widest grid.
STRIDE = 1 << 20
OWN_COLUMNS = (("row", "int"), ("col", "int"), ("value", "double"), ("__old", "bigint"))


def pixel_id(row="row", col="col"):
    return F.col(row).cast("bigint") * STRIDE + F.col(col)


def _offsets(connectivity: int, own: bool = True) -> list[tuple[int, int]]:
    reach = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    if connectivity == 4:
        reach = [(r, c) for r, c in reach if abs(r) + abs(c) <= 1]
    return [o for o in reach if own or o != (0, 0)]


def _active(df: DataFrame, keys: list[str], value: str, low: float) -> DataFrame:
    pixels = df.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("value"))
    pixels = pixels.filter(~F.isnan("value") & (F.col("value") >= low))
    return pixels.withColumn("id", pixel_id())


def _to_neighbours(pixels: DataFrame, keys: list[str], connectivity: int, payload: list) -> DataFrame:
    """Each pixel sends its payload to its neighbours and itself (flag ``own``)."""
    sends = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in _offsets(connectivity)])
    sent = pixels.select(*keys, "row", "col", *payload, F.inline(sends))
    return sent.select(
        *keys, (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"),
        ((F.col("dr") == 0) & (F.col("dc") == 0)).alias("own"), *[p for p in payload],
    )


def _jump(df: DataFrame, keys: list[str], pointer: str) -> DataFrame:
    """Replace each pointer by the pointer of the pixel it points to."""
    targets = df.select(*keys, F.col("id").alias(pointer), F.col(pointer).alias("__next"))
    return df.join(targets, [*keys, pointer]).drop(pointer).withColumnRenamed("__next", pointer)


def _grandparents(df: DataFrame, keys: list[str]) -> DataFrame:
    parents = df.select(*keys, F.col("id").alias("obj"), F.col("obj").alias("__up"))
    return df.join(parents, [*keys, "obj"])


def _until_settled(labels: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: list[str]) -> DataFrame:
    """Repeat ``step`` until it changes no ``obj`` (``__old`` is the one before).

    A slice that a round leaves as it was is done: it is written once and takes no part in
    later rounds, so a round costs what still changes. A round is deleted once the next one
    stands; the flag column's file statistics let the look for changes skip what has none.
    """
    done, last = [], None
    with stored_tables() as store:
        for turn in itertools.count():
            stepped = step(labels, turn)
            table = checkpointed(stepped.withColumn("__changed", F.col("obj") != F.col("__old")).drop("__old"))
            if last is not None:
                store.drop(last)
            # at most one row per slice
            moving = checkpointed(table.filter("__changed").select(*keys).distinct())
            if not moving.take(1):
                done.append(store.hand_out(table))
                return reduce(DataFrame.unionByName, done).drop("__changed")
            done.append(store.hand_out(keyed_join(table, moving, keys, "left_anti")))
            labels, last = keyed_join(table, moving, keys, "left_semi").drop("__changed"), table


def connected_components(pixels: DataFrame, keys: Iterable[str], connectivity: int = 8) -> DataFrame:
    """Adds ``obj``: the smallest pixel id of the component. Needs columns row, col, id, value.

    Every pixel points to a pixel of its component with a smaller or equal id. A round
    takes the least grandparent of the neighbourhood and offers it both to the pixel and
    to the pixel's parent, so whole trees hook onto each other and rounds grow with the
    logarithm of the object size. A slice leaves the loop when a round changes none of its labels.
    """
    keys = names(keys)

    def hook(labels: DataFrame, turn: int) -> DataFrame:
        # all pixels are their own parents at first
        up = _grandparents(labels, keys) if turn else labels.withColumn("__up", F.col("obj"))
        sent = _to_neighbours(up, keys, connectivity, ["obj", "__up", "value"])
        mine = lambda c: F.max(F.when(F.col("own"), F.col(c)))
        least = sent.groupBy(*keys, "row", "col").agg(F.min("__up").alias("__least"), mine("obj").alias("__old"), mine("value").alias("value"))
        least = least.filter("__old IS NOT NULL").withColumn("id", pixel_id())
        offers = F.array(
            F.struct("id", F.least("__least", "__old").alias("offer"), "row", "col", "value", "__old"),
            F.struct(F.col("__old").alias("id"), F.col("__least").alias("offer"), *[F.lit(None).cast(t).alias(c) for c, t in OWN_COLUMNS]),
        )
        return least.select(*keys, F.inline(offers)).groupBy(*keys, "id").agg(
            F.min("offer").alias("obj"), *[F.max(c).alias(c) for c, _ in OWN_COLUMNS]
        )

    return _until_settled(pixels.withColumn("obj", F.col("id")), hook, keys)


def ascent_basins(pixels: DataFrame, keys: Iterable[str], connectivity: int = 8) -> DataFrame:
    """Adds ``obj``: id of the local maximum reached by steepest ascent (ties go to the smaller id)."""
    keys = names(keys)
    sent = _to_neighbours(pixels, keys, connectivity, ["value", "id"])
    best = F.max(F.struct(F.col("value"), (-F.col("id")).alias("n")))
    pointers = sent.groupBy(*keys, "row", "col").agg(
        best.alias("__best"), F.max(F.when(F.col("own"), F.col("value"))).alias("value")
    ).filter("value IS NOT NULL")
    pointers = pointers.select(*keys, "row", "col", "value", pixel_id().alias("id"), (-F.col("__best.n")).alias("obj"))
    climb = lambda labels, turn: _jump(_jump(labels.withColumn("__old", F.col("obj")), keys, "obj"), keys, "obj")
    return _until_settled(pointers, climb, keys)


def _keep(labelled: DataFrame, keys: list[str], high: float, min_area: int) -> DataFrame:
    objects = labelled.groupBy(*keys, "obj").agg(F.max("value").alias("__peak"), F.count(F.lit(1)).alias("__area"))
    kept = objects.filter((F.col("__peak") >= high) & (F.col("__area") >= min_area)).select(*keys, "obj")
    return labelled.join(kept, [*keys, "obj"], "left_semi").select(*keys, "row", "col", "value", "obj")


def _grow_slice(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, ids: np.ndarray, high: float, max_area: int) -> np.ndarray:
    """Object id of each pixel of one slice (-1: none)."""
    place = {cell: i for i, cell in enumerate(zip(rows.tolist(), cols.tolist()))}
    around = _offsets(8, own=False)
    owner = np.full(len(value), -1, dtype=np.int64)
    for peak in np.lexsort((ids, -value)).tolist():
        if value[peak] < high:
            break
        if owner[peak] >= 0:
            continue
        area, border = 0, [(-value[peak], ids[peak], peak)]
        while border and area < max_area:
            pixel = heapq.heappop(border)[2]
            if owner[pixel] >= 0:
                continue
            owner[pixel] = ids[peak]
            area += 1
            for r, c in around:
                near = place.get((rows[pixel] + r, cols[pixel] + c))
                if near is not None and owner[near] < 0:
                    heapq.heappush(border, (-value[near], ids[near], near))
    return owner


def storm_objects(
    df: DataFrame, keys: Iterable[str], method: str = "ws", value: str = "value", low: float = LOW_DBZ, high: float = HIGH_DBZ,
    min_area: int = MIN_AREA, max_area: int = MAX_AREA, connectivity: int = 8,
) -> DataFrame:
    """Labelled storm pixels: keys, ``row``, ``col``, ``value``, ``obj`` (unique inside its slice), as one stored table."""
    keys = names(keys)
    pixels = _active(df, keys, value, low)
    with stored_tables() as store:
        if method == "hyst":
            labelled = connected_components(pixels, keys, connectivity)
        elif method == "ws":
            labelled = ascent_basins(pixels, keys, connectivity)
        elif method == "ew":
            schema = T.StructType([*pixels.schema.fields, T.StructField("obj", T.LongType())])

            # one slice per call: at most the pixels of one grid above the low threshold
            def grow(slice_pixels: pd.DataFrame) -> pd.DataFrame:
                columns = [slice_pixels[c].to_numpy() for c in ("row", "col", "value", "id")]
                return slice_pixels.assign(obj=_grow_slice(*columns, high, max_area))

            labelled = checkpointed(pixels.groupBy(*keys).applyInPandas(grow, schema).filter("obj >= 0"))
        else:
            raise ValueError(f"unknown method {method!r}: use hyst, ws or ew")
        return store.hand_out(_keep(labelled, keys, high, min_area))
