"""Physics on model fields.

Two layouts are supported. ``column3d`` keeps one row per (time, row, col) with arrays
over levels: level arithmetic there needs no shuffle at all, and is the layout to store.
``field3d`` has one row per level; its operators use windows bounded by the level count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchscope.functions import arrays as A
from patchscope.operators.relational import keyed_join, names, small_side, spread

# Heights of the interpolated fields, grid spacing, helicity layers, gravity.
HEIGHTS_M = (1000, 3000, 5000, 7000)
GRID_SPACING_M = 4000.0
UH25 = (2000.0, 5000.0)
UH03 = (0.0, 3000.0)
GRAVITY = 9.81
OPTICAL_DEPTH = 1.0
KELVIN = 273.15
# Rows and columns of a helicity tile.
TILE = 64
# Terrain cells that may be broadcast: two ints and a double each, about 80 MB.
TERRAIN_CELLS = 5_000_000


def crop(df: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Half-open index sub-domain; plain comparisons, so they reach the Parquet scan."""
    inside = (F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1)
    return df.filter(inside)


def at_level(df: DataFrame, level: int) -> DataFrame:
    return df.filter(F.col("level") == level)


def to_columns(df: DataFrame, keys: Iterable[str], values: Sequence[str], level: str = "level") -> DataFrame:
    """Long levels to arrays ordered by level; a column holds at most the model's level count."""
    keys = names(keys)
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(level, *values))).alias("__levels"))
    return packed.select(*keys, *[F.col(f"__levels.{v}").alias(v) for v in values])


def height_agl(df: DataFrame, terrain: DataFrame, height: str = "z", cell: Sequence[str] = ("row", "col")) -> DataFrame:
    """Subtract terrain height. The terrain has one row per grid cell of a fixed domain.

    It is broadcast if it has at most TERRAIN_CELLS rows, so the field is not shuffled.
    """
    joined = keyed_join(df, small_side(terrain.select(*cell, "hgt_m"), TERRAIN_CELLS), list(cell))
    if isinstance(df.schema[height].dataType, T.ArrayType):
        lowered = F.transform(height, lambda z: z - F.col("hgt_m"))
    else:
        lowered = F.col(height) - F.col("hgt_m")
    return joined.withColumn(height, lowered).drop("hgt_m")


def column_maximum(df: DataFrame, keys: Iterable[str], value: str = "value") -> DataFrame:
    """Maximum over levels, NaN skipped."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*names(keys)).agg(F.max(v).alias("value"))


def interp_levels(df: DataFrame, keys: Iterable[str], height: str, value: str, level: str = "level", heights: Sequence[float] = HEIGHTS_M) -> DataFrame:
    """Linear interpolation of each column to fixed heights above ground.

    The bracket is half-open, ``z <= h < z_next``; heights outside the column give NULL.
    Each pair of levels yields the heights it brackets, so levels never meet heights in a join.
    Where heights do not rise all the way, the lowest bracket counts.
    """
    keys = names(keys)
    up = Window.partitionBy(*keys).orderBy(level)
    z0, z1 = F.col(height), F.lead(height).over(up)
    pairs = df.withColumns({"__z1": z1, "__v1": F.lead(value).over(up)})
    wanted = F.array(*[F.lit(float(h)) for h in heights])
    pairs = pairs.withColumn("__h", F.filter(wanted, lambda h: (F.col(height) <= h) & (h < F.col("__z1"))))
    hit = pairs.select(*keys, F.col(level).alias("__level"), height, value, "__z1", "__v1", F.explode_outer("__h").alias("__at"))
    fraction = (F.col("__at") - F.col(height)) / (F.col("__z1") - F.col(height))
    hit = hit.withColumn("__value", F.col(value) + (F.col("__v1") - F.col(value)) * fraction)
    lowest = lambda h: F.min(F.when(F.col("__at") == float(h), F.struct("__level", "__value")))
    wide = hit.groupBy(*keys).agg(*[lowest(h).alias(f"h{int(h)}") for h in heights])
    rows = F.array(*[F.struct(F.lit(int(h)).alias("level_m"), F.col(f"h{int(h)}.__value").alias("value")) for h in heights])
    return wide.select(*keys, F.inline(rows))


def interp_at(heights, values, target: float) -> Column:
    """Array form of :func:`interp_levels` for one height: no shuffle."""
    z, v = A.as_column(heights), A.as_column(values)
    n = F.size(z)
    segments = F.arrays_zip(
        F.slice(z, F.lit(1), n - 1).alias("z0"), F.slice(z, F.lit(2), n - 1).alias("z1"),
        F.slice(v, F.lit(1), n - 1).alias("v0"), F.slice(v, F.lit(2), n - 1).alias("v1"),
    )
    hit = F.get(F.filter(segments, lambda s: (s["z0"] <= target) & (F.lit(target) < s["z1"])), 0)
    return hit["v0"] + (hit["v1"] - hit["v0"]) * ((F.lit(target) - hit["z0"]) / (hit["z1"] - hit["z0"]))


def stencil(df: DataFrame, keys: Iterable[str], weights: dict[tuple[int, int], float], value: str = "value", partial: bool = False) -> DataFrame:
    """Weighted sum over neighbour cells: ``out(r, c) = sum w(dr, dc) * value(r+dr, c+dc)``.

    Each cell sends its weighted value to its neighbours and the sums meet in one
    aggregate, so the field is shuffled once and never joined to itself. A result is NULL
    where a neighbour is missing, unless ``partial``: then the weights present are rescaled.
    """
    keys = names(keys)
    offsets = dict(weights)
    offsets.setdefault((0, 0), 0.0)
    sends = F.array(*[
        F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(float(w)).alias("w")) for (dr, dc), w in offsets.items()
    ])
    sent = df.select(*keys, "row", "col", value, F.inline(sends))
    arrived = sent.select(
        *keys, (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"),
        (F.col(value) * F.col("w")).alias("__wv"), F.when(F.col(value).isNotNull(), F.col("w")).alias("__w"),
        ((F.col("dr") == 0) & (F.col("dc") == 0)).alias("__own"),
    )
    sums = arrived.groupBy(*keys, "row", "col").agg(
        F.sum("__wv").alias("__wv"), F.sum("__w").alias("__w"), F.count("__wv").alias("__n"), F.max("__own").alias("__own")
    ).filter("__own")
    total = float(sum(weights.values()))
    if partial:
        result = F.try_divide(F.col("__wv") * F.lit(total), F.col("__w"))
    else:
        result = F.when(F.col("__n") == len(offsets), F.col("__wv"))
    return sums.select(*keys, "row", "col", result.alias("value"))


def gaussian_line(sigma: float = 1.0, truncate: float = 4.0) -> dict[int, float]:
    """Normalised Gaussian weights along one axis."""
    radius = int(truncate * sigma + 0.5)
    line = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)}
    total = sum(line.values())
    return {d: f / total for d, f in line.items()}


def gaussian_weights(sigma: float = 1.0, truncate: float = 4.0) -> dict[tuple[int, int], float]:
    """Normalised Gaussian kernel for :func:`stencil`."""
    line = gaussian_line(sigma, truncate)
    return {(r, c): line[r] * line[c] for r in line for c in line}


def gaussian_smooth(df: DataFrame, keys, sigma: float = 1.0, value: str = "value") -> DataFrame:
    """Smoothed map; near the edge the kernel is rescaled to the cells present.

    Two passes along x and y: the weighted values and the weights of the cells present
    are summed apart, so the quotient is that of the full kernel with any gaps.
    """
    keys = names(keys)
    v = F.col(value).cast("double")
    sums = df.select(
        *keys, "row", "col", F.coalesce(v, F.lit(0.0)).alias("__wv"), v.isNotNull().cast("double").alias("__w"), F.lit(True).alias("__own"))
    line = F.array(*[F.struct(F.lit(d).alias("__d"), F.lit(f).alias("__f")) for d, f in gaussian_line(sigma).items()])
    for axis, line_of in (("col", "row"), ("row", "col")):
        # a line lies in one task before its cells multiply, so the sums need no exchange of their own
        sums = spread(sums, [*keys, line_of])
        sent = sums.select("*", F.inline(line)).withColumns({
            axis: F.col(axis) + F.col("__d"), "__wv": F.col("__wv") * F.col("__f"), "__w": F.col("__w") * F.col("__f"),
            "__own": F.col("__own") & (F.col("__d") == 0)})
        sums = sent.groupBy(*keys, "row", "col").agg(F.sum("__wv").alias("__wv"), F.sum("__w").alias("__w"), F.max("__own").alias("__own"))
    return sums.filter("__own").select(*keys, "row", "col", F.try_divide("__wv", "__w").alias("value"))


def vertical_vorticity(df: DataFrame, keys: Iterable[str], u: str = "u", v: str = "v", dx: float = GRID_SPACING_M, dy: float = GRID_SPACING_M, map_factor: str | None = None) -> DataFrame:
    """Adds ``vort = dv/dx - du/dy`` by centred differences; NULL on the edges.

    ``keys`` identify a horizontal slice (time and, for long fields, level). ``u`` and
    ``v`` may be numbers or arrays over levels; array columns need two shuffles for all
    levels together. Columns run along x and rows along y.
    """
    keys = names(keys)
    along_x = Window.partitionBy(*keys, "row").orderBy("col")
    along_y = Window.partitionBy(*keys, "col").orderBy("row")
    is_array = isinstance(df.schema[u].dataType, T.ArrayType)
    factor = F.col(map_factor) if map_factor else F.lit(1.0)

    def centred(name, order, axis, spacing):
        whole = (F.lead(axis).over(order) == F.col(axis) + 1) & (F.lag(axis).over(order) == F.col(axis) - 1)
        after, before = F.lead(name).over(order), F.lag(name).over(order)
        if is_array:
            slope = F.zip_with(after, before, lambda a, b: (a - b) / F.lit(2 * spacing))
        else:
            slope = (after - before) / F.lit(2 * spacing)
        return F.when(whole, slope)

    sloped = df.withColumn("__dvdx", centred(v, along_x, "col", dx)).withColumn("__dudy", centred(u, along_y, "row", dy))
    if is_array:
        vort = F.zip_with("__dvdx", "__dudy", lambda a, b: (a - b) * factor)
    else:
        vort = (F.col("__dvdx") - F.col("__dudy")) * factor
    return sloped.withColumn("vort", vort).drop("__dvdx", "__dudy")


def updraft_helicity(df: DataFrame, keys: Iterable[str], bottom: float = UH25[0], top: float = UH25[1], u="u", v="v", w="w", z="z", level: str = "level", dx: float = GRID_SPACING_M, dy: float = GRID_SPACING_M, tile: int = TILE) -> DataFrame:
    """Integral of w times vertical vorticity between two heights above ground (trapezoids, clipped at both ends).

    Long input: keys, ``level``, ``row``, ``col``, u, v, w, z. Output: keys, ``row``, ``col``, ``value``;
    NULL where the vorticity is undefined or the column does not reach the layer.
    A slice is cut into tiles of ``tile`` x ``tile`` cells, each with the cells just outside
    its edges. The one shuffle by slice and tile serves all three windows (x, y, vertical),
    and no task needs a whole slice.
    """
    keys = names(keys)
    place = lambda axis, shift=0: F.floor((F.col(axis) + shift) / tile)
    homes = F.array_distinct(F.array(*[
        F.struct(place("row", r).alias("__tr"), place("col", c).alias("__tc")) for r, c in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
    ]))
    tiled = [*keys, "__tr", "__tc"]
    cells = df.select(*keys, level, "row", "col", u, v, w, z, F.inline(homes)).repartition(*tiled)
    spun = vertical_vorticity(cells, [*tiled, level], u, v, dx, dy)
    spun = spun.filter((F.col("__tr") == place("row")) & (F.col("__tc") == place("col")))
    up = Window.partitionBy(*tiled, "row", "col").orderBy(level)
    q = F.col(w) * F.col("vort")
    pairs = spun.select(*tiled, "row", "col", level, F.col(z).alias("__z0"), q.alias("__q0"))
    pairs = pairs.withColumns({"__z1": F.lead("__z0").over(up), "__q1": F.lead("__q0").over(up)})
    lo = F.greatest(F.col("__z0"), F.lit(float(bottom)))
    hi = F.least(F.col("__z1"), F.lit(float(top)))
    slope = (F.col("__q1") - F.col("__q0")) / (F.col("__z1") - F.col("__z0"))
    at = lambda h: F.col("__q0") + slope * (h - F.col("__z0"))
    part = F.when((F.col("__z1") > F.col("__z0")) & (hi > lo), (at(lo) + at(hi)) * 0.5 * (hi - lo))
    return pairs.groupBy(*tiled, "row", "col").agg(F.sum(part).alias("value")).drop("__tr", "__tc")


def cloud_top_temperature(
    df: DataFrame, keys: Iterable[str], k_water: float, k_ice: float, threshold: float = OPTICAL_DEPTH,
    temperature: str = "tk", water: str = "qcloud", ice: str = "qice", pressure: str = "p", level: str = "level",
    no_cloud: str | None = None,
) -> DataFrame:
    """Temperature (deg C) where the optical depth from the top first reaches the threshold.

    Level k adds ``(k_water*water + k_ice*ice) * 1000 * dp / g``, with dp the pressure
    difference (Pa) to the level above. Linear interpolation between the two levels around
    the crossing. Without a crossing: NULL, or the lowest level's temperature with ``no_cloud="surface"``.
    """
    keys = names(keys)
    down = Window.partitionBy(*keys).orderBy(F.col(level).desc())
    running = down.rowsBetween(Window.unboundedPreceding, 0)
    above = lambda c: F.lag(c).over(down)
    mass = (F.col(pressure) - above(pressure)) / GRAVITY
    tau = (F.lit(float(k_water)) * F.col(water) + F.lit(float(k_ice)) * F.col(ice)) * 1000 * mass
    layers = df.select(*keys, level, F.col(temperature).alias("__t"), F.coalesce(tau, F.lit(0.0)).alias("__tau"), above(temperature).alias("__t_above"))
    layers = layers.withColumn("__depth", F.sum("__tau").over(running))
    before = F.col("__depth") - F.col("__tau")
    crossing = (F.col("__depth") >= threshold) & (before < threshold)
    fraction = (F.lit(float(threshold)) - before) / F.col("__tau")
    at_top = F.coalesce(F.col("__t_above") + (F.col("__t") - F.col("__t_above")) * fraction, F.col("__t"))
    tops = layers.groupBy(*keys).agg(
        F.max(F.when(crossing, F.struct(F.col(level).alias("l"), at_top.alias("t")))).alias("__top"),
        F.min(F.struct(F.col(level).alias("l"), F.col("__t").alias("t"))).alias("__surface"),
    )
    kelvin = F.col("__top.t")
    if no_cloud == "surface":
        kelvin = F.coalesce(kelvin, F.col("__surface.t"))
    return tops.select(*keys, (kelvin - KELVIN).alias("value"))


def map_slices(df: DataFrame, function: Callable, keys: Iterable[str], schema) -> DataFrame:
    """Vectorised user function per slice (pandas in, pandas out) with a declared output schema.

    A slice is one time step of one field: its size is set by the grid, not by the data volume.
    """
    return df.groupBy(*names(keys)).applyInPandas(function, schema)
