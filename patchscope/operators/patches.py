"""Storm patches: extraction, land test, co-located fields, labels, assembly, features."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchscope.functions import arrays as A
from patchscope.functions.expressions import to_grams, wind_shear
from patchscope.functions.timeidx import is_step_index
from patchscope.operators.quantiles import exact_percentiles
from patchscope.operators.relational import keyed_join, names, small_side, spread

# Patch half width, label threshold (m2/s2), outlier percentile.
RADIUS = 16
ROTATION_THRESHOLD = 75.0
OUTLIER_PERCENTILE = 99
# Edges that a strip of a polygon holds in one row at most, about.
STRIP_EDGES = 4096


# --- extraction -----------------------------------------------------------------------


def object_centres(objects: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rounded centre of each object (halves round up)."""
    centre = lambda axis: F.floor(F.avg(axis) + 0.5).cast("int")
    return objects.groupBy(*names(keys), "obj").agg(centre("row").alias("row0"), centre("col").alias("col0"))


def extract_patches(objects: DataFrame, grid: DataFrame, keys: Iterable[str], radius: int = RADIUS, columns: Sequence[str] = ("value",)) -> DataFrame:
    """Pixels of the square around each object, complete patches only.

    ``grid`` holds the full slices (keys, row, col and ``columns``). Output per pixel:
    keys, ``obj``, ``patch_id``, ``y``, ``x``, ``row``, ``col``, columns, ``in_mask``
    (pixel belongs to this object). A patch cut by the domain edge has fewer pixels and is dropped.
    """
    keys = names(keys)
    side = F.sequence(F.lit(-radius), F.lit(radius - 1))
    centres = object_centres(objects, keys)
    cells = centres.select(*keys, "obj", "row0", "col0", F.explode(side).alias("dr"))
    cells = cells.select("*", F.explode(side).alias("dc"))
    cells = cells.select(
        *keys, "obj", (F.col("dr") + radius).alias("y"), (F.col("dc") + radius).alias("x"),
        (F.col("row0") + F.col("dr")).alias("row"), (F.col("col0") + F.col("dc")).alias("col"),
    )
    owners = objects.select(*keys, "row", "col", F.col("obj").alias("__owner"))
    place = [*keys, "row", "col"]
    surface = grid.select(*place, *columns).join(owners, place, "left")
    pixels = cells.join(surface, place)
    identity = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("obj").cast("string"))
    pixels = pixels.withColumns({"patch_id": identity, "in_mask": F.coalesce(F.col("__owner") == F.col("obj"), F.lit(False))})
    pixels = pixels.select("patch_id", *keys, "obj", "y", "x", "row", "col", *columns, "in_mask")
    return complete_patches(pixels, "patch_id", radius)


def complete_patches(pixels: DataFrame, key: str = "patch_id", radius: int = RADIUS) -> DataFrame:
    """Keep patches with all (2 * radius)**2 pixels; a patch never holds more."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return pixels.withColumn("__n", n).filter(F.col("__n") == (2 * radius) ** 2).drop("__n")


def pack_patches(pixels: DataFrame, keys: Iterable[str], columns: Sequence[str]) -> DataFrame:
    """Long pixels to row-major arrays, one row per patch."""
    keys = names(keys)
    packed = pixels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x", *columns))).alias("__px"))
    return packed.select(*keys, *[F.col(f"__px.{c}").alias(c) for c in columns])


def unpack_patches(patches: DataFrame, keys: Iterable[str], columns: Sequence[str], width: int) -> DataFrame:
    """Lossless long view: keys, ``y``, ``x``, one value column per array."""
    zipped = F.arrays_zip(*columns)
    long = patches.select(*names(keys), F.posexplode(zipped).alias("__i", "__px"))
    return long.select(
        *names(keys), F.floor(F.col("__i") / width).cast("int").alias("y"), (F.col("__i") % width).cast("int").alias("x"),
        *[F.col(f"__px.{c}").alias(c) for c in columns],
    )


def with_hours(patches: DataFrame, hour: str = "hour_idx") -> DataFrame:
    """Start and end hour of single-step objects, with zero motion."""
    return patches.withColumns({
        "start_hour": F.col(hour), "end_hour": F.col(hour), "x_speed": F.lit(0), "y_speed": F.lit(0),
    })


# --- land -----------------------------------------------------------------------------


def points_in_polygons(points: DataFrame, edges: DataFrame, point_id: str, poly: str = "poly_id", band: float = 1.0) -> DataFrame:
    """(point, polygon) pairs with the point strictly inside.

    Points have ``px, py``; edges ``x0, y0, x1, y1``. A polygon is cut into horizontal strips of
    its edges, and each strip is filed under the square cells it touches; so a point meets only
    the strips of its own cell, each with all edges that a line to its right can cross. Crossings
    are counted there, and points on an edge are removed. The strips of many polygons are far
    larger than their table, which the planner does not see, so they are shuffled, never broadcast.
    Pairs are summed up only where a point has several rows or a strip is cut for its many edges.
    """
    # slim tables whose rows multiply: even shares before cells and strips unfold
    edges = spread(edges, [poly])
    y_low, y_high = F.least("y0", "y1"), F.greatest("y0", "y1")
    band_of = lambda y: F.floor(y / F.lit(band)).cast("bigint")
    bands = lambda low, high: F.explode(F.sequence(band_of(low), band_of(high)))
    placed = points.select(point_id, "px", "py", band_of(F.col("px")).alias("__column"), band_of(F.col("py")).alias("__band"))
    placed = placed.withColumn("__again", F.count(F.lit(1)).over(Window.partitionBy(point_id)) > 1)
    filed = edges.withColumn("__left", F.min(F.least("x0", "x1")).over(Window.partitionBy(poly))).select("*", bands(y_low, y_high).alias("__band"))
    filed = filed.withColumn("__edge", F.struct("x0", "y0", "x1", "y1"))
    filed = filed.withColumn("__parts", F.ceil(F.count(F.lit(1)).over(Window.partitionBy(poly, "__band")) / F.lit(STRIP_EDGES)))
    # no line to the right of a point crosses a strip that ends left of it, above or below
    strips = filed.groupBy(poly, "__band", "__parts", F.pmod(F.xxhash64("__edge"), "__parts")).agg(
        F.first("__left").alias("__left"), F.max(F.greatest("x0", "x1")).alias("__right"),
        F.min(y_low).alias("__bottom"), F.max(y_high).alias("__top"), F.collect_list("__edge").alias("__edges"))
    strips = strips.select(poly, "__band", "__parts", "__left", "__right", "__bottom", "__top", "__edges", bands(F.col("__left"), F.col("__right")).alias("__column"))
    py, px, cell = F.col("py"), F.col("px"), ["__column", "__band"]

    def right(e: Column) -> Column:
        straddles = (e["y0"] > py) != (e["y1"] > py)
        # the crossing lies to the right of the point when the point is on the edge's left going up
        return straddles & F.when(e["y1"] > e["y0"], crossed(e) > 0).otherwise(crossed(e) < 0)

    def crossed(e: Column) -> Column:
        return (e["x1"] - e["x0"]) * (py - e["y0"]) - (px - e["x0"]) * (e["y1"] - e["y0"])

    def on_edge(e: Column) -> Column:
        return (crossed(e) == 0) & px.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & py.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))

    def met(points: DataFrame, strips: DataFrame) -> DataFrame:
        near = spread(points, cell).join(spread(strips, cell).hint("merge"), cell)
        near = near.filter(px.between(F.col("__left"), F.col("__right")) & py.between(F.col("__bottom"), F.col("__top")))
        return near.select(point_id, poly, F.size(F.filter("__edges", right)).alias("__n"), F.exists("__edges", lambda e: F.coalesce(on_edge(e), F.lit(False))).alias("__edge"))

    once, whole = placed.filter(~F.col("__again")), strips.filter("__parts = 1")
    parts = met(placed.filter("__again"), strips).union(met(once, strips.filter("__parts > 1")))
    summed = parts.groupBy(point_id, poly).agg(F.sum("__n").alias("__n"), F.max("__edge").alias("__edge"))
    inside = lambda counted: counted.filter((F.col("__n") % 2 == 1) & ~F.col("__edge")).select(point_id, poly)
    return inside(met(once, whole)).union(inside(summed))


def land_cells(grid: DataFrame, edges: DataFrame, band: float = 1.0) -> DataFrame:
    """Grid cells on land; compute once per domain and store."""
    cell = F.concat_ws(":", "row", "col").alias("cell")
    points = grid.select(cell, F.col("lon").alias("px"), F.col("lat").alias("py"))
    inside = points_in_polygons(points, edges, "cell", band=band).select("cell").distinct()
    parts = F.split("cell", ":")
    return inside.select(parts[0].cast("int").alias("row"), parts[1].cast("int").alias("col"))


def on_land(patches: DataFrame, land: DataFrame, width: int = 2 * RADIUS, intensity: str = "dbz", rows: str = "rows", cols: str = "cols") -> DataFrame:
    """Patches whose strongest pixel (first in row-major order) lies on a land cell."""
    position = F.array_position(intensity, A.pixel_max(intensity)).cast("int") - 1
    placed = patches.withColumns({"row": F.get(rows, position), "col": F.get(cols, position)})
    return placed.join(land.select("row", "col"), ["row", "col"], "left_semi").drop("row", "col")


def strongest_pixel(pixels: DataFrame, key: str = "patch_id", value: str = "value") -> DataFrame:
    """Long-form arg-max: first maximum in row-major order, as one aggregate."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("__b")
    return pixels.groupBy(key).agg(best).select(key, F.col("__b.v").alias(value), (-F.col("__b.ny")).alias("y"), (-F.col("__b.nx")).alias("x"))


# --- co-located fields ----------------------------------------------------------------


def attach_field(pixels: DataFrame, field: DataFrame, on: Sequence[str], value: str = "value", out: str | None = None) -> DataFrame:
    """Gather field values at patch pixels by equi-join on time and cell.

    Store both sides bucketed on these columns and the join needs no shuffle. Only field
    hours that have patches take part.
    """
    out = out or value
    hours = [c for c in on if c not in ("row", "col")]
    wanted = pixels.select(*hours).distinct()
    used = field.join(wanted, hours, "left_semi") if hours else field
    return pixels.join(used.select(*on, F.col(value).alias(out)), list(on), "left")


def gather_bucketed(pixels: DataFrame, fields: Mapping[str, DataFrame], on: Sequence[str], value: str = "value") -> DataFrame:
    """Attach several fields, all tables bucketed alike on ``on`` (see ``sinks.bucketed``): merged bucket by bucket, no exchange."""
    for name, field in fields.items():
        pixels = pixels.join(field.select(*on, F.col(value).alias(name)).hint("merge"), list(on), "left")
    return pixels


def with_coordinates(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``lat`` and ``lon`` of the cell; ``cells`` is the fixed domain (row, col, lat, lon)."""
    return pixels.join(small_side(cells.select("row", "col", "lat", "lon")), ["row", "col"], "left")


def label_pixels(pixels: DataFrame, value: str, threshold: float = ROTATION_THRESHOLD, key: str = "patch_id") -> DataFrame:
    """Adds ``label`` to long patches: 1 where the patch has a value above the threshold; missing pixels count for nothing."""
    top = F.max(F.nanvl(F.col(value), F.lit(None))).over(Window.partitionBy(key))
    return pixels.withColumn("label", F.coalesce((top > threshold).cast("int"), F.lit(0)))


def environment(pixels: DataFrame, fields: Mapping[str, DataFrame], on: Sequence[str], hour: str = "hour_idx", land: DataFrame | None = None) -> DataFrame:
    """Attach several fields to the pixels of three-hourly (and, with ``land``, land) patches."""
    kept = pixels.filter(is_step_index(hour))
    if land is not None:
        peak = strongest_pixel(kept, "patch_id", "value").select("patch_id", "y", "x")
        peak = kept.join(peak, ["patch_id", "y", "x"]).select("patch_id", "row", "col")
        good = peak.join(land.select("row", "col"), ["row", "col"], "left_semi").select("patch_id")
        kept = kept.join(good, "patch_id", "left_semi")
    for name, field in fields.items():
        kept = attach_field(kept, field, on, out=name)
    return kept


def attach_levels(pixels: DataFrame, field: DataFrame, on: Sequence[str], levels: Sequence[int], prefix: str) -> DataFrame:
    """Attach one state variable at several levels: columns ``<prefix>_<km>``, 1500 m being ``1p5``."""
    # the level list is a parameter, so this is a fixed-width pivot
    columns = [F.max(F.when(F.col("level_m") == lev, F.col("value"))).alias(f"{prefix}_{lev / 1000:g}".replace(".", "p")) for lev in levels]
    wide = field.filter(F.col("level_m").isin(list(levels))).groupBy(*on).agg(*columns)
    return pixels.join(wide, list(on), "left")


# --- labels and assembly --------------------------------------------------------------


def label_patches(patches: DataFrame, values: str = "uh25", threshold: float = ROTATION_THRESHOLD, mask: str | None = None) -> DataFrame:
    """Adds ``label``: 1 when the patch exceeds the threshold."""
    return patches.withColumn("label", A.exceeds(values, threshold, mask).cast("int"))


def exceeding(patches: DataFrame, values: str, threshold: float, mask: str | None = None) -> DataFrame:
    return patches.filter(A.exceeds(values, threshold, mask))


def not_exceeding(patches: DataFrame, values: str, threshold: float, mask: str | None = None) -> DataFrame:
    """Exact complement of :func:`exceeding`."""
    return patches.filter(~A.exceeds(values, threshold, mask))


def assemble_environment(sources: Sequence[DataFrame], on: str | Sequence[str] = "patch_id") -> DataFrame:
    """One wide row per patch from per-variable tables; all joins share the shuffle on ``patch_id``."""
    first, *rest = sources
    for source in rest:
        first = first.join(source, names(on))
    return first


def drop_incomplete(patches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Remove patches with a missing pixel in any of the columns."""
    return patches.filter(~_any([A.has_missing(c) for c in columns]))


def incomplete_count(patches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of patches with a missing pixel; 0 is the data-quality assertion."""
    return patches.agg(F.count_if(_any([A.has_missing(c) for c in columns])).alias("incomplete"))


def _any(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result | c
    return result


def _all(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result & c
    return result


def apply_mask(patches: DataFrame, columns: Sequence[str], mask: str = "mask", fill=0.0) -> DataFrame:
    """Replace pixels outside the storm by ``fill`` (None: missing)."""
    return patches.withColumns({c: A.inside(c, mask, fill) for c in columns})


def training_frame(sources: Sequence[DataFrame], features: Sequence[str], on: str = "patch_id", label: str | None = None) -> DataFrame:
    """Concatenate variables per patch and remove incomplete rows.

    With ``label`` every source carries it; the first one's is kept, and a patch whose
    sources disagree (NULL against a value included) fails.
    """
    if label is None:
        return drop_incomplete(assemble_environment(sources, on), features)
    first, *rest = sources
    others = [f"__{label}_{i}" for i in range(len(rest))]
    frame = assemble_environment([first, *(s.withColumnRenamed(label, o) for s, o in zip(rest, others))], on)
    unequal = F.raise_error(F.concat(F.lit("sources disagree on the label of "), F.col(on).cast("string"))).cast(first.schema[label].dataType)
    if others:
        frame = frame.withColumn(label, F.when(~_all([F.col(label).eqNullSafe(F.col(o)) for o in others]), unequal).otherwise(F.col(label)))
    return drop_incomplete(frame.drop(*others), features)


# --- features and extremes ------------------------------------------------------------

# The 20 averaged state variables and their published names.
STATE = {"tk": "temp", "ev": "evwd", "eu": "euwd", "qv": "qvap", "pr": "pres"}
LEVELS_KM = (1, 3, 5, 7)


def tabular_features(patches: DataFrame, keys: Iterable[str] = ("patch_id",)) -> DataFrame:
    """26 scalars per patch: 20 state means, w_max, dbz_max, dbz_mean, ctt_max, ctt_mean, uh25_max."""
    means = [
        A.pixel_mean(f"{source}_{km}").alias(f"{name}_{km}km") for name, source in STATE.items() for km in LEVELS_KM
    ]
    return patches.select(
        *names(keys), *means,
        A.pixel_max("maxw").alias("w_max"), A.pixel_max("dbzs").alias("dbz_max"), A.pixel_mean("dbzs").alias("dbz_mean"),
        A.pixel_max("ctts").alias("ctt_max"), A.pixel_mean("ctts").alias("ctt_mean"), A.pixel_max("uh25").alias("uh25_max"),
    )


def storm_extreme(patches: DataFrame, columns: Sequence[str], mask: str = "mask", minimum: Sequence[str] = ("ctts",)) -> DataFrame:
    """In-storm extreme per patch: minimum for cloud-top temperature, maximum otherwise."""
    extremes = {
        f"{c}_extreme": (A.pixel_min if c in minimum else A.pixel_max)(A.inside(c, mask)) for c in columns
    }
    return patches.withColumns(extremes)


def storm_shear(patches: DataFrame, u_low: str, v_low: str, u_high: str, v_high: str, mask: str = "mask", out: str = "shear") -> DataFrame:
    """Bulk shear between two levels from in-storm wind maxima."""
    peak = lambda c: A.pixel_max(A.inside(c, mask)).cast("double")
    return patches.withColumn(out, wind_shear(peak(u_low), peak(v_low), peak(u_high), peak(v_high)))


def feature_medians(
    patches: DataFrame, scaler: DataFrame, keys: Iterable[str], features: Sequence[str], mask: str | None = "mask",
    grams: Sequence[str] = (), splits: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Median over all (in-storm) pixels of each feature in physical units: keys, ``feature``, ``median``.

    The standardised median is mapped back afterwards, which is the same because the
    deviation is positive. ``mask=None`` uses every pixel.
    """
    keys = names(keys)
    masked = apply_mask(patches, features, mask, None) if mask else patches
    pixels = masked.select(*keys, F.explode(F.arrays_zip(*features)).alias("__px"))
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"__px.{f}").cast("double").alias("v")) for f in features]
    long = pixels.select(*keys, F.inline(F.array(*rows)))
    medians = exact_percentiles(long, [*keys, "feature"], "v", [0.5])
    scaled = keyed_join(medians, scaler.select("feature", "mean", "std"), ["feature"])
    physical = F.col("value") * F.col("std") + F.col("mean")
    physical = F.when(F.col("feature").isin(list(grams)), to_grams(physical)).otherwise(physical)
    return scaled.select(*keys, "feature", physical.alias("median"))


def outlier_cut(df: DataFrame, keys: Iterable[str], column: str, percentile: float = OUTLIER_PERCENTILE) -> DataFrame:
    """Percentile of a value per member: keys, ``cut``."""
    cut = exact_percentiles(df, keys, column, [percentile / 100])
    return cut.select(*names(keys), F.col("value").alias("cut"))


def top_percentile(df: DataFrame, keys: Iterable[str], column: str, percentile: float = OUTLIER_PERCENTILE) -> DataFrame:
    """Rows at or above their member's percentile, with the cut."""
    keys = names(keys)
    joined = keyed_join(df, small_side(outlier_cut(df, keys, column, percentile)), keys)
    return joined.filter(F.col(column) >= F.col("cut"))


def moisture_outliers(patches: DataFrame, keys: Iterable[str], moisture: str, mean: Column, std: Column, mask: str = "mask", percentile: float = OUTLIER_PERCENTILE) -> DataFrame:
    """Patches whose in-storm maximum of low-level moisture reaches the member's percentile."""
    peak = A.pixel_max(A.inside(moisture, mask)).cast("double") * std + mean
    return top_percentile(patches.withColumn("moisture_peak", peak), keys, "moisture_peak", percentile)


# --- maps over patches ----------------------------------------------------------------


def exceed_map(patches: DataFrame, keys: Iterable[str], values: str, threshold: float, width: int = 2 * RADIUS) -> DataFrame:
    """Per pixel, how many patches reach the threshold (>=), and that count over its largest."""
    keys = names(keys)
    long = unpack_patches(patches, keys, [values], width)
    counts = long.groupBy(*keys, "y", "x").agg(F.count_if(F.col(values) >= threshold).alias("n"))
    top = F.max("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), top.cast("double")))


def max_map(patches: DataFrame, keys: Iterable[str], values: str, width: int = 2 * RADIUS) -> DataFrame:
    """Per-pixel maximum over patches."""
    long = unpack_patches(patches, names(keys), [values], width)
    return long.groupBy(*names(keys), "y", "x").agg(F.max(values).alias("value"))
