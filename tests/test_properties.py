"""Identities and numpy cross-checks on random data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchscope.operators import curves, importance, patches, resampling, splits
from patchscope.operators import verification as V
from patchscope.operators.quantiles import exact_percentiles, rank_auc

RNG = np.random.default_rng(3)


def forecasts(spark, n=400):
    p = np.concatenate([RNG.random(n - 40), RNG.integers(0, 11, 40) / 10])
    y = (RNG.random(n) < p).astype(int)
    return p, y, spark.createDataFrame([(float(a), int(b), i) for i, (a, b) in enumerate(zip(p, y))], "prob double, label int, row_no long")


@pytest.mark.parametrize("n", [11, 101, 1000])
def test_sweep_equals_brute_force(spark, n):
    p, y, df = forecasts(spark)
    got = V.threshold_sweep(df, n=n).orderBy("Threshold").collect()
    grid = np.append(np.linspace(0.0, 1.0, n), 2.0)
    assert np.allclose([r["Threshold"] for r in got], grid, atol=0)
    for r, t in zip(got, grid):
        assert (r["TP"], r["FP"], r["FN"], r["TN"]) == (
            ((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum(), ((p < t) & (y == 1)).sum(), ((p < t) & (y == 0)).sum(),
        )


def test_rank_auc(spark):
    p, y, df = forecasts(spark)
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    expected = wins / (len(pos) * len(neg))
    for cuts in (None, [], [0.1, 0.5], [0.5]):
        assert rank_auc(df, None, splits=cuts).first()["auc_rank"] == pytest.approx(expected)


@pytest.mark.parametrize("cuts", [None, [], [0.0], [-1.0, -0.5, 0.2, 0.21, 3.0]])
def test_percentiles_equal_numpy(spark, cuts):
    data = {"a": RNG.normal(size=501), "b": RNG.integers(0, 4, 37).astype(float), "c": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    probabilities = [0.0, 0.025, 0.5, 0.99, 1.0]
    got = {(r["k"], r["p"]): r["value"] for r in exact_percentiles(df, "k", "v", probabilities, splits=cuts).collect()}
    for k, vs in data.items():
        for p in probabilities:
            assert got[k, p] == pytest.approx(np.percentile(vs, 100 * p))


def test_weighted_percentiles(spark):
    v, w = RNG.normal(size=50), RNG.integers(0, 4, 50)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, w)], "v double, w int")
    got = exact_percentiles(df, None, "v", [0.3], weight=F.col("w")).first()["value"]
    assert got == pytest.approx(np.percentile(np.repeat(v, w), 30))


def test_weights_sum_to_the_number_of_rows(spark):
    _, _, df = forecasts(spark)
    sums = resampling.bootstrap_weights(df, None, "row_no", 6).groupBy("rep").agg(F.sum("w").alias("s"), F.max("row_no").alias("m"))
    assert {r["s"] for r in sums.collect()} == {400}


def test_bootstrap_equals_numpy_gather(spark):
    p, y, df = forecasts(spark)
    weights = {r["row_no"]: r["w"] for r in resampling.bootstrap_weights(df, None, "row_no", 1, 5).collect()}
    w = np.array([weights.get(i, 0) for i in range(400)])
    got = resampling.bootstrap_scores(df, [], "row_no", 1, 5).first()
    assert got["TP"] == w[(p >= 0.5) & (y == 1)].sum() and got["TN"] == w[(p < 0.5) & (y == 0)].sum()


def test_bootstrap_median_equals_numpy(spark):
    arrays = RNG.normal(size=(60, 9))
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(arrays)], "row_no long, px array<double>")
    for cuts in (None, [], [0.0]):
        for r in resampling.bootstrap_medians(df, [], "row_no", "px", 3, splits=cuts).collect():
            draws = {d["row_no"]: d["w"] for d in resampling.bootstrap_weights(df, [], "row_no", 3).filter(F.col("rep") == r["rep"]).collect()}
            assert r["median"] == pytest.approx(np.median(np.concatenate([arrays[i] for i, w in draws.items() for _ in range(w)])))


def test_permutation_keeps_every_value(spark):
    df = spark.range(200).select(F.col("id").alias("row_no"), F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    moved = importance.permute_features(df, [], "row_no", ["a", "b"], 3)
    for r in moved.groupBy("pfi_var", "perm").agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b"), F.count_if(F.col("orig_row_no") == F.col("row_no")).alias("fixed")).collect():
        assert r["a"] == 200 and r["b"] == 200 and r["fixed"] < 20
    untouched = moved.filter("pfi_var = 'a' and b <> 2 * row_no").count()
    assert untouched == 0


def test_arrays_travel_whole(spark):
    df = spark.range(20).select(F.col("id").alias("row_no"), F.array("id", F.col("id") + 100).alias("a"), F.array(F.lit(1)).alias("b"))
    moved = importance.permute_feature(df, [], "row_no", "a").collect()
    assert all(r["a"] == [r["orig_row_no"], r["orig_row_no"] + 100] for r in moved)


def test_splits_partition_the_rows(spark):
    df = spark.range(503).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
    folds = splits.split_kfold(df, "id", 4)
    assert folds.count() == folds.select("id").distinct().count() == 503
    for label in (0, 1):
        sizes = [r["count"] for r in folds.filter(F.col("label") == label).groupBy("fold").count().collect()]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == 4
    members = splits.to_members(df, "id", 100).groupBy("member").agg(F.count("*").alias("n"), F.max("row_no").alias("m")).orderBy("member").collect()
    assert [r["n"] for r in members] == [100] * 5 + [3] and members[0]["m"] == 99


def test_curve_interpolation_equals_numpy(spark):
    x = np.sort(RNG.random(30)) * 0.8 + 0.1
    y = RNG.random(30)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = curves.interpolate_curve(df, [], "x", "y", 0.0, 1.0, 0.01).orderBy("grid_x").collect()
    assert np.allclose([r["grid_y"] for r in got], np.interp(np.arange(0, 1, 0.01), x, y))


def test_histogram_equals_numpy(spark):
    v = RNG.random(300) * 200
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    got = [r["n"] for r in curves.histogram(df, None, "v", 75, 160, 40).orderBy("bin").collect()]
    assert got == np.histogram(v, 40, (75, 160))[0].tolist()


def test_points_in_random_polygon(spark):
    corners = [(0, 0), (10, 1), (8, 9), (5, 4), (1, 8)]
    edges = [(1, *map(float, corners[i]), *map(float, corners[(i + 1) % 5])) for i in range(5)]
    pts = RNG.random((200, 2)) * 12 - 1

    def inside(px, py):
        hit = False
        for _, x0, y0, x1, y1 in edges:
            if (y0 > py) != (y1 > py) and px < (x1 - x0) * (py - y0) / (y1 - y0) + x0:
                hit = not hit
        return hit

    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)] + [(999, 0.0, 0.0), (998, 5.0, 0.5)], "id int, px double, py double")
    polygon = spark.createDataFrame(edges, "poly_id int, x0 double, y0 double, x1 double, y1 double")
    for band in (0.5, 1.0, 50.0):
        got = {r["id"] for r in patches.points_in_polygons(points, polygon, "id", band=band).collect()}
        assert got == {i for i, (a, b) in enumerate(pts) if inside(a, b)}
