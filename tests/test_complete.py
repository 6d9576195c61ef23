"""Rows that must not get lost: missing, sparse and out-of-range values, file layouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchscope.operators import curves, fields, patches, resampling, scoring, splits
from patchscope.operators import verification as V
from patchscope.sources import readers


def test_density_has_every_grid_point(spark):
    df = spark.createDataFrame([(0.0,), (100.0,)], "v double")
    assert curves.kde(df, None, "v", 0.0, 100.0, 101, 1.0).count() == 101


@pytest.mark.parametrize("bandwidth", [0.3, 2.0, 40.0])
def test_density_by_moments_is_exact_to_nine_digits(spark, bandwidth):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(30, 9, 700), rng.uniform(-500, 500, 300), [1e9, -1e9, 1e300]])
    rows = [(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)]
    got = curves.kde(spark.createDataFrame(rows, "v double"), None, "v", 0.0, 60.0, 61, bandwidth).orderBy("point").toPandas()
    z = (np.linspace(0, 60, 61)[:, None] - values[None, :]) / bandwidth
    # the infinite value counts and has no kernel
    wanted = np.exp(-0.5 * z * z).sum(axis=1) / ((len(values) + 1) * bandwidth * np.sqrt(2 * np.pi))
    assert len(got) == 61 and np.abs(got["density"] - wanted).max() < 1e-9 * max(1.0, 1 / bandwidth)


def test_density_within_reach_only(spark):
    df = spark.createDataFrame([("a", 10.2), ("b", None)], "k string, v double")
    got = curves.kde(df, ["k"], "v", 0.0, 100.0, 101, 1.0, reach=3.0).toPandas()
    assert set(got["k"]) == {"a"} and 6 <= len(got) <= 7 and got["density"].min() > 0


def test_density_of_nothing(spark):
    assert not curves.kde(spark.createDataFrame([], "v double"), None, "v", 0.0, 1.0, 11, 0.1).collect()


def test_classifier_keeps_rows_with_missing_features(spark):
    rows = [(float(i), float(i % 3), i % 2) for i in range(20)]
    model = scoring.fit_classifier(spark.createDataFrame(rows, "a double, b double, label int"), ["a", "b"])
    got = scoring.classify(model, spark.createDataFrame([(1.0, 2.0, 0), (None, 1.0, 1)], "a double, b double, label int")).collect()
    assert sorted(r["prob"] is None for r in got) == [False, True]


def test_probability_below_zero_is_counted(spark):
    df = spark.createDataFrame([(-0.1, 1), (0.5, 0)], "prob double, label int")
    assert V.reliability_frequencies(df).agg(F.sum("Total_Freq")).first()[0] == 2


def test_missing_probability_has_no_class(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), 0), (0.9, 1)], "prob double, label int")
    got = V.outcomes(df).select("outcome", "confident").collect()
    assert sorted((r["outcome"] or "", r["confident"]) for r in got if r["outcome"]) == [("tp", False)]
    assert sum(r["outcome"] is None and r["confident"] is None for r in got) == 2


def test_balanced_split_fails_without_positives(spark):
    df = spark.createDataFrame([(i, 0) for i in range(10)], "id int, label int")
    with pytest.raises(Exception, match="without positives"):
        splits.split_balanced(df, "id").collect()


def test_levels_between_kilometres_have_own_names(spark):
    pixels = spark.createDataFrame([(1,)], "p int")
    field = spark.createDataFrame([(1, 1000, 1.0), (1, 1500, 2.0)], "p int, level_m int, value double")
    assert patches.attach_levels(pixels, field, ["p"], [1000, 1500], "t").columns == ["p", "t_1", "t_1p5"]


def test_metric_files_go_by_name(spark, tmp_path):
    (tmp_path / "model1_random2.csv").write_text(",TP,FP,FN\n0,11,22,33\n")
    (tmp_path / "model1_random3.csv").write_text("FN,TP,FP\n3,1,2\n")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("TP", "FP", "FN")])
    got = readers.read_metrics(spark, str(tmp_path / "*.csv"), schema).select("member", "TP", "FP", "FN").collect()
    assert sorted(map(tuple, got)) == [(2, 11, 22, 33), (3, 1, 2, 3)]


def test_terrain_takes_the_first_time(spark, tmp_path):
    path = str(tmp_path / "terrain")
    spark.createDataFrame([(0, 0, 2, 7.0), (0, 0, 1, 5.0)], "row int, col int, ts int, hgt_m float").write.parquet(path)
    assert [r["hgt_m"] for r in readers.read_terrain(spark, path).collect()] == [5.0]


def test_both_layouts_take_the_lowest_bracket(spark):
    rows = [(1, k, z, v) for k, (z, v) in enumerate([(500.0, 0.0), (1500.0, 3.0), (800.0, 9.0), (1200.0, 7.0)])]
    df = spark.createDataFrame(rows, "c int, level int, z double, v double")
    long = fields.interp_levels(df, ["c"], "z", "v", heights=[1000.0]).first()["value"]
    assert long == fields.to_columns(df, ["c"], ["z", "v"]).select(fields.interp_at("z", "v", 1000.0)).first()[0] == 1.5


def test_bootstrap_refuses_gaps_in_row_numbers(spark):
    df = spark.createDataFrame([("a", i * 3) for i in range(5)], "k string, row_no int")
    for keys in (["k"], None):
        with pytest.raises(Exception, match="row numbers must count"):
            resampling.bootstrap_weights(df, keys, "row_no", 2).collect()


def test_smoothing_passes_equal_the_full_kernel(spark):
    cells = [(r, c, float(r * 7 % 5 + c) if (r + c) % 4 else None) for r in range(6) for c in range(5) if (r, c) != (2, 3)]
    df = spark.createDataFrame(cells, "row int, col int, value double")
    whole = {(x["row"], x["col"]): x["value"] for x in fields.stencil(df, None, fields.gaussian_weights(), partial=True).collect()}
    passes = {(x["row"], x["col"]): x["value"] for x in fields.gaussian_smooth(df, None).collect()}
    assert passes == pytest.approx(whole)


def test_helicity_does_not_depend_on_tiles(spark):
    cells = [(t, k, r, c, float(r * c % 7), float((r + 2 * c) % 5), 1.0 + k, 900.0 * k) for t in range(2) for k in range(5) for r in range(7) for c in range(6)]
    df = spark.createDataFrame(cells, "ts int, level int, row int, col int, u double, v double, w double, z double")
    got = [sorted(map(tuple, fields.updraft_helicity(df, ["ts"], tile=tile).select("ts", "row", "col", F.round("value", 9)).collect())) for tile in (2, 3, 64)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 84


def test_polygons_are_spread_before_their_cells_unfold(spark):
    """A tiny polygon table must not unfold in the one task that adaptive execution merges it into."""
    edges = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0), (1, 4.0, 0.0, 0.0, 4.0), (1, 0.0, 4.0, 0.0, 0.0)], "poly_id int, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([("in", 1.0, 1.0), ("out", 3.0, 3.0)], "id string, px double, py double")
    got = patches.points_in_polygons(points, edges, "id")
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("in", 1)]


def test_smoothing_does_not_exchange_multiplied_cells(spark):
    df = spark.createDataFrame([(t, i // 4, i % 4, float(i)) for t in range(3) for i in range(16)], "ts int, row int, col int, value double")
    text = fields.gaussian_smooth(df, ["ts"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 == text.count("REPARTITION_BY_NUM")
