"""Hand-made cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from patchscope.functions import arrays as A
from patchscope.functions import timeidx as TI
from patchscope.operators import curves, fields, importance, objects, patches, ranking, resampling, scaling, splits
from patchscope.operators import verification as V
from patchscope.sources import readers, schema, sinks


def one(df):
    (row,) = df.collect()
    return row.asDict()


def test_confusion_and_scores(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.3, 1), (0.1, 0)], "prob double, label int")
    s = one(V.scalar_scores(V.confusion(df)))
    assert (s["TP"], s["FP"], s["FN"], s["TN"]) == (1, 1, 1, 1)
    assert s["POD"] == s["POFD"] == s["FAR"] == s["AUC"] == 0.5
    assert s["CSI"] == pytest.approx(1 / 3)


def test_zero_rules(spark):
    no_yes = one(V.scalar_scores(V.confusion(spark.createDataFrame([(0.1, 1), (0.2, 0)], "prob double, label int"))))
    assert no_yes["FAR"] == 0 and no_yes["CSI"] == 0 and no_yes["Bias"] == 0
    no_event = one(V.scalar_scores(V.confusion(spark.createDataFrame([(0.1, 0), (0.9, 0)], "prob double, label int"))))
    assert no_event["POD"] == 0 and no_event["HitRate"] is None and no_event["AUC"] is None


def test_missing_probability_counts_nowhere(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 0), (0.9, 1)], "prob double, label int")
    assert one(V.confusion(df)) == {"TP": 1, "FP": 0, "FN": 0, "TN": 0}
    top = V.threshold_sweep(df, n=11).filter("Threshold = 0").first()
    assert (top["TP"], top["FN"]) == (1, 0)


def test_brier_identity(spark):
    df = spark.createDataFrame([(i / 40, int(i % 3 == 0)) for i in range(41)], "prob double, label int")
    b = one(V.brier_components(V.reliability_curve(df)))
    assert b["BS"] == pytest.approx(b["reliability"] - b["resolution"] + b["uncertainty"])
    assert V.reliability_frequencies(df).count() == V.reliability_curve(df).count() + 1
    for width in (0.05, 0.1):
        assert V.reliability_curve(df, width=width).agg(F.sum("Total_Freq")).first()[0] == 41


def test_bin_edges_are_exact(spark):
    df = spark.createDataFrame([(i * 5 / 100, 1) for i in range(21)], "prob double, label int")
    assert [r["Total_Freq"] for r in V.reliability_curve(df).orderBy("bin").collect()] == [1] * 21


def test_interpolation(spark):
    df = spark.createDataFrame([(1, 0, 500.0, 10.0), (1, 1, 1500.0, 20.0), (1, 2, 2500.0, 30.0)], "c int, level int, z double, v double")
    got = {r["level_m"]: r["value"] for r in fields.interp_levels(df, ["c"], "z", "v").collect()}
    assert got == {1000: 15.0, 3000: None, 5000: None, 7000: None}
    arrays = fields.to_columns(df, ["c"], ["z", "v"])
    assert arrays.select(fields.interp_at("z", "v", 1000.0)).first()[0] == 15.0


def test_solid_rotation(spark):
    omega, d = 1e-3, 4000.0
    cells = [(0, r, c, -omega * r * d, omega * c * d) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(cells, "ts int, row int, col int, u double, v double")
    got = {(r["row"], r["col"]): r["vort"] for r in fields.vertical_vorticity(df, ["ts"]).collect()}
    for (row, col), vort in got.items():
        if 0 < row < 3 and 0 < col < 3:
            assert vort == pytest.approx(2 * omega)
        else:
            assert vort is None


def test_helicity_of_uniform_column(spark):
    omega, d = 1e-3, 4000.0
    cells = [
        (0, k, r, c, -omega * r * d, omega * c * d, 5.0, 1000.0 * k) for k in range(8) for r in range(3) for c in range(3)
    ]
    df = spark.createDataFrame(cells, "ts int, level int, row int, col int, u double, v double, w double, z double")
    for tile in (1, 2, 64):
        centre = fields.updraft_helicity(df, ["ts"], tile=tile).filter("row = 1 and col = 1").first()
        assert centre["value"] == pytest.approx(5.0 * 2 * omega * 3000.0)


def test_column_array_vorticity(spark):
    rows = [(0, r, c, [1.0 * r, 2.0 * r], [3.0 * c, 4.0 * c]) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(rows, "ts int, row int, col int, u array<double>, v array<double>")
    centre = fields.vertical_vorticity(df, ["ts"], dx=0.5, dy=0.5).filter("row = 1 and col = 1").first()
    assert centre["vort"] == [4.0, 4.0]


def test_cloud_top(spark):
    # each layer weighs 1000 kg/m2 and holds 1000 g/m2 of water: a depth of 0.6 at k = 0.0006
    rows = [(1, 0, 280.0, 1e-3, 0.0, 29430.0), (1, 1, 260.0, 1e-3, 0.0, 19620.0), (1, 2, 240.0, 0.0, 0.0, 9810.0)]
    df = spark.createDataFrame(rows, "c int, level int, tk double, qcloud double, qice double, p double")
    # depth 0.6 at level 1, 1.2 at level 0: unity is two thirds of the way down
    top = fields.cloud_top_temperature(df, ["c"], k_water=0.6e-3, k_ice=0.0)
    assert top.first()["value"] == pytest.approx(260.0 + 20.0 * 2 / 3 - 273.15)
    clear = df.withColumn("qcloud", F.lit(0.0))
    assert fields.cloud_top_temperature(clear, ["c"], 1.0, 1.0).first()["value"] is None
    assert fields.cloud_top_temperature(clear, ["c"], 1.0, 1.0, no_cloud="surface").first()["value"] == pytest.approx(280.0 - 273.15)


def storm(spark, cells):
    return spark.createDataFrame([(0, r, c, float(v)) for (r, c), v in cells.items()], "ts int, row int, col int, value double")


def square(row, col, value):
    return {(row + i, col + j): value for i in range(3) for j in range(3)}


def test_components(spark):
    two = {**square(0, 0, 45), **square(0, 4, 45)}
    count = lambda cells: objects.storm_objects(storm(spark, cells), ["ts"], "hyst").select("obj").distinct().count()
    assert count({**two, (1, 3): 10}) == 2
    assert count({**two, (1, 3): 25}) == 1
    assert count({k: 30 for k in two}) == 0


def test_long_snake_is_one_object(spark):
    cells = {}
    for row in range(0, 30, 2):
        cells.update({(row, c): 41 for c in range(12)})
        cells[(row + 1, 11 if row % 4 == 0 else 0)] = 41
    got = objects.storm_objects(storm(spark, cells), ["ts"], "hyst", connectivity=4)
    assert got.select("obj").distinct().count() == 1 and got.count() == len(cells)


def test_basins_split_at_the_saddle(spark):
    cells = {(0, c): v for c, v in enumerate([42, 50, 42, 30, 43, 55, 41])}
    got = {r["col"]: r["obj"] for r in objects.storm_objects(storm(spark, cells), ["ts"], "ws").collect()}
    assert got[0] == got[1] == got[2] == 1 and got[4] == got[5] == got[6] == 5


def test_growth_respects_area(spark):
    cells = {(r, c): 60 - abs(r - 5) - abs(c - 5) for r in range(11) for c in range(11)}
    got = objects.storm_objects(storm(spark, cells), ["ts"], "ew", max_area=9)
    sizes = [r["count"] for r in got.groupBy("obj").count().collect()]
    assert max(sizes) == 9 and got.count() == got.select("row", "col").distinct().count()


def test_patch_at_the_edge_is_dropped(spark):
    grid = {(r, c): 0 for r in range(12) for c in range(12)}
    inside, outside = {**grid, **square(5, 5, 50)}, {**grid, **square(0, 5, 50)}
    for cells, n in ((inside, 64), (outside, 0)):
        df = storm(spark, cells)
        got = patches.extract_patches(objects.storm_objects(df, ["ts"], "hyst"), df, ["ts"], radius=4)
        assert got.count() == n
        assert got.filter("in_mask").count() == (9 if n else 0)


def test_infinite_and_missing_pixels(spark):
    df = spark.createDataFrame([([1.0, float("inf"), float("nan")],)], "uh03 array<double>")
    fitted = scaling.fit_scaler(df.select(A.clean("uh03").alias("uh03")), None, ["uh03"]).first()
    assert (fitted["mean"], fitted["std"], fitted["n"]) == (0.5, 0.5, 2)


def test_fold_sizes(spark):
    df = spark.range(11).select(F.col("id"), F.lit(1).alias("label"))
    sizes = splits.split_kfold(df, "id", 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [3, 2, 2, 2, 2]


def test_balanced_split(spark):
    df = spark.range(110).select(F.col("id"), (F.col("id") < 10).cast("int").alias("label"))
    got = {(r["split"], r["label"]): r["count"] for r in splits.split_balanced(df, "id", 0.6).groupBy("split", "label").count().collect()}
    assert got == {("train", 1): 6, ("train", 0): 6, ("test", 1): 4, ("test", 0): 38}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(160.0,), (160.1,), (74.9,), (75.0,)], "v double")
    got = [r["n"] for r in curves.histogram(df, None, "v", 75, 160, 40).orderBy("bin").collect()]
    assert got[0] == 1 and got[-1] == 1 and sum(got) == 2


def test_bands(spark):
    df = spark.range(1, 101).select(F.lit("a").alias("k"), F.col("id").alias("perm"), F.col("id").cast("double").alias("CSI"))
    got = {r["band"]: r["count"] for r in importance.permutation_bands(df, ["k"], ["CSI"]).groupBy("band").count().collect()}
    assert got == {"bottom": 5, "top": 5, "middle": 90}


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, id int")
    ranked = {(r["k"], r["rank"]) for r in ranking.seeded_rank(df, "id", 0, by=["k"]).collect()}
    assert ranked == {(None, 1), (None, 2), ("a", 1)}


def test_replicate_shards_add_up(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("row_no"))
    weights = lambda n, first: {tuple(r) for r in resampling.bootstrap_weights(df, ["k"], "row_no", n, 0, first).collect()}
    assert weights(5, 1) == weights(2, 1) | weights(3, 3)


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0, 0.0],)], "v array<double>")
    assert tuple(df.select(A.argmax_pixel("v", 2).alias("p")).select("p.*").first()) == (0, 1)


def test_hour_axis_of_the_simulations(spark):
    axis = spark.range(1).select(F.size(TI.time_axis("2000-10-01", "2013-10-01", "1 HOUR"))).first()[0]
    assert axis == 113_953
    assert TI.year_range(2001, 2001) == [2001] and TI.year_range(2000, 2003) == [2000, 2001, 2002]


def test_names(spark):
    assert len(schema.feature_columns()) == 30
    assert schema.level_index("temp_5") == 2
    df = spark.createDataFrame([(1, 2)], "TK5 int, MASK int")
    assert schema.rename_variables(df).columns == ["temp_5", "mask"]


def test_shards_overwrite_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "metrics")
    table = lambda rep, v: spark.createDataFrame([(rep, v)], "rep int, v int")
    sinks.write_dataset(table(1, 10), path, ["rep"])
    sinks.write_dataset(table(2, 20), path, ["rep"])
    sinks.write_dataset(table(2, 21), path, ["rep"])
    assert {(r["rep"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, 10), (2, 21)}
    empty = readers.read_if_exists(spark, str(tmp_path / "absent"), schema.GRID)
    assert empty.count() == 0 and empty.columns == schema.GRID.fieldNames()


def test_gaussian_kernel_sums_to_one():
    assert math.isclose(sum(fields.gaussian_weights(1.0).values()), 1.0)
