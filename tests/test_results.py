"""Calibration by pooled pieces, checked labels, published tables, median intervals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchscope.operators import calibration, curves, patches, resampling
from patchscope.operators import verification as V


def pool(p, y):
    """Isotonic means of sorted distinct probabilities, one after the other."""
    keys = sorted(set(p))
    blocks = [[k, k, float((p == k).sum()), float(y[p == k].sum())] for k in keys]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return out


@pytest.mark.parametrize("fan, pieces", [(2, 40), (32, 1024)])
def test_pieces_pool_to_the_same_blocks(spark, monkeypatch, fan, pieces):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(3000), 4)
    y = (rng.random(3000) < p**2).astype(int)
    monkeypatch.setattr(calibration, "FAN", fan)
    monkeypatch.setattr(calibration, "split_points", lambda df, c: [i / pieces for i in range(1, pieces)])
    rows = [("a", float(a), int(b)) for a, b in zip(p, y)] + [("b", 0.4, 1), (None, 0.2, 0), ("a", None, 1), ("a", 0.5, None), ("c", None, 0)]
    df = spark.createDataFrame(rows, "k string, prob double, label int")
    blocks = calibration.isotonic_blocks(df, ["k"])
    got = sorted([r["low"], r["high"], r["weight"], r["total"]] for r in blocks.filter("k = 'a'").collect())
    assert got == pool(p, y)
    asked = spark.createDataFrame([("a", float(v)) for v in [*p[:50], -0.5, 1.5, 0.0, 1.0]] + [("a", None), ("b", 0.9), ("c", 0.5), (None, 0.7)], "k string, prob double")
    fitted = calibration.calibrated(asked, blocks, ["k"]).collect()
    knots = sorted(got)
    xs = [x for low, high, _, _ in knots for x in (low, high)]
    ys = [t / w for _, _, w, t in knots for _ in (0, 1)]
    for r in fitted:
        want = np.interp(r["prob"], xs, ys) if r["k"] == "a" and r["prob"] is not None else {"b": 1.0, None: 0.0}.get(r["k"]) if r["prob"] is not None else None
        assert r["calibrated"] == (None if want is None else pytest.approx(want)), r
    assert len(fitted) == asked.count()


def test_no_rows_give_no_blocks(spark):
    empty = spark.createDataFrame([], "prob double, label int")
    blocks = calibration.isotonic_blocks(empty)
    assert blocks.count() == 0
    assert calibration.calibrated(spark.createDataFrame([(0.5,)], "prob double"), blocks).first()["calibrated"] is None


def test_labels_of_all_sources_must_agree(spark):
    a = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], None)], "patch_id int, a array<double>, label int")
    b = spark.createDataFrame([(1, [3.0], 1), (2, [None], None)], "patch_id int, b array<double>, label int")
    frame = patches.training_frame([a, b], ["a", "b"], label="label")
    assert [(r["patch_id"], r["label"]) for r in frame.collect()] == [(1, 1)] and frame.columns == ["patch_id", "a", "label", "b"]
    for other in (0, None):
        c = spark.createDataFrame([(1, [3.0], other), (2, [1.0], None)], "patch_id int, c array<double>, label int")
        with pytest.raises(Exception, match="disagree on the label of 1"):
            patches.training_frame([a, c], ["a", "c"], label="label").collect()
    assert patches.training_frame([a], ["a"], label="label").count() == 2


def test_published_table_sums_counts_and_averages_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(25, m, float(p), int(rng.random() < p)) for m in (1, 2) for p in rng.random(200)]
    df = spark.createDataFrame(rows, "model int, member int, prob double, label int")
    got = curves.published_table(df, ["model"], digits=None).first()
    each = V.evaluate(df, ["model", "member"]).collect()
    assert got["TP"] == sum(r["TP"] for r in each)
    for c in curves.PUBLISHED:
        assert got[c] == pytest.approx(np.mean([r[c] for r in each]))
    rounded = curves.published_table(df, ["model"]).first()
    assert rounded["BSS"] == pytest.approx(got["BSS"], abs=0.005)


def test_median_interval_maps_masks_units_and_scaler(spark):
    rng = np.random.default_rng(6)
    arrays = rng.normal(size=(40, 9))
    df = spark.createDataFrame([(i, [float(v) for v in a], [bool(v > 0) for v in a]) for i, a in enumerate(arrays)], "row_no long, qv array<double>, mask array<boolean>")
    scaler = spark.createDataFrame([("qv", 5.0, 2.0)], "feature string, mean double, std double")
    got = resampling.feature_median_intervals(df, scaler, [], "row_no", ["qv"], 40, mask="mask", grams=["qv"]).first()
    long = df.select("row_no", F.lit("qv").alias("feature"), F.transform("qv", lambda v, i: F.when(F.get("mask", i), v)).alias("px"))
    medians = [r["median"] for r in resampling.bootstrap_medians(long, ["feature"], "row_no", "px", 40).collect()]
    want = [(np.percentile(medians, q) * 2 + 5) * 1000 for q in (2.5, 97.5)]
    assert [got["q2_5"], got["q97_5"]] == pytest.approx(want)
