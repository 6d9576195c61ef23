"""Queries that SQL cannot state, against brute force on small data."""

import numpy as np
from pyspark.sql import functions as F

from patchscope.operators import objects, scoring

RNG = np.random.default_rng(11)


def grow_by_hand(values, low, high, max_area):
    """Largest unowned peak first; add the largest free neighbour until the area is full."""
    owner = {}
    order = sorted(values, key=lambda p: (-values[p], p))
    for peak in order:
        if values[peak] < high or peak in owner:
            continue
        mine = {peak}
        owner[peak] = peak
        while len(mine) < max_area:
            ring = {(r + i, c + j) for r, c in mine for i in (-1, 0, 1) for j in (-1, 0, 1)}
            ring = [p for p in ring if p in values and values[p] >= low and p not in owner]
            if not ring:
                break
            best = min(ring, key=lambda p: (-values[p], p))
            owner[best] = peak
            mine.add(best)
    return owner


def test_growth_equals_brute_force(spark):
    rows, expected = [], {}
    for ts in range(4):
        values = {(r, c): float(v) for (r, c), v in np.ndenumerate(RNG.integers(10, 60, (9, 9)))}
        rows += [(ts, r, c, v) for (r, c), v in values.items()]
        expected.update({(ts, *p): o[0] * objects.STRIDE + o[1] for p, o in grow_by_hand(values, 20.0, 40.0, 7).items()})
    df = spark.createDataFrame(rows, "ts int, row int, col int, value double")
    got = objects.storm_objects(df, ["ts"], "ew", max_area=7)
    assert {(r["ts"], r["row"], r["col"]): r["obj"] for r in got.collect()} == expected


def test_classifier_equals_newton_fit(spark):
    x = RNG.normal(size=(300, 2))
    y = (RNG.random(300) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    got = scoring.classify(scoring.fit_classifier(df, ["a", "b"], max_iter=100), df).select("a", "b", "prob").collect()
    # Newton steps on the same penalised likelihood: features scaled to unit sample deviation
    scale = x.std(axis=0, ddof=1)
    z = np.column_stack([x / scale, np.ones(300)])
    beta, penalty = np.zeros(3), np.diag([0.01, 0.01, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        gradient = z.T @ (p - y) / 300 + penalty @ beta
        beta -= np.linalg.solve((z.T * (p * (1 - p))) @ z / 300 + penalty, gradient)
    want = {(a, b): v for (a, b), v in zip(map(tuple, x), 1 / (1 + np.exp(-z @ beta)))}
    assert all(abs(r["prob"] - want[r["a"], r["b"]]) < 1e-4 for r in got)


def test_isotonic_is_monotone_and_keeps_the_mean(spark):
    p = RNG.random(200)
    y = (RNG.random(200) < p**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "prob double, label int")
    got = scoring.calibrate(df, scoring.calibrate_fit(df)).orderBy("prob").select("calibrated").collect()
    fitted = np.array([r["calibrated"] for r in got])
    assert (np.diff(fitted) >= -1e-12).all() and abs(fitted.mean() - y.mean()) < 1e-9
    assert df.agg(F.count("*")).first()[0] == 200
