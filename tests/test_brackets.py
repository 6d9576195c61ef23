"""Percentiles between brackets that sketches give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchscope.operators import quantiles as Q

RNG = np.random.default_rng(11)


def percentile(values, p):
    """Linear between the two nearest ranks; a rank met exactly needs no other value."""
    values, at = np.sort(values), (len(values) - 1) * p
    low, high = values[int(np.floor(at + 1e-9))], values[int(np.ceil(at - 1e-9))]
    return low if low == high else low + (high - low) * (at - np.floor(at + 1e-9))


@pytest.fixture(scope="module")
def mixed(spark):
    data = {
        "normal": RNG.normal(size=20_000), "ties": RNG.integers(0, 5, 9_000).astype(float), "one": np.array([3.0]), "two": np.array([1.0, 2.0]),
        "spread": np.concatenate([RNG.normal(size=3000), [-np.inf, np.inf, 1e300]]), "same": np.full(500, 7.0)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("normal", None), ("normal", float("nan")), ("none", None), (None, 5.0)]
    return data | {None: np.array([5.0])}, spark.createDataFrame(rows, "k string, v double").repartition(6)


@pytest.mark.parametrize("reach, ordered", [(Q.REACH, Q.ORDERED_ROWS), (Q.REACH, 5), (0.05, 100), (1.0, 10)])
def test_brackets_give_exact_percentiles(mixed, reach, ordered):
    data, df = mixed
    wanted = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {(r["k"], r["p"]): r["value"] for r in Q.exact_percentiles(df, "k", "v", wanted, reach=reach, ordered_rows=ordered).collect()}
    assert set(got) == {(k, p) for k in data for p in wanted}
    for (k, p), value in got.items():
        assert value == pytest.approx(percentile(data[k], p))


def test_a_bracket_that_misses_is_widened(mixed):
    data, df = mixed
    got = Q.exact_percentiles(df.where("k = 'normal'"), None, "v", [0.37], reach=1e-9).first()["value"]
    assert got == pytest.approx(percentile(data["normal"], 0.37))


def test_few_values_are_shuffled(spark):
    n = 400_000
    rows = spark.range(n, numPartitions=8).select(F.struct(F.lit(1).alias("one")).alias(Q.GROUP), F.rand(3).alias("__v"))
    brackets = Q._brackets(rows, [0.5], Q.REACH, Q.ORDERED_ROWS)
    counted = Q.bracketed(rows, brackets)
    assert counted.filter("__v is not null").count() < n / 100
    assert counted.agg(F.sum("__w")).first()[0] < 0.51 * n


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert Q.exact_percentiles(df, "k", "v", [0.5]).count() == 0
