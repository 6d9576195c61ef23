"""Stored tables: who owns them, when they go, and rounds that touch only what still changes."""

from pathlib import Path

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from patchscope import session
from patchscope.operators import objects
from patchscope.plans import all_queries
from patchscope.session import checkpointed, shared_folder, stored_tables


def stored(spark):
    return {path.name for path in Path(shared_folder(spark).removeprefix("file:")).glob("table-*")}


@pytest.mark.parametrize("name", ["storm_objects_hysteresis", "storm_objects_watershed", "storm_objects_growth", "permutation_misses"])
def test_only_the_result_is_left(spark, name):
    before = stored(spark)
    rows = all_queries()[0][name](spark, SMALL)
    assert len(stored(spark) - before) == 1
    assert rows.count()


def test_stores_nest_and_release_on_failure(spark):
    before = stored(spark)
    with pytest.raises(ValueError):
        with stored_tables():
            with stored_tables() as inner:
                checkpointed(spark.range(3))
                handed = inner.hand_out(checkpointed(spark.range(5)))
            assert len(stored(spark) - before) == 1 and handed.count() == 5
            raise ValueError
    assert stored(spark) == before


def test_drop_deletes_one_table(spark):
    before = stored(spark)
    with stored_tables() as store:
        first, second = checkpointed(spark.range(3)), checkpointed(spark.range(4))
        store.drop(first)
        assert len(stored(spark) - before) == 1 and second.count() == 4
        # not a table of this store: nothing to delete
        store.drop(spark.range(2))


def test_settled_slices_leave_the_rounds(spark, monkeypatch):
    """A long snake takes several rounds; slices of single pixels are not written again after the first."""
    snake = [(0, 0, c, 50.0) for c in range(40)]
    dots = [(t, 0, 0, 50.0) for t in range(1, 30)]
    written = []
    write = session._write

    def record(df, store):
        table = write(df, store)
        if "__changed" in df.columns:
            written.append({r["ts"] for r in table.select("ts").distinct().collect()})
        return table

    monkeypatch.setattr(session, "_write", record)
    df = spark.createDataFrame(snake + dots, "ts int, row int, col int, value double")
    got = objects.storm_objects(df, ["ts"], "hyst")
    assert got.groupBy("ts").agg(F.countDistinct("obj").alias("n")).filter("n = 1").count() == 30
    # rounds and settled parts in turn: every slice settles once, only the snake is in later rounds
    assert len(written) > 4 and all(part <= {0} for part in written[2:])


def test_no_pixels_no_objects(spark):
    df = spark.createDataFrame([], "ts int, row int, col int, value double")
    for method in ("hyst", "ws", "ew"):
        assert not objects.storm_objects(df, ["ts"], method).collect()
