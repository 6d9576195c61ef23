"""Permutations by bijection, bootstrap on cells, row sets as words, rows without label."""

import re

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from patchscope.functions import mixing as M
from patchscope.operators import importance, resampling
from patchscope.operators import verification as V
from patchscope.plans import resampling_queries as Q
from patchscope.plans import views

P = M.PRIME


def mix(t):
    return (t * t % P * M.SQUARE + M.ADD) % P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 97, 100, 1001])
def test_every_seed_gives_a_bijection(spark, n):
    df = spark.range(n).withColumn("n", F.lit(n).cast("bigint")).withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in range(7)])))
    rows = M.with_permutation(M.with_grid(df, "n"), "id", "seed", "to").select("seed", "id", "to").collect()
    for seed in range(7):
        assert sorted(r["to"] for r in rows if r["seed"] == seed) == list(range(n))


def test_permutations_are_even(spark):
    """Over many seeds every place is about as likely, also relative to the neighbour's place."""
    n, reps = 20, 6000
    df = spark.range(n).select(F.col("id").alias("row_no"), F.col("id").alias("a"))
    moved = importance.permutations(df, None, "row_no", ["a"], reps).select("perm", "row_no", "orig_row_no").collect()
    to = np.zeros((reps + 1, n), int)
    for r in moved:
        to[r["perm"], r["orig_row_no"]] = r["row_no"]
    to = to[1:]
    for place in (0, 7, 19):
        counts = np.bincount(to[:, place], minlength=n)
        assert ((counts - reps / n) ** 2 / (reps / n)).sum() < 60  # 19 degrees of freedom
        gaps = np.bincount((to[:, place] - to[:, (place + 1) % n]) % n, minlength=n)[1:]
        assert ((gaps - reps / (n - 1)) ** 2 / (reps / (n - 1))).sum() < 60


def test_row_numbers_must_be_dense(spark):
    with pytest.raises(Exception, match="row numbers must count"):
        importance.permutations(spark.range(1, 5).withColumnRenamed("id", "row_no"), None, "row_no", ["row_no"], 1).collect()


def test_nothing_is_ranked_or_sorted_before_scoring(spark):
    rows = Q._rows(spark, SMALL).drop("row_key")
    text = plan(Q._outcomes(rows))
    assert "Window" not in text and not re.search(r"\bSort\b", text) and "SortMergeJoin" not in text
    hashed = importance.keyed_join(rows, importance.hashed_side(rows.select(*Q.KEYS, "row_no"), max_bytes=0), [*Q.KEYS, "row_no"])
    assert "ShuffledHashJoin" in plan(hashed) and not re.search(r"\bSort\b", plan(hashed))


def test_draws_on_cells_equal_a_plain_draw_of_rows(spark):
    rng = np.random.default_rng(7)
    n, reps = 700, 5
    p, y = rng.random(n), rng.integers(0, 2, n)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "prob double, label int")
    place = np.where(p >= 0.5, 1 - y, 3 - y)
    cells = np.sort(np.minimum((np.round(p / 0.05, 9)).astype(int), 20) * 4 + place)  # rows numbered cell by cell
    keyed = spark.range(1).select(resampling.draw_int(0) % P).first()[0]
    got = {(r["rep"], r["cell"]): r["w"] for r in resampling.drawn_cells(V.forecast_cells(df, []), [], reps, 84).collect()}
    want = {}
    for rep in range(1, reps + 1):
        seed = mix((mix(keyed) + rep * M.SPREAD) % P)
        for slot in range(n):
            high, low = mix(mix((slot * M.SPREAD + seed + M.OTHER) % P)), mix(mix((slot * M.OTHER + seed + 2 * M.OTHER) % P))
            cell = (rep, int(cells[((high << 31) + low) % n]))
            want[cell] = want.get(cell, 0) + 1
    assert got == want


def test_bootstrap_on_cells_spreads_like_resampled_rows(spark):
    rng = np.random.default_rng(5)
    p = rng.random(800)
    y = (rng.random(800) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "prob double, label int")
    got = np.array([r["CSI"] for r in resampling.cell_bootstrap_scores(df, [], 300).collect()])
    own = []
    for _ in range(300):
        i = rng.integers(0, 800, 800)
        yes, event = p[i] >= 0.5, y[i] == 1
        own.append((yes & event).sum() / (yes | event).sum())
    assert len(got) == 300 and abs(got.mean() - np.mean(own)) < 0.006 and 0.8 < got.std() / np.std(own) < 1.25


def test_cell_bootstrap_has_no_join(spark):
    df = views.forecast(spark, SMALL)
    for made in (resampling.cell_bootstrap_scores(df, Q.KEYS, 3), resampling.cell_bootstrap_sweep(df, Q.KEYS, 2, n=50), resampling.cell_bootstrap_reliability(df, Q.KEYS, 2)):
        assert "Join" not in plan(made) and made.count()
    few = resampling.cell_bootstrap_sweep(df, Q.KEYS, 2, n=50)
    assert few.groupBy(*Q.KEYS, "rep").count().where("count <> 51").count() == 0


def test_sets_of_rows_as_words(spark):
    rng = np.random.default_rng(2)
    a = sorted({int(x) for x in rng.integers(0, 1000, 300)} | {0, 63, 64, 127})
    df = spark.createDataFrame([("k", i, i % 3 == 0) for i in a for _ in range(2)], "k string, row_no long, third boolean")
    words = importance.row_words(df, ["k"], all=F.lit(True), third=F.col("third"))
    assert words.count() == len({i // 64 for i in a})
    back = lambda c: sorted(r["row_no"] for r in importance.rows_of_words(words.select("k", "word", c), c).collect())
    assert back("all") == a and back("third") == [i for i in a if i % 3 == 0]


def test_fewer_rows_are_shuffled_for_the_sets(spark):
    wrong = spark.range(0, 6400).selectExpr("id div 4 as row_no", "id % 4 as perm", "'top' as band")
    assert importance.row_words(wrong, [], top=F.col("band") == "top").count() == 25


def test_rows_without_label_or_probability_do_not_count(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, None), (0.1, 0), (None, 1)], "prob double, label int")
    got = V.evaluate(df, [], width=0.1).first()
    assert (got["TP"], got["FP"], got["FN"], got["TN"]) == (1, 0, 0, 1) and got["climo"] == 0.5 and got["BS"] == pytest.approx((0.05**2 + 0.15**2) / 2)
    curve = V.reliability_curve(df, None, width=0.1)
    assert curve.agg(F.sum("Total_Freq"), F.sum("Positive_Freq")).first()[:] == (2, 1)
    assert V.brier_components(curve).first()["climo"] == 0.5
    assert V.evaluate(df.where("label is null"), []).first()["BS"] is None


@pytest.mark.parametrize("n", [1, 2, 3, 12, 97, 1001])
def test_arrays_permute_like_columns_and_back(spark, n):
    df = M.with_grid(spark.range(n).withColumn("n", F.lit(n).cast("bigint")), "n").withColumn("seed", F.lit(M.PRIME - 1).cast("bigint"))
    there = M.with_permutation(df, "id", "seed", "to")
    rows = M.with_inverse(there, "to", "seed", "back").select("id", "to", "back", "seed", "__wide", "__high", "__last").orderBy("id").collect()
    at, to, back, seed, *grid = (np.array(c, np.int64) for c in zip(*rows))
    assert (back == at).all()
    assert (M.permuted_array(at, seed, *grid) == to).all() and (M.unpermuted_array(to, seed, *grid) == at).all()


def test_packed_copies_equal_copies_sent_as_rows(spark):
    """NULL keys, values without a number, a number that two rows have, several blocks and messages a key."""
    rng = np.random.default_rng(3)
    rows = [(k, i, None if i % 7 == 0 else float(rng.random()), int(i % 5), [float(i)], f"{k}{i}") for k, n in (("a", 700), (None, 90)) for i in range(n)]
    rows += [("twice", i, float(i), i, [0.0], "t") for i in (0, 1, 1, 3)]
    df = spark.createDataFrame(rows, "k string, row_no int, a double, b int, v array<double>, text string")
    moved = importance.permutations(df, ["k"], "row_no", ["a", "b"], 3, seed=4, first_rep=2, carry=True)
    joined = importance.keyed_join(moved, df, ["k", "row_no"])
    want = joined.withColumns({f: F.when(F.col("pfi_var") == f, F.col("donated")).otherwise(F.col(f)).cast(df.schema[f].dataType) for f in ("a", "b")}).drop("donated")
    got = importance.permute_features(df, ["k"], "row_no", ["a", "b"], 3, seed=4, first_rep=2)
    assert got.columns == want.columns
    listed = lambda d: sorted(map(repr, d.collect()))
    assert listed(got) == listed(want)
    without = importance.permute_features(df, ["k"], "row_no", ["a", "b"], 3, seed=4, first_rep=2, donors=False)
    assert without.columns == [c for c in want.columns if c != "orig_row_no"]
    once = want.where("k is null or k <> 'twice'").select("k", "pfi_var", "perm", "row_no", "orig_row_no")
    found = importance.with_donors(once.drop("orig_row_no"), df, ["k"], ["a", "b"], seed=4)
    assert listed(found) == listed(once)


def test_copies_are_not_shuffled_as_rows(spark):
    """Packed, the exchange of the copies carries fewer records than there are copies."""
    rows = Q._rows(spark, SMALL)
    text = plan(Q._outcomes(rows))
    assert "orig_row_no" not in text and "MapInArrow" in text
    sent = text[text.index("Union"):]
    assert "__sent" in sent and "explode" not in sent.lower()


def test_draws_on_arrays_equal_draws_on_columns(spark):
    df = spark.range(0, 5000, 7).withColumns({"seed": F.lit(M.PRIME - 1).cast("bigint"), "n": F.lit(3_000_000_019).cast("bigint")})
    rows = M.with_draw(df, "id", "seed", "n", "draw").collect()
    assert M.draw_array(np.array([r["id"] for r in rows]), M.PRIME - 1, 3_000_000_019).tolist() == [r["draw"] for r in rows]


def test_draws_are_counted_in_arrays_not_row_by_row(spark):
    df = spark.createDataFrame([(None, 0, 70_000), (None, 5, 1), ("a", 3, 2)], "k string, cell int, w long")
    drawn = resampling.drawn_cells(df, ["k"], 4, 6)
    assert "__slot" not in plan(drawn)
    got = {(r["k"], r["rep"]): r["n"] for r in drawn.groupBy("k", "rep").agg(F.sum("w").alias("n")).collect()}
    assert got == {(k, rep): n for k, n in ((None, 70_001), ("a", 2)) for rep in (1, 2, 3, 4)}


def test_a_probability_is_drawn_once_a_row(spark):
    text = plan(V.forecast_cells(views.forecast(spark, SMALL), Q.KEYS))
    assert text.count("md5(") == 1


def test_messages_hold_values_alone(spark, monkeypatch):
    """Both sides know the permutations, so a copy of a feature with few distinct values costs about a byte, not four."""
    df = spark.range(20_000).selectExpr("id as row_no", "cast(id * 7 % 50 as double) as a", "cast(id * 13 % 11 as double) / 100 as b")
    seen, kind = [], type(df)
    laid = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *args: seen.append(self) or laid(self, *args))
    moved = importance.permute_features(df, None, "row_no", ["a", "b"], 12)
    monkeypatch.undo()
    sent = next(d for d in seen if "__sent" in d.columns)
    assert sent.agg(F.sum(F.length("__sent"))).first()[0] < 1.5 * 24 * 20_000
    assert moved.count() == 24 * 20_000


def test_packed_copies_of_many_distinct_values(spark):
    """Blocks with more distinct values than codes, with and without missing ones; in one key a number is repeated and one has no row."""
    df = spark.range(18_000).selectExpr(
        "if(id < 9000, 'a', 'b') as k", "if(id = 17000, 1, id % 9000) as row_no",
        "if(id % 9 = 0, null, cast(xxhash64(id) as double)) as a", "cast(xxhash64(id, 1) as double) as b")
    moved = importance.permutations(df, ["k"], "row_no", ["a", "b"], 2, carry=True)
    joined = importance.keyed_join(moved, df, ["k", "row_no"])
    want = joined.withColumns({f: F.when(F.col("pfi_var") == f, F.col("donated")).otherwise(F.col(f)) for f in ("a", "b")}).drop("donated")
    got = importance.permute_features(df, ["k"], "row_no", ["a", "b"], 2)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
