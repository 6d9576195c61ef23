"""Permuted copies by tables, their cells stored as words, and the cases mined from them."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from patchscope import session
from patchscope.functions import mixing as M
from patchscope.operators import importance as P
from patchscope.operators import packed
from patchscope.operators import verification as V
from patchscope.plans import resampling_queries as Q


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 97, 1001, 40_000])
def test_tables_permute_like_arrays(n):
    wide = int(np.sqrt(n)) + 1
    grid = wide, -(-n // wide), n - (-(-n // wide) - 1) * wide
    at, arrays = np.arange(n), [np.full(n, g) for g in grid]
    for seed in (0, 12_345, M.PRIME - 1):
        table = M.Rotations(seed, *grid)
        to = table.there(*table.place(at))
        assert (to == M.permuted_array(at, np.full(n, seed), *arrays)).all()
        assert (table.back(*table.place(to)) == at).all()


def test_order_by_radix():
    rng = np.random.default_rng(1)
    for most in (1, 1 << 16, 1 << 20, 1 << 40):
        values = rng.integers(0, most, 5000)
        assert (values[packed._ascending(values)] == np.sort(values)).all()
    assert len(packed._ascending(np.zeros(0, np.int64))) == 0


def test_cells_of_copies_are_stored_as_words(spark, monkeypatch):
    """64 rows' cells in one row: what case mining stores and reads again is far less than the copies."""
    written, write = [], session._write

    def record(df, store):
        table = write(df, store)
        if {"pfi_var", "perm"} <= set(table.columns):
            written.append(table.count())
        return table

    monkeypatch.setattr(session, "_write", record)
    found = Q._cases(Q._rows(spark, SMALL), "misses")
    copies = spark.read.parquet(f"{SMALL}/lineitem.parquet").count() * len(Q.FEATURES) * Q.PERMS
    assert found.count() and max(written) * 32 < copies


def test_words_count_and_give_back_every_cell(spark):
    rng = np.random.default_rng(6)
    last = V.reliability_bins() * 4 - 1
    rows = [(k, p, i, None if i % 11 == 0 else int(rng.choice([0, 1, 2, 3, last, int(rng.integers(0, last))]))) for k in ("a", None) for p in (1, 2) for i in range(300)]
    cells = spark.createDataFrame(rows, "k string, perm int, row_no long, cell int")
    words = P.cell_words(cells.repartition(5), ["k", "perm"])
    want = {}
    for k, p, _, c in rows:
        if c is not None:
            want[k, p, c] = want.get((k, p, c), 0) + 1
    assert {(r["k"], r["perm"], r["cell"]): r["w"] for r in P.counts_of_words(words, ["k", "perm"]).collect()} == want
    for outcome in V.OUTCOMES:
        back = P.rows_of_words(words.select("k", "perm", "word", P.outcome_words(words, outcome).alias("bits")), "bits")
        assert sorted(map(repr, (tuple(r) for r in back.select("k", "perm", "row_no").collect()))) == sorted(repr(r[:3]) for r in rows if r[3] is not None and V.OUTCOMES[r[3] % 4] == outcome)
    with pytest.raises(Exception, match="must not repeat"):
        P.cell_words(cells.union(cells.limit(40)), ["k", "perm"]).collect()


def test_cases_from_words_equal_cases_from_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(k, f, p, i, int(rng.integers(0, 4))) for k in ("a", "b") for f in ("x", "y") for p in range(1, 7) for i in range(200)]
    cells = spark.createDataFrame(rows, "k string, pfi_var string, perm int, row_no long, cell int")
    bands = spark.createDataFrame([(k, f, p, m, b) for k in ("a", "b") for f in ("x", "y") for p in range(1, 7) for m in ("u", "v") for b in {(p + len(m + f)) % 3: "top", 4: "x"}.get((p * 7 + ord(m)) % 3, "bottom middle".split()[p % 2]).split()], "k string, pfi_var string, perm int, metric string, band string")
    outcome = F.get(F.array(*[F.lit(o) for o in V.OUTCOMES]), F.col("cell"))
    original = cells.where("pfi_var = 'x' and perm = 1").select("k", "row_no", F.get(F.array(*[F.lit(o) for o in V.OUTCOMES]), (F.col("row_no") % 4).cast("int")).alias("outcome"))
    for kind in P.CASE_KINDS:
        by_rows = P.permutation_cases(cells.withColumn("outcome", outcome), bands, original, ["k"], kind)
        by_words = P.permutation_cases(P.cell_words(cells, ["k", "pfi_var", "perm"]), bands, original, ["k"], kind)
        assert by_rows.columns == by_words.columns
        listed = [sorted(tuple(r) for r in d.collect()) for d in (by_rows, by_words)]
        assert listed[0] == listed[1] and listed[0]
