"""Integer mixing, draws and permutations from it: compiled by Spark, and any SQL engine can repeat them.

All steps are products of numbers below 2**31, modulo the prime 2**31 - 1, so nothing overflows
64 bits. A value that later steps use more than once is a column of its own: stacked
projections stay stacked, while one nested expression would be copied again in each step.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
SQUARE, ADD, SPREAD, OTHER = 48271, 1013904223, 69621, 40692
#: Row and column steps of a permutation.
ROUNDS = 4


def _mod(value: Column, n) -> Column:
    return value % (n if isinstance(n, Column) else F.lit(n).cast("bigint"))


def mix(t: Column) -> Column:
    """Scrambles a number in [0, PRIME)."""
    return _mod(_mod(t * t, PRIME) * SQUARE + ADD, PRIME)


def text_seed(*parts) -> int:
    """A number in [0, PRIME) that depends on the parts only."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16) % PRIME


def combined(seed: Column, number: Column) -> Column:
    """A seed for each number."""
    return mix(_mod(mix(seed) + _mod(number, PRIME) * SPREAD, PRIME))


def _keyed(seed: Column, turn: int, value: Column, factor: int = SPREAD) -> Column:
    return mix(mix(_mod(value * factor + seed + turn * OTHER, PRIME)))


def with_draw(df: DataFrame, slot: str, seed: str, n: str, out: str) -> DataFrame:
    """Adds a number below ``n`` that depends on the seed and the slot, from 62 mixed bits."""
    slots = _mod(F.col(slot), PRIME)
    df = df.withColumns({"__high": _keyed(F.col(seed), 1, slots), "__low": _keyed(F.col(seed), 2, slots, OTHER)})
    return df.withColumn(out, _mod(F.col("__high") * (1 << 31) + F.col("__low"), F.col(n))).drop("__high", "__low")


def with_grid(df: DataFrame, n: str) -> DataFrame:
    """Adds the nearly square grid of 0..n-1: ``__wide``, ``__high`` and ``__last`` (cells of the last row). For one row a key."""
    df = df.withColumn("__wide", F.floor(F.sqrt(F.col(n).cast("double"))) + 1)
    df = df.withColumn("__high", F.expr(f"({n} + __wide - 1) div __wide"))
    return df.withColumn("__last", F.col(n) - (F.col("__high") - 1) * F.col("__wide"))


def with_permutation(df: DataFrame, position: str, seed: str, out: str) -> DataFrame:
    """Adds a bijection of 0..n-1 applied to ``position``, one for each seed; needs the columns of ``with_grid``.

    The numbers lie row by row in a grid whose last row may be short. In turn each row is
    rotated by an amount mixed from its number, then each column by one mixed from its own.
    Every step permutes all cells, whatever n is, so no rank, sort or retry is needed.
    """
    df = df.withColumns({"__x0": F.col(position) % F.col("__wide"), "__y0": F.expr(f"{position} div __wide")})
    for turn in range(ROUNDS):
        x, y, s = F.col(f"__x{turn}"), F.col(f"__y{turn}"), F.col(seed)
        cells = F.when(y == F.col("__high") - 1, F.col("__last")).otherwise(F.col("__wide"))
        df = df.withColumn(f"__x{turn + 1}", _mod(x + _keyed(s, 2 * turn, y), cells))
        x = F.col(f"__x{turn + 1}")
        cells = F.when(x < F.col("__last"), F.col("__high")).otherwise(F.col("__high") - 1)
        df = df.withColumn(f"__y{turn + 1}", _mod(y + _keyed(s, 2 * turn + 1, x), cells))
    df = with_closed(df, out, F.col(f"__y{ROUNDS}") * F.col("__wide") + F.col(f"__x{ROUNDS}"))
    return df.drop(*[f"__{c}{t}" for c in "xy" for t in range(ROUNDS + 1)])


def with_inverse(df: DataFrame, position: str, seed: str, out: str) -> DataFrame:
    """Adds the number that ``with_permutation`` sends to ``position``; needs the columns of ``with_grid``."""
    df = df.withColumns({f"__x{ROUNDS}": F.col(position) % F.col("__wide"), f"__y{ROUNDS}": F.expr(f"{position} div __wide")})
    for turn in reversed(range(ROUNDS)):
        x, y, s = F.col(f"__x{turn + 1}"), F.col(f"__y{turn + 1}"), F.col(seed)
        cells = F.when(x < F.col("__last"), F.col("__high")).otherwise(F.col("__high") - 1)
        df = df.withColumn(f"__y{turn}", F.pmod(y - _keyed(s, 2 * turn + 1, x), cells))
        y = F.col(f"__y{turn}")
        cells = F.when(y == F.col("__high") - 1, F.col("__last")).otherwise(F.col("__wide"))
        df = df.withColumn(f"__x{turn}", F.pmod(x - _keyed(s, 2 * turn, y), cells))
    df = with_closed(df, out, F.col("__y0") * F.col("__wide") + F.col("__x0"))
    return df.drop(*[f"__{c}{t}" for c in "xy" for t in range(ROUNDS + 1)])


def with_closed(df: DataFrame, out: str, value: Column) -> DataFrame:
    """Adds the last of many stacked steps so that no later filter is rewritten in terms of the first.

    The optimizer pushes filters through projections by copying expressions, which doubles and
    redoubles steps that use a value twice; it does not push them through an explode.
    """
    return df.select("*", F.explode(F.array(value)).alias(out))


# --- the same on numpy arrays of int64 -----------------------------------------------------


def _folded(t: np.ndarray) -> np.ndarray:
    """Congruent to t below 2**62 modulo PRIME, and at most PRIME + 1."""
    t = (t & PRIME) + (t >> 31)
    return (t & PRIME) + (t >> 31)


def _mixed(t: np.ndarray) -> np.ndarray:
    t = _folded(_folded(t * t) * SQUARE + ADD)
    return t - PRIME * (t >= PRIME)


def combined_array(seed: np.ndarray, number: int) -> np.ndarray:
    """``combined`` on an array of seeds."""
    return _mixed(_folded(_mixed(seed) + number % PRIME * SPREAD))


def _turned(seed: np.ndarray, turn: int, value: np.ndarray, factor: int = SPREAD) -> np.ndarray:
    return _mixed(_mixed(_folded(value * factor + seed + turn * OTHER)))


def draw_array(slots: np.ndarray, seed: int, n: int) -> np.ndarray:
    """``with_draw`` on an array of slots."""
    slots = slots % PRIME
    return ((_turned(seed, 1, slots) << 31) + _turned(seed, 2, slots, OTHER)) % n


def permuted_array(position: np.ndarray, seed: np.ndarray, wide: np.ndarray, high: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``with_permutation`` on arrays."""
    x, y = position % wide, position // wide
    for turn in range(ROUNDS):
        x = (x + _turned(seed, 2 * turn, y)) % np.where(y == high - 1, last, wide)
        y = (y + _turned(seed, 2 * turn + 1, x)) % np.where(x < last, high, high - 1)
    return y * wide + x


def unpermuted_array(position: np.ndarray, seed: np.ndarray, wide: np.ndarray, high: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``with_inverse`` on arrays."""
    x, y = position % wide, position // wide
    for turn in reversed(range(ROUNDS)):
        y = (y - _turned(seed, 2 * turn + 1, x)) % np.where(x < last, high, high - 1)
        x = (x - _turned(seed, 2 * turn, y)) % np.where(y == high - 1, last, wide)
    return y * wide + x


class Rotations:
    """The permutation of one seed on a grid as tables: how far a row or column turns depends on its number only, so many positions share few mixes.

    Columns and rows are unsigned 32-bit numbers below 2**31. Of a sum and the same less its modulus
    the smaller one is meant, as what would be negative wraps round to a large number.
    """

    def __init__(self, seed: int, wide: int, high: int, last: int):
        rows, columns = np.arange(high), np.arange(wide)
        cells = [np.where(rows == high - 1, last, wide), np.maximum(np.where(columns < last, high, high - 1), 1)]
        tables = [[_turned(seed, 2 * turn + k, (rows, columns)[k]) % cells[k] for turn in range(ROUNDS)] for k in (0, 1)]
        self.cells = [c.astype(np.uint32) for c in cells]
        self.turns = [*zip(*([t.astype(np.uint32) for t in k] for k in tables))]
        self.wide = wide

    def place(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and rows of positions."""
        y, x = np.divmod(position, self.wide)
        return x.astype(np.uint32), y.astype(np.uint32)

    def there(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``permuted_array`` of the positions in columns x of rows y."""
        for across, down in self.turns:
            x = x + across.take(y)
            x = np.minimum(x, x - self.cells[0].take(y))
            y = y + down.take(x)
            y = np.minimum(y, y - self.cells[1].take(x))
        return y.astype(np.int64) * self.wide + x

    def back(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``unpermuted_array`` of the positions in columns x of rows y."""
        for across, down in reversed(self.turns):
            y = y - down.take(x)
            y = np.minimum(y, y + self.cells[1].take(x))
            x = x - across.take(y)
            x = np.minimum(x, x + self.cells[0].take(y))
        return y.astype(np.int64) * self.wide + x
