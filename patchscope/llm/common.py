"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchscope.session import checkpointed

#: One key in HOT_SHARE rows counts as hot, so at most HOT_SHARE keys are, whatever the input.
HOT_SHARE = 1000
SALTS = 4096
#: Rows of whole texts that a Python worker handles and gives out at a time.
SLICE_ROWS = 512


class Recent:
    """Bounded memo of a function: two generations, the older one goes when the newer is full.

    ``fill`` takes a list of new keys and returns their values, so that a batch of misses
    can be worked out together.
    """

    def __init__(self, fill: Callable[[list], list], limit: int = 400_000):
        self.fill, self.limit = fill, limit
        self.new: dict = {}
        self.old: dict = {}

    def look_up(self, keys: list) -> list:
        """The values of ``keys``, in order."""
        try:
            return [self.new[k] for k in keys]
        except KeyError:
            pass
        new, old = self.new, self.old
        if len(new) >= self.limit:
            self.old, self.new = new, {}
            new, old = self.new, self.old
        missing = []
        for k in dict.fromkeys(keys):
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    missing.append(k)
        if missing:
            new.update(zip(missing, self.fill(missing)))
        return [new[k] for k in keys]


    def hold(self, keys: list) -> list:
        """The values of ``keys``, which are distinct already, in order."""
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        out = list(map(self.new.get, keys))
        missing = [i for i, v in enumerate(out) if v is None]
        lacking = []
        for i in missing:
            out[i] = self.old.get(keys[i])
            if out[i] is None:
                lacking.append(i)
        for i, v in zip(lacking, self.fill([keys[i] for i in lacking]) if lacking else ()):
            out[i] = v
        self.new.update((keys[i], out[i]) for i in missing)
        return out


_state: list = [None, None]


def worker_state(key: tuple, build: Callable[[], object]):
    """What a Python worker keeps between tasks. One thing only: building another drops it, as workers serve all stages."""
    if _state[0] != key:
        release()
        _state[:] = [key, build()]
    return _state[1]


def release() -> None:
    """Drop what the worker keeps, and give the memory back to the system: an executor counts what its idle allocators hold."""
    _state[:] = [None, None]
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that what is made from whole texts stays small; an empty batch stays."""
    for batch in batches:
        for start in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(start, rows)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows no model learns from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def arrow_map(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``function`` to the columns of each Arrow batch, as Python lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            out = function({name: batch.column(name).to_pylist() for name in batch.schema.names})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def attach(rows: DataFrame, stats: DataFrame, keys: list[str], count: str, salt: str) -> DataFrame:
    """Left join of a table with one row per key onto rows among which keys may be hot.

    ``stats`` is a stored table whose ``count`` is the number of ``rows`` with the key. Keys
    that hold one row in HOT_SHARE or more are broadcast; there are at most HOT_SHARE of
    them. Their rows are spread over the join by a hash of the column ``salt``.
    Keys must not be NULL.
    """
    values = [c for c in stats.columns if c not in keys]
    total = stats.agg(F.sum(count)).first()[0] or 0
    hot = stats.where(F.col(count) * HOT_SHARE >= total).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*values).alias("__hot"))
    cold = stats.where(F.col(count) * HOT_SHARE < total).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.lit(-1).alias("__salt"), F.struct(*values).alias("__cold"))
    same = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    left = rows.join(F.broadcast(hot), same, "left").drop(*[f"__k_{k}" for k in keys])
    left = left.withColumn("__row_salt", F.when(F.col("__hot").isNull(), -1).otherwise(F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")))
    out = left.join(cold, [*same, F.col("__row_salt") == F.col("__salt")], "left")
    found = F.coalesce("__hot", "__cold")
    return out.select(*rows.columns, *[found[c].alias(c) for c in values])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, label), for each node that has a link.

    Randomised contraction: in each round every node moves to the neighbour, or itself, that
    comes first in a fresh hash order, and the links are redrawn between the targets. Links
    shrink by a constant factor a round, also on chains and stars. The label is a member of
    the component. Every round is a written table, so lost executors repeat one round only.
    """
    graph = checkpointed(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while graph.take(1):
        order = lambda c: F.xxhash64(F.col(c), F.lit(len(moves)))
        both = graph.union(graph.select("b", "a"))
        best = both.groupBy("a").agg(F.min_by("b", order("b")).alias("b"))
        move = checkpointed(best.select(F.col("a").alias("node"), F.when(order("b") < order("a"), F.col("b")).otherwise(F.col("a")).alias("label")))
        moves.append(move)
        left, right = move.toDF("a", "la"), move.toDF("b", "lb")
        moved = graph.join(left, "a").join(right, "b").where("la != lb")
        graph = checkpointed(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    if not moves:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = moves[0]
    for move in moves[1:]:
        out = out.join(move.toDF("label", "__next"), "label", "left").select("node", F.coalesce("__next", "label").alias("label"))
    return out
