"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("patchscope")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # hash instead of sort where every measured partition of one side is small
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only on a local session without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="patchscope-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Store:
    """Tables that one computation stores. See :func:`stored_tables`."""

    def __init__(self, outer: Store | None):
        self.outer = outer
        self.tables: dict[str, DataFrame] = {}

    def _path(self, table: DataFrame) -> str | None:
        return next((path for path, own in self.tables.items() if own is table), None)

    def drop(self, table: DataFrame) -> None:
        """Delete a table stored here that nothing will read again: a round once the next one is written."""
        path = self._path(table)
        if path is not None:
            del self.tables[path]
            delete_folder(table.sparkSession, path)

    def hand_out(self, result: DataFrame) -> DataFrame:
        """The result as a table of the enclosing store, or without one of the caller; written unless it is a table of this store."""
        path = self._path(result)
        if path is None:
            return _write(result, self.outer)
        del self.tables[path]
        if self.outer is not None:
            self.outer.tables[path] = result
        return result

    def release(self) -> None:
        for path, table in self.tables.items():
            delete_folder(table.sparkSession, path)
        self.tables.clear()


_store: ContextVar[Store | None] = ContextVar("store", default=None)


@contextmanager
def stored_tables() -> Iterator[Store]:
    """Owns every table that :func:`checkpointed` stores inside, and deletes them at the end.

    What is returned from inside must not read them any more, so it goes through ``hand_out``.
    Stores nest; a failure releases the tables as well.
    """
    store = Store(_store.get())
    token = _store.set(store)
    try:
        yield store
    finally:
        _store.reset(token)
        store.release()


def _write(df: DataFrame, store: Store | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if store is not None:
        store.tables[path] = table
    return table


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared checkpoint folder and drop its lineage.

    One job writes it, later reads survive lost executors, and its file sizes give the
    planner true statistics. Inside :func:`stored_tables` the table is deleted with the rest.
    """
    return _write(df, _store.get())
