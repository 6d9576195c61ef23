"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks of bytes; each chunk's hash is a polynomial in its bytes modulo a
prime. The hash of two parts is H(x) + B^len(x) * H(y), so chunk hashes of one text can be
made anywhere, in any order, and combined by length-shifted sums. Rows with equal length and
fingerprints are then compared chunk by chunk; rows that differ after all are grouped by
their whole text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchscope.llm.common import arrow_map, attach, release
from patchscope.session import checkpointed

#: Two primes under 2**31 and a base for each (fixed values).
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 1 << 16
#: Texts longer than this (in characters) spread their chunks over tasks.
HUGE = 1 << 22
#: Rows and bytes of one group compared in one task, about; a share holds one row at least.
GROUP_ROWS, GROUP_BYTES = 128, 1 << 24
#: Chunks in one Arrow batch.
BATCH = 64


@lru_cache(maxsize=4)
def powers(which: int) -> np.ndarray:
    """base**i modulo the prime for every place in a chunk."""
    out, prime = np.ones(1, np.uint64), PRIMES[which]
    while len(out) < CHUNK:
        out = np.concatenate([out, out * np.uint64(pow(BASES[which], len(out), prime)) % np.uint64(prime)])
    return out[:CHUNK]


def chunk_hashes(data: bytes) -> tuple[int, int]:
    """Hashes of up to CHUNK bytes. A byte counts as itself plus one, so zero bytes count."""
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int((values * powers(k)[: len(values)]).sum() % np.uint64(p)) for k, p in enumerate(PRIMES))


def combine(left: tuple[int, ...], length: int, right: tuple[int, ...]) -> tuple[int, ...]:
    """Hashes of x + y from those of x, its length and those of y."""
    return tuple((a + pow(base, length, prime) * b) % prime for a, b, base, prime in zip(left, right, BASES, PRIMES))


def fingerprint(data: bytes) -> int:
    """Both hashes of a whole text in one number under 2**62."""
    total = (0, 0)
    for start in range(0, len(data), CHUNK):
        total = combine(total, start, chunk_hashes(data[start : start + CHUNK]))
    return total[0] << 31 | total[1]


def chunks(rows: DataFrame) -> DataFrame:
    """One row per chunk of ``__text``: the other columns, ``__no`` (from 0) and ``__part`` (bytes).

    A chunk is a view of the text's buffer, so cutting costs as much as the text is long. An
    empty text gives one empty chunk. ``__text`` must not be NULL.
    """
    others = [c for c in rows.columns if c != "__text"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)

    def run(batches):
        release()
        for batch in batches:
            rows_, numbers, parts = [], [], []

            def flush() -> pa.RecordBatch:
                columns = [batch.column(c).take(pa.array(rows_, pa.int64())) for c in others]
                out = pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], [*others, "__no", "__part"])
                for held in (rows_, numbers, parts):
                    held.clear()
                return out

            for i, text in enumerate(batch.column("__text")):
                data = text.as_buffer()
                for no in range(max(1, -(-len(data) // CHUNK))):
                    rows_.append(i)
                    numbers.append(no)
                    parts.append(data[no * CHUNK : (no + 1) * CHUNK].to_pybytes())
                    if len(rows_) == BATCH:
                        yield flush()
            if rows_:
                yield flush()

    return rows.mapInArrow(run, f"{schema}, __no int, __part binary")


def fingerprints(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, fp and text_sha256 of every row; NULL text counts as empty.

    Texts over ``huge`` characters go as chunk rows: their hashes are shifted by the bytes
    before them and summed per document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("__text"))

    def whole(batch: dict[str, list]) -> dict[str, list]:
        data = [t.encode() for t in batch["__text"]]
        return {"doc_id": batch["doc_id"], "n_bytes": list(map(len, data)), "fp": list(map(fingerprint, data)), "text_sha256": [hashlib.sha256(d).hexdigest() for d in data]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    short = arrow_map(rows.where(F.length("__text") <= huge), whole, f"doc_id {kind}, n_bytes long, fp long, text_sha256 string")
    # one row per repeated huge text is kept apart by its hash; equal rows fold and are unfolded by their count
    long = rows.where(F.length("__text") > huge).select("doc_id", "__text", F.sha2("__text", 256).alias("text_sha256"))
    cut = chunks(long).repartition("doc_id", "__no")

    def parts(batch: dict[str, list]) -> dict[str, list]:
        data = batch["__part"]
        return {"doc_id": batch["doc_id"], "text_sha256": batch["text_sha256"], "__no": batch["__no"], "__n": list(map(len, data)), "__fp": list(map(fingerprint, data))}

    hashed = arrow_map(cut, parts, f"doc_id {kind}, text_sha256 string, __no int, __n long, __fp long")
    # repeated rows give the same part several times
    hashed = hashed.groupBy("doc_id", "text_sha256", "__no", "__n", "__fp").agg(F.count("*").alias("__rows"))
    gathered = hashed.groupBy("doc_id", "text_sha256", "__rows").agg(F.sort_array(F.collect_list(F.struct("__no", "__n", "__fp"))).alias("__parts"))

    def join(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "fp": [], "text_sha256": []}
        for i, sha, rows_, parts_ in zip(batch["doc_id"], batch["text_sha256"], batch["__rows"], batch["__parts"]):
            total, length = (0, 0), 0
            for p in parts_:
                total = combine(total, length, (p["__fp"] >> 31, p["__fp"] & (1 << 31) - 1))
                length += p["__n"]
            for _ in range(rows_):
                for c, v in zip(out, (i, length, total[0] << 31 | total[1], sha)):
                    out[c].append(v)
        return out

    return short.unionByName(arrow_map(gathered, join, f"doc_id {kind}, n_bytes long, fp long, text_sha256 string"))


def unequal(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows (doc_id, fp, n_bytes) whose text differs from that of ``keep_id`` with the same fingerprint.

    ``marked``: doc_id, fp, n_bytes, keep_id, group_size of the rows in groups. Chunks of a
    group's members meet those of the row that stays; groups of many rows or bytes are split
    by a hash of the id, and the row that stays goes to every share.
    """
    shares = F.greatest(F.ceil(F.col("group_size") / GROUP_ROWS), F.ceil(F.col("group_size") * F.least("n_bytes", F.lit(CHUNK)) / GROUP_BYTES))
    keys = marked.select("doc_id", "fp", "n_bytes", "keep_id", shares.cast("int").alias("__shares")).distinct()
    text = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    rows = keys.join(text, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.octet_length("__text") == F.col("n_bytes")))
    rows = rows.select("doc_id", "fp", "n_bytes", "keep_id", "__shares", "__text")
    # all of a group have the same bytes, so they take the same way
    single = rows.where(F.col("n_bytes") <= CHUNK).withColumns({"__no": F.lit(0), "__part": F.col("__text").cast("binary")}).drop("__text")
    cut = single.unionByName(chunks(rows.where(F.col("n_bytes") > CHUNK)))
    mine = cut.where("doc_id < keep_id").withColumn("__share", F.pmod(F.xxhash64("doc_id"), F.col("__shares")).cast("int"))
    kept = cut.where("doc_id = keep_id").withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)))
    kept = kept.groupBy("keep_id", "fp", "n_bytes", "__no", "__share").agg(F.min("__part").alias("__kept"))  # repeated rows once
    met = mine.join(kept, ["keep_id", "fp", "n_bytes", "__no", "__share"], "left")
    return met.where(~F.col("__part").eqNullSafe(F.col("__kept"))).select("doc_id", "fp", "n_bytes").distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; NULL counts as empty. Of equal texts the row with the
    largest doc_id stays; group_size counts rows. Repeated rows (same id and text) count
    each, and all of them with the largest id are marked kept, since nothing tells them apart.
    A NULL id counts as the smallest; if all ids of a group are NULL, keep_id is NULL and kept
    true. An empty table gives no rows. Other columns are not read.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")
    made = checkpointed(fingerprints(ids))
    stats = made.groupBy("n_bytes", "fp").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = checkpointed(stats.where("group_size > 1"))
    marked = checkpointed(attach(made, groups, ["n_bytes", "fp"], "group_size", "doc_id"))
    differ = checkpointed(unequal(ids, marked.where("group_size > 1")))
    if differ.take(1):  # a collision: every row of such a group is grouped by its text instead
        bad = differ.select(F.col("fp").alias("__fp"), F.col("n_bytes").alias("__n")).distinct()
        on = (F.col("fp") == F.col("__fp")) & (F.col("n_bytes") == F.col("__n"))
        text = ids.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
        wrong = marked.join(bad, on, "left_semi").select("doc_id", "text_sha256").distinct()
        wrong = wrong.join(text, (F.col("doc_id") == F.col("__id")) & (F.col("text_sha256") == F.sha2("__text", 256)))
        by_text = wrong.groupBy("__text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        mended = wrong.join(by_text, "__text").select("doc_id", "keep_id", "group_size", "text_sha256")
        right = marked.join(bad, on, "left_anti").select("doc_id", "keep_id", "group_size", "text_sha256")
        marked = right.unionByName(mended)
    keep = F.coalesce("keep_id", "doc_id")
    null = lambda c: F.when(c != -(2**63), c)
    return marked.select(
        null(F.col("doc_id")).alias("doc_id"), null(keep).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id") == keep).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text; of repeated rows one stays, also when other columns differ."""
    kept = exact_groups(docs.select("doc_id", "text")).where("kept")
    kept = kept.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__sha": F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)})
    rows = rows.join(kept, ["__id", "__sha"], "left_semi")
    return rows.dropDuplicates(["__id", "__sha"]).select(*docs.columns)  # the partitioning of the join serves


SQL = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
