"""Centroid clustering in integers, filtered in a rotated space.

Vectors are rotated onto their principal axes. Kept are the leading coordinates and the norm
of the rest. For a vector x and a centroid c, |x - c|^2 is at least the squared distance of
the leading coordinates plus (|rest of x| - |rest of c|)^2, because the rotation keeps
lengths and two vectors of given norms are nearest when they point the same way. Centroids
whose bound lies above an exact distance already found are skipped, the others are compared
in integers. The rotation only steers the work: any orthonormal basis gives the same result.

A round is one pass of tasks over a stored table; each task returns a sum per cluster, so the
shuffle and the driver hold clusters, never vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchscope.llm.common import release
from patchscope.session import checkpointed

DIMS, CLUSTERS, ROUNDS, SCALE, LEAD = 64, 16, 3, 64, 16
#: Integers from here on could overflow a squared distance in 64 bits.
LIMIT = 1 << 26
#: Rounding of the bound, as a share of the squared norms; doubles are good to 1e-15.
SLACK = 1e-10


def quantised(vectors: DataFrame, id_column: str, vector: str, dims: int, scale: float) -> DataFrame:
    """vec_id and q (floor of scale times each component) of the vectors with ``dims`` finite components."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    small = F.forall(vector, lambda x: F.abs(x.cast("double") * F.lit(float(scale))) < LIMIT)
    whole = vectors.where((F.size(vector) == dims) & F.coalesce(finite, F.lit(False)))
    q = F.when(small, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"components must lie below {LIMIT} after scaling")))
    return whole.select(F.col(id_column).alias("vec_id"), q.alias("q"))


def matrix(batch: pa.RecordBatch, column: str, dims: int, kind) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def added(parts: DataFrame, key: str, values: str, dims: int) -> dict[int, list]:
    """Elementwise sums of the arrays of each key; as many rows as keys reach the driver."""
    rows = parts.groupBy(key).agg(*[F.sum(F.col(values)[i]).alias(f"s{i}") for i in range(dims)]).collect()
    return {r[key]: [r[f"s{i}"] for i in range(dims)] for r in rows}


def axes(q: DataFrame, dims: int) -> np.ndarray:
    """Principal axes of all vectors, strongest first, as columns. One pass; each task returns ``dims`` + 1 rows."""

    def run(batches):
        products, total, n = np.zeros((dims, dims)), np.zeros(dims), 0
        for batch in batches:
            x = matrix(batch, "q", dims, np.float64)
            products, total, n = products + x.T @ x, total + x.sum(axis=0), n + len(x)
        rows = np.concatenate([products, total[None]])
        values = pa.array([[float(n), *r] for r in rows.tolist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), values], ["i", "values"])

    sums = added(q.select("q").mapInArrow(run, "i int, values array<double>"), "i", "values", dims + 1)
    if not sums or not sums[0][0]:
        return np.eye(dims)
    n, mean = sums[0][0], np.array(sums[dims][1:]) / sums[0][0]
    spread = np.array([sums[i][1:] for i in range(dims)]) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh((spread + spread.T) / 2)
    return vectors[:, np.argsort(-values, kind="stable")]


def rotated(x: np.ndarray, basis: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates, and the norm of the others."""
    turned = x.astype(np.float64) @ basis
    return turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(axis=1))


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each row (ties: the smaller number), and how many exact distances were worked out."""
    c_lead, c_rest = rotated(centroids, basis, lead.shape[1])
    own, theirs = (lead**2).sum(axis=1), (c_lead**2).sum(axis=1)
    bound = own[:, None] - 2 * lead @ c_lead.T + theirs + (rest[:, None] - c_rest) ** 2
    bound -= SLACK * ((own + rest**2)[:, None] + (theirs + c_rest**2)) + SLACK
    label = bound.argmin(axis=1)
    distance = ((q - centroids[label]) ** 2).sum(axis=1)
    done = len(q)
    first = label.copy()
    for k in range(len(centroids)):
        rows = np.flatnonzero((bound[:, k] <= distance) & (first != k))
        done += len(rows)
        found = ((q[rows] - centroids[k]) ** 2).sum(axis=1)
        better = (found < distance[rows]) | ((found == distance[rows]) & (k < label[rows]))
        distance[rows[better]], label[rows[better]] = found[better], k
    return label, distance, done


def kmeans(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dims: int = DIMS, clusters: int = CLUSTERS,
    rounds: int = ROUNDS, scale: float = SCALE, lead: int = LEAD, seed: int = 1,
) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance), stored, and the final centroids.

    Vectors with another number of components, or a NULL or non-finite one, are not kept.
    Centroids start as the vectors with the smallest sha256 of ``seed:id`` (a NULL id counts
    as empty text; equal ids go by their components); with fewer vectors there are fewer
    centroids, with none no rows. A round moves each centroid that has vectors to the floor of
    their mean. Repeated rows each count. A component of 2**26 or more after scaling fails,
    as distances could overflow.
    """
    q = quantised(vectors, id_column, vector, dims, scale)
    token = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = q.orderBy(token, "q").limit(clusters).collect()
    centroids = np.array([r["q"] for r in start], np.int64).reshape(-1, dims)
    basis = axes(q, dims)

    def store(batches):
        release()
        for batch in batches:
            coordinates, rest = rotated(matrix(batch, "q", dims, np.float64), basis, lead)
            offsets = pa.array(np.arange(0, coordinates.size + 1, lead), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("q"), pa.ListArray.from_arrays(offsets, pa.array(coordinates.ravel())), pa.array(rest)], ["vec_id", "q", "lead", "rest"])

    kind = q.schema["vec_id"].dataType.simpleString()
    table = checkpointed(q.mapInArrow(store, f"vec_id {kind}, q array<int>, lead array<double>, rest double"))

    def assign(batch, centroids):
        x = matrix(batch, "q", dims, np.int64)
        return x, *nearest(x, matrix(batch, "lead", lead, np.float64), batch.column("rest").to_numpy(), centroids, basis)[:2]

    for _ in range(rounds if len(centroids) else 0):
        def sums(batches, centroids=centroids):
            total = np.zeros((len(centroids), dims + 1), np.int64)
            for batch in batches:
                x, label, _ = assign(batch, centroids)
                np.add.at(total, label, np.c_[np.ones(len(x), np.int64), x])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

        found = added(table.select("q", "lead", "rest").mapInArrow(sums, "cluster int, sums array<long>"), "cluster", "sums", dims + 1)
        moved = [[s // found[k][0] for s in found[k][1:]] if found[k][0] else c for k, c in enumerate(centroids.tolist())]
        centroids = np.array(moved, np.int64)

    def label(batches):
        for batch in batches:
            if len(batch):
                _, own, distance = assign(batch, centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return checkpointed(table.mapInArrow(label, f"vec_id {kind}, cluster int, distance long")), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. See ``kmeans``."""
    spark = vectors.sparkSession
    assigned, centroids = kmeans(vectors, **options)
    inertia = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    total = sum(inertia.values())
    if total >= 1 << 63:
        raise OverflowError("the inertia does not fit in 64 bits")
    rows = [(k, inertia.get(k, 0), total, centroid_digest(c)) for k, c in enumerate(centroids)]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same clusters in plain SQL, without the filter."""
    near = """a{0} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(q) AS q, min(d * 16 + k) AS best FROM (
  SELECT v.rid, v.vec_id, v.q, c.k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.c[i]) * (v.q[i] - c.c[i]))) AS BIGINT) AS d FROM v, c{0} c) GROUP BY rid)"""
    move = """m{0} AS (SELECT best % 16 AS k, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM a{0}, range(1, 65) t(i) GROUP BY ALL),
c{1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{0} c LEFT JOIN (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{0} GROUP BY k) m USING (k))"""
    rounds = ",\n".join(f"{near.format(i)},\n{move.format(i, i + 1)}" for i in range(ROUNDS))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS k, q AS c FROM v QUALIFY k < 16),
{rounds},
{near.format(ROUNDS)}
SELECT vec_id, CAST(best % 16 AS INT) AS cluster, best // 16 AS distance, CAST(sum(best // 16) OVER (PARTITION BY best % 16) AS BIGINT) AS cluster_inertia,
  CAST(sum(best // 16) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = best % 16"""


SQL = _sql()
