"""Centroid clustering over zone maps on a space-filling curve (operator 13).

Vectors are turned into integers, so that sums, means and distances are exact and every plan gives
the same clusters. They are projected to the span of the first centroids and ordered along a Hilbert
curve, range-partitioned, and cut into blocks of ``block_rows`` neighbours on the curve. A block keeps
its box (the least and largest value of each component) beside its vectors. In each round the boxes are
compared first: for a box the least value of ``d(x, b) - d(x, a)``, squared distances to two centroids,
is linear in x and so taken at a corner; centroid b drops out of the block when it is positive, as every
vector there is then nearer to a. The vectors are compared exactly with the block's candidates only; a
block with one candidate left is assigned without a distance.

A round is one pass over the blocks; a task returns a sum and a count for each centroid and component,
whatever it holds, so the driver sees ``k * (width + 1)`` rows. The blocks are written once to the folder
of ``spark.checkpoint.dir``; losing an executor costs the tasks that ran there.

Defined cases: a vector that is null, of another length, or with a null or non-finite component takes no
part, nor one with a component that is no 64-bit integer after scaling; a null id counts as empty text in
the start order and is kept; repeated rows are vectors of their own; fewer vectors than ``k`` give as many
centroids as vectors; an empty table gives an empty result; a distance or sum beyond 64 bits is null; other
columns are not read. The length of a vector is bounded by ``width``; there are no texts here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import hilbert_keys
from .store import settle
from .words import tidy

BLOCK_ROWS = 64
CURVE_BITS = 7
CURVE_DIMS = 8
_EXACT = 1 << 22  # integers below this: squared distances and box bounds are exact in doubles
_LONG = (1 << 63) - 1


def scaled(df: DataFrame, id: str, vector: str, width: int, scale: int) -> DataFrame:
    """Vectors that take part: ``id`` and ``v``, the integers ``floor(scale * x)``."""
    v = F.col(vector).cast("array<double>")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < float(1 << 63)))
    return (df.select(F.col(id).alias("id"), v.alias("v")).where((F.size("v") == width) & fits)
            .select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v")))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of least SHA-256 of ``seed:id``; equal ones in order of their components."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    return [r["v"] for r in rows.select(F.sha2(text, 256).alias("hash"), "v").orderBy("hash", "v").limit(k).collect()]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


@dataclass
class Curve:
    """Projection to the span of some centroids, and each direction's mean and spread over all vectors."""

    frame: np.ndarray
    low: np.ndarray
    span: np.ndarray

    @staticmethod
    def fit(rows: DataFrame, centroids: np.ndarray) -> Curve:
        width = centroids.shape[1]
        apart = (centroids[1:] - centroids[0]).T.astype(np.float64)
        other = np.random.default_rng(0).normal(size=(width, max(0, min(CURVE_DIMS, width) - apart.shape[1])))
        frame = np.linalg.qr(np.column_stack([apart, other * (np.abs(apart).max(initial=1.0) * 1e-3)]))[0][:, :CURVE_DIMS]
        dims = frame.shape[1]

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, square = 0, np.zeros(dims), np.zeros(dims)
            for batch in batches:
                at = _matrix(batch.column(0), width).astype(np.float64) @ frame
                n, total, square = n + len(at), total + at.sum(axis=0), square + (at * at).sum(axis=0)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(total), pa.array(square)], names=["at", "n", "total", "square"])

        found = (rows.select("v").mapInArrow(tidy(moments), "at long, n long, total double, square double")
                 .groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "total", "square")]).orderBy("at").toPandas())  # a row a direction
        mean = (found["total"] / found["n"]).to_numpy()
        spread = np.sqrt(np.maximum((found["square"] / found["n"]).to_numpy() - mean * mean, 0))
        spread = np.where(spread > 0, spread, 1.0)
        return Curve(frame, mean - 3 * spread, 6 * spread)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        cells = 1 << CURVE_BITS
        at = (vectors.astype(np.float64) @ self.frame - self.low) / self.span
        return hilbert_keys(np.clip((at * cells).astype(np.int64), 0, cells - 1), CURVE_BITS)


def blocks_on_curve(rows: DataFrame, curve: Curve, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each block of neighbours on the curve: ``ids``, ``vectors`` (64-bit integers), and its box ``low``, ``high``.

    Equal keys are dealt out by a seeded draw, so copies of one vector fill as many blocks as they need.
    """
    ids = rows.schema["id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve.keys(_matrix(batch.column(1), width)))], names=["id", "v", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), width).astype(np.int64)
            starts = np.arange(0, len(v), block_rows)
            ends = np.append(starts[1:], len(v))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(np.append(starts, len(v)).astype(np.int32)), batch.column(0)),
                 pa.array([v[a:z].tobytes() for a, z in zip(starts, ends)], pa.binary()),
                 pa.array(list(np.minimum.reduceat(v, starts)), pa.list_(pa.int64())),
                 pa.array(list(np.maximum.reduceat(v, starts)), pa.list_(pa.int64()))], names=["ids", "vectors", "low", "high"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (rows.mapInArrow(tidy(keyed), f"id {ids}, v array<bigint>, key bigint").withColumn("draw", F.rand(7))
               .repartitionByRange(parts, "key", "draw").sortWithinPartitions("key", "draw").select("id", "v"))
    return settle(ordered.mapInArrow(tidy(cut), f"ids array<{ids}>, vectors binary, low array<bigint>, high array<bigint>"), "zones")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each box (row) which centroids may be nearest to some point of it; exact for integers below 2**22.

    A centroid drops out if another is nearer all over the box, or as near and of smaller number.
    """
    c = centroids.astype(np.float64)
    square = (c * c).sum(axis=1)
    out = np.ones((len(low), len(c)), dtype=bool)
    for a in range(len(c)):
        slope = -2.0 * (c - c[a])  # of d(x, b) - d(x, a) for every b
        least = low @ np.maximum(slope, 0).T + high @ np.minimum(slope, 0).T + (square - square[a])
        behind = np.arange(len(c)) > a
        out &= ~((least > 0) | ((least == 0) & behind))
    return out


def _exact(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance in Python integers, for components of any size."""
    near, far = [], []
    for v in vectors.tolist():
        d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids.tolist()]
        near.append(d.index(min(d)))
        far.append(min(d))
    return np.array(near, dtype=np.int64), np.array(far, dtype=object)


def assign_blocks(batch: pa.RecordBatch, centroids: np.ndarray, distances: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
    """Vectors of a batch of blocks, their clusters, their squared distances if wanted, and how many pairs were compared."""
    width = centroids.shape[1]
    low, high = (_matrix(batch.column(name), width) for name in ("low", "high"))
    sizes = pa.compute.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)
    vectors = np.frombuffer(b"".join(batch.column("vectors").to_pylist()), dtype=np.int64).reshape(-1, width)
    cluster = np.zeros(len(vectors), dtype=np.int64)
    if max(np.abs(centroids).max(), low.max(initial=0), -low.min(initial=0), high.max(initial=0), -high.min(initial=0)) >= _EXACT:
        cluster, far = _exact(vectors, centroids)
        return vectors, cluster, far, len(vectors) * len(centroids)
    may = candidates(low.astype(np.float64), high.astype(np.float64), centroids)
    pattern = np.repeat(may @ (1 << np.arange(len(centroids), dtype=object)).astype(object), sizes)
    c = centroids.astype(np.float64)
    square = (c * c).sum(axis=1)
    far = np.zeros(len(vectors), dtype=np.int64) if distances else None
    compared = 0
    for p in set(pattern.tolist()):
        own = np.array([b for b in range(len(c)) if p >> b & 1])
        at = np.flatnonzero(pattern == p)
        if len(own) == 1 and not distances:
            cluster[at] = own[0]
            continue
        v = vectors[at].astype(np.float64)
        d = square[own] - 2.0 * (v @ c[own].T)
        best = d.argmin(axis=1)
        cluster[at] = own[best]
        compared += d.size
        if distances:
            far[at] = (d[np.arange(len(at)), best] + (v * v).sum(axis=1)).astype(np.int64)
    return vectors, cluster, far, compared


def _sums(blocks: DataFrame, centroids: np.ndarray, distances: bool) -> dict[tuple[int, int], int]:
    """One pass: for each cluster the componentwise sums (at 0, 1, ...), the count (-1), and distances or pairs compared (-2, -3)."""
    k, width = centroids.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, far, pairs = np.zeros((k, width), dtype=object), np.zeros(k, dtype=object), [0] * k, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, cluster, d, compared = assign_blocks(batch, centroids, distances)
            pairs += compared
            for b in np.unique(cluster):
                own = cluster == b
                part = vectors[own]
                small = np.abs(part).max() < (1 << 40)
                total[b] += (part if small else part.astype(object)).sum(axis=0)
                n[b] += int(own.sum())
                if distances:
                    far[b] += int(d[own].astype(object).sum())
        rows = [(b, i, int(x)) for b in range(k) if n[b] for i, x in enumerate(total[b])]
        rows += [(b, -1, int(n[b])) for b in range(k) if n[b]] + [(b, -2, far[b]) for b in range(k) if n[b]] + [(0, -3, pairs)]
        if n.sum():
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([Decimal(r[2]) if abs(r[2]) < 10 ** 37 else None for r in rows], pa.decimal128(38, 0))], names=["cluster", "at", "total"])

    found = blocks.mapInArrow(tidy(task), "cluster int, at int, total decimal(38,0)").groupBy("cluster", "at").agg(
        F.sum("total").alias("total"), F.bool_or(F.col("total").isNull()).alias("beyond"))
    return {(r["cluster"], r["at"]): None if r["beyond"] else int(r["total"]) for r in found.collect()}  # k * (width + 3) rows


@dataclass
class Clusters:
    """Centroids, and for each the number and the summed squared distance of its vectors (null beyond 64 bits)."""

    centroids: np.ndarray
    sizes: list[int]
    inertias: list[int | None]
    compared: float  # share of all pairs of vector and centroid that were compared, over all passes

    @property
    def inertia(self) -> int | None:
        return None if None in self.inertias or sum(self.inertias) > _LONG else sum(self.inertias)

    def digest(self, cluster: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[cluster].tolist())).encode()).hexdigest()


def fit(blocks: DataFrame, centroids: np.ndarray, rounds: int) -> Clusters:
    """Lloyd's rounds over the blocks with exact integer means, then the sums of the last assignment."""
    k, width = centroids.shape
    pairs = vectors = 0
    for _ in range(rounds):
        sums = _sums(blocks, centroids, False)
        pairs, vectors = pairs + sums.pop((0, -3), 0), vectors + sum(sums.get((b, -1), 0) for b in range(k))
        means = [[sums[b, i] // sums[b, -1] for i in range(width)] if sums.get((b, -1)) else centroids[b].tolist() for b in range(k)]
        centroids = np.array(means, dtype=np.int64)
    last = _sums(blocks, centroids, True)
    inertias = [last.get((b, -2), 0) for b in range(k)]
    return Clusters(centroids, [last.get((b, -1), 0) for b in range(k)], [x if x is not None and x <= _LONG else None for x in inertias],
                    pairs / (vectors * k) if vectors else 0.0)


def cluster_vectors(df: DataFrame, id: str, vector: str, width: int, scale: int = 1024, k: int = 8, rounds: int = 10,
                    seed: int = 3, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Clusters | None]:
    """Each vector's ``id``, ``cluster`` and squared ``distance``, and the clusters; none without vectors."""
    rows = scaled(df, id, vector, width, scale)
    start = first_centroids(rows, k, seed)
    ids = rows.schema["id"].dataType.simpleString()
    schema = f"id {ids}, cluster int, distance bigint"
    if not start:
        return df.sparkSession.createDataFrame([], schema), None
    start = np.array(start, dtype=np.int64)
    blocks = blocks_on_curve(rows, Curve.fit(rows, start), width, block_rows)
    found = fit(blocks, start, rounds)
    centroids = found.centroids

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, cluster, far, _ = assign_blocks(batch, centroids, True)
                far = pa.array(far) if far.dtype != object else pa.array([int(d) if d <= _LONG else None for d in far], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("ids").flatten(), pa.array(cluster.astype(np.int32)), far], names=["id", "cluster", "distance"])

    return blocks.mapInArrow(tidy(assigned), schema), found


def cluster_embeddings(df: DataFrame, width: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """Clusters of ``embeddings`` with the inertia of the cluster and of all, and the digest of the centroid."""
    rows, found = cluster_vectors(df, "vec_id", "embedding", width, scale, k, rounds, seed)

    def of_cluster(values: list, kind: str):
        pairs = [F.lit(x) for b, v in enumerate(values) if v is not None for x in (b, v)]
        return F.create_map(*pairs)[F.col("cluster")].cast(kind) if pairs else F.lit(None).cast(kind)

    return rows.select(
        F.col("id").alias("vec_id"), "cluster", "distance", of_cluster(found.inertias if found else [], "long").alias("cluster_inertia"),
        F.lit(found.inertia if found else None).cast("long").alias("inertia"),
        of_cluster([found.digest(b) for b in range(len(found.centroids))] if found else [], "string").alias("centroid_sha256"))


def cluster_embeddings_sql(width: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The same clusters in SQL: every vector is compared with every centroid, a row for each component."""
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
cells AS MATERIALIZED (SELECT n, unnest(v) AS x, unnest(range({width})) AS i FROM kept),
first_of AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept),
c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, unnest(range({width})) AS i FROM first_of WHERE c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
d{r} AS (SELECT n, c, sum((x - y) * (x - y)) AS d FROM cells JOIN c{r} USING (i) GROUP BY n, c),
a{r} AS MATERIALIZED (SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY n)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (SELECT c, i, sum(x) AS s, count(*) AS m FROM cells JOIN a{r} USING (n) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN m IS NULL THEN y ELSE CAST((s - ((s % m) + m) % m) // m AS BIGINT) END AS y
  FROM c{r} LEFT JOIN m{r} USING (c, i))""")
    return ",".join(parts) + f""",
named AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c),
whole AS (SELECT c, CAST(sum(d) AS BIGINT) AS own FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, own AS cluster_inertia,
  CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia, digest AS centroid_sha256
FROM kept JOIN a{rounds} USING (n) JOIN named USING (c) JOIN whole USING (c)"""
