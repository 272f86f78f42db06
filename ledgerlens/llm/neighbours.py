"""Approximate nearest neighbours on shifted space-filling curves (operator 6).

Vectors are projected to a few random orthonormal directions, moved by a random shift and ordered
along a Hilbert curve; several curves with projections and shifts of their own give several
orderings. Each ordering is range-partitioned into blocks at quantiles of a bounded sample of
keys. A query searches the window of neighbouring blocks around its own key on every curve; the
windows' best candidates are merged and reranked by exact inner product in double precision.

The curves order lifted vectors, so that near on a curve means a large inner product for vectors of
any norm: entries get one more component that brings them to the largest norm of all, queries are
scaled to that norm and get a zero. Scores are taken from the vectors as they are.

A group of a curve and a block is dealt out over parts, each of a bounded number of entries and of
queries whatever the table holds: entries and queries are counted for each group, then split by hash.
Every part of the entries meets every part of the queries in a task of its own.

The window is a share of the ordering (``window``), because in data without cluster structure the
neighbours of a vector spread over a fixed share of every curve; lower it for clustered data.
Equal vectors are one entry with their smallest ``k + 1`` ids, all that a result can hold.

Defined cases: vectors that are null, zero, of another length than most, or with null or non-finite
components take no part; equal scores are ordered by smaller id; a null id takes no part; rows of
equal id and vector are one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import settle
from .words import release, tidy

BITS = 7
_COPIES = 8192
_PAIRS = 1 << 16


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of integer points (rows, ``bits`` bits a coordinate) along a Hilbert curve."""
    x = points.T.astype(np.int64).copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curves:
    """Orderings fitted on a sample: projections, ranges, shifts and block boundaries of each curve."""

    projections: np.ndarray  # curves x width x dims
    low: np.ndarray
    span: np.ndarray
    shifts: np.ndarray
    bounds: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, blocks: int, curves: int, dims: int, seed: int) -> Curves:
        rng, width = np.random.default_rng(seed), sample.shape[1]
        dims = min(dims, width)
        frames = np.stack([np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)])
        out = Curves(frames, np.zeros((curves, dims)), np.ones((curves, dims)), rng.uniform(0, 0.5, size=(curves, dims)), [])
        for c in range(curves):
            at = sample @ frames[c]
            out.low[c], high = np.quantile(at, [0.001, 0.999], axis=0)
            out.span[c] = np.maximum(high - out.low[c], 1e-12)
            keys = np.sort(out.key(c, sample))
            out.bounds.append(keys[(np.arange(1, blocks) * len(keys)) // blocks])
        return out

    def key(self, c: int, vectors: np.ndarray) -> np.ndarray:
        unit = np.clip((vectors @ self.projections[c] - self.low[c]) / self.span[c], 0, 1) * 0.5 + self.shifts[c]
        return hilbert_keys(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))

    def block(self, c: int, vectors: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds[c], self.key(c, vectors), side="right")


def windows(own: np.ndarray, window: float, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last block to search around each own block: at least the share ``window`` of all, moved inwards at the ends."""
    reach = max(1, math.ceil((window * blocks - 1) / 2))
    first = np.clip(own - reach, 0, max(0, blocks - 2 * reach - 1))
    return first, np.minimum(first + 2 * reach, blocks - 1)


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """Rows that take part: ``id``, ``vector`` as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id).alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & fine)
    width = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.size("vector") == width["w"]) if width else rows


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def lifted(entries: np.ndarray, largest: float) -> np.ndarray:
    """Entries with a component more, all of norm ``largest``."""
    norm = np.linalg.norm(entries, axis=1)
    return np.column_stack([entries, np.sqrt(np.maximum(largest - norm, 0)) * np.sqrt(largest + norm)])


def levelled(queries: np.ndarray, largest: float) -> np.ndarray:
    """Queries scaled to norm ``largest``, which keeps the order of their scores, with a zero more."""
    return np.column_stack([queries * (largest / np.linalg.norm(queries, axis=1, keepdims=True)), np.zeros(len(queries))])


def once(rows: DataFrame) -> DataFrame:
    """Rows with the ``key`` of their vector, those of equal id and vector as one."""
    keyed = rows.withColumn("key", F.sha2(F.to_json("vector"), 256))
    return keyed.groupBy("id", "key").agg(F.first("vector").alias("vector"))


def distinct_vectors(rows: DataFrame, ids: int, salts: int = 8) -> DataFrame:
    """One row per different vector with its smallest ``ids`` ids, chosen in two rounds."""
    keyed = once(rows)
    salted = Window.partitionBy("key", F.pmod(F.xxhash64("id"), F.lit(salts))).orderBy("id")
    few = keyed.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= ids)
    final = few.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= ids)
    return final.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))


def id_order(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each entry's smallest id among those of all entries."""
    least = [row[0].as_py() for row in ids]
    return np.unique(np.array(least), return_inverse=True)[1] if least else np.zeros(0, np.int64)


def best_pairs(q: np.ndarray, x: np.ndarray, order: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``take`` entries of largest exact score, equal ones in order of id: query, entry, score.

    A fast product finds all that may be among them, whatever the number of ties; sums from the first component on decide.
    """
    fast = q @ x.T
    n = min(take, len(x))
    least = -np.partition(-fast, n - 1, axis=1)[:, n - 1]
    slack = 1e-14 * (len(x[0]) + 1) * np.abs(q).max(axis=1) * np.abs(x).max() * len(x[0])
    own, other = np.nonzero(fast >= (least - slack)[:, None])
    score = np.empty(len(own))
    for lo in range(0, len(own), _PAIRS):
        score[lo: lo + _PAIRS] = np.cumsum(q[own[lo: lo + _PAIRS]] * x[other[lo: lo + _PAIRS]], axis=1)[:, -1]
    by = np.lexsort((order[other], -score, own))
    own, other, score = own[by], other[by], score[by]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    return own[place < n], other[place < n], score[place < n]


def deal(queries: DataFrame, entries: DataFrame, fitted: Curves, largest: float, window: float, query_rows: int, entry_rows: int):
    """Queries and entries by ``curve``, ``block`` and ``part``: each pair that is to be scored on a curve meets in one part.

    Both have ``key``, ``vector`` and ``number`` (a hash) first. The parts of a block are every part of
    its entries with every part of its queries, as many as it takes to have about the given rows in each.
    """
    curves, blocks = len(fitted.bounds), len(fitted.bounds[0]) + 1
    sides = {"queries": (queries, window, levelled, query_rows), "entries": (entries, None, lifted, entry_rows)}

    def targets(batch: pa.RecordBatch, width: float | None, moved):
        v = moved(_vectors(batch.column(1)), largest) if batch.num_rows else None
        for c in range(curves if batch.num_rows else 0):
            own = fitted.block(c, v)
            first, last = (own, own) if width is None else windows(own, width, blocks)
            for step in range(int((last - first).max()) + 1):
                rows = np.flatnonzero(first + step <= last)
                yield c, rows, (first + step)[rows]

    def count(width: float | None, moved):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((curves, blocks), np.int64)
            for batch in batches:
                for c, _, at in targets(batch, width, moved):
                    n[c] += np.bincount(at, minlength=blocks)
            c, at = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[c, at])], names=["curve", "block", "n"])
        return run

    parts = {side: np.zeros((curves, blocks), np.int64) for side in sides}
    for side, (rows, width, moved, most) in sides.items():
        counts = rows.mapInArrow(tidy(count(width, moved)), "curve int, block int, n long").groupBy("curve", "block").agg(F.sum("n").alias("n"))
        for r in counts.collect():  # one row a curve and block
            parts[side][r["curve"], r["block"]] = math.ceil(r["n"] / most)

    def place(side: str, width: float | None, moved):
        own_parts, other_parts = parts[side], parts["entries" if side == "queries" else "queries"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number = batch.column(2).to_numpy()
                for c, rows, at in targets(batch, width, moved):
                    own, copies = number[rows] % own_parts[c, at], other_parts[c, at]
                    ends = np.cumsum(copies)
                    for lo in range(0, int(ends[-1]) if len(ends) else 0, _COPIES):
                        copy = np.arange(lo, min(lo + _COPIES, int(ends[-1])))
                        i = np.searchsorted(ends, copy, side="right")
                        other = copy - (ends[i] - copies[i])
                        part = other * own_parts[c, at[i]] + own[i] if side == "queries" else own[i] * copies[i] + other
                        taken = pa.array(rows[i])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(i), c, np.int32)), pa.array(at[i].astype(np.int32)), pa.array(part),
                             *[column.take(taken) for column in batch.columns]],
                            names=["curve", "block", "part", *batch.schema.names])
        return run

    def dealt(side: str) -> DataFrame:
        rows, width, moved, _ = sides[side]
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(tidy(place(side, width, moved)), f"curve int, block int, part long, {fields}")

    return dealt("queries"), dealt("entries")


def search(df: DataFrame, queries: DataFrame, id: str, vector: str, k: int = 20, curves: int = 10, dims: int = 6,
           window: float = 0.1875, least_blocks: int = 16, block_rows: int = 16384, sample: int = 8192, seed: int = 7,
           query_rows: int = 8192) -> DataFrame:
    """The ``k`` nearest rows found for each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    About ``block_rows`` entries and ``query_rows`` queries, as the hash deals them, meet in a task.
    ``queries`` is a part of ``df`` with the same columns; a row is never its own neighbour.
    """
    wanted = settle(once(usable(queries, id, vector)), "queries")
    entries = settle(distinct_vectors(usable(df, id, vector), k + 1).withColumn("number", F.xxhash64("key")), "entries")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    total, largest = entries.agg(F.count(F.lit(1)), F.max(norm)).first()
    id_kind = df.schema[id].dataType.simpleString()
    if not total:
        return df.sparkSession.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score double")
    blocks = min(max(least_blocks, math.ceil(total / block_rows)), max(1, total // (8 * (k + 1))),  # none of few rows
                 max(1, sample // 8))  # nor more than the sample can bound
    picked = entries.where(F.pmod("number", F.lit(1 << 20)) < max(1, math.ceil(2 * sample * (1 << 20) / total))).orderBy("number").limit(sample)
    drawn = picked.select("vector").collect()  # at most ``sample`` vectors
    if not drawn:
        drawn = entries.orderBy("number").limit(sample).select("vector").collect()
    fitted = Curves.fit(lifted(np.array([r["vector"] for r in drawn]), largest), blocks, curves, dims, seed)

    different = wanted.groupBy("key").agg(F.first("vector").alias("vector")).withColumn("number", F.xxhash64("key"))
    sought, dealt = deal(different.select("key", "vector", "number"), entries.select("key", "vector", "number", "ids"),
                         fitted, largest, window, query_rows, block_rows)
    take = k + 1  # a query's own id may be one of them

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = (_vectors(t.column("vector").combine_chunks()) for t in (left, right))
        kept = [best_pairs(q[lo: lo + 512], x, id_order(right.column("ids")), take) for lo in range(0, len(q) if len(x) else 0, 512)]
        own = np.concatenate([r + 512 * i for i, (r, _, _) in enumerate(kept)]) if kept else np.zeros(0, np.int64)
        other, score = (np.concatenate([t[j] for t in kept]) if kept else np.zeros(0, np.int64) for j in (1, 2))
        release()
        return pa.table({"query": left.column("key").take(pa.array(own, pa.int64())), "key": right.column("key").take(pa.array(other, pa.int64())),
                         "ids": right.column("ids").take(pa.array(other, pa.int64())), "score": pa.array(score, pa.float64())})

    found = sought.groupBy("curve", "block", "part").cogroup(dealt.groupBy("curve", "block", "part")).applyInArrow(
        nearest, f"query string, key string, ids array<{id_kind}>, score double")
    again = F.row_number().over(Window.partitionBy("query", "key").orderBy("score"))
    merged = found.withColumn("again", again).where("again = 1")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0], "key")
    top = settle(merged.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= take)
                 .groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near")), "near")
    own = F.col("id")
    ranked = F.slice(F.array_sort(F.flatten(F.transform("near", lambda n: F.transform(
        F.filter(n["ids"], lambda i: i != own), lambda i: F.struct((-n["score"]).alias("far"), i.alias("vec_id")))))), 1, k)
    return (wanted.join(top, F.col("key") == F.col("query")).select(F.col("id").alias("query_id"), F.posexplode(ranked).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score")))
