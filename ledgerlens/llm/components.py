"""Connected components of an edge table: local union-find, then alternating star rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, settle

TASK_EDGES = 1_000_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task: each node with the least node it reaches there."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kinds = None
    for batch in batches:
        kinds = batch.schema.types
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for lo in range(0, len(nodes), 100_000):
        part = nodes[lo: lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kinds[0]), pa.array([root(n) for n in part], kinds[1])], names=["u", "v"])


def connected_components(edges: DataFrame, purpose: str, task_edges: int = TASK_EDGES, most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the least node reachable) for all nodes of edges ``u``, ``v``.

    Tasks of at most about ``task_edges`` edges each shrink them to stars by union-find; where one task
    holds all edges that is the result. Otherwise each round links every node's larger, then its
    smaller neighbours to the least of them; the number of rounds is logarithmic. Each round
    is a table in the shared folder. Loops count as nodes without links.
    """
    kind = edges.schema["u"].dataType.simpleString()
    links = settle(edges.select("u", "v"), purpose)
    tasks = max(1, math.ceil(links.count() / task_edges))
    read, links = links, settle(links.coalesce(tasks).mapInArrow(_local_stars, f"u {kind}, v {kind}"), purpose)
    discard(read)
    if tasks > 1:
        links = _star_rounds(links.where("u <> v").distinct(), purpose, most_rounds)
        roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _star_rounds(links: DataFrame, purpose: str, most_rounds: int) -> DataFrame:
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    links, state = settle(links, purpose), None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(least(both), purpose)
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct(), purpose)
        low = settle(least(large), purpose)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = settle(small, purpose)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return links
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
