"""Near-duplicate documents by MinHash with tensored banding (operator 9).

A document's set is its distinct word shingles. Equal sets form one class. Two collections of
``m`` short signatures (``r`` minhashes each) are computed per class; a table key pairs one
signature of either collection, so ``m * m`` tables need only ``2 * m * r`` minhashes. ``m``
follows from the wanted chance of missing a pair at the threshold. Signatures that occur once
are dropped before keys are formed. Classes sharing a key are joined into candidate
components; each component's sets are compared exactly, in blocks of bounded size, and the
links that hold give the final components.

Nothing is capped: a large component is cut into blocks by hash and every pair of blocks is a
task of its own; a block pair returns a spanning forest of its links, not the pairs.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; a text
of fewer words than a shingle has its whole sequence as one shingle; repeated rows and copies
share a class; a null id counts as none when the smallest id is taken; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import discard, settle, whole_text
from .words import buffers, find_words, mix, release, sequence_hash, slices, tidy

SIGNATURE = 3
BLOCK = 128
BLOCK_BYTES = 64 << 20
_SLAB = 4096


def signatures_needed(threshold: float, missed: float, r: int = SIGNATURE) -> int:
    """Signatures per collection so that a pair at the threshold is missed with at most that chance."""
    return math.ceil(math.log(missed / 2) / math.log(1 - threshold ** r))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, words split at ASCII white space, A-Z lower-cased."""
    w = find_words(*buffers(texts), lower=True)
    runs = sequence_hash(w.hash, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        else:
            out.append(sequence_hash(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def set_key(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None


def _signatures(sets: list[np.ndarray], m: int, r: int) -> np.ndarray:
    """Both collections of each set (sets x 2m); sets must not be empty."""
    if not sets:
        return np.zeros((0, 2 * m), np.int64)
    flat = np.concatenate(sets)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    seeds = mix(np.arange(1, 2 * 2 * m * r + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(sets), 2 * m), np.uint64)
    for k in range(2 * m):
        total = np.full(len(sets), k + 1, np.uint64)
        for q in range(r):
            j = 2 * (k * r + q)
            x = (flat ^ seeds[j]) * (seeds[j + 1] | np.uint64(1))
            x ^= x >> np.uint64(32)
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, begin))
        out[:, k] = total
    return out.view(np.int64)


def describe(df: DataFrame, id: str, text: str, size: int, m: int, r: int) -> DataFrame:
    """Per row: id, text hash, set size, 16-byte set key (null if empty), and 2m signatures."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                sets = shingle_sets(part.column(2), size)
                full = [i for i, s in enumerate(sets) if len(s)]
                signs = dict(zip(full, _signatures([sets[i] for i in full], m, r)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_key(s) for s in sets], pa.binary()),
                     pa.array([signs.get(i) for i in range(len(sets))], pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n_shingles", "set_key", "signatures"])

    kind = df.schema[id].dataType.simpleString()
    body = whole_text(F.col(text))
    return df.select(F.col(id).alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text")).mapInArrow(
        tidy(rows), f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, signatures array<long>")


def candidate_components(classes: DataFrame, m: int) -> DataFrame:
    """Per class that shares a table key with another: set key, first document, set size, and its candidate component.

    Classes go by an 8-byte hash of the set key here; two of one hash share a component, where sets are compared in full.
    """
    signs = classes.select(F.xxhash64("set_key").alias("node"), F.posexplode("signatures").alias("slot", "sign"))
    often = settle(signs.groupBy("sign").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sign"), "signs")
    shared = signs.join(often, "sign").groupBy("node").agg(F.collect_set(F.struct("slot", "sign")).alias("s"))  # at most 2m a class
    left = F.filter("s", lambda x: x["slot"] < m)
    right = F.filter("s", lambda x: x["slot"] >= m)
    halves = shared.select("node", left.alias("a"), right.alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    keys = settle(halves.select("node", F.explode("a.sign").alias("a"), "b").select("node", "a", F.explode("b.sign").alias("b"))
                  .select("node", F.xxhash64("a", "b").alias("key")), "keys")
    hubs = settle(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"))
                  .where("n > 1").select("key", "hub"), "hubs")
    edges = keys.join(hubs, "key").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    found = connected_components(edges, "candidates")
    named = classes.select(F.xxhash64("set_key").alias("node"), "set_key", "rep", "n_shingles")
    out = settle(named.join(found, "node").select("set_key", "rep", "n_shingles", "component"), "candidates")
    discard(often, keys, hubs, found)
    return out


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The component number of each set where 100 * intersection >= percent * union links two."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    _, feature, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    common = np.flatnonzero(count[feature] > 1)
    number = np.cumsum(count > 1) - 1
    owner, feature = owner[common], number[feature[common]]
    order = np.argsort(feature, kind="stable")
    owner, feature = owner[order], feature[order]
    both = np.zeros((n, n), dtype=np.float64)
    features = int(feature[-1]) + 1 if len(feature) else 0
    for lo in range(0, features, _SLAB):
        i, j = np.searchsorted(feature, [lo, lo + _SLAB])
        block = np.zeros((n, min(_SLAB, features - lo)), dtype=np.float32)
        block[owner[i:j], feature[i:j] - lo] = 1
        both += block @ block.T
    both = both.astype(np.int64)
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = np.minimum(new, label)[np.minimum(new, label)]
        if (new == label).all():
            return label
        label = new


def verified_edges(df: DataFrame, candidates: DataFrame, id: str, text: str, size: int, percent: int) -> DataFrame:
    """Edges of a spanning forest of the exact links inside each candidate component.

    A block holds about ``BLOCK`` sets and ``BLOCK_BYTES`` of them at most, whichever is less; one larger set is alone.
    """
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_shingles") * 8).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.ceil(F.col("bytes") / BLOCK_BYTES), F.col("n")))
    spread = settle(sizes.select("component", "n", "bytes", blocks.cast("int").alias("blocks")), "sizes")
    few = spread.where("blocks = 1").agg(F.sum("n"), F.sum("bytes")).first()
    small = max(1, math.ceil((few[0] or 0) / BLOCK), math.ceil((few[1] or 0) / BLOCK_BYTES))
    placed = (candidates.join(spread, "component")
              .select("component", "blocks", F.col("set_key").alias("node"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"),
                      F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int").alias("block"),
                      F.pmod(F.xxhash64("component"), F.lit(small)).cast("int").alias("share")))
    placed = settle(placed, "placed")
    body = whole_text(F.col(text))
    texts = df.select(F.col(id).alias("own_id"), F.xxhash64(body).alias("own_hash"), body.alias("text"))
    # merged whatever the sizes: texts are exchanged alike for few and for many candidates
    rows = texts.join(placed.hint("merge"), F.col("own_id").eqNullSafe(F.col("rep_id")) & (F.col("own_hash") == F.col("rep_hash")))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["component", "low", "high", "node", "members"]
        for batch in batches:
            for part in slices(batch, 5, 1 << 20):
                p = part.to_pydict()
                sets = shingle_sets(part.column(5), size)
                out = []
                for comp, blocks, node, block, share, s in zip(p["component"], p["blocks"], p["node"], p["block"], p["share"], sets):
                    if blocks == 1:
                        out.append((comp, share, -1, node, s.tobytes()))
                    else:
                        out += [(comp, min(block, x), max(block, x), node, s.tobytes()) for x in range(blocks)]
                    if sum(len(x[4]) for x in out[-blocks:]) > 1 << 20 or len(out) > 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=names)

    spread_sets = rows.select("component", "blocks", "node", "block", "share", "text").mapInArrow(
        tidy(replicate), "component long, low int, high int, node binary, members binary")
    grouping = [F.when(F.col("high") >= 0, F.col("component")).alias("whole"), "low", "high"]

    def verify(table: pa.Table) -> pa.Table:
        parts: dict[int, dict[bytes, np.ndarray]] = {}
        for comp, node, members in zip(*(table.column(c).to_pylist() for c in ("component", "node", "members"))):
            parts.setdefault(comp, {})[node] = np.frombuffer(members, dtype=np.uint64)
        u, v = [], []
        for sets in parts.values():
            nodes = sorted(sets)
            for node, root in zip(nodes, linked([sets[k] for k in nodes], percent).tolist()):
                if nodes[root] != node:
                    u.append(node)
                    v.append(nodes[root])
        release()
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    links = settle(spread_sets.groupBy(*grouping).applyInArrow(verify, "u binary, v binary"), "links")
    discard(spread, placed)
    return links


_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
                    missed: float = 1e-5, r: int = SIGNATURE) -> DataFrame:
    """Per row: id, text hash, set size, the smallest id of its component, and the component's first document.

    ``first`` holds the id (null only if all are) and the text hash of one document of the component.
    """
    rows, of_class = _components(df, id, text, size, percent, missed, r)
    columns = ["doc_id", "text_hash", "n_shingles", F.col("first.doc_id").alias("component_id"), "first"]
    some = rows.join(of_class, F.col("set_key") == F.col("of")).select(*columns)
    none = rows.where(F.col("set_key").isNull()).withColumn("first", _place()).select(*columns)
    return some.unionByName(none)


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")


def _components(df: DataFrame, id: str, text: str, size: int, percent: int, missed: float, r: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their set keys, and the first document of each set's component."""
    m = signatures_needed(percent / 100, missed, r)
    described = settle(describe(df, id, text, size, m, r), "described")
    rows = settle(described.drop("signatures"), "rows")
    classes = settle(described.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(
        F.min(_place()).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signatures").alias("signatures")), "classes")
    discard(described)
    candidates = candidate_components(classes, m)
    reps = settle(classes.select("set_key", "rep"), "reps")
    discard(classes)
    links = verified_edges(df, candidates, id, text, size, percent)
    found = connected_components(links, "components")
    labelled = settle(reps.join(found, reps["set_key"] == found["node"], "left")
                      .select("set_key", "rep", F.coalesce("component", "set_key").alias("component")), "labelled")
    first = settle(labelled.groupBy("component").agg(F.min("rep").alias("first")), "first")
    of_class = settle(labelled.join(first, "component").select(F.col("set_key").alias("of"), "first"), "of")
    discard(candidates, reps, links, found, labelled, first)
    return rows, of_class


def keep_first(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one row of each near-duplicate group; rows of equal id and text are one document."""
    found = near_duplicates(df, id, text, size, percent)
    kept = found.where(_place() == F.col("first")).select(F.xxhash64("doc_id", "text_hash").alias("_llm_key")).distinct()
    kept = settle(kept, "kept")
    discard(found)
    keyed = df.withColumn("_llm_own", F.xxhash64(F.col(id), F.xxhash64(whole_text(F.col(text)))))
    joined = keyed.join(kept, F.col("_llm_own") == F.col("_llm_key"), "left_semi")
    once = F.row_number().over(Window.partitionBy("_llm_own").orderBy("_llm_own"))
    return joined.withColumn("_llm_once", once).where("_llm_once = 1").select(*df.columns)


def near_duplicates_sql(size: int, percent: int) -> str:
    """Set sizes and components in SQL, by all pairs that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shingle = " || ' ' || ".join(f"ws[i + {k}]" for k in range(size))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {size - 2}), lambda i: {shingle}) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= {percent} * (x.n + y.n - c)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, edge.v FROM reach JOIN edge ON reach.r = edge.u),
least AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id JOIN least ON d = w.doc_id"""
