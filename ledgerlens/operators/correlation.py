"""Pearson, Spearman and Kendall correlation matrices."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import report_rows
from ..schema import MEASURES
from .prefix import range_splits

COLUMNS = ["step", *MEASURES]
ROWS_IN_RANGE, LEAST_RANGES, MOST_RANGES = 1_000_000, 64, 512


def pearson(df: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """(x, y, r) for every pair in one aggregate; pairs with a null are skipped."""
    pairs = list(combinations(columns, 2))
    stats = df.agg(*[
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)
    ])
    return report_rows(stats, [(F.lit(a), F.lit(b), F.col(f"r{i}")) for i, (a, b) in enumerate(pairs)], ["x", "y", "r"])


def _range_cuts(rows: DataFrame, columns: list[str], buckets: int | None = None) -> list[np.ndarray]:
    """Cut points of each column, so many that a range between two of them holds about a million rows at most."""
    if buckets is None:
        buckets = min(MOST_RANGES, max(LEAST_RANGES, rows.count() // ROWS_IN_RANGE))
    splits = range_splits(rows, columns, buckets)
    return [np.array(splits[c], float) for c in columns]


def _read(batch: pa.RecordBatch, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values (null as NaN) and their places along the cuts. A value on a cut has an odd place, which holds no other value,
    however many rows there are; one between cuts has an even place; NaN and null have the last two odd ones."""
    columns = batch.columns[:len(cuts)]
    values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(float)
    places = np.empty(values.shape, np.int16)
    for i, (column, cut) in enumerate(zip(columns, cuts)):
        v, k = values[:, i], len(cut)
        at = np.searchsorted(cut, v, "left")
        places[:, i] = np.where(np.isnan(v), 2 * k + 1, 2 * at + (np.append(cut, np.nan)[at] == v))
        places[column.is_null().to_numpy(zero_copy_only=False), i] = 2 * k + 3
    return values, places


def _place_counts(rows: DataFrame, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows at every place of each column: a row a place reaches the driver."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(2 * len(cut) + 4, np.int64) for cut in cuts]
        for batch in batches:
            _, places = _read(batch, cuts)
            for i, t in enumerate(total):
                t += np.bincount(places[:, i], minlength=len(t))
        for i, t in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), i)), pa.array(np.arange(len(t))), pa.array(t)], names=["column", "place", "n"])

    out = [np.zeros(2 * len(cut) + 4, np.int64) for cut in cuts]
    parts = rows.mapInArrow(task, "column long, place long, n long")
    for r in parts.groupBy("column", "place").agg(F.sum("n").alias("n")).collect():
        out[r["column"]][r["place"]] = r["n"]
    return out


def with_ranks(df: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Columns replaced by their average ranks, null by null.

    One column after the other: its rows are brought together by ranges and ranked there, behind the rows of lower ranges.
    Rows of a value on a cut share one rank, known from the counts, so they are spread over all tasks and only passed on.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    cuts = _range_cuts(rows, columns, buckets)
    counts = _place_counts(rows, cuts)
    layout = ", ".join(f"`{c}` double" for c in columns)

    def batch_of(values: np.ndarray, nulls: np.ndarray, following: int) -> pa.RecordBatch:
        arrays = [pa.array(values[:, i], mask=nulls[:, i]) for i in range(len(columns))]
        names = list(columns)
        if following < len(columns):
            place = _read(pa.RecordBatch.from_arrays([arrays[following]], names=["v"]), [cuts[following]])[1][:, 0]
            arrays, names = [*arrays, pa.array(place.astype(np.int32))], [*names, "_place"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, _ = _read(batch, cuts)
            yield batch_of(values, np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns]), 0)

    def ranker(i: int):
        below = np.cumsum(counts[i]) - counts[i]

        def ranked(places: np.ndarray, values: np.ndarray, nulls: np.ndarray) -> pa.RecordBatch:
            rank = below[places] + (counts[i][places] + 1) / 2
            for place in np.unique(places[places % 2 == 0]):
                here = places == place
                _, of, n = np.unique(values[here, i], return_inverse=True, return_counts=True)
                rank[here] = below[place] + (np.cumsum(n) - (n - 1) / 2)[of]
            values[:, i] = rank
            return batch_of(values, nulls, i + 1)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []  # rows of the range at hand
            for batch in batches:
                values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]).astype(float)
                nulls = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns[:-1]])
                places = batch.columns[-1].to_numpy()
                on = places % 2 == 1
                if on.any():
                    yield ranked(places[on], values[on], nulls[on])
                places, values, nulls = places[~on], values[~on], nulls[~on]
                if not len(places):
                    continue
                if held and held[0][0][0] != places[0]:
                    yield ranked(*map(np.concatenate, zip(*held)))
                    held = []
                done = np.searchsorted(places, places[-1])  # the last range may go on in the next batch
                if done:
                    yield ranked(*map(np.concatenate, zip(*held, (places[:done], values[:done], nulls[:done]))))
                    held = []
                held.append((places[done:], values[done:], nulls[done:]))
            if held:
                yield ranked(*map(np.concatenate, zip(*held)))

        return task

    out = rows.mapInArrow(start, f"{layout}, _place int")
    for i in range(len(columns)):
        spread = F.when(F.col("_place") % 2 == 1, F.xxhash64(*columns))
        apart = out.repartition("_place", spread).sortWithinPartitions("_place")
        out = apart.mapInArrow(ranker(i), layout if i + 1 == len(columns) else f"{layout}, _place int")
    return out


def spearman(df: DataFrame, columns: list[str] = COLUMNS, buckets: int | None = None) -> DataFrame:
    """Pearson correlation of average ranks; with nulls each pair ranks its complete rows."""
    nulls = df.agg(F.count_if(_any_null(columns))).first()[0]
    if not nulls:
        return pearson(with_ranks(df, columns, buckets), columns)
    out = None
    for a, b in combinations(columns, 2):
        part = pearson(with_ranks(df.filter(~_any_null([a, b])), [a, b], buckets), [a, b])
        out = part if out is None else out.unionByName(part)
    return out


def _any_null(columns):
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).isNull()
    return cond


def inversions(ranks: np.ndarray) -> int:
    """Pairs of a lower rank behind a higher one. Two ranks differ first at one bit, where they share all higher bits: bit by
    bit, groups with equal higher bits are split into those with 0 and 1, both in the old order."""
    r, n, total = ranks.astype(np.int64), len(ranks), 0
    if not n:
        return 0
    first, behind = np.zeros(n, np.int64), np.full(n, n, np.int64)  # each row's group
    ones = np.zeros(n + 1, np.int64)
    for bit in range(int(r.max()).bit_length() - 1, -1, -1):
        one = (r >> bit & 1).astype(bool)
        np.cumsum(one, out=ones[1:])
        before = ones[:-1] - ones[first]
        total += int(before[~one].sum())
        middle = behind - (ones[behind] - ones[first])
        to = np.where(one, middle + before, np.arange(n) - before)
        moved = np.empty((3, n), np.int64)
        moved[:, to] = r, np.where(one, middle, first), np.where(one, behind, middle)
        r, first, behind = moved
    return total


def _ties(*keys: np.ndarray) -> int:
    """Pairs of rows equal in all keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    n = np.bincount(np.cumsum(new))
    return int((n * (n - 1) // 2).sum())


COUNTED = ["pair", "rows", "discordant", "tied_x", "tied_y", "tied_both"]
_LAYOUT = ", ".join(f"{c} long" for c in COUNTED)


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTED))], names=COUNTED)


def kendall_counts(df: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """(pair, rows, discordant, tied_x, tied_y, tied_both): pairs of rows, summed over complete rows; pairs as in ``combinations``.

    Ranges of each column hold a bounded number of rows. Two rows in different ranges of both columns are counted from a table
    of rows by ranges, two in the same range of a column inside that range's task, which sorts its rows; rows on a cut are
    equal there and sent nowhere. A row is sent once a column, and no pair of rows is ever built.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    cuts = _range_cuts(rows, columns, buckets)
    pairs = list(combinations(range(len(columns)), 2))
    number = {p: i for i, p in enumerate(pairs)}
    sizes = [2 * len(cut) + 2 for cut in cuts]  # places but null's

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(sizes[i] * sizes[j], np.int64) for i, j in pairs]
        for batch in batches:
            _, places = _read(batch, cuts)
            for t, (i, j) in zip(total, pairs):
                both = (places[:, i] < sizes[i]) & (places[:, j] < sizes[j])
                t += np.bincount(places[both, i].astype(np.int64) * sizes[j] + places[both, j], minlength=len(t))
        for k, t in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([t], pa.list_(pa.float64()))], names=["pair", "part"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, part in zip(batch.column("pair").to_pylist(), batch.column("total")):
                i, j = pairs[k]
                n = part.values.to_numpy().astype(np.int64).reshape(sizes[i], sizes[j])
                higher = n[::-1].cumsum(axis=0)[::-1] - n
                discordant = (n * (higher.cumsum(axis=1) - higher)).sum()
                x, y, cells = n.sum(axis=1)[1::2], n.sum(axis=0)[1::2], n[1::2, 1::2]
                yield _counted([(k, int(n.sum()), int(discordant), *(int((v * (v - 1) // 2).sum()) for v in (x, y, cells)))])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, places = _read(batch, cuts)
            for i in range(len(columns)):
                at = np.flatnonzero(places[:, i] % 2 == 0)
                at = at[np.argsort(places[at, i], kind="stable")]
                starts = np.flatnonzero(np.append(True, places[at[1:], i] != places[at[:-1], i])) if len(at) else []
                parts = np.split(at, starts[1:]) if len(at) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([i] * len(parts), pa.int32()), pa.array([int(places[p[0], i]) for p in parts], pa.int32()),
                    pa.array([values[p, i:].tobytes() for p in parts], pa.binary()),
                    pa.array([places[p].tobytes() for p in parts], pa.binary())], names=["column", "place", "later", "places"])

    def inside(group: pa.Table) -> pa.Table:
        i = group.column("column")[0].as_py()
        values = np.concatenate([np.frombuffer(b.as_buffer()).reshape(-1, len(columns) - i) for b in group.column("later")])
        places = np.concatenate([np.frombuffer(b.as_buffer(), np.int16).reshape(-1, len(columns)) for b in group.column("places")])
        own = np.unique(values[:, 0], return_inverse=True)[1]
        found = []
        for j in range(len(columns)):
            both = places[:, j] < sizes[j]
            mine, other = own[both], places[both, j]
            if j > i:
                other = np.unique(values[both, j - i], return_inverse=True)[1]
                found.append((number[i, j], 0, inversions(other[np.lexsort((other, mine))]), _ties(mine), 0, _ties(mine, other)))
            elif j < i:  # rows in the same range of j meet there
                on = other % 2 == 1
                found.append((number[j, i], 0, inversions(mine[np.lexsort((mine, other))]), 0, _ties(mine), _ties(mine[on], other[on])))
        return pa.Table.from_batches([_counted(found)])

    grid = rows.mapInArrow(tables, "pair long, part array<double>").groupBy("pair").agg(Summarizer.sum(array_to_vector("part")).alias("total"))
    far = grid.select("pair", vector_to_array("total").alias("total")).mapInArrow(across, _LAYOUT)
    near = rows.mapInArrow(sent, "column int, place int, later binary, places binary").groupBy("column", "place").applyInArrow(inside, _LAYOUT)
    return far.unionByName(near).groupBy("pair").agg(*[F.sum(c).cast("double").alias(c) for c in COUNTED[1:]])


def kendall(df: DataFrame, columns: list[str] = COLUMNS, buckets: int | None = None) -> DataFrame:
    """(x, y, r): Kendall's tau-b of every pair of columns; each pair skips the rows with a null in one of its two."""
    names = [(i, a, b) for i, (a, b) in enumerate(combinations(columns, 2))]
    every = df.sparkSession.createDataFrame(names, "pair long, x string, y string")
    found = every.join(F.broadcast(kendall_counts(df, columns, buckets)), "pair", "left").na.fill(0.0)  # a row a pair
    pairs_of_rows = F.col("rows") * (F.col("rows") - 1) / 2
    score = pairs_of_rows - F.col("tied_x") - F.col("tied_y") + F.col("tied_both") - 2 * F.col("discordant")
    size = F.sqrt((pairs_of_rows - F.col("tied_x")) * (pairs_of_rows - F.col("tied_y")))
    return found.select("x", "y", F.when(size > 0, score / size).alias("r"))


def kendall_pair(df: DataFrame, x: str, y: str, buckets: int | None = None) -> DataFrame:
    """Kendall's tau-b of one pair: (x, y, r)."""
    return kendall(df, [x, y], buckets)
