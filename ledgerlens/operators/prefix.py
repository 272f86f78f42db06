"""Running totals over a global order without a single-task window.

The values are cut into range buckets along the order; each bucket is summed on
its own and shifted by the total of the buckets before it. Callers first group
equal order values into one row, so a value held by a third of all rows is one
row here, and no bucket grows with a hot value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_PARTITION = 2


def range_splits(rows: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Cut points per column for ``buckets`` ranges (default: two per shuffle partition).

    The number of cut points and the error of the sketches depend on the cluster's settings,
    not on the rows.
    """
    if buckets is None:
        buckets = BUCKETS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / buckets for i in range(1, buckets)]
    found = rows.approxQuantile(list(columns), probs, 1.0 / (4 * buckets)) if probs else [[] for _ in columns]
    return {c: sorted(set(f)) for c, f in zip(columns, found)}


def assign_buckets(df: DataFrame, splits: Mapping[str, Sequence[float]], suffix: str = "_bucket") -> DataFrame:
    """Add the range bucket of each column; a column without cut points gets bucket 0."""
    cut = [c for c, s in splits.items() if s]
    if cut:
        inf = float("inf")
        df = Bucketizer(
            inputCols=cut, outputCols=[c + suffix for c in cut],
            splitsArray=[[-inf, *splits[c], inf] for c in cut], handleInvalid="keep",
        ).transform(df)
    # never null: a null-check on the bucket would differ between the two users of the
    # grouped values and keep Spark from sharing their shuffle
    return df.withColumns(
        {c + suffix: F.coalesce(F.col(c + suffix).cast("int"), F.lit(-1)) if c in cut else F.lit(0) for c in splits}
    )


def running_totals(values: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, str],
                   bucket: str | None = None, descending: bool = False) -> DataFrame:
    """Add inclusive running sums ``{output: input}`` along ``order`` within ``by``.

    ``values`` has one row per (by, order). With ``bucket`` (a range bucket of
    ``order``) the window partitions are the buckets.
    """
    by = list(by)
    key = F.col(order).desc() if descending else F.col(order).asc()
    cells = by + ([bucket] if bucket else [])
    within = Window.partitionBy(*cells).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    if not bucket:
        return values.withColumns({out: F.sum(c).over(within) for out, c in sums.items()})
    before = Window.partitionBy(*by).orderBy(
        F.col(bucket).desc() if descending else F.col(bucket).asc()
    ).rowsBetween(Window.unboundedPreceding, -1)
    totals = values.groupBy(*cells).agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    offsets = totals.select(
        *cells,
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums],
    )
    shifted = values.join(offsets, cells)
    return shifted.withColumns(
        {out: F.sum(c).over(within) + F.col(f"_o_{out}") for out, c in sums.items()}
    ).drop(*[f"_o_{out}" for out in sums])
