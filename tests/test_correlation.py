from itertools import combinations

import numpy as np
import pytest

from ledgerlens.operators import correlation

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table():
    """Ties, a value held by half of the rows, NaN, an infinity, -0.0 and nulls."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)).round(1)
    x[rng.random(400) < 0.5, 0] = 0.0
    x[::31, 0], x[::29, 1], x[7, 1] = -0.0, np.nan, np.inf
    x[:, 3] = 1.0
    nulls = rng.random(x.shape) < 0.05
    return x, nulls


def ranks(v):
    """Average ranks from 1, NaN last."""
    return np.array([np.sum(v < u) + (np.sum(v == u) + 1) / 2 if u == u else np.sum(~np.isnan(v)) + (np.sum(np.isnan(v)) + 1) / 2 for u in v])


def rows_of(spark, table):
    x, nulls = table
    rows = [[None if n else float(v) for v, n in zip(r, m)] for r, m in zip(x, nulls)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in NAMES)).repartition(3)


@pytest.mark.parametrize("buckets", [1, 6, None])
def test_pairs_of_rows_are_counted_as_by_comparing_all(spark, table, buckets):
    x, nulls = table
    out = correlation.kendall_counts(rows_of(spark, table), NAMES, buckets)
    got = {r.pair: list(r)[1:] for r in out.collect()}
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        both = ~nulls[:, i] & ~nulls[:, j]
        a, b = (ranks(x[both, c]) for c in (i, j))
        l, r = np.triu_indices(len(a), 1)
        sa, sb = np.sign(a[l] - a[r]), np.sign(b[l] - b[r])
        assert got[k] == [both.sum(), (sa * sb < 0).sum(), (sa == 0).sum(), (sb == 0).sum(), ((sa == 0) & (sb == 0)).sum()]


def test_no_row_is_copied_for_its_bits(spark, table):
    plan = correlation.kendall_counts(rows_of(spark, table), NAMES)._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_kendall_of_constant_and_empty_columns(spark, table):
    got = {(r.x, r.y): r.r for r in correlation.kendall(rows_of(spark, table), NAMES, 4).collect()}
    assert len(got) == 6 and got["a", "d"] is None and got["a", "b"] is not None
    assert [r.r for r in correlation.kendall(rows_of(spark, table).limit(0), ["a", "b"]).collect()] == [None]


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 77):
        r = rng.integers(0, 20, n)
        assert correlation.inversions(r) == sum(int(r[i] > r[j]) for i, j in combinations(range(n), 2))


@pytest.mark.parametrize("buckets", [1, 6, None])
def test_ranks_need_no_join(spark, table, buckets):
    x, _ = table
    df = rows_of(spark, (x, np.zeros(x.shape, bool)))
    out = correlation.with_ranks(df, NAMES, buckets)
    plan = out._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted(tuple(r) for r in out.collect()) == sorted(map(tuple, np.column_stack([ranks(x[:, c]) for c in range(4)])))
