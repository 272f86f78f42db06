"""Tail probabilities as column expressions, for the few rows a test ends in."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _series(first: Column, terms: Column, factor) -> Column:
    """first + first*factor(1) + first*factor(1)*factor(2) + ... (``terms`` further terms)."""
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(acc, j):
        term = acc["term"] * factor(j)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, add)["total"]


def student_t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for whole degrees of freedom, by the finite trigonometric sums."""
    df = df.cast("int")
    angle = F.atan(F.abs(t) / F.sqrt(df))
    cos, sin = F.cos(angle), F.sin(angle)
    even = sin * _series(F.lit(1.0), (df / 2 - 1).cast("int"), lambda j: (2 * j - 1) / (2 * j) * cos * cos)
    tail = sin * _series(cos, ((df - 3) / 2).cast("int"), lambda j: (2 * j) / (2 * j + 1) * cos * cos)
    odd = (angle + F.when(df > 1, tail).otherwise(0.0)) * (2 / math.pi)
    inside = F.when(df % 2 == 0, even).otherwise(odd)
    return F.greatest(F.lit(1.0) - inside, F.lit(0.0))


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail by the complementary error function (continued fraction for
    large, series for small arguments)."""
    x = F.abs(z) / math.sqrt(2)
    # erf series: 2/sqrt(pi) * sum (-1)^k x^(2k+1) / (k! (2k+1))
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(acc, k):
        term = acc["term"] * (-x * x) / k
        return F.struct(term.alias("term"), (acc["total"] + term / (2 * k + 1)).alias("total"))

    erf = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add)["total"] * (2 / math.sqrt(math.pi))
    fraction = F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), x, lambda acc, k: x + (k / 2.0) / acc)
    far = F.exp(-x * x) / (fraction * math.sqrt(math.pi))
    return F.when(x < 2, 1 - erf).otherwise(far)


def kolmogorov(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    size = F.sqrt(n.cast("double") * m / (n + m))
    x = (size + 0.12 + 0.11 / size) * statistic
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)))


def _at(values: Column, index: Column) -> Column:
    return F.coalesce(F.get(values, index), F.lit(0.0))


def signed_rank_exact(w: Column, n: Column) -> Column:
    """Exact two-sided Wilcoxon p-value: subsets of 1..n counted by their sum."""
    top = (n * (n + 1) / 2).cast("int")
    sums = F.sequence(F.lit(0), top)
    start = F.transform(sums, lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")), start,
        lambda acc, r: F.transform(acc, lambda c, s: c + F.when(s >= r, _at(acc, s - r)).otherwise(0.0)),
    )
    low = F.least(w, top - w)
    below = F.aggregate(F.slice(ways, 1, F.floor(low).cast("int") + 1), F.lit(0.0), lambda a, c: a + c)
    return F.least(2.0 * below / F.pow(F.lit(2.0), n), F.lit(1.0))


def rank_sum_exact(u: Column, n: Column, m: Column) -> Column:
    """Exact two-sided Mann-Whitney p-value without ties: ways to choose n of n+m ranks,
    by number chosen and rank sum in one flat array."""
    n, m = n.cast("int"), m.cast("int")
    all_ = n + m
    width = (all_ * (all_ + 1) / 2).cast("int") + 1
    cells = F.sequence(F.lit(0), (n + 1) * width - 1)
    start = F.transform(cells, lambda i: F.when(i == 0, 1.0).otherwise(0.0))

    def take(acc, r):
        return F.transform(
            acc,
            lambda c, i: c + F.when((i >= width) & (i % width >= r), _at(acc, i - width - r)).otherwise(0.0),
        )

    ways = F.aggregate(F.sequence(F.lit(1), all_), start, take)
    chosen = F.slice(ways, n * width + 1, width)
    floor_sum = (n * (n + 1) / 2).cast("int")
    low = F.least(u, n * m - u)
    below = F.aggregate(F.slice(chosen, 1, F.floor(low).cast("int") + floor_sum + 1), F.lit(0.0), lambda a, c: a + c)
    every = F.aggregate(chosen, F.lit(0.0), lambda a, c: a + c)
    return F.least(2.0 * below / every, F.lit(1.0))
