"""Tail probabilities against published values."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import pvalues


def value(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize("t,df,p", [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.776, 4, 0.05), (2.306, 8, 0.05), (2.262, 9, 0.05), (0.0, 5, 1.0)])
def test_student(spark, t, df, p):
    assert value(spark, pvalues.student_t_two_sided(F.lit(t), F.lit(df))) == pytest.approx(p, abs=1e-4)


@pytest.mark.parametrize("z,p", [(0.0, 1.0), (1.0, 0.317311), (1.959964, 0.05), (3.290527, 0.001), (5.0, 5.7330e-7)])
def test_normal(spark, z, p):
    assert value(spark, pvalues.normal_two_sided(F.lit(z))) == pytest.approx(p, rel=1e-4)


def test_exact_rank_tests(spark):
    assert value(spark, pvalues.signed_rank_exact(F.lit(0.0), F.lit(5))) == pytest.approx(0.0625)
    assert value(spark, pvalues.signed_rank_exact(F.lit(3.0), F.lit(6))) == pytest.approx(0.15625)
    assert value(spark, pvalues.rank_sum_exact(F.lit(25.0), F.lit(5), F.lit(5))) == pytest.approx(2 / 252)
    assert value(spark, pvalues.rank_sum_exact(F.lit(6.0), F.lit(3), F.lit(4))) == pytest.approx(1.0)


def test_kolmogorov(spark):
    assert value(spark, pvalues.kolmogorov(F.lit(0.0), F.lit(10), F.lit(10))) == 1.0
    p = value(spark, pvalues.kolmogorov(F.lit(0.0192), F.lit(10000), F.lit(10000)))
    assert p == pytest.approx(0.05, abs=0.003)
