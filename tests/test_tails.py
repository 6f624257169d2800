"""Tail probabilities against sums, integrals and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import tails


def test_binomial_tail_equals_exact_sum(spark):
    pairs = [(0, 0), (0, 5), (3, 5), (5, 5), (60, 100), (5300, 10000), (4600, 10000), (1, 10000)]
    rows = spark.createDataFrame(pairs, "h long, n long").withColumn("p", tails.binomial_at_least(F.col("h"), F.col("n"))).collect()
    for r in rows:
        exact = sum(math.comb(r.n, k) for k in range(r.h, r.n + 1)) / 2 ** r.n
        assert r.p == pytest.approx(exact, rel=1e-9, abs=1e-14)


def test_t_tail_equals_integral(spark):
    cases = [(t, v) for t in (-3.5, -0.2, 0.0, 1.0, 2.5, 6.0) for v in (1, 2, 7, 60, 20000)]
    for r in spark.createDataFrame(cases, "t double, v long").withColumn("p", tails.t_above(F.col("t"), F.col("v"))).collect():
        x = np.linspace(0, abs(r.t), 200001)
        log = math.lgamma((r.v + 1) / 2) - math.lgamma(r.v / 2) - math.log(r.v * math.pi) / 2
        y = np.exp(log - (r.v + 1) / 2 * np.log1p(x * x / r.v))
        area = np.trapezoid(y, x) if r.t else 0.0
        assert r.p == pytest.approx(0.5 - math.copysign(area, r.t), abs=1e-9)


def test_chi_square_tail_equals_poisson_sum(spark):
    cases = [(x, k) for x in (0.0, 0.5, 3.0, 20.0, 400.0) for k in (2, 4, 10, 38, 300)]
    for r in spark.createDataFrame(cases, "x double, k long").withColumn("p", tails.chi_square_above(F.col("x"), F.col("k"))).collect():
        half = r.x / 2
        exact = 1.0 if not half else sum(math.exp(-half + i * math.log(half) - math.lgamma(i + 1)) for i in range(r.k // 2))
        assert r.p == pytest.approx(exact, rel=1e-9, abs=1e-13)
    one = spark.range(1).select(tails.chi_square_above(F.lit(3.841458820694124), F.lit(1)).alias("p")).first().p
    assert one == pytest.approx(0.05, abs=1e-12)
