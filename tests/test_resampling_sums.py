"""Bootstrap sums made many weights at a time, against the same weights as columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import resampling


def test_weights_equal_those_of_the_columns(spark):
    slots = np.array([0, 1, 2, 77, 123456789, resampling.PRIME - 2, resampling.PRIME - 1])
    made = {r: resampling.poisson_weights(r, r + 2, slots) for r in (1, 4999)}
    rows = spark.createDataFrame([(int(s), r) for s in slots for r in (1, 2, 3, 4999, 5000, 5001)], "slot long, rep long")
    for r in resampling.with_poisson_weight(rows).collect():
        first = 1 if r.rep < 10 else 4999
        assert made[first][r.rep - first, slots.tolist().index(r.slot)] == r.w
    draws = np.array(resampling._least_draws())
    assert all(a / resampling.PRIME >= s > (a - 1) / resampling.PRIME for a, s in zip(draws, resampling.POISSON_STEPS))


def test_sums_equal_those_of_the_columns(spark, monkeypatch):
    monkeypatch.setattr(resampling, "HELD", 2)
    rows = spark.range(0, 400, 1, 3).select(
        F.concat(F.lit("m"), F.col("id")).alias("match_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 2).cast("string").alias("h"),
        F.rand(5).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"), F.when(F.col("id") % 3 != 1, 1).alias("c")).cache()
    got = {(r.g, r.h, r.rep): (r.w, r.a, r.b, r.c) for r in resampling.replicate_sums(rows, ["g", "h"], ["a", "b", "c"], samples=30).collect()}
    plain = resampling.with_poisson_weight(rows.withColumn("slot", resampling.slot_of("match_id", "string")).withColumn(
        "rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long")))))
    want = {(r.g, r.h, r.rep): (r.w, r.a, r.b, r.c) for r in plain.groupBy("g", "h", "rep").agg(
        F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(v)).alias(v) for v in "abc"]).collect()}
    assert set(got) == set(want) and len(got) == 180
    for key, own in want.items():
        assert all((a is None) == (b is None) and (a is None or np.isclose(a, b)) for a, b in zip(got[key], own)), key


def test_a_replicate_without_a_draw_has_no_part(spark):
    """One match is not drawn by about a third of the replicates, as in the SQL these give no row."""
    one = spark.createDataFrame([(5, "a", "H", 0.5, 0.3, 0.2)], "match_id long, model string, result string, prob_home double, prob_draw double, prob_away double")
    sums = resampling.replicate_sums(one.withColumn("v", F.lit(2.0)), ["model"], ["v"], samples=200).collect()
    assert 90 < len(sums) < 160 and all(r.v == 2 * r.w > 0 for r in sums)
    row = resampling.bootstrap_metrics(one, samples=200).first()
    assert row.log_loss_mean == pytest.approx(-np.log(0.5))
