"""Combining the forecasts of several models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.probability import PROBS, normalize, row_scores, with_draw_prior


def meta_features(predictions: DataFrame, models: list) -> DataFrame:
    """One row per match with three columns per model; the fixed model list spares a discovery job."""
    wide = predictions.groupBy("match_id").pivot("model", models).agg(*[F.max(p).alias(p) for p in PROBS])
    return wide.select("match_id", *[f"{m}_{p}" for m in models for p in PROBS])


def simple_average(predictions: DataFrame, keys: list) -> DataFrame:
    """Mean probability over models, renormalised."""
    return normalize(predictions.groupBy(*keys).agg(*[F.avg(p).alias(p) for p in PROBS]))


def gap_to_benchmark(summary: DataFrame, benchmark: str, earlier_rps_gap: float) -> DataFrame:
    """Distance of each model's scores to the benchmark row, and its change since an earlier state."""
    pick = summary.where(F.col("model") == benchmark).select(
        F.lit(True).alias("one"), F.col("log_loss").alias("b_log_loss"), F.col("rps").alias("b_rps"))
    rows = summary.where(F.col("model") != benchmark).withColumn("one", F.lit(True)).join(pick, "one")
    gap = F.col("rps") - F.col("b_rps")
    return rows.select("model", (F.col("log_loss") - F.col("b_log_loss")).alias("log_loss_gap"), gap.alias("rps_gap"),
                       (gap - earlier_rps_gap).alias("rps_gap_change"))


def draw_prior_search(predictions: DataFrame, factors: tuple, keys: list | None = None) -> DataFrame:
    """RPS of every model under every draw factor, in one pass over the forecasts."""
    keys = keys or ["model"]
    rows = predictions.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    return row_scores(with_draw_prior(rows, F.col("factor"))).groupBy(*keys, "factor").agg(F.round(F.avg("rps"), 9).alias("rps"))
