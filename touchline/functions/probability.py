"""Column expressions over home/draw/away probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBS = ("prob_home", "prob_draw", "prob_away")


def normalize(df: DataFrame, columns: tuple = PROBS) -> DataFrame:
    """Scale each row of probabilities to sum 1; a row without any mass is an error."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    safe = F.when(total > 0, total).otherwise(F.raise_error(F.lit("probabilities of a row sum to zero")))
    return df.withColumns({c: F.col(c) / safe for c in columns})


def predicted_result(columns: tuple = PROBS) -> Column:
    h, d, a = (F.col(c) for c in columns)
    return F.when((h >= d) & (h >= a), "H").when(d >= a, "D").otherwise("A")


def with_draw_prior(df: DataFrame, factor) -> DataFrame:
    """Multiply the draw probability and renormalise the row."""
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return normalize(df.withColumn("prob_draw", F.col("prob_draw") * factor))


def decode_odds(df: DataFrame, odds: tuple, out: tuple = PROBS, margin: str = "overround") -> DataFrame:
    """Multiplicative overround removal; odds that are NULL or not above 1 are an error."""
    bad = sum(((F.col(c).isNull() | (F.col(c) <= 1)).cast("int") for c in odds[1:]),
              (F.col(odds[0]).isNull() | (F.col(odds[0]) <= 1)).cast("int"))
    inverse = [F.lit(1.0) / F.col(c) for c in odds]
    total = F.when(bad == 0, inverse[0] + inverse[1] + inverse[2]).otherwise(
        F.raise_error(F.lit("decimal odds must be above 1")))
    return df.withColumn("_total", total).withColumns(
        {name: i / F.col("_total") for name, i in zip(out, inverse)} | {margin: F.col("_total") - 1}).drop("_total")


def log_loss(columns: tuple = PROBS, result: str = "result") -> Column:
    h, d, a = (F.col(c) for c in columns)
    p = F.when(F.col(result) == "H", h).when(F.col(result) == "D", d).otherwise(a)
    return -F.ln(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0)))


def row_scores(df: DataFrame, columns: tuple = PROBS, result: str = "result") -> DataFrame:
    """Losses of each forecast row: ranked probability, Brier over classes, log loss, hit."""
    h, d, a = (F.col(c) for c in columns)
    is_ = lambda c: (F.col(result) == c).cast("double")
    first, second = h - is_("H"), (h + d) - (is_("H") + is_("D"))
    return df.withColumns({
        "rps": (first * first + second * second) / 2,
        "brier": (h - is_("H")) * (h - is_("H")) + (d - is_("D")) * (d - is_("D")) + (a - is_("A")) * (a - is_("A")),
        "log_loss": log_loss(columns, result),
        "correct": (predicted_result(columns) == F.col(result)).cast("long"),
    })
