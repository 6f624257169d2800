"""Choosing a model by cross-validated scores, with guards against contaminated or stale folds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.folds import fold_differences, summarize_folds

RECORD = {"model", "fold", "last_train_season", "validation_season", "log_loss", "accuracy"}
IN_SAMPLE = "training rows only, in-sample (not out-of-fold)"


def guard_folds(stored: DataFrame, expected: DataFrame, holdout: str) -> None:
    """Refuse scores that saw the holdout season or come from other folds than today's."""
    if stored.where(F.col("validation_season") == holdout).limit(1).count():
        raise ValueError(f"selection scores contain the holdout season {holdout}")
    wrong = fold_differences(stored.select("fold", "last_train_season", "validation_season").distinct(), expected).limit(5).collect()
    if wrong:
        raise ValueError(f"selection scores come from other folds: {wrong}")


def guarded_or_in_sample(stored: DataFrame | None, expected: DataFrame, holdout: str, basis: str,
                         in_sample: Callable[[], DataFrame]) -> tuple[DataFrame, str | None]:
    """A track for ``selection_table``: stored fold scores that pass the guards, or scores of the fitted rows.

    Without a stored table, or with one that lacks a column the guards need, ``in_sample`` (model, log_loss,
    accuracy) is used and the basis is None. A stored table of other folds is an error, never replaced.
    """
    if stored is None or not RECORD.issubset(stored.columns):
        return in_sample(), None
    guard_folds(stored, expected, holdout)
    return stored, basis


def selection_table(tracks: dict) -> DataFrame:
    """Mean and deviation of fold scores per model; ``tracks`` maps a track to (fold scores, basis).

    A track whose basis is None holds one in-sample score per model: it has no deviation and says what it is.
    """
    parts = []
    for track, (scores, basis) in tracks.items():
        if basis is None:
            none = F.lit(None).cast("double")
            parts.append(scores.select(
                "model", F.lit(track).alias("track"), F.col("log_loss").alias("cv_log_loss_mean"), none.alias("cv_log_loss_std"),
                F.col("accuracy").alias("cv_accuracy_mean"), none.alias("cv_accuracy_std"), F.lit(IN_SAMPLE).alias("selection_basis")))
            continue
        mean = summarize_folds(scores, ["log_loss", "accuracy"])
        parts.append(mean.select(
            "model", F.lit(track).alias("track"), *[F.col(f"{m}_{s}").alias(f"cv_{m}_{s}") for m in ("log_loss", "accuracy") for s in ("mean", "std")],
            F.concat(F.lit(f"{basis}, "), F.col("folds"), F.lit(" folds (out-of-sample)")).alias("selection_basis")))
    return reduce(DataFrame.unionByName, parts)


def select_best_model(table: DataFrame, candidates: list, by_accuracy: bool = True) -> DataFrame:
    """Smallest log loss, then largest accuracy, then name; a missing candidate or metric is an error."""
    rows = table.where(F.col("model").isin(candidates))
    state = rows.agg(F.collect_set("model").alias("seen"), F.sum((F.col("cv_log_loss_mean").isNull() | F.col("cv_accuracy_mean").isNull()).cast("int")).alias("nulls")).first()
    missing = sorted(set(candidates) - set(state["seen"]))
    if missing or state["nulls"]:
        raise ValueError(f"candidates without usable metrics: {missing}, rows with NULL metrics: {state['nulls']}")
    order = [F.asc("cv_log_loss_mean")] + ([F.desc("cv_accuracy_mean")] if by_accuracy else []) + [F.asc("model")]
    return rows.orderBy(*order).limit(1)


def metric_label(basis: str = "selection_basis", value: str = "cv_log_loss_mean") -> Column:
    """Wording that says whether the number is out-of-sample."""
    inside = F.lower(basis).rlike("in-sample|not out-of-fold")
    number = F.format_string("%.6f", F.col(value))
    return F.when(F.col(value).isNull(), F.lit("no metric available")).when(
        inside, F.concat(F.lit("In-sample log loss (not out-of-fold): "), number)).otherwise(F.concat(F.lit("CV log loss: "), number))
