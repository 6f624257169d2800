"""Forward-only folds over seasons and over match dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.schema import DATE_SPLITS, MIN_TRAIN_SEASONS


def _ranked_seasons(matches: DataFrame, holdout: str) -> DataFrame:
    """Training seasons with their 1-based order; one row per season."""
    seasons = matches.where(F.col("season") != holdout).select("season").distinct()
    everything = Window.partitionBy(F.lit(1))
    return seasons.select("season", F.row_number().over(everything.orderBy("season")).alias("r"),
                          F.count("*").over(everything).alias("n"))


def season_folds(matches: DataFrame, holdout: str, minimum: int = MIN_TRAIN_SEASONS) -> DataFrame:
    """Expanding folds: each training season after the first ``minimum`` validates once."""
    seasons = _ranked_seasons(matches, holdout)
    previous = F.lag("season").over(Window.partitionBy(F.lit(1)).orderBy("season"))
    return seasons.withColumn("last_train_season", previous).where(F.col("r") > minimum).select(
        (F.col("r") - minimum).cast("long").alias("fold"), "last_train_season", F.col("season").alias("validation_season"))


def season_membership(matches: DataFrame, holdout: str, minimum: int = MIN_TRAIN_SEASONS) -> DataFrame:
    """(season, fold, part): which folds a season trains and which it validates."""
    r, folds = F.col("r"), F.col("n") - minimum
    first = F.greatest(F.lit(1), r - minimum + 1)
    train = F.when(first <= folds, F.sequence(first, folds)).otherwise(F.array().cast("array<int>"))
    roles = F.transform(train, lambda f: F.struct(f.cast("long").alias("fold"), F.lit("train").alias("part")))
    check = F.when(r > minimum, F.array(F.struct((r - minimum).cast("long").alias("fold"), F.lit("validation").alias("part"))))
    return _ranked_seasons(matches, holdout).select(
        "season", F.inline(F.concat(roles, F.coalesce(check, F.array().cast("array<struct<fold:bigint,part:string>>")))))


def date_membership(matches: DataFrame, splits: int = DATE_SPLITS) -> DataFrame:
    """(match_date, fold, part) for ``splits`` expanding folds over the distinct dates, one row per calendar day."""
    everything = Window.partitionBy(F.lit(1))
    days = matches.select("match_date").distinct().select(
        "match_date", (F.row_number().over(everything.orderBy("match_date")) - 1).alias("r"),
        F.count("*").over(everything).alias("d"))
    size = F.floor(F.col("d") / (splits + 1))
    start = lambda k: F.col("d") - (splits - k + 1) * size
    roles = F.array(*[
        F.struct(F.lit(k).cast("long").alias("fold"), F.when(F.col("r") < start(k), "train").when(
            F.col("r") < start(k) + size, "validation").alias("part")) for k in range(1, splits + 1)])
    return days.select("match_date", F.inline(F.filter(roles, lambda x: x["part"].isNotNull())))


def summarize_folds(results: DataFrame, metrics: list, keys: list | None = None) -> DataFrame:
    """Mean and sample deviation of each metric over folds."""
    keys = keys or ["model"]
    return results.groupBy(*keys).agg(
        F.countDistinct("fold").alias("folds"),
        *[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def compare_folds(results: DataFrame, baseline: str, metric: str = "log_loss", keys: list | None = None) -> DataFrame:
    """Per-fold difference of each model to the baseline: mean, deviation, folds won."""
    keys = keys or []
    base = results.where(F.col("model") == baseline).select(*keys, "fold", F.col(metric).alias("base"))
    delta = F.col(metric) - F.col("base")
    return results.where(F.col("model") != baseline).join(base, keys + ["fold"]).groupBy(*keys, "model").agg(
        F.count("*").alias("folds"), F.avg(delta).alias("delta_mean"), F.stddev_samp(delta).alias("delta_std"),
        F.sum((delta < 0).cast("long")).alias("folds_better"))


def best_decay(results: DataFrame, metric: str = "log_loss") -> DataFrame:
    """The decay with the smallest mean metric per model; the smaller decay wins a tie."""
    means = results.groupBy("model", "xi").agg(F.avg(metric).alias("mean"))
    return means.groupBy("model").agg(
        F.min_by("xi", F.struct(F.round("mean", 9), "xi")).alias("best_xi"), F.min("mean").alias(f"best_{metric}"))


def fold_pairs(results: DataFrame) -> DataFrame:
    return results.select("fold", "last_train_season", "validation_season").dropDuplicates()


def fold_differences(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Folds that are stored but not expected (stale) and expected but not stored (missing)."""
    pairs = ["fold", "last_train_season", "validation_season"]
    stale = stored.select(*pairs).subtract(expected.select(*pairs)).withColumn("problem", F.lit("stale"))
    missing = expected.select(*pairs).subtract(stored.select(*pairs)).withColumn("problem", F.lit("missing"))
    return stale.unionByName(missing)
