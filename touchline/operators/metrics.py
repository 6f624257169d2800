"""Scoring of forecasts: proper scores, calibration, class reports, stable result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.probability import PROBS, predicted_result, row_scores
from touchline.schema import CLASSES
from touchline.session import settle

MODEL = ["model"]


def model_metrics(predictions: DataFrame, keys: list = MODEL) -> DataFrame:
    """Accuracy, log loss, both Brier conventions and RPS per model."""
    return row_scores(predictions).groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.sum("correct") / F.count("*")).alias("accuracy"),
        F.avg("log_loss").alias("log_loss"),
        F.avg("brier").alias("brier_sum"),
        (F.avg("brier") / 3).alias("brier_mean"),
        F.avg("rps").alias("rps"),
    )


def class_rows(predictions: DataFrame, keys: list = MODEL) -> DataFrame:
    """One row per forecast and outcome: its probability and whether it happened."""
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(p).alias("p"), (F.col("result") == c).cast("long").alias("y"))
                     for c, p in zip(CLASSES, PROBS)])
    return predictions.select(*keys, F.inline(rows))


def equal_bin(p: Column, bins: int) -> Column:
    """Index of the equal-width bin, by comparison with the edges; 1 belongs to the last bin."""
    edges = [k * (1.0 / bins) for k in range(1, bins)]
    return sum(((p >= e).cast("int") for e in edges[1:]), (p >= edges[0]).cast("int"))


def calibration_error(predictions: DataFrame, bins: int = 10, keys: list = MODEL) -> DataFrame:
    """Expected calibration error, one-vs-rest, averaged over the three outcomes."""
    cells = class_rows(predictions, keys).groupBy(*keys, "class", equal_bin(F.col("p"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"))
    by_class = cells.groupBy(*keys, "class").agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("e"))
    return by_class.groupBy(*keys).agg(F.avg("e").alias("ece"))


def confusion(predictions: DataFrame, keys: list = MODEL) -> DataFrame:
    """All nine actual-by-predicted counts of each model, zeros included."""
    counts = predictions.withColumn("predicted", predicted_result()).groupBy(*keys).agg(
        *[F.sum(((F.col("result") == a) & (F.col("predicted") == p)).cast("long")).alias(f"{a}{p}")
          for a in CLASSES for p in CLASSES])
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"{a}{p}").alias("n"))
             for a in CLASSES for p in CLASSES]
    return counts.select(*keys, F.inline(F.array(*cells)))


def class_report(predictions: DataFrame, keys: list = MODEL) -> DataFrame:
    """Precision, recall, F1 (0 where undefined), support and predicted count per outcome."""
    cells = confusion(predictions, keys).groupBy(*keys).agg(*[
        F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(f"{c}_{what}")
        for c in CLASSES for what, cond in (
            ("hit", (F.col("actual") == c) & (F.col("predicted") == c)),
            ("support", F.col("actual") == c), ("predicted", F.col("predicted") == c))])
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"{c}_hit").alias("hit"), F.col(f"{c}_support").alias("support"),
                              F.col(f"{c}_predicted").alias("predicted_count")) for c in CLASSES])
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    hit, support, predicted = F.col("hit"), F.col("support"), F.col("predicted_count")
    return cells.select(*keys, F.inline(rows)).select(
        *keys, "class", part(hit, predicted).alias("precision"), part(hit, support).alias("recall"),
        part(2 * hit, support + predicted).alias("f1"), "support", "predicted_count")


def macro_f1(predictions: DataFrame, keys: list = MODEL) -> DataFrame:
    """Mean F1 over the outcomes that occur as actual or predicted."""
    seen = class_report(predictions, keys).where((F.col("support") > 0) | (F.col("predicted_count") > 0))
    return seen.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def draw_report(predictions: DataFrame, keys: list = MODEL) -> DataFrame:
    """How draws are treated; recall both as NULL without draws and as 0 without draws."""
    draw = F.col("result") == "D"
    called = predicted_result() == "D"
    hits, draws = F.sum((draw & called).cast("long")), F.sum(draw.cast("long"))
    return predictions.groupBy(*keys).agg(
        F.when(draws > 0, hits / draws).alias("draw_recall"),
        (hits / F.greatest(draws, F.lit(1))).alias("draw_recall_or_zero"),
        F.sum(called.cast("long")).alias("draw_predictions"),
        F.avg("prob_draw").alias("mean_prob_draw"))


def order_statistics(values: DataFrame, keys: list, ranks: DataFrame, bits: int = 12, levels: int = 3) -> DataFrame:
    """Values at the wanted 0-based ranks of each key, for values in [0, 1].

    ``ranks`` holds the keys and an array column ``ranks``. Radix selection: the range is cut into 2 ** ``bits`` slices, only
    slices that hold a wanted rank are kept and cut again, and after ``levels`` rounds the few values left are counted one by
    one. Slices are powers of two, so they nest exactly. A round shuffles counts of slices, never the values of a key.
    """
    held = ranks.select(*keys, F.explode("ranks").alias("rank")).withColumns({"slice": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    for level in range(1, levels + 2):
        outer = F.floor(F.col("p") * float(1 << bits * (level - 1))).cast("long") if level > 1 else F.lit(0).cast("long")
        finer = F.floor(F.col("p") * float(1 << bits * level)).cast("long") if level <= levels else F.col("p")
        held = settle(held)  # a row for each key and rank
        open_slices = held.select(*keys, "slice").distinct()
        cells = values.where("p is not null").withColumn("slice", outer).join(open_slices, [*keys, "slice"]).groupBy(*keys, "slice", finer.alias("finer")).agg(
            F.count("*").alias("n"))
        inside = Window.partitionBy(*keys, "slice").orderBy("finer")  # at most 2 ** bits rows, or the values of a last slice
        upto = cells.withColumn("upto", F.sum("n").over(inside))
        hit = (F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n"))
        held = upto.join(held, [*keys, "slice"]).where(hit).select(
            *keys, "rank", F.col("finer").alias("slice"), (F.col("before") + F.col("upto") - F.col("n")).alias("before"))
    return held.select(*keys, "rank", F.col("slice").alias("value"))


def reliability_curve(predictions: DataFrame, bins: int = 8, keys: list = MODEL) -> DataFrame:
    """Mean forecast and observed share in quantile bins, per outcome, with exact linear quantile edges."""
    group = keys + ["class"]
    rows = class_rows(predictions, keys)
    at = [F.col("n1") * k / bins for k in range(1, bins)]
    sizes = rows.groupBy(*group).agg((F.count("*") - 1).alias("n1"))
    ranks = sizes.withColumn("ranks", F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])))
    stats = order_statistics(rows, group, ranks.select(*group, "ranks"))
    points = stats.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))
    low = lambda x: F.element_at("v", F.floor(x).cast("long"))
    high = lambda x: F.element_at("v", F.ceil(x).cast("long"))
    edges = points.join(sizes, group).select(
        *group, F.array(*[low(x) + (high(x) - low(x)) * (x - F.floor(x)) for x in at]).alias("edges"))
    return (
        rows.join(edges, group)
        .groupBy(*group, F.size(F.filter("edges", lambda e: e < F.col("p"))).cast("long").alias("bin"))
        .agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed"))
    )


def registry(spark_df: DataFrame, names: list) -> DataFrame:
    """One row per registered model, whatever data exists."""
    return spark_df.sparkSession.createDataFrame([(n,) for n in names], "model string")


def stable_summary(predictions: DataFrame, names: list) -> DataFrame:
    """Metrics with one row per registered model; a model without rows is unavailable with NULL metrics."""
    return registry(predictions, names).join(model_metrics(predictions), "model", "left").withColumn(
        "available", F.col("n").isNotNull())


def stable_by_class(predictions: DataFrame, names: list) -> DataFrame:
    scaffold = registry(predictions, names).select("model", F.explode(F.array(*map(F.lit, CLASSES))).alias("class"))
    return scaffold.join(class_report(predictions), ["model", "class"], "left").withColumn(
        "available", F.col("support").isNotNull())


def stable_confusion(predictions: DataFrame, names: list) -> DataFrame:
    each = F.array(*map(F.lit, CLASSES))
    scaffold = registry(predictions, names).select("model", F.explode(each).alias("actual")).select(
        "model", "actual", F.explode(each).alias("predicted"))
    return scaffold.join(confusion(predictions), ["model", "actual", "predicted"], "left").withColumn(
        "available", F.col("n").isNotNull())
