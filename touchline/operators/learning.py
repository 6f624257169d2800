"""Classifiers over the feature table: forward folds, forecasts, stacking, calibration, tuning.

All fits of a query are made together: logistic regressions advance in one job a step, trees grow in one job, a task for
each fit (``logistic``, ``trees``). Every model forecasts in the same single pass over the rows of its fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.probability import PROBS, row_scores
from touchline.operators import calibration, logistic, trees as grown
from touchline.operators.logistic import Logistic
from touchline.operators.trees import Boosted, Forest
from touchline.schema import CLASSES, FEATURE_COLUMNS
from touchline.session import settle

RATING_COLUMNS = ["home_elo_pre", "away_elo_pre", "elo_gap_pre"]
COLUMNS = list(FEATURE_COLUMNS) + RATING_COLUMNS
METHODS = ("sigmoid", "isotonic")
#: The least probability that is calibrated or comes of it; a forest can give 0.
LEAST = 1e-6


def modeling_table(features: DataFrame, home_ratings: DataFrame) -> DataFrame:
    """Features with the home view of the ratings, one row per match, and the coded label."""
    rows = features.join(home_ratings.select("match_id", *RATING_COLUMNS), "match_id", "left")
    code = F.when(F.col("result") == "H", 0.0).when(F.col("result") == "D", 1.0).otherwise(2.0)
    return rows.withColumn("label", code).withColumns({c: F.col(c).cast("double") for c in COLUMNS})


def _prepare(columns: list) -> list:
    filled = [f"{c}_f" for c in columns]
    return [Imputer(strategy="median", inputCols=columns, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def classifiers(trees: int = 350, rounds: int = 200) -> dict:
    """The models by name, with their default sizes."""
    return {"logistic_regression": Logistic(), "random_forest": Forest(trees=trees), "boosted_trees": Boosted(rounds=rounds)}


def prepared(train: DataFrame, columns: list = COLUMNS):
    """A fitted preparation (medians, one vector, standardised) that can be stored; it learns from ``train`` only."""
    return Pipeline(stages=_prepare(columns)).fit(train)


def trained(table: DataFrame, roles: DataFrame, key: str) -> DataFrame:
    """Every row of ``table`` that trains a fold, once, with the ``folds`` that it trains; ``roles`` gives (key, fold, part)."""
    own = roles.where("part = 'train'").groupBy(key).agg(F.sort_array(F.collect_list(F.col("fold").cast("long"))).alias("folds"))
    return table.join(settle(own), key)


def fit_folds(placed: DataFrame, models: dict, folds: list, columns: list = COLUMNS) -> dict:
    """{(fold, name): fitted} of every model on the rows of each fold whose ``part`` is train, or on the rows of ``trained``."""
    curves = {n: m for n, m in models.items() if isinstance(m, Logistic)}
    tree_models = {n: m for n, m in models.items() if n not in curves}
    made = logistic.fit_many(placed, curves, folds, columns) if curves else {}
    return made | (grown.fit_many(placed, tree_models, folds, columns) if tree_models else {})


def fit(train: DataFrame, models: dict, columns: list = COLUMNS) -> dict:
    """Models fitted on all rows of ``train``, as fold 0."""
    return fit_folds(train.drop("fold", "part").withColumns({"fold": F.lit(0), "part": F.lit("train")}), models, [0], columns)


def scored(rows: DataFrame, columns: list, keep: list, schema: str, score) -> DataFrame:
    """One pass over ``rows`` (with a ``fold``): ``score(fold, batch of keep columns, inputs)`` gives the columns of ``schema``."""
    held = rows.select(*keep, F.col("fold").cast("long").alias("_fold"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("_fold").to_numpy()
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, len(columns))
            own = batch.select(keep)
            for fold in np.unique(of).tolist():
                yield from score(fold, own.filter(pa.array(of == fold)), x[of == fold])

    return held.mapInArrow(run, schema)


def forecasts(fitted: dict, rows: DataFrame, keep: list, columns: list = COLUMNS) -> DataFrame:
    """Probabilities of every row by every model of its fold: ``keep``, model, and one column a class."""
    shared = rows.sparkSession.sparkContext.broadcast(fitted)  # numbers of the fitted models, bounded by their sizes

    def score(fold: int, own: pa.RecordBatch, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for (k, name), model in shared.value.items():
            if k == fold:
                p = model.probabilities(x)
                out = own.append_column("model", pa.array([name] * len(x), pa.string()))
                for j, column in enumerate(PROBS):
                    out = out.append_column(column, pa.array(p[:, j].copy()))
                yield out

    schema = ", ".join([rows.select(*keep).schema.toDDL(), "model string", *[f"{p} double" for p in PROBS]])
    return scored(rows, columns, keep, schema, score)


def forecast(fitted: dict, rows: DataFrame, keep: list, columns: list = COLUMNS) -> DataFrame:
    """Forecasts of models fitted by ``fit``."""
    return forecasts(fitted, rows.drop("fold").withColumn("fold", F.lit(0)), keep, columns)


def forward_forecasts(table: DataFrame, roles: DataFrame, key: str, models: dict, folds: list, columns: list = COLUMNS) -> DataFrame:
    """Out-of-fold forecasts of every model; ``roles`` gives (key, fold, part) and each fold trains on its past."""
    roles = settle(roles)
    fitted = fit_folds(trained(table, roles, key), models, folds, columns)
    return forecasts(fitted, table.join(roles.where("part = 'validation'"), key), ["match_id", "season", "match_date", "result", "fold"], columns)


def assert_out_of_fold(forecasts: DataFrame, placed: DataFrame) -> None:
    """No forecast row may belong to the training part of its own fold."""
    train = placed.where("part = 'train'").select("match_id", "fold")
    if forecasts.select("match_id", "fold").join(train, ["match_id", "fold"], "left_semi").limit(1).count():
        raise ValueError("a validation row was also a training row")


class RankedProbabilityEvaluator(Evaluator):
    """RPS of a fitted classifier's ``probability`` column against the coded label; smaller is better."""

    def _evaluate(self, dataset: DataFrame) -> float:
        p = vector_to_array("probability")
        rows = dataset.select(*[p[i].alias(n) for i, n in enumerate(PROBS)], F.when(F.col("label") == 0, "H").when(
            F.col("label") == 1, "D").otherwise("A").alias("result"))
        return row_scores(rows).agg(F.avg("rps")).first()[0]

    def isLargerBetter(self) -> bool:
        return False


def coefficient_table(model: logistic.Logit, columns: list, spark: SparkSession) -> DataFrame:
    """Coefficients of a multinomial model on standardised inputs, one row per class and input."""
    rows = [(c, name, float(model.weights[i, j])) for i, c in enumerate(CLASSES) for j, name in enumerate(columns)]
    return spark.createDataFrame(rows, "class string, input string, coefficient double")


def gradient_table(fitted: dict, spark: SparkSession) -> DataFrame:
    """(fold, model, rows, steps, gradient) of every logistic fit: how near its score equations are to 0."""
    rows = [(k, name, m.rows, m.steps, m.gradient) for (k, name), m in fitted.items() if isinstance(m, logistic.Logit)]
    return spark.createDataFrame(rows, "fold long, model string, rows long, steps int, gradient double")


def _curves(scores: DataFrame, names: list) -> dict:
    """{(method, fold, model, class): function of a probability}, fitted on held-out ``scores`` (fold, model, result, probabilities);
    all folds, models and classes are fitted side by side."""
    number = F.col("fold") * (3 * len(names)) + 3 * (F.array_position(F.array(*map(F.lit, names)), F.col("model")) - 1)
    parts = F.array(*[F.struct((number + j).alias("group"), F.col(p).alias("x"), (F.col("result") == c).cast("int").alias("y"))
                      for j, (c, p) in enumerate(zip(CLASSES, PROBS))])
    known = settle(scores.select(F.inline(parts)))
    of = lambda group: (group // (3 * len(names)), names[group // 3 % len(names)], group % 3)
    curves = {}
    for r in calibration.fit_sigmoid(known.withColumn("x", F.ln(F.greatest("x", F.lit(LEAST))))).collect():  # one row a group
        curves["sigmoid", *of(r.group)] = partial(calibration.sigmoid, slope=r.slope, shift=r.shift, least=LEAST)
    blocks = calibration.fit_isotonic(known).toArrow().to_pandas()  # few a group, see there
    for group, own in blocks.sort_values("low").groupby("group"):
        at, value = np.stack([own.low, own.high], 1).ravel(), np.repeat((own.total / own.weight).to_numpy(), 2)
        curves["isotonic", *of(group)] = partial(np.interp, xp=at, fp=value)
    return curves


def calibrated_forecasts(training: DataFrame, validation: DataFrame, check: DataFrame, models: dict, folds: list, keep: list,
                         columns: list = COLUMNS) -> DataFrame:
    """Forecasts of ``check`` by every model and method. A split has several inner folds (``fold`` // 100 is the split): each
    one's model is calibrated on its own ``validation`` rows (with a fold), each class by itself and renormalised, and the
    calibrated models of a split are averaged. ``check`` has its rows once, with their split; what the inner folds forecast for
    a row is made, calibrated and averaged where the row is."""
    fitted = fit_folds(training, models, folds, columns)
    names = list(models)
    curves = _curves(settle(forecasts(fitted, validation, ["result", "fold"], columns)), names)
    shared = check.sparkSession.sparkContext.broadcast((fitted, curves))

    def score(split: int, own: pa.RecordBatch, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        fits, lines = shared.value
        for name in names:
            raw = {k: fits[k, name].probabilities(x) for k in folds if k // 100 == split}
            for method in METHODS:
                mean = 0.0
                for k, p in raw.items():
                    c = np.maximum(np.stack([lines[method, k, name, j](p[:, j]) for j in range(3)], 1), LEAST)
                    mean = mean + c / c.sum(1, keepdims=True) / len(raw)
                mean /= mean.sum(1, keepdims=True)
                out = own.append_column("model", pa.array([name] * len(x), pa.string())).append_column("method", pa.array([method] * len(x), pa.string()))
                for j, column in enumerate(PROBS):
                    out = out.append_column(column, pa.array(mean[:, j].copy()))
                yield out

    rows = check.withColumnRenamed("split", "fold").withColumn("split", F.col("fold").cast("long"))
    schema = ", ".join([rows.select(*keep, "split").schema.toDDL(), "model string", "method string", *[f"{p} double" for p in PROBS]])
    return scored(rows, columns, [*keep, "split"], schema, score)


def staged_scores(fitted: dict, rows: DataFrame, stages: dict, columns: list = COLUMNS) -> DataFrame:
    """(fold, label, rps, n): mean RPS of every choice. ``stages`` gives {model: (sizes, depths, label of (size, depth))}; the
    sizes and depths of a model are read from its one fit, in one pass over the rows of its fold."""
    shared = rows.sparkSession.sparkContext.broadcast((fitted, stages))
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism  # a row costs far more to score than to move

    def score(fold: int, own: pa.RecordBatch, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        result = own.column("result").to_numpy(zero_copy_only=False)
        first, second = (result == CLASSES[0]).astype(float), np.isin(result, CLASSES[:2]).astype(float)
        fits, ways = shared.value
        for (k, name), model in fits.items():
            if k != fold:
                continue
            if name in ways:
                sizes, depths, labels = ways[name]
                made = {labels[key]: p for key, p in model.stages(x, sizes, depths).items()}
            else:
                made = {name: model.probabilities(x)}
            sums = [(((p[:, 0] - first) ** 2 + (p[:, 0] + p[:, 1] - second) ** 2) / 2).sum() for p in made.values()]
            yield pa.RecordBatch.from_pydict({"fold": pa.array([fold] * len(made), pa.int64()), "label": list(made), "total": sums,
                                              "n": pa.array([len(x)] * len(made), pa.int64())})

    parts = scored(rows.repartition(tasks), columns, ["result"], "fold long, label string, total double, n long", score)
    return parts.groupBy("fold", "label").agg((F.sum("total") / F.sum("n")).alias("rps"), F.sum("n").alias("n"))
