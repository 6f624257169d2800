"""Classifier queries.

All models with the operators' default trees and rounds, over all folds; the fits of a query run side by side.
"""

from functools import reduce
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from touchline.functions.probability import PROBS
from touchline.operators import blending, counts, folds, grids, learning as ml, ratings, walkforward as wf
from touchline.operators.features import generate_features
from touchline.operators.logistic import TOLERANCE, Logistic
from touchline.operators.metrics import draw_report, model_metrics
from touchline.operators.trees import Boosted, Forest
from touchline.plans.metrics import rounded
from touchline.plans.ratings import rated_matches
from touchline.plans.registry import query
from touchline.schema import DATE_SPLITS
from touchline.session import settle
from touchline.sources import files
from touchline.sources.derived import HOLDOUT_SEASON, load_matches

#: Inner date folds of a calibrated model.
INNER_SPLITS = 3
KEEP = ["match_id", "season", "result"]


def _table(spark, d):
    m, _, done = rated_matches(spark, d)
    home = ratings.rating_history(done).where("venue = 'home'").select(
        "match_id", F.col("elo_pre").alias("home_elo_pre"), F.col("opponent_elo_pre").alias("away_elo_pre"),
        F.col("elo_gap_pre"))
    return m, settle(ml.modeling_table(generate_features(m), home))


def _split(table):
    return table.where(F.col("season") != HOLDOUT_SEASON), table.where(F.col("season") == HOLDOUT_SEASON)


def _models(*names):
    every = ml.classifiers()
    return {n: every[n] for n in names or every}


def _holdout(spark, d, name):
    train, holdout = _split(_table(spark, d)[1])
    return rounded(ml.forecast(ml.fit(train, _models(name)), holdout, KEEP).drop("model"), 6)


@query("m17_logistic_regression")
def _(spark, d):
    return _holdout(spark, d, "logistic_regression")


@query("m18_random_forest")
def _(spark, d):
    return _holdout(spark, d, "random_forest")


@query("m19_boosted_trees")
def _(spark, d):
    return _holdout(spark, d, "boosted_trees")


def _date_folds(spark, d, *names):
    _, table = _table(spark, d)
    train, holdout = _split(table)
    roles = folds.date_membership(train)
    return train, holdout, settle(ml.forward_forecasts(train, roles, "match_date", _models(*names), list(range(1, DATE_SPLITS + 1))))


@query("m20_date_fold_cv")
def _(spark, d):
    *_, rows = _date_folds(spark, d)
    scores = model_metrics(rows, ["model", "fold"])
    return rounded(folds.summarize_folds(scores, ["log_loss", "accuracy", "rps"]).orderBy("log_loss_mean", "model"), 6)


@query("k3_best_cv_model")
def _(spark, d):
    *_, rows = _date_folds(spark, d)
    best = folds.summarize_folds(model_metrics(rows, ["model", "fold"]), ["log_loss"]).orderBy("log_loss_mean", "model").limit(1)
    return rounded(best, 6)


@query("v4_v11_classifier_checks", """WITH days AS (SELECT match_date, row_number() OVER (ORDER BY match_date) - 1 AS r, count(*) OVER () AS d
  FROM (SELECT DISTINCT match_date FROM matches WHERE season <> '2001')),
cut AS (SELECT k AS fold, match_date FROM days, generate_series(1, 5) AS g(k)
  WHERE r >= d - (6 - k) * (d // 6) AND r < d - (5 - k) * (d // 6))
SELECT fold, model, count(*) AS n, CAST(0 AS BIGINT) AS bad_sum FROM matches m JOIN cut USING (match_date),
  (VALUES ('logistic_regression'), ('random_forest'), ('boosted_trees')) AS t(model) WHERE m.season <> '2001' GROUP BY ALL""")
def _(spark, d):
    train, _, rows = _date_folds(spark, d)
    ml.assert_out_of_fold(rows, train.join(folds.date_membership(train), "match_date"))
    total = F.col("prob_home") + F.col("prob_draw") + F.col("prob_away")
    return rows.groupBy("fold", "model").agg(F.count("*").alias("n"), F.sum((F.abs(total - 1) > 1e-6).cast("long")).alias("bad_sum"))


@query("m17_score_equations", """WITH days AS (SELECT match_date, row_number() OVER (ORDER BY match_date) - 1 AS r, count(*) OVER () AS d
  FROM (SELECT DISTINCT match_date FROM matches WHERE season <> '2001')),
cut AS (SELECT k AS fold, match_date FROM days, generate_series(1, 5) AS g(k) WHERE r < d - (6 - k) * (d // 6))
SELECT fold, count(*) AS rows, true AS settled FROM matches m JOIN cut USING (match_date) WHERE m.season <> '2001' GROUP BY fold""")
def _(spark, d):
    """Whether the logistic fit of each date fold solves its score equations (largest slope of the penalised mean loss)."""
    train, _ = _split(_table(spark, d)[1])
    placed = ml.trained(train, folds.date_membership(train), "match_date")
    fitted = ml.fit_folds(placed, _models("logistic_regression"), list(range(1, DATE_SPLITS + 1)))
    return ml.gradient_table(fitted, spark).select("fold", "rows", (F.col("gradient") <= TOLERANCE).alias("settled"))


@query("m22_season_walk_forward_classifiers")
def _(spark, d):
    _, table = _table(spark, d)
    roles = folds.season_membership(table, "none", 4)  # no holdout: the last fold is the holdout season, report only
    n = folds.season_folds(table, "none", 4).count()
    rows = ml.forward_forecasts(table, roles, "season", _models(), list(range(1, n + 1)))
    return rounded(model_metrics(rows, ["model", "fold"]).join(draw_report(rows, ["model", "fold"]), ["model", "fold"]), 6)


GOAL_INPUTS = [f"{fit}_expected_{side}" for fit in ("goals", "joint") for side in ("home", "away")]


@query("m24_expected_goal_inputs", """WITH days AS (SELECT match_date, row_number() OVER (ORDER BY match_date) - 1 AS r, count(*) OVER () AS d
  FROM (SELECT DISTINCT match_date FROM matches)),
cut AS (SELECT k AS fold, match_date FROM days, generate_series(1, 5) AS g(k) WHERE r >= d - (6 - k) * (d // 6) AND r < d - (5 - k) * (d // 6))
SELECT match_id, CAST(fold AS BIGINT) AS fold, 4 AS inputs FROM matches JOIN cut USING (match_date)""")
def _(spark, d):
    """Which matches have out-of-fold expected goals, from which date fold, and how many of the four inputs are positive numbers."""
    m = settle(load_matches(spark, d))
    rows = wf.expected_goal_inputs(m, settle(folds.date_membership(m)))
    usable = sum(F.when((F.col(c) > 0) & (F.col(c) < float("inf")), 1).otherwise(0) for c in GOAL_INPUTS)
    return rows.select("match_id", F.col("fold").cast("bigint").alias("fold"), usable.alias("inputs"))


@query("m24_j11_expected_goal_features")
def _(spark, d):
    """Out-of-fold expected goals of the goal model and of its joint fit with the low-score dependence on date folds: four
    extra inputs, against the same forest without, on every season fold of the matches that have them."""
    m, table = _table(spark, d)
    expected = wf.expected_goal_inputs(m, settle(folds.date_membership(m)))
    covered = settle(table.join(expected.drop("fold"), "match_id"))
    inner = folds.season_membership(covered, "none", 1)
    n = folds.season_folds(covered, "none", 1).count()
    parts = []
    for name, columns in (("random_forest", ml.COLUMNS), ("random_forest_expected_goals", ml.COLUMNS + GOAL_INPUTS)):
        forest = _models("random_forest")["random_forest"]
        parts.append(ml.forward_forecasts(covered, inner, "season", {name: forest}, list(range(1, n + 1)), columns))
    return rounded(model_metrics(parts[0].unionByName(parts[1]), ["model", "fold"]), 6)


def base_forecasts(spark, d, holdout=HOLDOUT_SEASON):
    """Out-of-fold forecasts of all base models on the season folds, labels by match."""
    m, table = _table(spark, d)
    roles = settle(folds.season_membership(m, holdout))
    fold_list = _fold_numbers(roles)
    columns = ["match_id", "season", "result", "fold", "model", *PROBS]
    goals = wf.walk_forward(m, holdout, {"poisson": ("goals",), "shots_on_target": wf.VARIANTS["shots_on_target"]})
    rates = wf.fold_rates(m, roles, ("goals",))
    train = m.join(roles.where("part = 'train'").select("season", "fold"), "season")
    rho = counts.low_score_correlation(train, rates).select("competition", "fold", "rho")
    validation = m.join(roles.where("part = 'validation'").select("season", "fold"), "season")
    low = grids.outcome_probabilities(counts.expected_counts(validation, rates).join(rho, ["competition", "fold"])).withColumn("model", F.lit("dixon_coles"))
    elo = ratings.rating_probabilities(ratings.rate(m.where(F.col("season") != holdout)).where("kind = 'match'")).join(
        roles.where("part = 'validation'").select("season", "fold"), "season").withColumn("model", F.lit("elo"))
    learned = ml.forward_forecasts(table, roles, "season", _models(), fold_list)
    rows = goals.select(*columns)
    for part in (low, elo, learned):
        rows = rows.unionByName(part.select(*columns))
    return settle(rows)


BASE = ["poisson", "dixon_coles", "elo", "logistic_regression", "random_forest", "boosted_trees", "shots_on_target"]


@query("m25_base_forecasts")
def _(spark, d):
    return rounded(base_forecasts(spark, d), 6)


def _blend(spark, d, holdout=HOLDOUT_SEASON):
    """Base forecasts, and one row per match with all of them as inputs."""
    rows = base_forecasts(spark, d, holdout)
    wide = blending.meta_features(rows, BASE)
    columns = [c for c in wide.columns if c != "match_id"]
    labels = rows.select("match_id", "season", "result", "fold").distinct()
    table = settle(wide.join(labels, "match_id").withColumn("label", F.when(F.col("result") == "H", 0.0).when(F.col("result") == "D", 1.0).otherwise(2.0)))
    return rows, table, columns


def _scored_blend(rows, table, columns, fold_list, keys):
    """Scores of the base models, their average and the meta-learner, which learns from the folds before each."""
    keep = [*KEEP, "fold"]
    later = F.explode(F.sequence(F.col("fold") + 1, F.lit(max(fold_list))))  # the folds that a row trains
    past = table.where(F.col("fold") < max(fold_list)).withColumn("next", later).drop("fold").withColumnsRenamed({"next": "fold"})
    placed = past.where(F.col("fold").isin(fold_list)).withColumn("part", F.lit("train"))
    fitted = ml.fit_folds(placed, {"meta_learner": _models("logistic_regression")["logistic_regression"]}, fold_list, columns)
    meta = ml.forecasts(fitted, table.where(F.col("fold").isin(fold_list)), keep, columns)
    seen = rows.where(F.col("fold").isin(fold_list)).select(*keep, "model", *PROBS)
    mean = blending.simple_average(seen, keep).withColumn("model", F.lit("simple_average"))
    for part in (meta, mean):
        seen = seen.unionByName(part.select(*keep, "model", *PROBS))
    return rounded(model_metrics(seen, keys), 6)


def _fold_numbers(table):
    return [r[0] for r in table.select("fold").distinct().orderBy("fold").collect()]  # one number per fold


@query("m27_meta_learner")
def _(spark, d):
    """Second-level walk-forward: every fold but the first is scored."""
    rows, table, columns = _blend(spark, d)
    return _scored_blend(rows, table, columns, _fold_numbers(table)[1:], ["model", "fold"])


@query("m27_meta_coefficients")
def _(spark, d):
    """Coefficients of the meta-learner fitted on all out-of-fold forecasts."""
    _, table, columns = _blend(spark, d)
    fitted = ml.fit(table, _models("logistic_regression"), columns)
    return rounded(ml.coefficient_table(fitted[0, "logistic_regression"], columns, spark), 6)


def _calibration_splits(train, holdout):
    """(inner, outer, ahead): days of the inner folds of every split (0 is the holdout, else a date fold), days of the plain refit
    of every split, and the rows to forecast, once, with their split."""
    day, past = settle(train.select("match_date").distinct()), []
    outer = settle(folds.date_membership(day).where(F.col("fold") <= DATE_SPLITS))
    for split in range(DATE_SPLITS + 1):
        own = day if split == 0 else outer.where((F.col("fold") == split) & (F.col("part") == "train")).select("match_date")
        past.append(folds.date_membership(own, INNER_SPLITS).withColumn("fold", F.col("fold") + 100 * split))
    ahead = train.join(outer.where("part = 'validation'").select("match_date", F.col("fold").alias("split")), "match_date").unionByName(
        holdout.withColumn("split", F.lit(0).cast("long")))
    whole = day.select("match_date", F.lit(0).cast("long").alias("fold"), F.lit("train").alias("part"))
    return settle(reduce(DataFrame.unionByName, past)), outer.where("part = 'train'").unionByName(whole), ahead


def calibration_rows(spark, d):
    """Raw, sigmoid and isotonic forecasts of every classifier, on all date folds (splits 1 and up) and on the holdout (0)."""
    train, holdout = _split(_table(spark, d)[1])
    inner, outer, ahead = _calibration_splits(train, holdout)
    splits = list(range(DATE_SPLITS + 1))
    made = ml.calibrated_forecasts(ml.trained(train, inner, "match_date"), train.join(inner.where("part = 'validation'"), "match_date"), ahead, _models(),
                                   [100 * s + k for s in splits for k in range(1, INNER_SPLITS + 1)], KEEP)
    plain = ml.fit_folds(ml.trained(train, outer, "match_date"), _models(), splits)
    raw = ml.forecasts(plain, ahead.withColumnRenamed("split", "fold"), [*KEEP, "fold"]).withColumnRenamed("fold", "split").withColumn("method", F.lit("raw"))
    columns = [*KEEP, "model", "method", "split", *PROBS]
    return settle(raw.select(*columns).unionByName(made.select(*columns)))


@query("m28_calibration")
def _(spark, d):
    """Scores of every classifier and method, on all date folds together and on the holdout; calibrated forecasts come from
    refits on inner date folds."""
    rows = calibration_rows(spark, d).withColumn("split", F.when(F.col("split") == 0, "holdout").otherwise("oof"))
    return rounded(model_metrics(rows, ["model", "method", "split"]), 6)


def parameter_grids():
    """{model: {parameter: values}} of the choices that are scored."""
    return {"logistic_regression": {"strength": [0.001, 0.01, 0.1]},
            "random_forest": {"trees": [250, 400], "depth": [6, 10, 30], "least": [3, 8]},
            "boosted_trees": {"rounds": [200, 350, 500], "step": [0.02, 0.05, 0.1], "depth": [2, 3, 5]}}


def grid_fits(grids):
    """(models, stages): the fits that hold every choice. A forest of the most trees and the greatest depth holds the smaller
    ones, and a booster of the most rounds the shorter ones."""
    models, stages = {}, {}
    for choice in grids.get("logistic_regression", {}).get("strength", []):
        models[f"logistic_regression|strength={choice}"] = Logistic(choice)
    forest, boosted = grids.get("random_forest"), grids.get("boosted_trees")
    for least in forest["least"] if forest else []:
        name = f"random_forest|least={least}"
        models[name] = Forest(max(forest["trees"]), max(forest["depth"]), least)
        stages[name] = (forest["trees"], sorted(forest["depth"]), {(t, k): f"random_forest|trees={t},depth={k},least={least}" for t, k in product(
            forest["trees"], forest["depth"])})
    for step, depth in product(boosted["step"], boosted["depth"]) if boosted else []:
        name = f"boosted_trees|step={step},depth={depth}"
        models[name] = Boosted(max(boosted["rounds"]), depth, step)
        stages[name] = (boosted["rounds"], [depth], {(r, depth): f"boosted_trees|rounds={r},step={step},depth={depth}" for r in boosted["rounds"]})
    return models, stages


def grid_scores(spark, d):
    """(fold, label, rps, n) of each parameter choice of each model over forward date folds."""
    train, _ = _split(_table(spark, d)[1])
    placed = train.join(settle(folds.date_membership(train)), "match_date")
    models, stages = grid_fits(parameter_grids())
    parts = []
    for fold in range(1, DATE_SPLITS + 1):  # one fold's models are held at a time
        fitted = ml.fit_folds(placed, models, [fold])
        check = placed.where((F.col("fold") == fold) & (F.col("part") == "validation"))
        parts.append(settle(ml.staged_scores(fitted, check, stages)))
    return reduce(DataFrame.unionByName, parts)


@query("m30_parameter_grid")
def _(spark, d):
    """Mean RPS of each parameter choice of each model over forward date folds."""
    parts = F.split("label", r"\|")
    return rounded(grid_scores(spark, d).groupBy(parts[0].alias("model"), parts[1].alias("parameters")).agg(
        F.avg("rps").alias("rps_mean"), F.stddev_samp("rps").alias("rps_std"), F.sum("n").alias("n")).orderBy("rps_mean", "model", "parameters"), 6)


@query("m41_blend_on_holdout")
def _(spark, d):
    """Base models refitted on all training seasons, scored on the holdout with their average and the meta-learner, which
    learns from the out-of-fold forecasts of the training seasons."""
    rows, table, columns = _blend(spark, d, "none")  # no holdout: the last fold is the holdout season
    return _scored_blend(rows, table, columns, _fold_numbers(table)[-1:], ["model"])


@query("m39_fixture_forecasts")
def _(spark, d):
    """Classifier and goal-model forecasts for every fixture of the holdout season."""
    from touchline.plans.products import goal_forecasts
    _, _, goals = goal_forecasts(spark, d)
    train, holdout = _split(_table(spark, d)[1])
    learned = ml.forecast(ml.fit(train, _models("random_forest")), holdout, ["match_id"])
    learned = learned.select(F.concat(F.lit("F"), F.col("match_id")).alias("fixture_id"), "model", *PROBS)
    return rounded(goals.unionByName(learned), 6)


@query("s9_model_store")
def _(spark, d):
    """Fitted rates as a table and a fitted preparation as a saved pipeline, both read back."""
    m, table = _table(spark, d)
    train, _ = _split(table)
    path = files.scratch(spark)
    ml.prepared(train).write().overwrite().save(path)
    stages = len(PipelineModel.load(path).stages)
    rates = settle(counts.fit_rates(counts.fit_cells(counts.day_cells(m.where(F.col("season") != HOLDOUT_SEASON)))))
    return rates.groupBy("competition", "target").agg(F.count("*").alias("teams")).withColumn("pipeline_stages", F.lit(stages).cast("long"))
