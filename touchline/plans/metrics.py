"""Forecast scoring."""

from pyspark.sql import functions as F

from touchline.functions.probability import (
    PROBS, decode_odds, log_loss, normalize, predicted_result, row_scores, with_draw_prior)
from touchline.operators import metrics
from touchline.plans.cleaning import MODELS, predictions_of
from touchline.plans.registry import query
from touchline.session import settle
from touchline.sources.derived import load_matches

ODDS = ("odds_avg_home", "odds_avg_draw", "odds_avg_away")


def _predictions(spark, d):
    return predictions_of(settle(load_matches(spark, d)))


def rounded(df, digits=9):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


_NAMES = "(SELECT unnest(['market', 'uniform', 'form', 'base_rate', 'absent_model']) AS model)"
_P9 = "round(prob_home, 9) AS prob_home, round(prob_draw, 9) AS prob_draw, round(prob_away, 9) AS prob_away"


@query("p12_normalize_rows", f"""WITH z AS (SELECT match_id, CAST(shots_home AS DOUBLE) AS h, CAST(corners_home + 1 AS DOUBLE) AS d,
  CAST(shots_away AS DOUBLE) AS a FROM matches) SELECT match_id, round(h / (h + d + a), 9) AS prob_home,
  round(d / (h + d + a), 9) AS prob_draw, round(a / (h + d + a), 9) AS prob_away FROM z""")
def _(spark, d):
    m = load_matches(spark, d).select("match_id", F.col("shots_home").cast("double").alias("prob_home"),
                                      (F.col("corners_home") + 1).cast("double").alias("prob_draw"),
                                      F.col("shots_away").cast("double").alias("prob_away"))
    return rounded(normalize(m))


@query("p13_arg_max_label", "SELECT match_id, model, predicted_result FROM scores", ("scores",))
def _(spark, d):
    return _predictions(spark, d).select("match_id", "model", predicted_result().alias("predicted_result"))


@query("p14_draw_prior", """SELECT match_id, model, round(prob_home / (prob_home + 1.3e0 * prob_draw + prob_away), 9) AS prob_home,
  round(1.3e0 * prob_draw / (prob_home + 1.3e0 * prob_draw + prob_away), 9) AS prob_draw,
  round(prob_away / (prob_home + 1.3e0 * prob_draw + prob_away), 9) AS prob_away FROM predictions""", ("predictions",))
def _(spark, d):
    return rounded(with_draw_prior(_predictions(spark, d).select("match_id", "model", *PROBS), 1.3))


@query("p18_overround_removal", """WITH i AS (SELECT match_id, 1e0 / odds_avg_home AS h, 1e0 / odds_avg_draw AS d,
  1e0 / odds_avg_away AS a FROM matches) SELECT match_id, round(h + d + a - 1, 9) AS overround,
  round(h / (h + d + a), 9) AS prob_home, round(d / (h + d + a), 9) AS prob_draw, round(a / (h + d + a), 9) AS prob_away FROM i""")
def _(spark, d):
    return rounded(decode_odds(load_matches(spark, d), ODDS).select("match_id", "overround", *PROBS))


@query("p22_row_validation", """SELECT model, count(*) AS n,
  count(*) FILTER (abs(prob_home + prob_draw + prob_away - 1) > 1e-5) AS bad_sum,
  count(*) FILTER (prob_home IS NULL OR prob_draw IS NULL OR prob_away IS NULL OR isnan(prob_home + prob_draw + prob_away)
    OR isinf(prob_home + prob_draw + prob_away)) AS not_finite FROM predictions GROUP BY model""", ("predictions",))
def _(spark, d):
    total = F.col("prob_home") + F.col("prob_draw") + F.col("prob_away")
    broken = total.isNull() | F.isnan(total) | (F.abs(total) == float("inf"))
    return _predictions(spark, d).groupBy("model").agg(
        F.count("*").alias("n"), F.sum((F.abs(total - 1) > 1e-5).cast("long")).alias("bad_sum"),
        F.sum(broken.cast("long")).alias("not_finite"))


@query("p24_row_losses", """SELECT match_id, model, round(rps, 9) AS rps, round(brier, 9) AS brier,
  round(log_loss, 9) AS log_loss, correct FROM scores""", ("scores",))
def _(spark, d):
    return rounded(row_scores(_predictions(spark, d)).select("match_id", "model", "rps", "brier", "log_loss", "correct"))


@query("m34_clipped_log_loss", """SELECT match_id, round(-ln(least(greatest(CASE result WHEN 'H' THEN p WHEN 'D' THEN 0 ELSE 1 - p END,
  1e-15), 1)), 9) AS loss FROM (SELECT match_id, result, CAST(goals_home AS DOUBLE) / (goals_home + goals_away + 1) AS p FROM matches)""")
def _(spark, d):
    p = F.col("goals_home") / (F.col("goals_home") + F.col("goals_away") + 1)
    m = load_matches(spark, d).select("match_id", "result", p.alias("prob_home"), F.lit(0.0).alias("prob_draw"),
                                      (1 - p).alias("prob_away"))
    return rounded(m.select("match_id", log_loss().alias("loss")))


@query("a8_model_metrics", """SELECT model, count(*) AS n, round(CAST(sum(correct) AS DOUBLE) / count(*), 9) AS accuracy,
  round(avg(log_loss), 9) AS log_loss, round(avg(brier), 9) AS brier_sum, round(avg(brier) / 3, 9) AS brier_mean,
  round(avg(rps), 9) AS rps FROM scores GROUP BY model""", ("scores",))
def _(spark, d):
    return rounded(metrics.model_metrics(_predictions(spark, d)))


_CLASSES = """
c AS (
  SELECT model, 'H' AS class, prob_home AS p, CAST(result = 'H' AS BIGINT) AS y FROM predictions
  UNION ALL SELECT model, 'D', prob_draw, CAST(result = 'D' AS BIGINT) FROM predictions
  UNION ALL SELECT model, 'A', prob_away, CAST(result = 'A' AS BIGINT) FROM predictions)"""


@query("a9_calibration_error", f"""WITH {_CLASSES},
b AS (SELECT model, class, least(len(list_filter([1,2,3,4,5,6,7,8,9], lambda k: p >= k * 0.1e0)), 9) AS bin, p, y FROM c),
g AS (SELECT model, class, bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY ALL),
e AS (SELECT model, class, sum(n * abs(mp - my)) / sum(n) AS e FROM g GROUP BY ALL)
SELECT model, round(avg(e), 9) AS ece FROM e GROUP BY model""", ("predictions",))
def _(spark, d):
    return rounded(metrics.calibration_error(_predictions(spark, d)))


_REPORT = """
r AS (
  SELECT n.model, k.class, count(*) FILTER (s.result = k.class AND s.predicted_result = k.class) AS hit,
    count(*) FILTER (s.result = k.class) AS support, count(*) FILTER (s.predicted_result = k.class) AS predicted_count
  FROM (SELECT DISTINCT model FROM scores) n CROSS JOIN (SELECT unnest(['H', 'D', 'A']) AS class) k
  JOIN scores s ON s.model = n.model GROUP BY ALL),
f AS (
  SELECT model, class, CASE WHEN predicted_count > 0 THEN hit / predicted_count ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
    CASE WHEN support + predicted_count > 0 THEN 2 * hit / (support + predicted_count) ELSE 0 END AS f1,
    support, predicted_count FROM r)"""


@query("a10_class_report", f"""WITH {_REPORT} SELECT model, class, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(f1, 9) AS f1, support, predicted_count FROM f""", ("scores",))
def _(spark, d):
    return rounded(metrics.class_report(_predictions(spark, d)))


@query("a11_confusion_matrix", """SELECT n.model, a.actual, p.predicted, count(s.match_id) AS n
FROM (SELECT DISTINCT model FROM scores) n CROSS JOIN (SELECT unnest(['H', 'D', 'A']) AS actual) a
CROSS JOIN (SELECT unnest(['H', 'D', 'A']) AS predicted) p LEFT JOIN scores s ON s.model = n.model
  AND s.result = a.actual AND s.predicted_result = p.predicted GROUP BY ALL""", ("scores",))
def _(spark, d):
    return metrics.confusion(_predictions(spark, d))


@query("a12_macro_f1", f"""WITH {_REPORT} SELECT model, round(avg(f1), 9) AS macro_f1 FROM f
WHERE support > 0 OR predicted_count > 0 GROUP BY model""", ("scores",))
def _(spark, d):
    return rounded(metrics.macro_f1(_predictions(spark, d)))


@query("a13_draw_report", """SELECT model, round(count(*) FILTER (result = 'D' AND predicted_result = 'D')
    / nullif(count(*) FILTER (result = 'D'), 0), 9) AS draw_recall,
  round(count(*) FILTER (result = 'D' AND predicted_result = 'D') / greatest(count(*) FILTER (result = 'D'), 1), 9)
    AS draw_recall_or_zero, count(*) FILTER (predicted_result = 'D') AS draw_predictions,
  round(avg(prob_draw), 9) AS mean_prob_draw FROM scores GROUP BY model""", ("scores",))
def _(spark, d):
    return rounded(metrics.draw_report(_predictions(spark, d)))


@query("a18_reliability_curve", f"""WITH {_CLASSES},
e AS (SELECT model, class, quantile_cont(p, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS edges FROM c GROUP BY ALL)
SELECT c.model, c.class, CAST(len(list_filter(edges, lambda x: x < p)) AS BIGINT) AS bin, count(*) AS n,
  round(avg(p), 9) AS mean_predicted, round(avg(y), 9) AS observed
FROM c JOIN e ON e.model = c.model AND e.class = c.class GROUP BY ALL""", ("predictions",))
def _(spark, d):
    return rounded(metrics.reliability_curve(settle(_predictions(spark, d))))


@query("j2_identity_to_predictions", f"""SELECT m.match_id, m.season, m.team_home, m.team_away, p.model, {_P9.replace('round(', 'round(p.')}
FROM matches m LEFT JOIN predictions p ON p.match_id = m.match_id""", ("predictions",))
def _(spark, d):
    m = settle(load_matches(spark, d))
    return rounded(m.select("match_id", "season", "team_home", "team_away").join(
        predictions_of(m).select("match_id", "model", *PROBS), "match_id", "left"))


@query("j9_model_pair_delta", """SELECT a.match_id, round(a.rps - b.rps, 9) AS delta_rps, round(a.log_loss - b.log_loss, 9) AS delta_log_loss
FROM scores a JOIN scores b ON b.match_id = a.match_id AND a.model = 'form' AND b.model = 'market'""", ("scores",))
def _(spark, d):
    from touchline.operators.resampling import paired_losses
    return rounded(paired_losses(_predictions(spark, d), "form", "market"))


@query("j12_stable_summary", f"""SELECT n.model, count(s.match_id) > 0 AS available,
  round(avg(log_loss), 9) AS log_loss, round(avg(rps), 9) AS rps
FROM {_NAMES} n LEFT JOIN scores s ON s.model = n.model GROUP BY n.model""", ("scores",))
def _(spark, d):
    return rounded(metrics.stable_summary(_predictions(spark, d), MODELS).select("model", "available", "log_loss", "rps"))


@query("j12_stable_class_report", f"""WITH {_REPORT} SELECT n.model, k.class, f.support IS NOT NULL AS available,
  round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support, predicted_count
FROM {_NAMES} n CROSS JOIN (SELECT unnest(['H', 'D', 'A']) AS class) k LEFT JOIN f ON f.model = n.model AND f.class = k.class""", ("scores",))
def _(spark, d):
    return rounded(metrics.stable_by_class(_predictions(spark, d), MODELS))


@query("j12_stable_confusion", f"""SELECT n.model, a.actual, p.predicted,
  CASE WHEN n.model = 'absent_model' THEN NULL ELSE count(s.match_id) END AS n, n.model <> 'absent_model' AS available
FROM {_NAMES} n CROSS JOIN (SELECT unnest(['H', 'D', 'A']) AS actual) a
CROSS JOIN (SELECT unnest(['H', 'D', 'A']) AS predicted) p LEFT JOIN scores s ON s.model = n.model
  AND s.result = a.actual AND s.predicted_result = p.predicted GROUP BY n.model, a.actual, p.predicted""", ("scores",))
def _(spark, d):
    return metrics.stable_confusion(_predictions(spark, d), MODELS)


@query("j17_all_or_nothing", """SELECT p.match_id, p.model, round(p.prob_home - b.prob_home, 9) AS home_minus_market
FROM predictions p JOIN predictions b ON b.match_id = p.match_id AND b.model = 'market' WHERE p.model <> 'market'""", ("predictions",))
def _(spark, d):
    rows = settle(_predictions(spark, d))
    market = rows.where(F.col("model") == "market").select("match_id", F.col("prob_home").alias("market"))
    others = rows.where(F.col("model") != "market")
    missing = others.select("match_id").distinct().join(market, "match_id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("the market lacks rows that other models have")
    return rounded(others.join(market, "match_id").select(
        "match_id", "model", (F.col("prob_home") - F.col("market")).alias("home_minus_market")))


@query("j18_gap_to_market", """WITH g AS (SELECT model, avg(log_loss) AS ll, avg(rps) AS rps FROM scores GROUP BY model)
SELECT a.model, round(a.ll - b.ll, 9) AS log_loss_gap, round(a.rps - b.rps, 9) AS rps_gap,
  round(a.rps - b.rps - 0.006e0, 9) AS rps_gap_change FROM g a JOIN g b ON b.model = 'market' WHERE a.model <> 'market'""", ("scores",))
def _(spark, d):
    from touchline.operators.blending import gap_to_benchmark
    summary = metrics.model_metrics(_predictions(spark, d))
    # Fixed value: the stored earlier RPS distance between best model and market (0.211 - 0.205).
    return rounded(gap_to_benchmark(summary, "market", 0.006))


@query("k5_summary_order", f"""SELECT n.model, count(s.match_id) > 0 AS available, round(avg(rps), 9) AS rps
FROM {_NAMES} n LEFT JOIN scores s ON s.model = n.model GROUP BY n.model ORDER BY available DESC, rps ASC NULLS LAST""", ("scores",))
def _(spark, d):
    return rounded(metrics.stable_summary(_predictions(spark, d), MODELS).select("model", "available", "rps")).orderBy(
        F.desc("available"), F.asc_nulls_last("rps"))


@query("a27_leaderboard", """WITH g AS (SELECT model, avg(rps) AS rps,
    count(*) FILTER (result = 'D' AND predicted_result = 'D') / greatest(count(*) FILTER (result = 'D'), 1) AS dr
  FROM scores GROUP BY model)
SELECT min_by(model, rps) AS best_model, round(min(rps), 9) AS best_rps, min_by(model, struct_pack(a := dr, b := model)) AS worst_draw_recall_model,
  count(*) FILTER (rps < (SELECT rps FROM g WHERE model = 'market')) AS models_beating_market FROM g""", ("scores",))
def _(spark, d):
    rows = settle(_predictions(spark, d))
    board = metrics.model_metrics(rows).join(metrics.draw_report(rows), "model")
    market = F.max(F.when(F.col("model") == "market", F.col("rps")))
    scores = F.collect_list("rps")  # one value per registered model
    return rounded(board.agg(
        F.min_by("model", "rps").alias("best_model"), F.min("rps").alias("best_rps"),
        F.min_by("model", F.struct("draw_recall_or_zero", "model")).alias("worst_draw_recall_model"),
        market.alias("market"), scores.alias("scores"))
        .withColumn("models_beating_market", F.size(F.filter("scores", lambda x: x < F.col("market"))).cast("long"))
        .drop("market", "scores"))


@query("u5_common_matches", """SELECT match_id FROM predictions WHERE model = 'form'
INTERSECT SELECT match_id FROM predictions WHERE model = 'market'""", ("predictions",))
def _(spark, d):
    rows = settle(_predictions(spark, d))
    of = lambda name: rows.where(F.col("model") == name).select("match_id")
    return of("form").intersect(of("market"))


@query("u6_wide_to_long", """SELECT match_id, 'goals' AS model, CAST(goals_home AS BIGINT) AS home, CAST(goals_away AS BIGINT) AS away FROM matches
UNION ALL SELECT match_id, 'shots', CAST(shots_home AS BIGINT), CAST(shots_away AS BIGINT) FROM matches
UNION ALL SELECT match_id, 'corners', CAST(corners_home AS BIGINT), CAST(corners_away AS BIGINT) FROM matches""")
def _(spark, d):
    rows = [F.struct(F.lit(n).alias("model"), F.col(f"{n}_home").cast("long").alias("home"),
                     F.col(f"{n}_away").cast("long").alias("away")) for n in ("goals", "shots", "corners")]
    return load_matches(spark, d).select("match_id", F.inline(F.array(*rows)))


@query("u7_outcome_rows", """SELECT match_id, 'H' AS outcome, odds_avg_home AS odds FROM matches
UNION ALL SELECT match_id, 'D', odds_avg_draw FROM matches UNION ALL SELECT match_id, 'A', odds_avg_away FROM matches""")
def _(spark, d):
    return load_matches(spark, d).select("match_id", *ODDS).unpivot("match_id", list(ODDS), "outcome", "odds").withColumn(
        "outcome", F.upper(F.substring(F.element_at(F.split("outcome", "_"), -1), 1, 1)))


@query("u9_meta_features", "SELECT match_id, " + ", ".join(
    f"round(max(prob_{o}) FILTER (model = '{m}'), 9) AS {m}_prob_{o}" for m in MODELS[:4] for o in ("home", "draw", "away"))
    + " FROM predictions GROUP BY match_id", ("predictions",))
def _(spark, d):
    from touchline.operators.blending import meta_features
    return rounded(meta_features(_predictions(spark, d), MODELS[:4]))
