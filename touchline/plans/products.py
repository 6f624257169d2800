"""Resampling, blending by average, odds comparison and fixture cards."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions.probability import PROBS, with_draw_prior
from touchline.operators import blending, checks, counts, grids, markets, metrics, ratings, resampling, walkforward as wf
from touchline.operators.summaries import referee_card_factors, with_referee_factor
from touchline.operators.teams import team_coverage
from touchline.plans.blocks import BLOCKS
from touchline.plans.cleaning import predictions_of, stored_fixtures
from touchline.plans.count_blocks import grid_sql
from touchline.plans.counts import _FACT, PAIR, pair_expectations, split_matches, train_rates
from touchline.plans.metrics import rounded
from touchline.plans.registry import query
from touchline.plans.walkforward import profile_rows
from touchline.schema import BOOTSTRAP_SAMPLES, CORNER_LINE, MAX_CORNERS, YELLOW_LINE
from touchline.session import settle
from touchline.sources.derived import HOLDOUT_SEASON, load_matches

_P = resampling.PRIME


def _weights(source, columns, samples=BOOTSTRAP_SAMPLES):
    """Rows of ``source`` times replicates with the Poisson weight of (replicate, match)."""
    w = " + ".join(f"CAST(u >= {s!r} AS INT)" for s in resampling.POISSON_STEPS)
    return f"""
  SELECT {columns}, rep, {w} AS w FROM (SELECT {columns}, rep, CAST((x * x) % {_P} AS DOUBLE) / {_P}e0 AS u FROM (
    SELECT {columns}, rep, (x * 48271 + rep) % {_P} AS x FROM (SELECT {columns}, rep, (x * x) % {_P} AS x FROM (
      SELECT {columns}, rep, (rep * 1000003 + (match_id % {_P}) * 7919 + 12345) % {_P} AS x
      FROM {source}, (SELECT unnest(range(1, {samples + 1})) AS rep)))))"""


def _ci(x, name, digits=6):
    return (f"round(avg({x}), {digits}) AS {name}_mean, round(quantile_cont({x}, 0.025), {digits}) AS {name}_ci_low, "
            f"round(quantile_cont({x}, 0.975), {digits}) AS {name}_ci_high")


def _holdout_predictions(spark, d):
    return predictions_of(settle(load_matches(spark, d))).where(F.col("season") == HOLDOUT_SEASON)


_M = (("rps", "rps"), ("log_loss", "log_loss"), ("correct", "accuracy"), ("brier", "brier"))


@query("m31_bootstrap_intervals", f"""WITH h AS (SELECT * FROM scores WHERE season = '2001'), w AS ({_weights('h', 'model, rps, log_loss, correct, brier, match_id')}),
s AS (SELECT model, rep, sum(w) AS w, {', '.join(f'sum(w * {c}) AS {c}' for c, _ in _M)} FROM w WHERE w > 0 GROUP BY ALL)
SELECT model, {', '.join(_ci(f'{c} / w', n) for c, n in _M)} FROM s GROUP BY model""", ("scores",))
def _(spark, d):
    return rounded(resampling.bootstrap_metrics(_holdout_predictions(spark, d)), 6)


@query("m32_paired_bootstrap", f"""WITH h AS (SELECT a.match_id, a.model, a.rps - b.rps AS delta_rps, a.log_loss - b.log_loss AS delta_log_loss FROM scores a
  JOIN scores b ON b.match_id = a.match_id AND b.model = 'market' WHERE a.model <> 'market' AND a.season = '2001'),
w AS ({_weights('h', 'model, delta_rps, delta_log_loss, match_id')}),
s AS (SELECT model, rep, sum(w * delta_rps) / sum(w) AS r, sum(w * delta_log_loss) / sum(w) AS l FROM w WHERE w > 0 GROUP BY ALL),
o AS (SELECT model, count(*) AS n_matches, round(avg(delta_rps), 6) AS observed_delta_rps, round(avg(delta_log_loss), 6) AS observed_delta_log_loss FROM h GROUP BY model)
SELECT model, any_value(n_matches) AS n_matches, any_value(observed_delta_rps) AS observed_delta_rps, any_value(observed_delta_log_loss) AS observed_delta_log_loss,
  {_ci('r', 'delta_rps')}, {_ci('l', 'delta_log_loss')}, round(avg(CASE WHEN r >= 0 THEN 1e0 ELSE 0e0 END), 6) AS p_value_not_better,
  avg(CASE WHEN r >= 0 THEN 1e0 ELSE 0e0 END) < 0.05 AS significant_by_p, quantile_cont(l, 0.025) * quantile_cont(l, 0.975) > 0 AS significant_by_interval
FROM s JOIN o USING (model) GROUP BY model""", ("scores",))
def _(spark, d):
    deltas = settle(resampling.all_paired_losses(settle(_holdout_predictions(spark, d)), "market"))
    return rounded(resampling.bootstrap_differences(deltas, ["model"]), 6)


@query("m33_bootstrap_home_advantage_gap", f"""WITH w AS ({_weights('profile', 'competition, subset, scored, expected, match_id')}),
s AS (SELECT competition, subset, rep, ln(sum(w * scored) / sum(w * expected)) AS h FROM w WHERE w > 0 GROUP BY ALL),
g AS (SELECT competition, rep, max(h) FILTER (subset = 'empty') - max(h) FILTER (subset = 'normal') AS gap FROM s GROUP BY ALL)
SELECT competition, {_ci('gap', 'gap')}, quantile_cont(gap, 0.025) * quantile_cont(gap, 0.975) > 0 AS significant FROM g GROUP BY competition""", ("profile",))
def _(spark, d):
    rows = settle(wf.profile_sums(*profile_rows(spark, d)))
    return rounded(resampling.bootstrap_home_advantage_gap(rows, ["competition"]), 6)


@query("m26_simple_average", """WITH a AS (SELECT match_id, avg(prob_home) AS h, avg(prob_draw) AS d, avg(prob_away) AS a FROM predictions WHERE model <> 'market' GROUP BY match_id)
SELECT match_id, round(h / (h + d + a), 9) AS prob_home, round(d / (h + d + a), 9) AS prob_draw, round(a / (h + d + a), 9) AS prob_away FROM a""", ("predictions",))
def _(spark, d):
    rows = predictions_of(settle(load_matches(spark, d))).where("model <> 'market'")
    return rounded(blending.simple_average(rows, ["match_id"]))


_PRIOR = """
f AS (SELECT p.*, CAST(unnest(range(10, 21)) AS DOUBLE) / 10 AS factor FROM predictions p
  WHERE match_id IN (SELECT match_id FROM matches WHERE season <> '2001')),
n AS (SELECT model, factor, result, prob_home / (prob_home + factor * prob_draw + prob_away) AS h, factor * prob_draw / (prob_home + factor * prob_draw + prob_away) AS dd FROM f),
g AS (SELECT model, factor, round(avg(((h - CAST(result = 'H' AS INT)) ** 2 + (h + dd - CAST(result IN ('H', 'D') AS INT)) ** 2) / 2), 9) AS rps FROM n GROUP BY ALL)"""


def _factors(spark, d):
    """Scores of every draw factor on the training seasons; the holdout has no say in the choice."""
    rows = predictions_of(settle(load_matches(spark, d).where(F.col("season") != HOLDOUT_SEASON)))
    return blending.draw_prior_search(rows, tuple(round(1 + k / 10, 1) for k in range(11)))


@query("m29_draw_prior_search", f"WITH {_PRIOR} SELECT model, min_by(factor, (rps, factor)) AS factor, min(rps) AS rps FROM g GROUP BY model", ("predictions",))
def _(spark, d):
    return _factors(spark, d).groupBy("model").agg(
        F.min_by("factor", F.struct("rps", "factor")).alias("factor"), F.min("rps").alias("rps"))


@query("k6_factor_leaderboard", f"WITH {_PRIOR} SELECT model, factor, rps, rank() OVER (PARTITION BY model ORDER BY rps) AS rank FROM g ORDER BY model, rps, factor", ("predictions",))
def _(spark, d):
    order = Window.partitionBy("model").orderBy("rps")
    return _factors(spark, d).withColumn("rank", F.rank().over(order).cast("long")).orderBy("model", "rps", "factor")


def goal_forecasts(spark, d):
    """Holdout fixtures and the two goal models' and the rating model's probabilities for them."""
    m, train, holdout = split_matches(spark, d)
    rates = train_rates(train)
    rho = counts.low_score_correlation(train, rates).select("competition", "rho")
    pairs = settle(pair_expectations(holdout, rates))
    plain = grids.outcome_probabilities(pairs).withColumn("model", F.lit("poisson"))
    low = grids.outcome_probabilities(pairs.join(rho, "competition")).withColumn("model", F.lit("dixon_coles"))
    names = [*PAIR, "model", *PROBS]
    rows = plain.select(*names).unionByName(low.select(*names))
    forecasts = holdout.select(F.concat(F.lit("F"), F.col("match_id")).alias("fixture_id"), *PAIR).join(rows, PAIR)
    return m, stored_fixtures(spark, m), forecasts.select("fixture_id", "model", *PROBS)


BLOCKS["goal_models"] = (("pair_grid", "pair_grid_rho", "matches"), """
  WITH z AS (SELECT competition, team_home, team_away, 'poisson' AS model, sum(p) FILTER (i > j) AS h, sum(p) FILTER (i = j) AS d, sum(p) FILTER (i < j) AS a FROM pair_grid GROUP BY ALL
    UNION ALL SELECT competition, team_home, team_away, 'dixon_coles', sum(p) FILTER (i > j), sum(p) FILTER (i = j), sum(p) FILTER (i < j) FROM pair_grid_rho GROUP BY ALL)
  SELECT concat('F', CAST(m.match_id AS VARCHAR)) AS fixture_id, m.season, m.team_home, m.team_away, z.model, h, d, a, odds_avg_home AS oh, odds_avg_draw AS od, odds_avg_away AS oa,
    1 / odds_avg_home + 1 / odds_avg_draw + 1 / odds_avg_away - 1 AS overround FROM matches m JOIN z USING (competition, team_home, team_away) WHERE m.season = '2001'""", "MATERIALIZED ")
BLOCKS["value_rows"] = (("goal_models",), """
  WITH o AS (SELECT fixture_id, season, team_home, team_away, model, overround, unnest(['H', 'D', 'A']) AS outcome, unnest([h, d, a]) AS model_probability,
    unnest([1 / oh, 1 / od, 1 / oa]) / (1 + overround) AS market_probability, unnest([oh, od, oa]) AS decimal_odds FROM goal_models)
  SELECT *, model_probability - market_probability AS probability_edge, model_probability * decimal_odds - 1 AS expected_value FROM o""", "MATERIALIZED ")
_V6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("model_probability", "market_probability", "decimal_odds", "probability_edge", "expected_value", "overround"))


@query("p19_j3_value_rows", f"SELECT fixture_id, season, team_home, team_away, model, outcome, {_V6}, round(expected_value * 100, 5) AS expected_value_percent FROM value_rows", ("value_rows",))
def _(spark, d):
    _, fixtures, rows = goal_forecasts(spark, d)
    table = markets.value_rows(fixtures, rows)
    return table.withColumns({c: F.round(c, 5 if c.endswith("percent") else 6) for c, t in table.dtypes if t == "double"})


@query("w7_value_ranking", """SELECT fixture_id, model, outcome, round(expected_value, 6) AS expected_value,
  row_number() OVER (ORDER BY round(expected_value, 9) DESC, round(model_probability, 9) DESC, fixture_id, model, outcome) AS ev_rank FROM value_rows""", ("value_rows",))
def _(spark, d):
    _, fixtures, rows = goal_forecasts(spark, d)
    return rounded(markets.value_table(fixtures, rows).select("fixture_id", "model", "outcome", "expected_value", "ev_rank"), 6)


@query("k8_best_value_rows", """SELECT fixture_id, model, outcome, round(expected_value, 6) AS expected_value FROM value_rows
ORDER BY round(expected_value, 9) DESC, round(model_probability, 9) DESC, fixture_id, model, outcome LIMIT 15""", ("value_rows",))
def _(spark, d):
    _, fixtures, rows = goal_forecasts(spark, d)
    table = markets.value_rows(fixtures, rows)
    return table.orderBy(F.desc(F.round("expected_value", 9)), F.desc(F.round("model_probability", 9)), "fixture_id", "model", "outcome").limit(
        15).select("fixture_id", "model", "outcome", F.round("expected_value", 6).alias("expected_value"))


@query("v8_value_table_checks", """WITH r AS (SELECT *, lead(expected_value) OVER (
    ORDER BY round(expected_value, 9) DESC, round(model_probability, 9) DESC, fixture_id, model, outcome) AS next_value FROM value_rows)
SELECT count(*) AS rows, count(*) FILTER (abs(model_probability * decimal_odds - 1 - expected_value) > 1e-12) AS bad_arithmetic,
  count(*) FILTER (round(next_value, 9) > round(expected_value, 9)) AS out_of_order, count(*) FILTER (expected_value IS NULL) AS missing FROM r""", ("value_rows",))
def _(spark, d):
    _, fixtures, rows = goal_forecasts(spark, d)
    table = settle(markets.value_table(fixtures, rows))
    return checks.check_value_table(table)


@query("m36_fixture_card", f"""WITH {_FACT},
g AS (SELECT competition, team_home, team_away, sum(p) FILTER (i > j) AS prob_home, sum(p) FILTER (i = j) AS prob_draw, sum(p) FILTER (i < j) AS prob_away,
  sum(p) FILTER (i > 0 AND j > 0) AS btts FROM pair_grid_rho GROUP BY ALL),
tp AS (SELECT competition, team_home, team_away, string_agg(concat(i, '-', j), ',' ORDER BY round(p, 9) DESC, i, j) AS top_scores FROM
  (SELECT *, row_number() OVER (PARTITION BY competition, team_home, team_away ORDER BY round(p, 9) DESC, i, j) AS k FROM pair_grid_rho) WHERE k <= 3 GROUP BY ALL),
cg AS ({grid_sql('pair_rates', 'competition, team_home, team_away', 25, "target = 'corners'")}),
c AS (SELECT competition, team_home, team_away, sum(p) FILTER (i + j > 9.5) AS corners_over FROM cg GROUP BY ALL),
x AS (SELECT m.match_id, p.expected_home * coalesce(f.factor, 1e0) AS expected_home, p.expected_away * coalesce(f.factor, 1e0) AS expected_away
  FROM matches m JOIN pair_rates p ON p.target = 'yellow' AND p.competition = m.competition AND p.team_home = m.team_home AND p.team_away = m.team_away
  LEFT JOIN fac f ON f.referee = m.referee WHERE m.season = '2001'),
yg AS ({grid_sql('x', 'match_id')}),
y AS (SELECT match_id, sum(p) FILTER (i + j > 4.5) AS cards_over, sum(p) FILTER (i > j) AS home_more_cards FROM yg GROUP BY ALL),
cv AS (SELECT team, CASE WHEN count(DISTINCT season) <= 1 OR count(*) < 100 THEN 'limited_history' END AS few FROM t WHERE season <> '2001' GROUP BY team)
SELECT m.match_id, round(g.prob_home, 6) AS prob_home, round(g.prob_draw, 6) AS prob_draw, round(g.prob_away, 6) AS prob_away, round(btts, 6) AS btts, top_scores,
  round(corners_over, 6) AS corners_over, round(cards_over, 6) AS cards_over, round(home_more_cards, 6) AS home_more_cards,
  concat_ws(',', CASE WHEN r.cold_start THEN 'cold_start' END, h.few, a.few) AS warnings
FROM matches m JOIN g USING (competition, team_home, team_away) JOIN tp USING (competition, team_home, team_away) JOIN c USING (competition, team_home, team_away)
JOIN y ON y.match_id = m.match_id JOIN pair_rates r ON r.target = 'goals' AND r.competition = m.competition AND r.team_home = m.team_home AND r.team_away = m.team_away
LEFT JOIN cv h ON h.team = m.team_home LEFT JOIN cv a ON a.team = m.team_away WHERE m.season = '2001'""", ("pair_grid_rho", "pair_rates", "t"))
def _(spark, d):
    return rounded(fixture_cards(*split_matches(spark, d)[1:]), 6)


def fixture_cards(train, fixtures):
    """Everything forecast about each fixture, one row per fixture, for one or millions of them."""
    rates = train_rates(train, ("goals", "corners", "yellow"))
    rho = counts.low_score_correlation(train, rates.where("target = 'goals'")).select("competition", "rho")
    pairs = settle(pair_expectations(fixtures, rates))
    of = lambda t: pairs.where(F.col("target") == t).drop("target", "xi")
    goals = grids.both_score(grids.outcome_probabilities(of("goals").join(rho, "competition")))
    best = grids.top_scores(goals).groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.struct("score_rank", F.concat_ws("-", "score_home", "score_away").alias("s")))).alias("b")
    ).select(*PAIR, F.array_join(F.transform("b", lambda x: x["s"]), ",").alias("top_scores"))
    corners = grids.over_under(of("corners"), CORNER_LINE, MAX_CORNERS, "corners_").select(*PAIR, "corners_over")
    yellow = of("yellow").select(*PAIR, "expected_home", "expected_away")
    cards = with_referee_factor(fixtures.select("match_id", "referee", *PAIR).join(yellow, PAIR), referee_card_factors(train))
    cards = cards.withColumns({c: F.col(c) * F.col("factor") for c in ("expected_home", "expected_away")})
    cards = grids.outcome_probabilities(grids.over_under(cards, YELLOW_LINE, prefix="cards_"), names=("home_more_cards", "_equal", "_away"))
    few = team_coverage(train).select("team", F.when((F.col("seasons") <= 1) | (F.col("matches") < 100), "limited_history").alias("few"))
    rows = cards.select("match_id", *PAIR, "cards_over", "home_more_cards")
    for part in (goals.select(*PAIR, *PROBS, "btts", "cold_start"), best, corners):
        rows = rows.join(part, PAIR)
    for side in ("home", "away"):
        rows = rows.join(few.select(F.col("team").alias(f"team_{side}"), F.col("few").alias(f"{side}_few")), f"team_{side}", "left")
    return rows.select("match_id", *PROBS, "btts", "top_scores", "corners_over", "cards_over", "home_more_cards",
                       F.concat_ws(",", F.when(F.col("cold_start"), "cold_start"), "home_few", "away_few").alias("warnings"))
