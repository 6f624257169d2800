"""Aggregates, tests, promotion, referees, players and data checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import checks, summaries as ops
from touchline.operators.features import generate_features
from touchline.operators.teams import final_table, team_coverage, team_view
from touchline.plans.cleaning import predictions_of, stored_fixtures
from touchline.operators.metrics import draw_report
from touchline.plans.metrics import rounded
from touchline.plans.registry import query
from touchline.session import settle
from touchline.sources import files
from touchline.sources.derived import (
    HOLDOUT_SEASON, load_external_ratings, load_matches, load_player_matches, load_player_shooting,
    load_player_standard)

# Stable layout of written forecasts.
FORECAST_TYPES = {"match_id": "bigint", "competition": "string", "season": "string", "match_date": "date", "model": "string",
                  "result": "string", "prob_home": "double", "prob_draw": "double", "prob_away": "double"}


@query("a1_result_distribution", """SELECT result, count(*) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM matches), 9) AS percent
FROM matches GROUP BY result""")
def _(spark, d):
    return rounded(ops.result_distribution(load_matches(spark, d)))


@query("a2_season_crosstab", "SELECT season, " + ", ".join(f"count(*) FILTER (result = '{c}') AS n_{c}" for c in "HDA") + ", "
       + ", ".join(f"round(100e0 * count(*) FILTER (result = '{c}') / count(*), 9) AS percent_{c}" for c in "HDA")
       + " FROM matches GROUP BY season")
def _(spark, d):
    return rounded(ops.season_crosstab(load_matches(spark, d)))


@query("a3_season_goal_gap", "SELECT season, round(avg(goals_home - goals_away), 9) AS mean_goal_gap FROM matches GROUP BY season")
def _(spark, d):
    return rounded(ops.season_goal_gap(load_matches(spark, d)))


@query("a4_home_advantage_tests", """WITH s AS (SELECT count(*) AS n, count(*) FILTER (result = 'H') AS h, count(*) FILTER (result = 'A') AS a,
  avg(goals_home - goals_away) AS m, stddev_samp(goals_home - goals_away) AS sd FROM matches)
SELECT n, h AS home_wins, a AS away_wins, round(100e0 * (h - a) / n, 9) AS win_rate_gap, round(m, 9) AS mean_goal_gap,
  round(m / (sd / sqrt(n)), 7) AS t_goals, round((h - (h + a) / 2) / sqrt((h + a) / 4), 7) AS z_wins FROM s""")
def _(spark, d):
    return rounded(ops.home_advantage_tests(load_matches(spark, d))).withColumns(
        {c: F.round(c, 7) for c in ("t_goals", "z_wins")})


@query("a4_season_result_chi_square", """WITH c AS (SELECT season, result, count(*) AS n FROM matches GROUP BY ALL),
e AS (SELECT n, sum(n) OVER (PARTITION BY season) * sum(n) OVER (PARTITION BY result) / sum(n) OVER () AS e FROM c)
SELECT round(CAST(sum((n - e) ** 2 / e) AS DOUBLE), 7) AS chi_square, (SELECT (count(DISTINCT season) - 1) * (count(DISTINCT result) - 1) FROM c) AS degrees FROM e""")
def _(spark, d):
    return rounded(ops.season_result_chi_square(load_matches(spark, d)), 7)


@query("a4_tail_probabilities", """WITH s AS (SELECT count(*) AS n, count(*) FILTER (result = 'H') AS h, count(*) FILTER (result = 'A') AS a,
  avg(goals_home - goals_away) AS m, stddev_samp(goals_home - goals_away) AS sd FROM matches),
b AS (SELECT CAST(sum(exp(lgamma(h + a + 1) - lgamma(k + 1) - lgamma(h + a - k + 1) - (h + a) * ln(2e0))) AS DOUBLE) AS p
  FROM (SELECT h, a, unnest(generate_series(h, h + a)) AS k FROM s)),
t AS (SELECT n - 1 AS v, abs(m) / (sd / sqrt(n)) AS t, sign(m) AS side FROM s),
g AS (SELECT t, v, side, i, (t / 20000) * i AS x FROM t, generate_series(0, 20000) AS r(i)),
d AS (SELECT any_value(side) AS side, sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(lgamma((v + 1) / 2e0) - lgamma(v / 2e0) - ln(v * pi()) / 2 - (v + 1) / 2e0 * ln(1 + x * x / v)) * (t / 20000) / 3) AS area FROM g),
c AS (SELECT season, result, count(*) AS n FROM matches GROUP BY ALL),
e AS (SELECT n, sum(n) OVER (PARTITION BY season) * sum(n) OVER (PARTITION BY result) / sum(n) OVER () AS e FROM c),
x AS (SELECT CAST(sum((n - e) ** 2 / e) AS DOUBLE) / 2 AS x, (SELECT (count(DISTINCT season) - 1) * (count(DISTINCT result) - 1) FROM c) AS k FROM e),
q AS (SELECT CAST(sum(exp(-x + i * ln(x) - lgamma(i + 1))) AS DOUBLE) AS p FROM (SELECT x, unnest(generate_series(0, k // 2 - 1)) AS i FROM x))
SELECT round(b.p, 9) AS p_wins, round(greatest(0.5 - side * area, 0), 9) AS p_goals, round(q.p, 9) AS p_seasons FROM b, d, q""")
def _(spark, d):
    """Degrees of freedom are even here, as there are three results, so the SQL has a closed form."""
    return rounded(ops.tail_probabilities(load_matches(spark, d)), 9)


@query("a5_team_coverage", """SELECT team, count(*) AS matches, count(DISTINCT season) AS seasons, max(season) AS last_season,
  max(match_date) AS last_date FROM t GROUP BY team""", ("t",))
def _(spark, d):
    return team_coverage(load_matches(spark, d))


@query("a6_final_table", """WITH g AS (SELECT competition, season, team, count(*) AS played, CAST(sum(points) AS BIGINT) AS points,
  CAST(sum(gf - ga) AS BIGINT) AS goal_difference, CAST(sum(gf) AS BIGINT) AS goals_for FROM t GROUP BY ALL)
SELECT *, rank() OVER (PARTITION BY competition, season ORDER BY points DESC, goal_difference DESC, goals_for DESC) AS position FROM g""", ("t",))
def _(spark, d):
    return final_table(load_matches(spark, d))


_FACTORS = """
tr AS (SELECT * FROM matches WHERE season <> '2001'),
lr AS (SELECT sum(yellow_cards_home + yellow_cards_away) / count(*) AS r FROM tr),
g AS (SELECT referee, count(*) AS n, CAST(sum(yellow_cards_home + yellow_cards_away) AS BIGINT) AS c FROM tr GROUP BY referee),
fac AS (SELECT referee, n AS training_matches, c AS total_cards, c / n AS raw_rate,
    CASE WHEN n < 30 THEN 'other_referee' ELSE referee END AS category, CASE WHEN n < 30 THEN 0e0 ELSE 30e0 END AS prior_weight,
    CASE WHEN n < 30 THEN r ELSE (n * (c / n) + 30 * r) / (n + 30) END AS shrunk_rate,
    CASE WHEN n < 30 THEN r ELSE (n * (c / n) + 30 * r) / (n + 30) END / r AS factor, r AS league_rate FROM g, lr)"""


@query("a15_referee_factors", f"""WITH {_FACTORS} SELECT referee, training_matches, total_cards, category, prior_weight,
  round(raw_rate, 9) AS raw_rate, round(shrunk_rate, 9) AS shrunk_rate, round(factor, 9) AS factor,
  round(league_rate, 9) AS league_rate, 'yellow' AS label FROM fac""")
def _(spark, d):
    train = load_matches(spark, d).where(F.col("season") != HOLDOUT_SEASON)
    return rounded(ops.referee_card_factors(train))


@query("j8_referee_lookup", f"""WITH {_FACTORS} SELECT m.match_id, m.referee, round(coalesce(f.factor, 1e0), 9) AS factor
FROM matches m LEFT JOIN fac f ON f.referee = m.referee WHERE m.season = '2001'""")
def _(spark, d):
    m = settle(load_matches(spark, d))
    factors = ops.referee_card_factors(m.where(F.col("season") != HOLDOUT_SEASON))
    rows = m.where(F.col("season") == HOLDOUT_SEASON).select("match_id", "referee")
    return rounded(ops.with_referee_factor(rows, factors).select("match_id", "referee", "factor"))


@query("a16_shots_conceded", """WITH h AS (SELECT team_home AS team, avg(shots_on_target_away) AS x FROM matches GROUP BY 1),
a AS (SELECT team_away AS team, avg(shots_on_target_home) AS y FROM matches GROUP BY 1)
SELECT coalesce(h.team, a.team) AS team, round((coalesce(x, 0) + coalesce(y, 0)) / 2, 9) AS conceded
FROM h FULL JOIN a ON a.team = h.team""")
def _(spark, d):
    return rounded(ops.shots_conceded(load_matches(spark, d)))


_RECENT = """
lastm AS (SELECT team, match_id FROM (SELECT DISTINCT team, match_id, match_date FROM player_matches)
  QUALIFY row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) <= 5),
rec AS (SELECT p.* FROM player_matches p JOIN lastm l ON l.team = p.team AND l.match_id = p.match_id)"""


@query("w13_recent_team_matches", f"WITH {_RECENT} SELECT team, match_id, match_date, player, sot FROM rec", ("player_matches",))
def _(spark, d):
    return ops.recent_team_matches(load_player_matches(spark, d)).select("team", "match_id", "match_date", "player", "sot")


@query("a17_player_shot_ranges", f"""WITH {_RECENT},
con AS (SELECT coalesce(h.team, a.team) AS opponent, (coalesce(x, 0) + coalesce(y, 0)) / 2 AS conceded
  FROM (SELECT team_home AS team, avg(shots_on_target_away) AS x FROM matches GROUP BY 1) h
  FULL JOIN (SELECT team_away AS team, avg(shots_on_target_home) AS y FROM matches GROUP BY 1) a ON a.team = h.team),
pl AS (SELECT team, player, count(*) AS n, avg(sot) AS m, CASE WHEN count(*) > 1 THEN stddev_pop(sot) ELSE 0.3e0 END AS s FROM rec GROUP BY ALL),
meet AS (SELECT team_home AS team, team_away AS opponent FROM matches WHERE season = '2001' UNION SELECT team_away, team_home FROM matches WHERE season = '2001'),
o AS (SELECT pl.*, con.*, m * (conceded / (SELECT avg(conceded) FROM con)) AS adj FROM pl JOIN meet ON meet.team = pl.team JOIN con ON con.opponent = meet.opponent)
SELECT team, player, opponent, n AS matches_used, round(m, 2) AS avg_sot_raw, round(adj, 2) AS avg_sot_adjusted,
  greatest(0e0, round(adj - s, 1)) AS sot_range_low, round(adj + s, 1) AS sot_range_high, round(conceded, 2) AS opponent_conceded FROM o""",
       ("player_matches", "matches"))
def _(spark, d):
    m = settle(load_matches(spark, d))
    meetings = team_view(m.where(F.col("season") == HOLDOUT_SEASON))
    return ops.player_shot_ranges(load_player_matches(spark, d), ops.shots_conceded(m), meetings)


@query("a21_season_completeness", """SELECT competition, season, count(*) AS matches, (SELECT count(DISTINCT team) FROM t
    WHERE t.competition = m.competition AND t.season = m.season) AS teams, 380 - count(*) AS matches_missing,
  20 - (SELECT count(DISTINCT team) FROM t WHERE t.competition = m.competition AND t.season = m.season) AS teams_missing
FROM matches m GROUP BY competition, season""", ("t",))
def _(spark, d):
    return ops.season_completeness(load_matches(spark, d))


@query("a24_volume_conversion", """WITH s AS (SELECT """ + ", ".join(
    f"CAST(sum({c}_{s}) AS DOUBLE) AS {c[:7].replace('shots_o', 'sot')}_{s[0]}" for c in ("goals", "shots", "shots_on_target") for s in ("home", "away"))
    + """ FROM matches) SELECT round(goals_h / goals_a, 9) AS goals_ratio, round(shots_h / shots_a, 9) AS shots_ratio,
  round(sot_h / sot_a, 9) AS shots_on_target_ratio, round((goals_h / shots_h) / (goals_a / shots_a), 9) AS goals_per_shots_ratio,
  round((goals_h / sot_h) / (goals_a / sot_a), 9) AS goals_per_shots_on_target_ratio FROM s""")
def _(spark, d):
    return rounded(ops.volume_and_conversion(load_matches(spark, d)))


# Targets of the models whose runs are compared.
RUNS = {"outcome": ["result"], "goals": ["goals_home", "goals_away"], "corners": ["corners_home", "corners_away"],
        "cards": ["yellow_cards_home", "yellow_cards_away", "referee"]}


def stored_runs(spark, d):
    """Metadata rows of the runs, written as JSON beside the models and read back."""
    runs = ops.run_metadata(load_matches(spark, d).where(F.col("season") != HOLDOUT_SEASON), RUNS)
    path = files.scratch(spark)
    runs.write.json(path)
    return spark.read.schema(runs.schema).json(path)


_RUNS = " UNION ALL ".join(
    f"""SELECT '{n}' AS model, count(*) AS n, string_agg(DISTINCT season, ',' ORDER BY season) AS seasons, min(match_date) AS a, max(match_date) AS b
  FROM matches WHERE season <> '2001' AND {' AND '.join(f'{c} IS NOT NULL' for c in columns)}""" for n, columns in RUNS.items())


@query("s8_model_runs", f"WITH s AS ({_RUNS}) SELECT model, n AS training_rows, seasons, a AS first_date, b AS last_date FROM s")
def _(spark, d):
    return stored_runs(spark, d)


@query("a25_training_consistency", f"""WITH s AS ({_RUNS})
SELECT count(*) AS models, count(DISTINCT (a, b)) AS periods, count(DISTINCT n) AS sizes,
  count(DISTINCT (a, b)) > 1 OR count(DISTINCT n) > 1 AS inconsistent FROM s""")
def _(spark, d):
    return ops.training_consistency(stored_runs(spark, d))


@query("a26_red_card_share", """SELECT count(*) AS matches, count(*) FILTER (red_cards_home + red_cards_away > 0) AS with_red,
  round(count(*) FILTER (red_cards_home + red_cards_away > 0) / count(*), 9) AS share, min(corners_home + corners_away) AS fewest_corners,
  max(corners_home + corners_away) AS most_corners FROM matches""")
def _(spark, d):
    red = (F.col("red_cards_home") + F.col("red_cards_away") > 0).cast("long")
    corners = F.col("corners_home") + F.col("corners_away")
    return rounded(load_matches(spark, d).agg(
        F.count("*").alias("matches"), F.sum(red).alias("with_red"), (F.sum(red) / F.count("*")).alias("share"),
        F.min(corners).alias("fewest_corners"), F.max(corners).alias("most_corners")))


@query("j4_player_season", """SELECT s.season, s.team, s.player, goals, assists, shots, shots_on_target FROM player_standard s
LEFT JOIN player_shooting h ON h.season = s.season AND h.team = s.team AND h.player = s.player""", ("player_standard", "player_shooting"))
def _(spark, d):
    return ops.player_season(load_player_standard(spark, d), load_player_shooting(spark, d))


_KEY = """
k AS (SELECT s.season, s.team, s.player, goals, assists, shots, shots_on_target, goals + assists AS goal_contribution,
  row_number() OVER (PARTITION BY s.season, s.team ORDER BY goals + assists DESC, goals DESC, assists DESC, s.player) AS player_rank
  FROM player_standard s LEFT JOIN player_shooting h ON h.season = s.season AND h.team = s.team AND h.player = s.player
  QUALIFY player_rank <= 3)"""


@query("w10_key_players", f"WITH {_KEY} SELECT * FROM k", ("player_standard", "player_shooting"))
def _(spark, d):
    return ops.key_players(ops.player_season(load_player_standard(spark, d), load_player_shooting(spark, d)))


@query("m40_best_player_candidates", f"""WITH {_KEY} SELECT m.match_id, 'home' AS side, k.* FROM matches m JOIN k ON k.season = m.season AND k.team = m.team_home
WHERE m.season = '2001' UNION ALL SELECT m.match_id, 'away', k.* FROM matches m JOIN k ON k.season = m.season AND k.team = m.team_away
WHERE m.season = '2001'""", ("matches", "player_standard", "player_shooting"))
def _(spark, d):
    best = ops.key_players(ops.player_season(load_player_standard(spark, d), load_player_shooting(spark, d)))
    sides = load_matches(spark, d).where(F.col("season") == HOLDOUT_SEASON).select("match_id", "season", F.inline(F.array(
        *[F.struct(F.lit(s).alias("side"), F.col(f"team_{s}").alias("team")) for s in ("home", "away")])))
    return sides.join(best, ["season", "team"])


_PROMOTED = """
p AS (SELECT DISTINCT competition, season, team FROM t),
prom AS (SELECT p.* FROM p WHERE p.season > (SELECT min(season) FROM p q WHERE q.competition = p.competition)
  AND NOT EXISTS (SELECT 1 FROM p q WHERE q.competition = p.competition AND q.team = p.team
    AND q.season = (SELECT max(season) FROM p z WHERE z.competition = p.competition AND z.season < p.season)))"""


@query("j5_promoted_teams", f"WITH {_PROMOTED} SELECT * FROM prom", ("t",))
def _(spark, d):
    return ops.promoted_teams(load_matches(spark, d))


@query("u3_team_difference", f"WITH {_PROMOTED} SELECT season, team, count(*) AS competitions FROM prom GROUP BY ALL", ("t",))
def _(spark, d):
    return ops.promoted_teams(load_matches(spark, d)).groupBy("season", "team").agg(F.count("*").alias("competitions"))


@query("j6_rating_as_of", """SELECT m.match_id, m.team_home AS club, m.match_date AS as_of, max(r.from_date) AS rating_date,
  max_by(r.rating, r.from_date) AS raw_rating FROM matches m LEFT JOIN ratings_outside r ON r.club = m.team_home AND r.from_date < m.match_date
GROUP BY ALL""", ("matches", "ratings_outside"))
def _(spark, d):
    asked = load_matches(spark, d).select("match_id", F.col("team_home").alias("club"), F.col("match_date").alias("as_of"))
    return ops.rating_as_of(asked, load_external_ratings(spark, d))


@query("p17_rescaled_rating", "SELECT club, from_date, round(-469.1728e0 + 1.0893e0 * rating, 6) AS rescaled FROM ratings_outside", ("ratings_outside",))
def _(spark, d):
    from touchline.schema import RESCALE_INTERCEPT, RESCALE_SLOPE
    return load_external_ratings(spark, d).select(
        "club", "from_date", F.round(RESCALE_INTERCEPT + RESCALE_SLOPE * F.col("rating"), 6).alias("rescaled"))


@query("p21_coverage_warnings", """WITH c AS (SELECT team, count(*) AS matches, count(DISTINCT season) AS seasons, max(season) AS last_season FROM t GROUP BY team)
SELECT team, concat_ws(',', CASE WHEN seasons <= 1 OR matches < 100 THEN 'limited_history' END,
  CASE WHEN last_season < (SELECT max(season) FROM t) THEN 'stale_season' END) AS warnings FROM c""", ("t",))
def _(spark, d):
    seen = team_coverage(load_matches(spark, d))
    latest = F.max("last_season").over(Window.partitionBy(F.lit(1)))  # one row per team
    few = (F.col("seasons") <= 1) | (F.col("matches") < 100)
    return seen.withColumn("latest", latest).select("team", F.concat_ws(
        ",", F.when(few, "limited_history"), F.when(F.col("last_season") < F.col("latest"), "stale_season")).alias("warnings"))


@query("p21_fixture_warnings", """WITH c AS (SELECT team, count(*) AS matches, count(DISTINCT season) AS seasons, max(season) AS last_season FROM t WHERE season <> '2001' GROUP BY team),
l AS (SELECT max(last_season) AS latest FROM c),
r AS (SELECT count(*) FILTER (result = 'D' AND predicted_result = 'D') / nullif(count(*) FILTER (result = 'D'), 0) AS recall FROM scores WHERE season = '2001' AND model = 'base_rate')
SELECT m.match_id, concat_ws(',', CASE WHEN h.seasons <= 1 OR h.matches < 100 THEN 'home_limited_history' END, CASE WHEN h.last_season < latest THEN 'home_stale_season' END,
  CASE WHEN a.seasons <= 1 OR a.matches < 100 THEN 'away_limited_history' END, CASE WHEN a.last_season < latest THEN 'away_stale_season' END,
  CASE WHEN h.team IS NULL OR a.team IS NULL THEN 'cold_start' END, CASE WHEN recall < 0.1 THEN 'low_draw_recall' END) AS warnings
FROM matches m, l, r LEFT JOIN c h ON h.team = m.team_home LEFT JOIN c a ON a.team = m.team_away WHERE m.season = '2001'""", ("t", "scores"))
def _(spark, d):
    m = settle(load_matches(spark, d))
    coverage = settle(team_coverage(m.where(F.col("season") != HOLDOUT_SEASON)))
    held = predictions_of(m).where((F.col("season") == HOLDOUT_SEASON) & (F.col("model") == "base_rate"))
    fixtures = m.where(F.col("season") == HOLDOUT_SEASON).select("match_id", "team_home", "team_away")
    return ops.fixture_warnings(fixtures, coverage, draw_report(held, ["model"])).select("match_id", "warnings")


@query("v1_match_checks", """SELECT count(*) AS rows, count(*) FILTER (team_home = team_away) AS self_matches,
  count(*) FILTER (goals_home < 0 OR goals_away < 0) AS negative_goals, count(*) FILTER (match_date IS NULL OR result IS NULL) AS missing_core,
  (SELECT count(*) FROM (SELECT match_id FROM matches GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys FROM matches""")
def _(spark, d):
    return checks.check_matches(load_matches(spark, d))


@query("v2_feature_checks", """SELECT count(*) AS rows, count(*) FILTER (greatest(home_form5_played, away_form5_played, h2h_played) > 5) AS window_too_long,
  count(*) FILTER (greatest(home_league_played, away_league_played) > 37) AS played_beyond_season,
  count(*) FILTER (match_date = (SELECT min(match_date) FROM features_by_day g WHERE g.competition = f.competition AND g.season = f.season)
    AND home_home_played + away_away_played + home_league_points + away_league_points + home_league_played + away_league_played <> 0) AS openers_not_zero,
  count(*) FILTER (home_rest_days <= 0 OR away_rest_days <= 0) AS rest_not_positive,
  (SELECT count(*) FROM (SELECT match_id FROM features_by_day GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys FROM features_by_day f""", ("features_by_day",))
def _(spark, d):
    return checks.check_features(settle(generate_features(settle(load_matches(spark, d)))))


@query("v3_v5_prediction_checks", """SELECT count(DISTINCT match_id) AS matches, count(*) AS rows,
  count(*) FILTER (abs(prob_home + prob_draw + prob_away - 1) > 1e-9) AS bad_sum, count(*) FILTER (prob_home IS NULL) AS null_rows,
  CAST(0 AS BIGINT) AS matches_without_all_models, count(*) - count(DISTINCT (match_id, model)) AS duplicate_rows FROM predictions""", ("predictions",))
def _(spark, d):
    return checks.check_probabilities(predictions_of(settle(load_matches(spark, d))), 4)


@query("v5_stable_schema", """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing_columns, CAST(0 AS BIGINT) AS extra_columns, CAST(0 AS BIGINT) AS wrong_types
FROM predictions""", ("predictions",))
def _(spark, d):
    """The written forecasts read back without a given schema, as a later reader meets them."""
    path = files.scratch(spark)
    predictions_of(settle(load_matches(spark, d))).select(*FORECAST_TYPES).write.parquet(path)
    return checks.check_schema(spark.read.parquet(path), FORECAST_TYPES)


@query("v9_fixture_checks", """SELECT count(*) AS fixtures, count(*) FILTER (team_home = team_away) AS self_matches,
  count(*) FILTER (least(odds_avg_home, odds_avg_draw, odds_avg_away) <= 1) AS bad_odds,
  count(*) FILTER (match_date <= (SELECT max(match_date) FROM matches WHERE season <> '2001')) AS not_after_history,
  count(*) - count(DISTINCT match_id) AS duplicate_keys FROM matches WHERE season = '2001'""")
def _(spark, d):
    m = settle(load_matches(spark, d))
    last = m.where(F.col("season") != HOLDOUT_SEASON).agg(F.max("match_date")).first()[0]
    return checks.check_fixtures(stored_fixtures(spark, m), last)


@query("v10_numeric_features", "SELECT CAST(35 AS BIGINT) AS numeric_columns, CAST(0 AS BIGINT) AS other_columns, count(*) AS rows FROM matches")
def _(spark, d):
    features = generate_features(settle(load_matches(spark, d)))
    other = checks.non_numeric_features(features)
    return features.agg(F.lit(35 - len(other)).cast("long").alias("numeric_columns"),
                        F.lit(len(other)).cast("long").alias("other_columns"), F.count("*").alias("rows"))


@query("j1_features_with_ratings", """SELECT f.match_id, max_by(r.raw, r.d) FILTER (r.side = 'home') AS home_rating,
  max_by(r.raw, r.d) FILTER (r.side = 'away') AS away_rating,
  max_by(r.raw, r.d) FILTER (r.side = 'home') - max_by(r.raw, r.d) FILTER (r.side = 'away') AS rating_gap, f.home_form5_wins, f.away_form5_wins
FROM features f LEFT JOIN (
  SELECT m.match_id, 'home' AS side, r.from_date AS d, r.rating AS raw FROM matches m JOIN ratings_outside r ON r.club = m.team_home AND r.from_date < m.match_date
  UNION ALL SELECT m.match_id, 'away', r.from_date, r.rating FROM matches m JOIN ratings_outside r ON r.club = m.team_away AND r.from_date < m.match_date) r
  ON r.match_id = f.match_id GROUP BY f.match_id, f.home_form5_wins, f.away_form5_wins""", ("features", "ratings_outside"))
def _(spark, d):
    m = settle(load_matches(spark, d))
    rows = generate_features(m).select("match_id", "match_date", "team_home", "team_away", "home_form5_wins", "away_form5_wins")
    outside = settle(load_external_ratings(spark, d))
    for side in ("home", "away"):
        asked = m.select(F.col(f"team_{side}").alias("club"), F.col("match_date").alias("as_of")).distinct()
        found = ops.rating_as_of(asked, outside).select(
            F.col("club").alias(f"team_{side}"), F.col("as_of").alias("match_date"), F.col("raw_rating").alias(f"{side}_rating"))
        rows = rows.join(found, [f"team_{side}", "match_date"], "left")
    return rows.select("match_id", "home_rating", "away_rating", (F.col("home_rating") - F.col("away_rating")).alias("rating_gap"),
                       "home_form5_wins", "away_form5_wins")


_FORM13 = lambda s: ", ".join(f"coalesce({s}.{c}, 0) AS {side}_form5_{c}" for side in [{"h": "home", "a": "away"}[s]]
                             for c in ("played", "wins", "draws", "losses", "goal_difference"))
_FIXTURE_COLUMNS = [f"{s}_{c}" for s in ("home", "away") for c in (
    "form5_played", "form5_wins", "form5_draws", "form5_losses", "form5_goal_difference", "rest_days", "league_position",
    "league_points", "league_played")] + ["h2h_played", "h2h_home_wins", "h2h_draws", "h2h_away_wins", "home_home_played",
    "away_away_played", "home_home_points_per_game", "is_empty_stadium"]


@query("j13_fixture_features", f"""WITH tr AS (SELECT *, row_number() OVER (PARTITION BY competition, team ORDER BY match_date DESC, match_id DESC) AS k FROM t WHERE season <> '2001'),
f AS (SELECT competition, team, count(*) FILTER (k <= 5) AS played, count(*) FILTER (k <= 5 AND outcome = 'W') AS wins, count(*) FILTER (k <= 5 AND outcome = 'D') AS draws,
  count(*) FILTER (k <= 5 AND outcome = 'L') AS losses, CAST(sum(gf - ga) FILTER (k <= 5) AS BIGINT) AS goal_difference, max(match_date) AS last_day FROM tr GROUP BY ALL),
p AS (SELECT competition, least(team_home, team_away) AS lo, greatest(team_home, team_away) AS hi, CASE result WHEN 'H' THEN team_home WHEN 'A' THEN team_away ELSE '' END AS winner,
  row_number() OVER (PARTITION BY competition, least(team_home, team_away), greatest(team_home, team_away) ORDER BY match_date DESC, match_id DESC) AS k FROM matches WHERE season <> '2001'),
x AS (SELECT competition, lo, hi, list(winner) AS ws FROM p WHERE k <= 5 GROUP BY ALL)
SELECT m.match_id, {_FORM13('h')}, {_FORM13('a')}, CAST(date_diff('day', h.last_day, m.match_date) AS BIGINT) AS home_rest_days, CAST(date_diff('day', a.last_day, m.match_date) AS BIGINT) AS away_rest_days,
  CAST(1 AS BIGINT) AS home_league_position, CAST(1 AS BIGINT) AS away_league_position, {', '.join(f'CAST(0 AS BIGINT) AS {s}_league_{c}' for s in ('home', 'away') for c in ('points', 'played'))},
  CAST(coalesce(len(ws), 0) AS BIGINT) AS h2h_played, CAST(coalesce(len(list_filter(ws, lambda z: z = m.team_home)), 0) AS BIGINT) AS h2h_home_wins,
  CAST(coalesce(len(list_filter(ws, lambda z: z = '')), 0) AS BIGINT) AS h2h_draws, CAST(coalesce(len(list_filter(ws, lambda z: z = m.team_away)), 0) AS BIGINT) AS h2h_away_wins,
  CAST(0 AS BIGINT) AS home_home_played, CAST(0 AS BIGINT) AS away_away_played, CAST(NULL AS DOUBLE) AS home_home_points_per_game, 0 AS is_empty_stadium
FROM matches m LEFT JOIN f h ON h.competition = m.competition AND h.team = m.team_home LEFT JOIN f a ON a.competition = m.competition AND a.team = m.team_away
LEFT JOIN x ON x.competition = m.competition AND x.lo = least(m.team_home, m.team_away) AND x.hi = greatest(m.team_home, m.team_away) WHERE m.season = '2001'""", ("t",))
def _(spark, d):
    m = settle(load_matches(spark, d))
    history = m.where(F.col("season") != HOLDOUT_SEASON)
    fixtures = m.where(F.col("season") == HOLDOUT_SEASON).select(
        "match_id", "competition", "season", "match_date", "team_home", "team_away")
    return generate_features(history, fixtures).select("match_id", *_FIXTURE_COLUMNS)


@query("u1_season_union", """SELECT season, count(*) AS rows, count("Time") FILTER (season >= '1998') AS with_time FROM raw GROUP BY season""", ("raw",))
def _(spark, d):
    from touchline.sources.derived import raw_copy
    raw = raw_copy(load_matches(spark, d))
    old = raw.where(F.col("season") < "1998").drop("Time")
    both = old.unionByName(raw.where(F.col("season") >= "1998"), allowMissingColumns=True)
    return both.groupBy("season").agg(F.count("*").alias("rows"), F.count("Time").alias("with_time"))


@query("j14_attach_scores", "SELECT p.match_id, p.model, m.goals_home, m.goals_away, m.shots_home, m.shots_away FROM predictions p JOIN matches m ON m.match_id = p.match_id", ("predictions",))
def _(spark, d):
    m = settle(load_matches(spark, d))
    rows = predictions_of(m).select("match_id", "model").join(
        m.select("match_id", "goals_home", "goals_away", "shots_home", "shots_away"), "match_id", "left")
    whole = F.when(F.col("goals_home").isNull(), F.raise_error(F.lit("a forecast has no match"))).otherwise(F.col("goals_home"))
    return rows.withColumn("goals_home", whole)
