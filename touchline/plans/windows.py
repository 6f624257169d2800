"""Queries over the point-in-time windows (W1-W5, W9) and the feature table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators.features import generate_features, head_to_head, league_by_day, team_day_features
from touchline.operators.teams import DAY
from touchline.plans.registry import query
from touchline.session import settle
from touchline.sources.derived import load_matches

TEAM_DAY = ["competition", "team", "match_date"]


def _rounded(df, *ends):
    return df.withColumns({c: F.round(c, 9) for c in df.columns if c.endswith(ends)})


@query("w1_recent_form", "SELECT * FROM form", ("form",))
def _(spark, d):
    days = team_day_features(settle(load_matches(spark, d)))
    return days.select(*TEAM_DAY, *[c for c in days.columns if c.startswith("form5_")])


@query("w2_head_to_head", "SELECT * FROM h2h", ("h2h",))
def _(spark, d):
    features = generate_features(settle(load_matches(spark, d)))
    return features.select("match_id", *[c for c in features.columns if c.startswith("h2h_")])


@query("w3_venue_split", """
SELECT m.match_id, s.venue, s.played, s.wins, s.draws, s.losses, s.points_per_game, s.goal_difference_per_game
FROM t m JOIN split_by_day s USING (competition, season, team, venue, match_date)""", ("t", "split_by_day"))
def _(spark, d):
    features = _rounded(generate_features(settle(load_matches(spark, d))), "per_game")
    names = ("played", "wins", "draws", "losses", "points_per_game", "goal_difference_per_game")
    sides = [F.struct(F.lit(v).alias("venue"), *[F.col(f"{v}_{v}_{c}").alias(c) for c in names]) for v in ("home", "away")]
    return features.select("match_id", F.inline(F.array(*sides)))


@query("w4_rest_days", "SELECT * FROM rest", ("rest",))
def _(spark, d):
    return team_day_features(settle(load_matches(spark, d))).select(*TEAM_DAY, "rest_days")


@query("w5_league_position", "SELECT * FROM league", ("league",))
def _(spark, d):
    return league_by_day(settle(load_matches(spark, d))).select(*DAY, "league_position", "league_points", "league_played")


@query("w9_season_openers", """
SELECT match_id, competition, season, match_date, home_home_played, away_away_played, home_league_points,
  away_league_points, home_league_played, away_league_played,
  home_home_played + away_away_played + home_league_points + away_league_points + home_league_played
    + away_league_played = 0 AS opens_at_zero
FROM features f WHERE match_date = (SELECT min(match_date) FROM matches m
  WHERE m.season = f.season AND m.competition = f.competition)""", ("features",))
def _(spark, d):
    features = generate_features(settle(load_matches(spark, d)))
    columns = ["home_home_played", "away_away_played", "home_league_points", "away_league_points",
               "home_league_played", "away_league_played"]
    opening = features.groupBy("competition", "season").agg(F.min("match_date").alias("match_date"))
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return features.join(opening, ["competition", "season", "match_date"]).select(
        "match_id", "competition", "season", "match_date", *columns, (total == 0).alias("opens_at_zero"))


@query("w_all_match_features", "SELECT * FROM features_by_day", ("features_by_day",))
def _(spark, d):
    return _rounded(generate_features(settle(load_matches(spark, d))), "per_game")


@query("w_league_table_and_form", """
SELECT f.match_id, f.competition, f.season, f.match_date, f.team_home, f.team_away, f.home_league_position,
  f.home_league_points, f.home_form5_wins, f.home_form5_goal_difference, f.away_league_position,
  f.away_league_points, f.away_form5_wins, f.away_form5_goal_difference, f.result FROM features_by_day f""", ("features_by_day",))
def _(spark, d):
    return generate_features(settle(load_matches(spark, d))).select(
        "match_id", "competition", "season", "match_date", "team_home", "team_away", "home_league_position",
        "home_league_points", "home_form5_wins", "home_form5_goal_difference", "away_league_position",
        "away_league_points", "away_form5_wins", "away_form5_goal_difference", "result")
