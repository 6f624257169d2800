"""Data checks: each is one aggregate over the table, raised as an error by ``require``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.schema import FEATURE_COLUMNS, FORM_WINDOW
from touchline.session import settle


def _count(condition):
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def require(report: DataFrame, *columns: str) -> None:
    """Fail when any of the named counts is not zero."""
    row = report.select(*[F.sum(c).alias(c) for c in columns]).first()
    bad = {c: row[c] for c in columns if row[c]}
    if bad:
        raise ValueError(f"data check failed: {bad}")


def duplicate_keys(df: DataFrame, keys: list) -> DataFrame:
    """Number of key values that occur more than once."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(_count(F.col("n") > 1).alias("duplicate_keys"))


def check_matches(matches: DataFrame) -> DataFrame:
    core = ["match_date", "team_home", "team_away", "result"]
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in core]) > 0
    facts = matches.agg(
        F.count("*").alias("rows"), _count(F.col("team_home") == F.col("team_away")).alias("self_matches"),
        _count((F.col("goals_home") < 0) | (F.col("goals_away") < 0)).alias("negative_goals"),
        _count(missing).alias("missing_core"))
    return _beside(facts, duplicate_keys(matches, ["match_id"]))


def _beside(*one_row: DataFrame) -> DataFrame:
    """Put several one-row reports next to each other."""
    out = one_row[0].withColumn("one", F.lit(1))
    for other in one_row[1:]:
        out = out.join(other.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def check_features(features: DataFrame, max_league_played: int = 37) -> DataFrame:
    opening = settle(features.groupBy("competition", "season").agg(F.min("match_date").alias("first_day")))
    zero = ["home_home_played", "away_away_played", "home_league_points", "away_league_points",
            "home_league_played", "away_league_played"]
    not_zero = sum((F.col(c) for c in zero[1:]), F.col(zero[0])) != 0
    window = F.greatest("home_form5_played", "away_form5_played", "h2h_played")
    facts = features.join(opening, ["competition", "season"]).agg(
        F.count("*").alias("rows"), _count(window > FORM_WINDOW).alias("window_too_long"),
        _count(F.greatest("home_league_played", "away_league_played") > max_league_played).alias("played_beyond_season"),
        _count((F.col("match_date") == F.col("first_day")) & not_zero).alias("openers_not_zero"),
        _count((F.col("home_rest_days") <= 0) | (F.col("away_rest_days") <= 0)).alias("rest_not_positive"))
    return _beside(facts, duplicate_keys(features, ["match_id"]))


def check_probabilities(predictions: DataFrame, models: int) -> DataFrame:
    """Sums, coverage of matches by models, uniqueness."""
    total = F.col("prob_home") + F.col("prob_draw") + F.col("prob_away")
    per_match = predictions.groupBy("match_id").agg(
        F.count("*").alias("n"), F.countDistinct("model").alias("models"), _count(F.abs(total - 1) > 1e-9).alias("bad"),
        _count(total.isNull()).alias("nulls"))
    return per_match.agg(
        F.count("*").alias("matches"), F.sum("n").alias("rows"), F.sum("bad").alias("bad_sum"),
        F.sum("nulls").alias("null_rows"), _count(F.col("models") != models).alias("matches_without_all_models"),
        F.sum(F.col("n") - F.col("models")).alias("duplicate_rows"))


def check_rating_history(history: DataFrame) -> DataFrame:
    """Two rows per match, one a venue, that mirror each other; ratings present."""
    per_match = history.groupBy("match_id").agg(
        F.count("*").alias("n"), F.countDistinct("venue").alias("v"), F.abs(F.sum("elo_gap_pre")).alias("gap"),
        _count(F.col("elo_pre").isNull() | F.col("elo_post").isNull()).alias("nulls"))
    return per_match.agg(F.count("*").alias("matches"), F.sum("n").alias("rows"), _count((F.col("n") != 2) | (F.col("v") != 2)).alias("not_two_views"),
                         _count(F.col("gap") > 1e-9).alias("not_mirrored"), F.sum("nulls").alias("null_ratings"))


def check_schema(table: DataFrame, expected: dict) -> DataFrame:
    """Columns of the stable layout that are missing, of another type, or not in it; one row of counts."""
    found = dict(table.dtypes)
    facts = {"missing_columns": set(expected) - set(found), "extra_columns": set(found) - set(expected),
             "wrong_types": {c for c in expected if c in found and found[c] != expected[c]}}
    return table.agg(F.count("*").alias("rows"), *[F.lit(len(v)).cast("long").alias(k) for k, v in facts.items()])


def check_split(rows: DataFrame, part: str = "part") -> DataFrame:
    """Training must end before validation starts, fold by fold."""
    edge = rows.groupBy("fold").agg(
        F.max(F.when(F.col(part) == "train", F.col("match_date"))).alias("last_train"),
        F.min(F.when(F.col(part) == "validation", F.col("match_date"))).alias("first_validation"),
        _count(F.col(part) == "train").alias("train_rows"), _count(F.col(part) == "validation").alias("validation_rows"))
    return edge.withColumn("overlap", (F.col("last_train") >= F.col("first_validation")).cast("long"))


def check_value_table(table: DataFrame) -> DataFrame:
    """Expected-value arithmetic, completeness and order by rank; ranks are given to values of nine decimals (``value_table``)."""
    following = table.select((F.col("ev_rank") - 1).alias("ev_rank"), F.round("expected_value", 9).alias("next_value"))
    ev = F.col("model_probability") * F.col("decimal_odds") - 1
    return table.join(following, "ev_rank", "left").agg(
        F.count("*").alias("rows"), _count(F.abs(ev - F.col("expected_value")) > 1e-12).alias("bad_arithmetic"),
        _count(F.col("next_value") > F.round("expected_value", 9)).alias("out_of_order"),
        _count(F.col("expected_value").isNull()).alias("missing"))


def check_fixtures(fixtures: DataFrame, last_match) -> DataFrame:
    odds_bad = F.least("odds_home", "odds_draw", "odds_away") <= 1
    facts = fixtures.agg(
        F.count("*").alias("fixtures"), _count(F.col("team_home") == F.col("team_away")).alias("self_matches"),
        _count(odds_bad).alias("bad_odds"), _count(F.to_date("datetime") <= F.lit(last_match)).alias("not_after_history"))
    return _beside(facts, duplicate_keys(fixtures, ["fixture_id"]))


def non_numeric_features(features: DataFrame) -> list:
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    kinds = dict(features.dtypes)
    return [c for c in FEATURE_COLUMNS if kinds.get(c) not in numeric]
