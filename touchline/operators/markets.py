"""Forecasts against decoded odds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.probability import decode_odds
from touchline.operators.ordering import global_row_number

ODDS = ("odds_home", "odds_draw", "odds_away")
SIDES = (("H", "home"), ("D", "draw"), ("A", "away"))


def value_rows(fixtures: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per fixture, model and outcome with expected value and edge over the market."""
    market = decode_odds(fixtures.select("fixture_id", *ODDS), ODDS, tuple(f"market_{s}" for _, s in SIDES))
    rows = fixtures.select("fixture_id", "season", "team_home", "team_away").join(market, "fixture_id", "left").join(
        predictions, "fixture_id", "left")
    outcomes = F.array(*[F.struct(
        F.lit(code).alias("outcome"), F.col(f"prob_{s}").alias("model_probability"),
        F.col(f"market_{s}").alias("market_probability"), F.col(f"odds_{s}").alias("decimal_odds")) for code, s in SIDES])
    long = rows.select("fixture_id", "season", "team_home", "team_away", "model", "overround", F.inline(outcomes))
    ev = F.col("model_probability") * F.col("decimal_odds") - 1
    return long.withColumns({
        "probability_edge": F.col("model_probability") - F.col("market_probability"),
        "expected_value": ev, "expected_value_percent": ev * 100})


def value_table(fixtures: DataFrame, predictions: DataFrame) -> DataFrame:
    """Value rows ranked by expected value over the whole table; analysis only, not advice."""
    order = [F.desc(F.round("expected_value", 9)), F.desc(F.round("model_probability", 9)), F.asc("fixture_id"), F.asc("model"), F.asc("outcome")]
    return global_row_number(value_rows(fixtures, predictions), order, "ev_rank")
