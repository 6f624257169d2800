"""Run metadata, fixture warnings and data checks on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from touchline.operators import checks, ratings, summaries
from touchline.operators.teams import team_coverage

DAY = datetime.date(2001, 1, 1)


def test_run_metadata_counts_the_rows_each_model_can_use(spark):
    rows = [("2001", DAY, "H", 5), ("2002", DAY.replace(year=2002), "D", None), ("2003", DAY.replace(year=2003), "A", 7)]
    train = spark.createDataFrame(rows, "season string, match_date date, result string, corners int")
    runs = summaries.run_metadata(train, {"outcome": ["result"], "corners": ["result", "corners"]})
    got = {r.model: tuple(r)[1:] for r in runs.collect()}
    assert got == {"outcome": (3, "2001,2002,2003", DAY, DAY.replace(year=2003)), "corners": (2, "2001,2003", DAY, DAY.replace(year=2003))}
    assert tuple(summaries.training_consistency(runs).first()) == (2, 1, 2, True)
    assert tuple(summaries.training_consistency(runs.where("model = 'outcome'")).first()) == (1, 1, 1, False)


def test_run_metadata_of_no_rows(spark):
    train = spark.createDataFrame([], "season string, match_date date, result string")
    assert tuple(summaries.run_metadata(train, {"outcome": ["result"]}).first()) == ("outcome", 0, "", None, None)


def test_fixture_warnings_name_every_reason_once(spark):
    coverage = spark.createDataFrame([("old", 300, 3, "2001"), ("new", 20, 1, "2002"), ("sound", 200, 2, "2002")],
                                     "team string, matches long, seasons long, last_season string")
    fixtures = spark.createDataFrame([(1, "sound", "sound"), (2, "old", "new"), (3, "new", "nobody")], "match_id int, team_home string, team_away string")

    def warned(recall):
        asked = spark.createDataFrame([(recall,)], "draw_recall double")
        return {r.match_id: r.warnings for r in summaries.fixture_warnings(fixtures, coverage, asked).collect()}

    plain = {1: "", 2: "home_stale_season,away_limited_history", 3: "home_limited_history,cold_start"}
    assert warned(0.1) == plain and warned(None) == plain
    assert warned(0.0999) == {k: f"{v},low_draw_recall".lstrip(",") for k, v in plain.items()}


def test_coverage_feeds_the_warnings(spark, matches):
    coverage = team_coverage(matches.where("season < '2003'"))
    asked = spark.createDataFrame([(0.5,)], "draw_recall double")
    fixtures = matches.where("season = '2003'").select("match_id", "team_home", "team_away")
    rows = summaries.fixture_warnings(fixtures, coverage, asked)
    assert rows.count() == fixtures.count()
    known = {r.team for r in coverage.collect()}
    for r in rows.collect():
        assert ("cold_start" in r.warnings) == (r.team_home not in known or r.team_away not in known)


def test_rating_history_check_finds_a_lost_and_a_changed_view(matches):
    history = ratings.rating_history(ratings.rate(matches)).cache()
    n = matches.count()
    assert tuple(checks.check_rating_history(history).first()) == (n, 2 * n, 0, 0, 0)
    first = history.agg(F.min("match_id")).first()[0]
    lost = history.where(~((F.col("match_id") == first) & (F.col("venue") == "away")))
    assert checks.check_rating_history(lost).first()["not_two_views"] == 1
    wrong = history.withColumn("elo_gap_pre", F.when((F.col("match_id") == first) & (F.col("venue") == "home"), F.lit(1e6)).otherwise(F.col("elo_gap_pre")))
    assert checks.check_rating_history(wrong).first()["not_mirrored"] == 1


def test_schema_check_counts_each_kind_of_difference(spark):
    table = spark.sql("SELECT 1 AS a, 'x' AS b, 2.0D AS c")
    row = checks.check_schema(table, {"a": "bigint", "b": "string", "d": "double"}).first()
    assert row.asDict() == {"rows": 1, "missing_columns": 1, "extra_columns": 1, "wrong_types": 1}


def test_referee_factors_without_a_named_referee(spark):
    rows = [(None, 2, 1), ("  ", 3, 0)]
    train = spark.createDataFrame(rows, "referee string, yellow_cards_home int, yellow_cards_away int")
    assert summaries.referee_card_factors(train).count() == 0
    named = spark.createDataFrame(rows + [("R", 4, 2)] * 3, train.schema)
    got = {r.referee: (r.training_matches, round(r.factor, 9), r.category) for r in summaries.referee_card_factors(named, minimum=3, prior=3).collect()}
    assert got == {None: (2, 1.0, summaries.REFEREE_OTHER), "R": (3, round((18 + 3 * 24 / 5) / 6 / (24 / 5), 9), "R")}


@pytest.mark.parametrize("extra", ["rows", "n"])
def test_checks_ignore_columns_of_the_same_name(spark, extra):
    table = spark.sql("SELECT 1L AS a").withColumn(extra, F.lit(5))
    assert checks.check_schema(table, {"a": "bigint", extra: "int"}).first()["rows"] == 1
