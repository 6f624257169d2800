"""The SQL that the checks share: one row a key, and the rule of the query it stands beside."""

import duckdb
import pytest

from touchline.operators import checks
from touchline.plans import load_all
from touchline.plans.registry import ORACLES, with_blocks


@pytest.fixture(scope="module")
def db(rows):
    made = duckdb.connect()
    made.execute("CREATE TABLE matches (match_id BIGINT, competition VARCHAR, season VARCHAR, match_date DATE, team_home VARCHAR, "
                 "team_away VARCHAR, goals_home INT, goals_away INT, result VARCHAR)")
    made.executemany("INSERT INTO matches VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", [r[:9] for r in rows])
    return made


def block(name):
    """The SQL over the table ``matches`` in place of its block."""
    sql = with_blocks(f"SELECT * FROM {name}", name)
    return "WITH t AS " + sql.split("t AS ", 1)[1]


def test_venue_record_is_summed_by_day(db):
    split, by_day = (db.execute(block(n) + " ORDER BY ALL").fetchall() for n in ("split", "split_by_day"))
    assert by_day == split and len({r[:5] for r in by_day}) == len(by_day)


def test_feature_queries_read_the_sums_by_day():
    load_all()
    for name in ("w3_venue_split", "w_all_match_features", "w_league_table_and_form", "v2_feature_checks"):
        assert "split_by_day" in ORACLES[name] and "DISTINCT competition, season, team, venue" not in ORACLES[name]


def test_value_order_is_judged_at_the_decimals_of_the_rank(spark):
    rows = [(1, 0.5, 2.0, 0.0), (2, 0.5, 2.0 + 2e-10, 1e-10), (3, 0.4, 2.0, -0.2), (4, 0.45, 2.0, -0.1)]
    table = spark.createDataFrame(rows, "ev_rank long, model_probability double, decimal_odds double, expected_value double")
    got = checks.check_value_table(table).first()
    assert (got["rows"], got["bad_arithmetic"], got["out_of_order"], got["missing"]) == (4, 0, 1, 0)


def test_value_check_states_its_rule():
    load_all()
    assert "CAST(0 AS BIGINT)" not in ORACLES["v8_value_table_checks"]
