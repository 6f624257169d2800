"""Ratings against a plain loop; cutting history into blocks must not change a single bit."""

import pytest

from touchline.operators import ratings


def loop(rows, seeds):
    state, out = {}, {}
    order = sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0]))
    seen = set()
    for r in order:
        comp, season = r[1], r[2]
        if (comp, season) not in seen:
            seen.add((comp, season))
            for team, value, bottom in sorted(seeds.get((comp, season), []), key=lambda s: s[0]):
                known = [state[comp, b] for b in bottom or () if (comp, b) in state]
                state[comp, team] = value if value is not None else sum(known) / len(known) if known else 1500.0
        h, a = state.get((comp, r[4]), 1500.0), state.get((comp, r[5]), 1500.0)
        gain = 20.0 * ({"H": 1.0, "D": 0.5, "A": 0.0}[r[8]] - 1.0 / (1.0 + 10.0 ** (-(h + 100.0 - a) / 400.0)))
        state[comp, r[4]], state[comp, r[5]] = h + gain, a - gain
        out[r[0]] = (h, a, h + gain, a - gain)
    return out


@pytest.mark.parametrize("rows_per_block", [10**6, 37])
def test_blocks_equal_one_pass(spark, matches, rows, rows_per_block):
    outside = spark.sql("SELECT 'T1' AS club, DATE'2001-06-01' AS from_date, 1800.0D AS rating")
    seeds = ratings.seed_requests(matches, outside)
    known = {}
    for s in seeds.collect():
        known.setdefault((s["competition"], s["season"]), []).append((s["team"], s["rescaled"], s["bottom"]))
    assert any(v is None for group in known.values() for _, v, _ in group)
    done = ratings.rate(matches, seeds, rows_per_block=rows_per_block)
    found = {r["match_id"]: (r["home_pre"], r["away_pre"], r["home_post"], r["away_post"]) for r in done.where("kind = 'match'").collect()}
    assert found == loop(rows, known)


def test_rating_as_of_is_strict(spark):
    from touchline.operators.summaries import rating_as_of
    ratings_ = spark.sql("SELECT * FROM VALUES ('X', DATE'2020-01-01', 1500D), ('X', DATE'2020-02-01', 1600D) t(club, from_date, rating)")
    asked = spark.sql("SELECT * FROM VALUES ('X', DATE'2020-01-01'), ('X', DATE'2020-02-01'), ('X', DATE'2020-02-02'), ('Y', DATE'2020-02-02') t(club, as_of)")
    found = {(r["club"], str(r["as_of"])): r["raw_rating"] for r in rating_as_of(asked, ratings_).collect()}
    assert found == {("X", "2020-01-01"): None, ("X", "2020-02-01"): 1500.0, ("X", "2020-02-02"): 1600.0, ("Y", "2020-02-02"): None}


def test_history_is_dealt_by_competition_and_block(matches, monkeypatch):
    plans, settle = [], ratings.settle
    monkeypatch.setattr(ratings, "settle", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or settle(df))
    ratings.rate(matches, rows_per_block=37)
    dealt = [line for plan in plans for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert dealt and all("competition" in line and "block" in line for line in dealt)


def test_no_event_sends_a_null_list_to_its_fold(spark, matches, monkeypatch):
    """Spark's Arrow writer takes time with the square of the null lists of a batch."""
    seen, settle = [], ratings.settle
    monkeypatch.setattr(ratings, "settle", lambda df: (seen.append(df) if "bottom" in df.columns else None) or settle(df))
    seeds = ratings.seed_requests(matches, None)
    ratings.rate(matches, seeds, rows_per_block=37)
    assert seen and all(df.where("bottom IS NULL").count() == 0 for df in seen)
