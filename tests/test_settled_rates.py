"""Count fits that run until they settle: against long plain sweeps, score equations, the joint maximum, and by joins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import counts, folds
from touchline.operators import settled_rates as sr


def _by_key(df, keys=("competition", "target", "team")):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.fixture(scope="module")
def cells(matches):
    return counts.fit_cells(counts.day_cells(matches, ("goals", "goal_per_shot")))


def test_settled_fit_equals_many_plain_sweeps_in_fewer(cells):
    many = _by_key(counts.fit_rates(cells, sweeps=400))
    found = _by_key(sr.settled_rates(cells))
    assert found.keys() == many.keys()
    for k, r in found.items():
        assert r.settled and r.sweeps < 60 and r.rho == 0.0
        for c in ("attack", "defense", "home_advantage"):
            assert r[c] == pytest.approx(many[k][c], abs=1e-8)


def test_score_equations_hold(cells):
    rates = _by_key(sr.settled_rates(cells))
    won, expected = {}, {}
    for c in cells.collect():
        key = (c.competition, c.target)
        a, b = rates[*key, c.team], rates[*key, c.opponent]
        rate = c.we * math.exp(a.attack + b.defense + a.home_advantage * c.is_home)
        for name in (("attack", c.team), ("defense", c.opponent)):
            won[key, name] = won.get((key, name), 0) + c.wy
            expected[key, name] = expected.get((key, name), 0) + rate
    assert all(expected[k] == pytest.approx(max(won[k], counts.LEAST_MASS), rel=1e-7) for k in won)


def test_an_unsettled_fit_is_flagged(cells):
    rows = sr.fit_report(sr.settled_rates(cells, rounds=1)).collect()
    assert rows and not any(r.settled for r in rows) and all(r.sweeps == 2 and r.gap > 1e-9 for r in rows)


def test_joint_fit_is_the_joint_maximum(matches):
    part = matches.where("competition = 'A'")
    found = sr.settled_rates(counts.fit_cells(counts.day_cells(part)), sr.low_score_sums(part)).collect()
    assert all(r.settled for r in found)
    att, dfn = {r.team: r.attack for r in found}, {r.team: r.defense for r in found}
    data = part.collect()
    last = max(m.match_date for m in data)

    def likelihood(att, dfn, h, rho):
        total = 0.0
        for m in data:
            a, b = math.exp(att[m.team_home] + dfn[m.team_away] + h), math.exp(att[m.team_away] + dfn[m.team_home])
            t = {(0, 0): 1 - a * b * rho, (0, 1): 1 + a * rho, (1, 0): 1 + b * rho, (1, 1): 1 - rho}.get((m.goals_home, m.goals_away), 1.0)
            w = math.exp(-counts.TIME_DECAY * (last - m.match_date).days)
            total += w * (math.log(t) + m.goals_home * math.log(a) - a + m.goals_away * math.log(b) - b)
        return total

    h, rho = found[0].home_advantage, found[0].rho
    assert abs(rho) > 1e-3
    slope = lambda f, e=1e-5: (f(e) - f(-e)) / (2 * e)
    assert slope(lambda e: likelihood(att, dfn, h + e, rho)) == pytest.approx(0, abs=1e-4)
    assert slope(lambda e: likelihood(att, dfn, h, rho + e)) == pytest.approx(0, abs=1e-4)
    for team in att:
        assert slope(lambda e: likelihood(att | {team: att[team] + e}, dfn, h, rho)) == pytest.approx(0, abs=1e-4)
        assert slope(lambda e: likelihood(att, dfn | {team: dfn[team] + e}, h, rho)) == pytest.approx(0, abs=1e-4)
    assert likelihood(att, dfn, h, rho) > max(likelihood(att, dfn, h, rho + s) for s in (-0.02, 0.02))


def test_joins_follow_the_same_steps(matches):
    low = sr.low_score_sums(matches)
    cells = counts.fit_cells(counts.day_cells(matches))
    one, other = (_by_key(sr.settled_rates(cells, low, rounds=2, limit=n)) for n in (10 ** 6, 1))
    assert one.keys() == other.keys()
    for k, r in one.items():
        assert r.sweeps == other[k].sweeps
        for c in (*sr.FITTED, "gap"):
            assert r[c] == pytest.approx(other[k][c], abs=1e-9)


def test_joins_close_settled_fits_and_go_on_with_the_rest(matches):
    cells = counts.fit_cells(counts.day_cells(matches))
    gap = {r.competition: r.gap for r in sr.fit_report(sr.settled_rates(cells, rounds=1)).collect()}
    middle = float(np.mean(list(gap.values())))  # one of two fits is done after its first round
    rows = {r.competition: r for r in sr.fit_report(sr.settled_rates(cells, tolerance=middle, limit=1)).collect()}
    assert sorted(r.sweeps for r in rows.values())[0] == 2 < sorted(r.sweeps for r in rows.values())[1]
    assert all(r.settled for r in rows.values())


def test_folds_differ_and_empty_cells_give_no_fit(matches):
    roles = folds.season_membership(matches, "2003", 1)
    rows = sr.settled_rates(counts.fit_cells(counts.day_cells(matches), roles), sr.low_score_sums(matches, roles))
    assert {r.fold for r in rows.select("fold").distinct().collect()} == {1} and not rows.where("NOT settled").count()
    nothing = matches.where(F.lit(False))
    assert sr.settled_rates(counts.fit_cells(counts.day_cells(nothing)), sr.low_score_sums(nothing)).count() == 0


def test_a_team_without_events_settles_where_plain_sweeps_lead(spark):
    rows = [("A", "red", 0.0, "x", "y", 1, 0.0, 9.0), ("A", "red", 0.0, "y", "x", 0, 1.0, 8.0), ("A", "red", 0.0, "y", "z", 1, 2.0, 9.0),
            ("A", "red", 0.0, "z", "y", 0, 0.0, 7.0), ("A", "red", 0.0, "z", "x", 1, 1.0, 5.0), ("A", "red", 0.0, "x", "z", 0, 0.0, 5.0)]
    cells = spark.createDataFrame(rows, "competition string, target string, xi double, team string, opponent string, is_home int, wy double, we double")
    plain = _by_key(counts.fit_rates(cells, sweeps=6000))  # a slow case: each plain sweep closes 0.3 % of what is left
    for k, r in _by_key(sr.settled_rates(cells)).items():
        assert r.settled and r.sweeps < 300
        for c in ("attack", "defense", "home_advantage"):
            assert r[c] == pytest.approx(plain[k][c], abs=1e-5)


def test_expected_goal_inputs_see_only_days_before_the_fold(matches):
    from touchline.operators.walkforward import expected_goal_inputs
    days = folds.date_membership(matches)
    inputs = [f"{fit}_expected_{s}" for fit in ("goals", "joint") for s in ("home", "away")]
    got = {r.match_id: r for r in expected_goal_inputs(matches, days).collect()}
    first = matches.join(days.where("part = 'validation'"), "match_date").groupBy("fold").agg(F.min("match_date").alias("first"))
    assert got and len(got) == matches.join(days.where("part = 'validation'"), "match_date").count()
    third = first.where("fold = 3").first()["first"]
    later = matches.withColumn("goals_home", F.when(F.col("match_date") >= F.lit(third), F.lit(9)).otherwise(F.col("goals_home")))
    moved = {r.match_id: r for r in expected_goal_inputs(later, days).collect()}
    assert got.keys() == moved.keys()
    for k, r in got.items():
        if r.fold <= 3:
            assert [r[c] for c in inputs] == pytest.approx([moved[k][c] for c in inputs], abs=1e-9)
    assert any(abs(r[inputs[0]] - moved[k][inputs[0]]) > 0.1 for k, r in got.items() if r.fold > 3)
    assert any(abs(r["goals_expected_home"] - r["joint_expected_home"]) > 1e-5 for r in got.values())
