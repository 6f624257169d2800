"""Count models fitted until they settle, and the goal model joint with its low-score dependence."""

from pyspark.sql import functions as F

from touchline.operators import counts, grids
from touchline.operators import settled_rates as sr
from touchline.plans.blocks import BLOCKS
from touchline.plans.count_blocks import grid_sql, rates_block
from touchline.plans.counts import ALL, PAIR, split_matches
from touchline.plans.metrics import rounded
from touchline.plans.registry import query

SQL_SWEEPS = 60  # plain sweeps that the SQL unrolls; enough for five digits
_PARAMS = ", ".join(f"round({c}, 5) AS {c}" for c in ("attack", "defense", "home_advantage"))

rates_block("settled_train", "train_cells", sweeps=SQL_SWEEPS)
rates_block("settled_rate", "rate_cells", sweeps=SQL_SWEEPS)
BLOCKS["low_sums"] = (("matches",), """
  WITH b AS (SELECT competition, max(match_date) AS base_date FROM matches WHERE season <> '2001' GROUP BY 1),
  w AS (SELECT m.competition, team_home, team_away, goals_home AS i, goals_away AS j, exp(-0.0018e0 * date_diff('day', match_date, base_date)) AS w
    FROM matches m JOIN b USING (competition) WHERE season <> '2001')
  SELECT competition, team_home, team_away, """ + ", ".join(
    f"coalesce(sum(w) FILTER (i = {i} AND j = {j}), 0e0) AS w{i}{j}" for i in (0, 1) for j in (0, 1)) + " FROM w GROUP BY ALL", "MATERIALIZED ")


def _joint_block(name, sweeps):
    """Unrolled sweeps of the joint fit. Tables: t team effects, f home advantage and rho of a competition, p pairs, k corrections."""
    least = f"greatest(sum({{}}), {counts.LEAST_MASS}e0)"
    parts = ["c AS MATERIALIZED (SELECT competition, team, opponent, is_home, wy, we FROM train_cells WHERE target = 'goals')",
             "z AS MATERIALIZED (SELECT competition, team, " + least.format("x") + " AS won, " + least.format("y") + """ AS lost FROM (
      SELECT competition, team, wy AS x, 0e0 AS y FROM c UNION ALL SELECT competition, opponent, 0e0, wy FROM c) GROUP BY ALL)""",
             "z2 AS MATERIALIZED (SELECT competition, " + least.format("wy * is_home") + " AS at_home FROM c GROUP BY ALL)",
             "t0 AS (SELECT competition, team, 0e0 AS a, 0e0 AS d FROM z)", "f0 AS (SELECT competition, 0e0 AS h, 0e0 AS rho FROM z2)"]
    pairs = lambda t, f: f"""SELECT l.*, exp(x.a + y.d + f.h) AS lam, exp(y.a + x.d) AS mu, f.rho FROM low_sums l JOIN {t} x ON x.competition = l.competition
      AND x.team = team_home JOIN {t} y ON y.competition = l.competition AND y.team = team_away JOIN {f} f ON f.competition = l.competition"""
    now = lambda c, d: f"greatest({c} + coalesce({d}, 0e0), 0.1e0 * {c})"
    for i in range(1, sweeps + 1):
        t, f = f"t{i - 1}", f"f{i - 1}"
        parts += [
            f"""p{i} AS MATERIALIZED (SELECT *, -w00 * lam * mu * rho / (1 - lam * mu * rho) + w01 * lam * rho / (1 + lam * rho) AS g,
      -w00 * lam * mu * rho / (1 - lam * mu * rho) + w10 * mu * rho / (1 + mu * rho) AS q FROM ({pairs(t, f)}))""",
            f"""k{i} AS MATERIALIZED (SELECT competition, team, sum(dw) AS dw, sum(dl) AS dl, sum(dh) AS dh FROM (
      SELECT competition, team_home AS team, g AS dw, q AS dl, g AS dh FROM p{i} UNION ALL SELECT competition, team_away, q, g, 0e0 FROM p{i}) GROUP BY ALL)""",
            f"""a{i} AS MATERIALIZED (SELECT z.competition, z.team, ln({now('won', 'dw')} / e) AS a, {now('lost', 'dl')} AS lost_now FROM z LEFT JOIN k{i} USING (competition, team)
      JOIN (SELECT c.competition, c.team, sum(we * exp(o.d + f.h * is_home)) AS e FROM c JOIN {t} o ON o.competition = c.competition AND o.team = c.opponent
        JOIN {f} f ON f.competition = c.competition GROUP BY ALL) USING (competition, team))""",
            f"""t{i} AS MATERIALIZED (SELECT a{i}.competition, a{i}.team, a, ln(lost_now / e) AS d FROM a{i}
      JOIN (SELECT c.competition, c.opponent AS team, sum(we * exp(o.a + f.h * is_home)) AS e FROM c JOIN a{i} o ON o.competition = c.competition AND o.team = c.team
        JOIN {f} f ON f.competition = c.competition GROUP BY ALL) USING (competition, team))""",
            f"""h{i} AS MATERIALIZED (SELECT competition, ln({now('at_home', 's')} / e) AS h, rho FROM z2 JOIN {f} USING (competition)
      LEFT JOIN (SELECT competition, sum(dh) AS s FROM k{i} GROUP BY 1) USING (competition)
      JOIN (SELECT c.competition, sum(we * exp(x.a + y.d)) AS e FROM c JOIN t{i} x ON x.competition = c.competition AND x.team = c.team
        JOIN t{i} y ON y.competition = c.competition AND y.team = c.opponent WHERE is_home = 1 GROUP BY 1) USING (competition))""",
            f"""f{i} AS MATERIALIZED (SELECT competition, h{i}.h, h{i}.rho + s / b AS rho FROM h{i} JOIN (SELECT competition,
        sum(-w00 * lam * mu / (1 - lam * mu * rho) + w01 * lam / (1 + lam * rho) + w10 * mu / (1 + mu * rho) - w11 / (1 - rho)) AS s,
        sum(w00 * (lam * mu / (1 - lam * mu * rho)) ** 2 + w01 * (lam / (1 + lam * rho)) ** 2 + w10 * (mu / (1 + mu * rho)) ** 2 + w11 / (1 - rho) ** 2) AS b
      FROM ({pairs(f't{i}', f'h{i}')}) GROUP BY 1) USING (competition))"""]
    n = sweeps
    BLOCKS[name] = (("train_cells", "low_sums"), f"""
  WITH {', '.join(parts)}, g AS (SELECT competition, 1 - avg(a) AS shift FROM t{n} GROUP BY 1)
  SELECT t.competition, t.team, t.a + shift AS attack, t.d - shift AS defense, f.h AS home_advantage, f.rho
  FROM t{n} t JOIN f{n} f USING (competition) JOIN g USING (competition)""", "MATERIALIZED ")


_joint_block("joint_rates", SQL_SWEEPS)


@query("m5_settled_count_models", f"SELECT competition, target, team, {_PARAMS}, true AS settled FROM settled_train", ("settled_train",))
def _(spark, d):
    """Every count model fitted until it settles, not for a fixed number of sweeps."""
    _, train, _ = split_matches(spark, d)
    rates = sr.settled_rates(counts.fit_cells(counts.day_cells(train, ALL)))
    return rounded(rates.select("competition", "target", "team", "attack", "defense", "home_advantage", "settled"), 5)


@query("m14_settled_exposure_rates", f"""SELECT competition, target, team, {_PARAMS.replace('round(defense', 'round(-defense')}, true AS settled
FROM settled_rate WHERE target IN ('goal_per_shot', 'sot_per_shot', 'goal_per_sot')""", ("settled_rate",))
def _(spark, d):
    _, train, _ = split_matches(spark, d)
    rates = sr.settled_rates(counts.fit_cells(counts.day_cells(train, counts.RATES)))
    return rounded(rates.select("competition", "target", "team", "attack", (-F.col("defense")).alias("defense"), "home_advantage", "settled"), 5)


def joint_rates(train):
    return sr.settled_rates(counts.fit_cells(counts.day_cells(train)), sr.low_score_sums(train))


@query("m6_joint_low_score", f"SELECT competition, team, {_PARAMS}, round(rho, 5) AS rho, true AS settled FROM joint_rates", ("joint_rates",))
def _(spark, d):
    """Team effects, home advantage and low-score dependence that are likeliest together."""
    _, train, _ = split_matches(spark, d)
    return rounded(joint_rates(train).select("competition", "team", "attack", "defense", "home_advantage", "rho", "settled"), 5)


BLOCKS["joint_pairs"] = (("joint_rates", "pairs"), """
  WITH l AS (SELECT competition, avg(attack) AS ma, avg(defense) AS md, any_value(home_advantage) AS home_advantage, any_value(rho) AS rho FROM joint_rates GROUP BY 1)
  SELECT pairs.competition, team_home, team_away, l.rho, exp(l.home_advantage + coalesce(h.attack, ma) + coalesce(a.defense, md)) AS expected_home,
    exp(coalesce(a.attack, ma) + coalesce(h.defense, md)) AS expected_away
  FROM pairs JOIN l ON l.competition = pairs.competition LEFT JOIN joint_rates h ON h.competition = pairs.competition AND h.team = team_home
  LEFT JOIN joint_rates a ON a.competition = pairs.competition AND a.team = team_away""", "MATERIALIZED ")
BLOCKS["joint_grid"] = (("joint_pairs",), grid_sql("joint_pairs", "competition, team_home, team_away", rho="rho"), "MATERIALIZED ")


@query("m7_joint_holdout_probabilities", """SELECT competition, team_home, team_away, round(any_value(expected_home), 5) AS expected_home,
  round(any_value(expected_away), 5) AS expected_away, round(sum(p) FILTER (i > j), 5) AS prob_home, round(sum(p) FILTER (i = j), 5) AS prob_draw,
  round(sum(p) FILTER (i < j), 5) AS prob_away FROM joint_grid JOIN joint_pairs USING (competition, team_home, team_away) GROUP BY ALL""", ("joint_grid",))
def _(spark, d):
    """Outcome probabilities of every holdout pairing from the joint fit."""
    _, train, holdout = split_matches(spark, d)
    rates = joint_rates(train)
    rho = rates.groupBy("competition").agg(F.first("rho").alias("rho"))
    rows = counts.expected_counts(holdout.select(*PAIR).distinct(), rates.drop("rho")).join(rho, "competition")
    return rounded(grids.outcome_probabilities(rows).select(*PAIR, "expected_home", "expected_away", "prob_home", "prob_draw", "prob_away"), 5)
