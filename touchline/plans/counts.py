"""Count models and what is read off their grids."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import counts, grids
from touchline.operators.summaries import referee_card_factors, with_referee_factor
from touchline.operators.teams import team_view
from touchline.plans import count_blocks  # noqa: F401  (defines the SQL blocks)
from touchline.plans.metrics import rounded
from touchline.plans.registry import query
from touchline.schema import CORNER_LINE, MAX_CORNERS, TIME_DECAY, YELLOW_LINE
from touchline.session import settle
from touchline.sources.derived import HOLDOUT_SEASON, load_matches

ALL = ("goals", "corners", "yellow", "red", "shots")
PAIR = ["competition", "team_home", "team_away"]
DC = ("dc_home", "dc_draw", "dc_away")


def split_matches(spark, d):
    m = settle(load_matches(spark, d))
    return m, m.where(F.col("season") != HOLDOUT_SEASON), m.where(F.col("season") == HOLDOUT_SEASON)


def train_rates(train, targets=("goals",)):
    return settle(counts.fit_rates(counts.fit_cells(counts.day_cells(train, targets))))


def pair_expectations(holdout, rates):
    """Rates per distinct pairing: every later probability depends on the pairing alone."""
    return counts.expected_counts(holdout.select(*PAIR).distinct(), rates)


@query("m4_decay_weights", """SELECT match_id, round(exp(-0.0018e0 * date_diff('day', match_date, (SELECT max(match_date) FROM matches WHERE season <> '2001'))), 9) AS weight
FROM matches WHERE season <> '2001'""")
def _(spark, d):
    _, train, _ = split_matches(spark, d)
    last = train.agg(F.max("match_date").alias("base_date")).withColumn("one", F.lit(1))
    return rounded(train.withColumn("one", F.lit(1)).join(last, "one").select(
        "match_id", counts.decay_weight(TIME_DECAY).alias("weight")))


_PARAMS = "competition, target, team, round(attack, 6) AS attack, round(defense, 6) AS defense, round(home_advantage, 6) AS home_advantage"


@query("m5_count_models", f"SELECT {_PARAMS} FROM train_rates", ("train_rates",))
def _(spark, d):
    _, train, _ = split_matches(spark, d)
    return rounded(counts.fit_rates(counts.fit_cells(counts.day_cells(train, ALL))).drop("xi"), 6)


@query("m6_low_score_correlation", "SELECT competition, rho, round(gain, 5) AS gain FROM rho", ("rho",))
def _(spark, d):
    _, train, _ = split_matches(spark, d)
    return counts.low_score_correlation(train, train_rates(train)).select("competition", "rho", F.round("gain", 5).alias("gain"))


_1X2 = """
z AS (SELECT competition, team_home, team_away, sum(p) FILTER (i > j) AS h, sum(p) FILTER (i = j) AS d, sum(p) FILTER (i < j) AS a,
  sum(p) FILTER (i > 0 AND j > 0) AS b FROM pair_grid GROUP BY ALL),
y AS (SELECT competition, team_home, team_away, sum(p) FILTER (i > j) AS h, sum(p) FILTER (i = j) AS d, sum(p) FILTER (i < j) AS a
  FROM pair_grid_rho GROUP BY ALL)"""


@query("m7_m38_holdout_probabilities", f"""WITH {_1X2}
SELECT m.match_id, m.result, r.cold_start, round(r.expected_home, 6) AS expected_home, round(r.expected_away, 6) AS expected_away,
  round(z.h, 6) AS prob_home, round(z.d, 6) AS prob_draw, round(z.a, 6) AS prob_away,
  round(y.h, 6) AS dc_home, round(y.d, 6) AS dc_draw, round(y.a, 6) AS dc_away
FROM matches m JOIN z USING (competition, team_home, team_away) JOIN y USING (competition, team_home, team_away)
JOIN pair_rates r ON r.competition = m.competition AND r.team_home = m.team_home AND r.team_away = m.team_away AND r.target = 'goals'
WHERE m.season = '2001'""", ("pair_grid", "pair_grid_rho"))
def _(spark, d):
    _, train, holdout = split_matches(spark, d)
    rates = train_rates(train)
    rho = counts.low_score_correlation(train, rates).select("competition", "rho")
    pairs = grids.outcome_probabilities(pair_expectations(holdout, rates))
    pairs = grids.outcome_probabilities(pairs.join(rho, "competition"), names=DC)
    return rounded(holdout.select("match_id", "result", *PAIR).join(pairs, PAIR).select(
        "match_id", "result", "cold_start", "expected_home", "expected_away", "prob_home", "prob_draw", "prob_away", *DC), 6)


@query("m8_both_score", f"""WITH {_1X2} SELECT m.match_id, round(z.b, 6) AS btts, goals_home > 0 AND goals_away > 0 AS both_scored
FROM matches m JOIN z USING (competition, team_home, team_away) WHERE m.season = '2001'""", ("pair_grid", "pair_grid_rho"))
def _(spark, d):
    _, train, holdout = split_matches(spark, d)
    pairs = grids.both_score(pair_expectations(holdout, train_rates(train)))
    return rounded(holdout.join(pairs, PAIR).select("match_id", "btts", (
        (F.col("goals_home") > 0) & (F.col("goals_away") > 0)).alias("both_scored")), 6)


@query("m9_over_under", f"""WITH
c AS ({count_blocks.grid_sql('pair_rates', 'competition, team_home, team_away', 25, "target = 'corners'")}),
y AS ({count_blocks.grid_sql('pair_rates', 'competition, team_home, team_away', 15, "target = 'yellow'")})
SELECT c.competition, c.team_home, c.team_away, round(sum(p) FILTER (i + j > 9.5), 6) AS corners_over, round(sum(p) FILTER (i + j < 9.5), 6) AS corners_under,
  0e0 AS corners_push, round(sum(p) FILTER (i + j > 9), 6) AS whole_over, round(sum(p) FILTER (i + j < 9), 6) AS whole_under, round(sum(p) FILTER (i + j = 9), 6) AS whole_push,
  any_value(yo) AS yellow_over, any_value(yu) AS yellow_under, 0e0 AS yellow_push
FROM c JOIN (SELECT competition, team_home, team_away, round(sum(p) FILTER (i + j > 4.5), 6) AS yo, round(sum(p) FILTER (i + j < 4.5), 6) AS yu FROM y GROUP BY ALL) y
  USING (competition, team_home, team_away) GROUP BY c.competition, c.team_home, c.team_away""", ("pair_rates",))
def _(spark, d):
    _, train, holdout = split_matches(spark, d)
    both = settle(pair_expectations(holdout, train_rates(train, ("corners", "yellow"))))
    c = both.where("target = 'corners'")
    c = grids.over_under(grids.over_under(c, CORNER_LINE, MAX_CORNERS, "corners_"), 9.0, MAX_CORNERS, "whole_")
    y = grids.over_under(both.where("target = 'yellow'"), YELLOW_LINE, prefix="yellow_")
    names = [f"{p}_{x}" for p in ("corners", "whole", "yellow") for x in ("over", "under", "push")]
    return rounded(c.select(*PAIR, *names[:6]).join(y.select(*PAIR, *names[6:]), PAIR), 6)


@query("m10_more_cards", f"""WITH y AS ({count_blocks.grid_sql('pair_rates', 'competition, team_home, team_away', 15, "target = 'yellow'")})
SELECT competition, team_home, team_away, round(sum(p) FILTER (i > j), 6) AS home_more, round(sum(p) FILTER (i = j), 6) AS equal,
  round(sum(p) FILTER (i < j), 6) AS away_more FROM y GROUP BY ALL""", ("pair_rates",))
def _(spark, d):
    _, train, holdout = split_matches(spark, d)
    names = ("home_more", "equal", "away_more")
    pairs = grids.outcome_probabilities(pair_expectations(holdout, train_rates(train, ("yellow",))), names=names)
    return rounded(pairs.select(*PAIR, *names), 6)


@query("m11_expected_counts", """SELECT competition, team_home, team_away, target, round(expected_home, 6) AS expected_home,
  round(expected_away, 6) AS expected_away, round(expected_home + expected_away, 6) AS expected_total FROM pair_rates
WHERE target IN ('corners', 'yellow', 'red')""", ("pair_rates",))
def _(spark, d):
    _, train, holdout = split_matches(spark, d)
    rows = pair_expectations(holdout, train_rates(train, ("corners", "yellow", "red")))
    return rounded(rows.select(*PAIR, "target", "expected_home", "expected_away", (
        F.col("expected_home") + F.col("expected_away")).alias("expected_total")), 6)


_FACT = """
fac AS (SELECT referee, CASE WHEN n < 30 THEN 1e0 ELSE (n * (c / n) + 30 * r) / (n + 30) / r END AS factor FROM (
  SELECT referee, count(*) AS n, sum(yellow_cards_home + yellow_cards_away) AS c FROM matches WHERE season <> '2001' GROUP BY 1),
  (SELECT sum(yellow_cards_home + yellow_cards_away) / count(*) AS r FROM matches WHERE season <> '2001'))"""
_CARDS = f"""{_FACT},
x AS (SELECT m.match_id, coalesce(f.factor, 1e0) AS factor, p.expected_home * coalesce(f.factor, 1e0) AS expected_home,
    p.expected_away * coalesce(f.factor, 1e0) AS expected_away, p.expected_home + p.expected_away AS plain,
    m.yellow_cards_home + m.yellow_cards_away AS actual
  FROM matches m JOIN pair_rates p ON p.target = 'yellow' AND p.competition = m.competition AND p.team_home = m.team_home AND p.team_away = m.team_away
  LEFT JOIN fac f ON f.referee = m.referee WHERE m.season = '2001')"""


def _cards(spark, d):
    _, train, holdout = split_matches(spark, d)
    pairs = pair_expectations(holdout, train_rates(train, ("yellow",))).select(*PAIR, "expected_home", "expected_away")
    rows = with_referee_factor(holdout.join(pairs, PAIR), referee_card_factors(train))
    return rows.withColumn("plain", F.col("expected_home") + F.col("expected_away")).withColumns(
        {c: F.col(c) * F.col("factor") for c in ("expected_home", "expected_away")})


@query("m12_referee_adjusted_cards", f"""WITH {_CARDS}, g AS ({count_blocks.grid_sql('x', 'match_id')})
SELECT x.match_id, round(any_value(factor), 6) AS factor, round(any_value(expected_home), 6) AS expected_home, round(any_value(expected_away), 6) AS expected_away,
  round(sum(p) FILTER (i + j > 4.5), 6) AS over, round(sum(p) FILTER (i + j < 4.5), 6) AS under FROM x JOIN g USING (match_id) GROUP BY x.match_id""", ("pair_rates",))
def _(spark, d):
    rows = grids.over_under(_cards(spark, d), YELLOW_LINE)
    return rounded(rows.select("match_id", "factor", "expected_home", "expected_away", "over", "under"), 6)


@query("a20_card_error", f"""WITH {_CARDS} SELECT count(*) AS n, round(avg(abs(plain - actual)), 6) AS mae_plain,
  round(avg(abs(expected_home + expected_away - actual)), 6) AS mae_adjusted, count(*) FILTER (factor <> 1) AS adjusted FROM x""", ("pair_rates",))
def _(spark, d):
    actual = F.col("yellow_cards_home") + F.col("yellow_cards_away")
    return rounded(_cards(spark, d).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("plain") - actual)).alias("mae_plain"),
        F.avg(F.abs(F.col("expected_home") + F.col("expected_away") - actual)).alias("mae_adjusted"),
        F.sum((F.col("factor") != 1).cast("long")).alias("adjusted")), 6)


_STRENGTH = """
u AS (SELECT DISTINCT competition, team FROM t),
l AS (SELECT competition, target, avg(attack) AS ma, avg(defense) AS md, any_value(home_advantage) AS ha FROM train_rates GROUP BY ALL),
st AS (SELECT u.competition, l.target, u.team, coalesce(r.attack, ma) AS attack, coalesce(r.defense, md) AS defense,
    CASE WHEN r.team IS NULL THEN 'cold_start_league_average' ELSE 'fitted' END AS parameter_source
  FROM u JOIN l USING (competition) LEFT JOIN train_rates r ON r.competition = u.competition AND r.target = l.target AND r.team = u.team)"""


def _strengths(spark, d, targets):
    m, train, _ = split_matches(spark, d)
    teams = team_view(m).select("competition", "team").distinct()
    return counts.team_strengths(train_rates(train, targets), teams)


@query("m13_team_strengths", f"""WITH {_STRENGTH} SELECT competition, target, team, parameter_source, round(attack, 6) AS attack,
  round(defense, 6) AS defense FROM st""", ("train_rates", "t"))
def _(spark, d):
    return rounded(_strengths(spark, d, ALL).select(
        "competition", "target", "team", "parameter_source", "attack", "defense"), 6)


@query("w6_strength_ranks", f"""WITH {_STRENGTH} SELECT competition, team, rank() OVER (PARTITION BY competition ORDER BY round(attack, 6) DESC) AS attack_rank,
  rank() OVER (PARTITION BY competition ORDER BY round(defense, 6)) AS defense_rank FROM st WHERE target = 'goals'""", ("train_rates", "t"))
def _(spark, d):
    per = Window.partitionBy("competition")
    return _strengths(spark, d, ("goals",)).select(
        "competition", "team", F.rank().over(per.orderBy(F.desc(F.round("attack", 6)))).cast("long").alias("attack_rank"),
        F.rank().over(per.orderBy(F.round("defense", 6))).cast("long").alias("defense_rank"))


@query("k7_strongest_teams", """SELECT competition, target, max_by(team, struct_pack(a := round(attack, 6), t := team)) AS strongest_attack,
  min_by(team, struct_pack(a := round(defense, 6), t := team)) AS strongest_defense FROM train_rates GROUP BY ALL""", ("train_rates",))
def _(spark, d):
    _, train, _ = split_matches(spark, d)
    return train_rates(train, ALL).groupBy("competition", "target").agg(
        F.max_by("team", F.struct(F.round("attack", 6), "team")).alias("strongest_attack"),
        F.min_by("team", F.struct(F.round("defense", 6), "team")).alias("strongest_defense"))


@query("k4_top_scorelines", """SELECT competition, team_home, team_away, row_number() OVER w AS score_rank, i AS score_home, j AS score_away,
  round(p, 9) AS probability FROM pair_grid WINDOW w AS (PARTITION BY competition, team_home, team_away ORDER BY round(p, 9) DESC, i, j)
QUALIFY score_rank <= 3""", ("pair_grid",))
def _(spark, d):
    _, train, holdout = split_matches(spark, d)
    pairs = pair_expectations(holdout, train_rates(train)).select(*PAIR, "expected_home", "expected_away")
    return grids.top_scores(pairs).select(*PAIR, "score_rank", "score_home", "score_away", "probability")


_LL = """
b AS (SELECT competition, max(match_date) AS base_date FROM matches WHERE season <> '2001' GROUP BY 1),
x AS (SELECT m.competition, goals_home AS i, goals_away AS j, exp(-0.0018e0 * date_diff('day', match_date, base_date)) AS w, r.rho,
    exp(h.home_advantage + h.attack + a.defense) AS lam, exp(a.attack + h.defense) AS mu
  FROM matches m JOIN b USING (competition) JOIN rho r USING (competition)
  JOIN train_rates h ON h.target = 'goals' AND h.competition = m.competition AND h.team = m.team_home
  JOIN train_rates a ON a.target = 'goals' AND a.competition = m.competition AND a.team = m.team_away WHERE m.season <> '2001'),
s AS (SELECT competition, sum(w * (-lam + i * ln(lam) - lgamma(i + 1e0) - mu + j * ln(mu) - lgamma(j + 1e0))) AS ll,
    sum(w * ln(greatest(CASE WHEN i = 0 AND j = 0 THEN 1 - lam * mu * rho WHEN i = 0 AND j = 1 THEN 1 + lam * rho WHEN i = 1 AND j = 0 THEN 1 + mu * rho
      WHEN i = 1 AND j = 1 THEN 1 - rho ELSE 1 END, 1e-10))) AS gain, sum(w * w) AS dummy FROM x GROUP BY 1),
n AS (SELECT competition, 2 * count(*) + 1 AS k FROM train_rates WHERE target = 'goals' GROUP BY 1)"""


@query("a19_model_likelihoods", f"""WITH {_LL}
SELECT competition, round(ll, 4) AS poisson_log_likelihood, round(2 * k - 2 * ll, 4) AS poisson_aic, round(ll + gain, 4) AS dixon_coles_log_likelihood,
  round(2 * (k + 1) - 2 * (ll + gain), 4) AS dixon_coles_aic, round(gain, 4) AS gain FROM s JOIN n USING (competition)""", ("rho",))
def _(spark, d):
    _, train, _ = split_matches(spark, d)
    rates = train_rates(train)
    rho = counts.low_score_correlation(train, rates).select("competition", "rho")
    last = settle(train.groupBy("competition").agg(F.max("match_date").alias("base_date")))
    cells = train.join(last, "competition").groupBy(*PAIR, "goals_home", "goals_away").agg(
        F.sum(counts.decay_weight(TIME_DECAY)).alias("w"))
    rows = counts.expected_counts(cells, rates).join(rho, "competition")
    log_factorial = lambda g: F.aggregate(F.sequence(F.lit(1), F.greatest(F.col(g), F.lit(1)).cast("int")), F.lit(0.0), lambda a, k: a + F.ln(k))
    part = lambda rate, g: -F.col(rate) + F.col(g) * F.ln(rate) - log_factorial(g)
    tau = counts.low_score_factor("goals_home", "goals_away", "expected_home", "expected_away", "rho")
    sums = rows.groupBy("competition").agg(
        F.sum(F.col("w") * (part("expected_home", "goals_home") + part("expected_away", "goals_away"))).alias("ll"),
        F.sum(F.col("w") * F.ln(F.greatest(tau, F.lit(1e-10)))).alias("gain"))
    k = rates.groupBy("competition").agg((2 * F.count("*") + 1).alias("k"))
    ll, gain, k_ = F.col("ll"), F.col("gain"), F.col("k")
    return rounded(sums.join(k, "competition").select(
        "competition", ll.alias("poisson_log_likelihood"), (2 * k_ - 2 * ll).alias("poisson_aic"),
        (ll + gain).alias("dixon_coles_log_likelihood"), (2 * (k_ + 1) - 2 * (ll + gain)).alias("dixon_coles_aic"), "gain"), 4)


@query("j7_strength_lookup", """SELECT m.match_id, round(p.expected_home, 6) AS expected_home, round(p.expected_away, 6) AS expected_away, p.cold_start
FROM matches m JOIN pair_rates p ON p.target = 'shots' AND p.competition = m.competition AND p.team_home = m.team_home AND p.team_away = m.team_away
WHERE m.season = '2001'""", ("pair_rates",))
def _(spark, d):
    _, train, holdout = split_matches(spark, d)
    return rounded(counts.expected_counts(holdout.select("match_id", *PAIR), train_rates(train, ("shots",))).select(
        "match_id", "expected_home", "expected_away", "cold_start"), 6)
