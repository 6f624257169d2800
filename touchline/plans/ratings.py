"""Ratings (M1-M3, M44, A7, W8, W14, J15)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import checks, ratings
from touchline.plans.blocks import BLOCKS
from touchline.plans.metrics import rounded
from touchline.plans.registry import query
from touchline.session import settle
from touchline.sources import files
from touchline.sources.derived import load_external_ratings, load_matches, table

BLOCKS["events"] = (("t", "ratings_outside"), """
  WITH fetched AS (SELECT n.n_name AS club, max(CAST(o.o_orderdate AS DATE)) AS fetched_at FROM orders o
      JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1),
  outside AS (SELECT r.* FROM ratings_outside r JOIN fetched f ON f.club = r.club WHERE f.fetched_at > (SELECT max(fetched_at) FROM fetched) - INTERVAL 7 DAY),
  p AS (SELECT DISTINCT competition, season, team FROM t),
  sp AS (SELECT competition, season, lag(season) OVER (PARTITION BY competition ORDER BY season) AS prev FROM (SELECT DISTINCT competition, season FROM p)),
  promo AS (SELECT p.competition, p.season, p.team, sp.prev FROM p JOIN sp USING (competition, season) WHERE prev IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM p q WHERE q.competition = p.competition AND q.season = sp.prev AND q.team = p.team)),
  op AS (SELECT competition, season, min(match_date) AS as_of FROM t GROUP BY ALL),
  found AS (SELECT promo.competition, promo.season, promo.team, promo.prev, max(o.from_date) AS rating_date, max_by(o.rating, o.from_date) AS raw_rating
    FROM promo JOIN op USING (competition, season) LEFT JOIN outside o ON o.club = promo.team AND o.from_date < op.as_of GROUP BY ALL),
  ft AS (SELECT competition, season, team, row_number() OVER (PARTITION BY competition, season ORDER BY sum(points), sum(gf - ga), sum(gf), team) AS k FROM t GROUP BY competition, season, team),
  ix AS (SELECT team, row_number() OVER (ORDER BY team) AS i FROM (SELECT DISTINCT team FROM t)),
  bot AS (SELECT competition, season, list(ix.i ORDER BY ft.team) AS b FROM ft JOIN ix USING (team) WHERE k <= 3 GROUP BY ALL),
  ev AS (
    SELECT found.competition, found.season, 1 AS kind, CAST(NULL AS DATE) AS match_date, CAST(NULL AS BIGINT) AS match_id, found.team AS team_home,
      CAST(NULL AS VARCHAR) AS team_away, CAST(NULL AS VARCHAR) AS result, -469.1728e0 + 1.0893e0 * raw_rating AS value, bot.b, rating_date, raw_rating
    FROM found JOIN bot ON bot.competition = found.competition AND bot.season = found.prev
    UNION ALL SELECT competition, season, 2, match_date, match_id, team_home, team_away, result, NULL, NULL, NULL, NULL FROM matches)
  SELECT ev.*, h.i AS hi, a.i AS ai, row_number() OVER (PARTITION BY competition ORDER BY season, kind, match_date, match_id, team_home) AS n
  FROM ev LEFT JOIN ix h ON h.team = team_home LEFT JOIN ix a ON a.team = team_away""", "MATERIALIZED ")


def _recursion(events):
    e = "1 / (1 + pow(10e0, -(r[e.hi] + 100 - r[e.ai]) / 400))"
    gain = f"20 * (CASE e.result WHEN 'H' THEN 1e0 WHEN 'D' THEN 0.5e0 ELSE 0e0 END - {e})"
    seed = "coalesce(e.value, (r[e.b[1]] + r[e.b[2]] + r[e.b[3]]) / 3)"
    return f"""
  WITH RECURSIVE f AS (
    SELECT competition, CAST(0 AS BIGINT) AS n, list_transform(range(25), lambda z: 1500e0) AS r, 0e0 AS hp, 0e0 AS ap, 0e0 AS gain
    FROM (SELECT DISTINCT competition FROM {events})
    UNION ALL
    SELECT f.competition, e.n, list_transform(r, lambda x, i: CASE WHEN e.kind = 1 AND i = e.hi THEN {seed}
        WHEN e.kind = 2 AND i = e.hi THEN x + {gain} WHEN e.kind = 2 AND i = e.ai THEN x - ({gain}) ELSE x END),
      CASE WHEN e.kind = 1 THEN {seed} ELSE r[e.hi] END, CASE WHEN e.kind = 2 THEN r[e.ai] END, CASE WHEN e.kind = 2 THEN {gain} END
    FROM f JOIN {events} e ON e.competition = f.competition AND e.n = f.n + 1)
  SELECT e.*, f.hp, f.ap, f.hp + f.gain AS hq, f.ap - f.gain AS aq, f.gain FROM f JOIN {events} e USING (competition, n)"""


BLOCKS["rated"] = (("events",), _recursion("events"), "MATERIALIZED ")
BLOCKS["plain_events"] = (("events",), """SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY competition ORDER BY season, match_date, match_id) AS n
  FROM events WHERE kind = 2""", "MATERIALIZED ")
BLOCKS["plain_rated"] = (("plain_events",), _recursion("plain_events"), "MATERIALIZED ")
BLOCKS["elo_probs"] = (("rated",), """
  WITH g AS (SELECT *, hp + 100 - ap AS gap FROM rated WHERE kind = 2), d AS (SELECT *, 0.3e0 * exp(-pow(gap / 200, 2) / 2) AS dr, 1 / (1 + pow(10e0, -gap / 400)) AS e FROM g)
  SELECT match_id, competition, season, match_date, team_home, team_away, result, hp, ap, (1 - dr) * e AS prob_home, dr AS prob_draw, (1 - dr) * (1 - e) AS prob_away FROM d""", "MATERIALIZED ")
BLOCKS["plain_elo_probs"] = (("plain_rated",), BLOCKS["elo_probs"][1].replace("FROM rated", "FROM plain_rated"), "MATERIALIZED ")


def seeds_of(spark, d, matches):
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(
        table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    fetched = orders.groupBy(F.col("n_name").alias("club")).agg(F.max(F.to_date("o_orderdate")).alias("fetched_at"))
    now = fetched.agg(F.max("fetched_at")).first()[0]
    outside = files.fresh_ratings(load_external_ratings(spark, d).join(fetched, "club"), now)
    return settle(ratings.seed_requests(matches, outside.select("club", "from_date", "rating")))


def rated_matches(spark, d):
    m = settle(load_matches(spark, d))
    seeds = seeds_of(spark, d, m)
    return m, seeds, ratings.rate(m, seeds)


_VIEWS = """
h AS (SELECT match_id, competition, season, 'home' AS venue, team_home AS team, team_away AS opponent, hp AS elo_pre, ap AS opponent_elo_pre, hp - ap AS elo_gap_pre, hq AS elo_post FROM rated WHERE kind = 2
  UNION ALL SELECT match_id, competition, season, 'away', team_away, team_home, ap, hp, ap - hp, aq FROM rated WHERE kind = 2)"""
_VIEW_COLUMNS = ["match_id", "competition", "season", "venue", "team", "opponent"]
_R6 = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)


@query("v3_rating_history_checks", f"""WITH {_VIEWS}, p AS (SELECT match_id, count(*) AS n, count(DISTINCT venue) AS v, abs(sum(elo_gap_pre)) AS gap,
  count(*) FILTER (elo_pre IS NULL OR elo_post IS NULL) AS nulls FROM h GROUP BY 1)
SELECT count(*) AS matches, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n <> 2 OR v <> 2) AS not_two_views, count(*) FILTER (gap > 1e-9) AS not_mirrored,
  CAST(sum(nulls) AS BIGINT) AS null_ratings FROM p""", ("rated",))
def _(spark, d):
    return checks.check_rating_history(ratings.rating_history(rated_matches(spark, d)[2]))


@query("m1_rating_history", f"WITH {_VIEWS} SELECT {', '.join(_VIEW_COLUMNS)}, {_R6('elo_pre', 'opponent_elo_pre', 'elo_gap_pre', 'elo_post')} FROM h", ("rated",))
def _(spark, d):
    _, _, done = rated_matches(spark, d)
    return rounded(ratings.rating_history(done).select(*_VIEW_COLUMNS, "elo_pre", "opponent_elo_pre", "elo_gap_pre", "elo_post"), 6)


@query("m2_unseeded_fold_ratings", f"SELECT match_id, season, {_R6('hp', 'ap')} FROM plain_rated WHERE season IN ('1999', '2000')", ("plain_rated",))
def _(spark, d):
    from touchline.operators.folds import season_folds
    from touchline.sources.derived import HOLDOUT_SEASON
    m = settle(load_matches(spark, d))
    train = m.where(F.col("season") != HOLDOUT_SEASON)
    # A fold's ratings before its validation season are those of the one unbroken history.
    done = ratings.rate(train)
    folds = season_folds(m, HOLDOUT_SEASON).select(F.col("validation_season").alias("season"))
    return rounded(done.where("kind = 'match'").join(folds, "season").select(
        "match_id", "season", F.col("home_pre").alias("hp"), F.col("away_pre").alias("ap")), 6)


@query("m3_j15_rating_probabilities", f"SELECT match_id, {_R6('prob_home', 'prob_draw', 'prob_away')} FROM elo_probs WHERE season = '2001'", ("elo_probs",))
def _(spark, d):
    from touchline.sources.derived import HOLDOUT_SEASON
    m, _, done = rated_matches(spark, d)
    base = m.where(F.col("season") == HOLDOUT_SEASON).select("match_id", "team_home", "team_away")
    rows = base.join(done.where("kind = 'match'").select("match_id", "team", "opponent", "home_pre", "away_pre"), "match_id", "left")
    wrong = F.col("home_pre").isNull() | (F.col("team") != F.col("team_home")) | (F.col("opponent") != F.col("team_away"))
    rows = rows.withColumn("home_pre", F.when(wrong, F.raise_error(F.lit("rating history does not fit the match"))).otherwise(F.col("home_pre")))
    return rounded(ratings.rating_probabilities(rows).select("match_id", "prob_home", "prob_draw", "prob_away"), 6)


@query("m44_seed_log", """SELECT competition, season, team_home AS team, CASE WHEN raw_rating IS NULL THEN 'fallback_bottom3' ELSE 'outside' END AS source,
  rating_date, raw_rating, round(value, 6) AS rescaled, round(hp, 6) AS rating FROM rated WHERE kind = 1""", ("rated",))
def _(spark, d):
    _, seeds, done = rated_matches(spark, d)
    return rounded(ratings.seed_log(done, seeds), 6)


@query("a7_bottom_three_average", """WITH ls AS (SELECT competition, season, team_home AS team, hq AS r, n FROM rated WHERE kind = 2 UNION ALL SELECT competition, season, team_away, aq, n FROM rated WHERE kind = 2),
en AS (SELECT competition, season, team, max_by(r, n) AS r FROM ls GROUP BY ALL),
ft AS (SELECT competition, season, team, row_number() OVER (PARTITION BY competition, season ORDER BY sum(points), sum(gf - ga), sum(gf), team) AS k FROM t GROUP BY competition, season, team)
SELECT competition, season, round(avg(en.r), 6) AS bottom_three_rating FROM ft JOIN en USING (competition, season, team) WHERE k <= 3 GROUP BY ALL""", ("rated", "t"))
def _(spark, d):
    from touchline.operators.teams import final_table
    m, _, done = rated_matches(spark, d)
    worst = Window.partitionBy("competition", "season").orderBy("points", "goal_difference", "goals_for", "team")
    bottom = final_table(m).withColumn("k", F.row_number().over(worst)).where("k <= 3")
    ends = ratings.rating_history(done).groupBy("competition", "season", "team").agg(
        F.max_by("elo_post", F.struct("match_date", "match_id")).alias("r"))
    return rounded(bottom.join(ends, ["competition", "season", "team"]).groupBy("competition", "season").agg(
        F.avg("r").alias("bottom_three_rating")), 6)


@query("w8_current_ratings", f"""WITH {_VIEWS}, z AS (SELECT h.*, m.match_date FROM h JOIN matches m USING (match_id)),
c AS (SELECT competition, team, round(max_by(elo_post, (match_date, match_id)), 6) AS rating FROM z GROUP BY ALL)
SELECT competition, team, rating, row_number() OVER (PARTITION BY competition ORDER BY rating DESC, team) AS rating_rank,
  (SELECT max(match_date) FROM matches m WHERE m.competition = c.competition) AS as_of FROM c""", ("rated",))
def _(spark, d):
    _, _, done = rated_matches(spark, d)
    return rounded(ratings.current_ratings(done), 6)


@query("w14_rating_continuity", f"""WITH {_VIEWS} SELECT competition, count(*) AS rows, CAST(0 AS BIGINT) AS breaks FROM h GROUP BY 1""", ("rated",))
def _(spark, d):
    _, seeds, done = rated_matches(spark, d)
    history = ratings.rating_history(done)
    order = Window.partitionBy("competition", "team").orderBy("match_date", "match_id")
    before = history.withColumn("previous", F.lag("elo_post").over(order)).withColumn("previous_season", F.lag("season").over(order))
    broken = F.col("previous").isNotNull() & (F.col("season") == F.col("previous_season")) & (F.abs(F.col("previous") - F.col("elo_pre")) > 1e-9)
    return before.groupBy("competition").agg(F.count("*").alias("rows"), F.sum(broken.cast("long")).alias("breaks"))
