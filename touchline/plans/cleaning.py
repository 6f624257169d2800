"""Sources, sinks and cleaning (S, P1-P11, P15-P16, K1, U1-U2, U11)."""

from pyspark.sql import functions as F

from touchline.operators.cleaning import CORE, clean_matches, normalize_columns, team_name
from touchline.operators.features import team_day_features
from touchline.operators.metrics import stable_summary
from touchline.operators.teams import team_universe, team_view
from touchline.plans.registry import query
from touchline.schema import CLASSES, FEATURE_COLUMNS, TIME_DECAY
from touchline.session import settle
from touchline.sources import files
from touchline.sources.derived import (
    EMPTY_STADIUM_SEASONS, HOLDOUT_SEASON, RAW_HEADER, SHORT_NAMES, load_external_ratings, load_matches,
    load_player_shooting, load_player_standard, load_predictions, raw_copy, table)

MODELS = ["market", "uniform", "form", "base_rate", "absent_model"]


def predictions_of(matches):
    form = team_day_features(matches).select("competition", "team", "match_date", "form5_wins", "form5_draws")
    return load_predictions(matches, settle(form))


def _seasons_of(spark, d):
    """Raw season files: written as CSV with a season folder each, read back by header."""
    path = files.scratch(spark)
    files.write_season_csv(raw_copy(load_matches(spark, d)), path)
    return files.read_season_csv(spark, path, RAW_HEADER)


@query("s1_read_season_csv", """
SELECT season, "Div", "Date", "Time", trim("HomeTeam") AS "HomeTeam", trim("AwayTeam") AS "AwayTeam", "FTHG", "FTAG",
  "FTR", "HS", "AS", "Referee", CAST(odds_avg_home AS DOUBLE) AS avg_h FROM raw""", ("raw",))
def _(spark, d):
    return _seasons_of(spark, d).select(
        "season", "Div", "Date", "Time", F.trim("HomeTeam").alias("HomeTeam"), F.trim("AwayTeam").alias("AwayTeam"),
        "FTHG", "FTAG", "FTR", "HS", "AS", "Referee", F.col("AvgH").cast("double").alias("avg_h"))


@query("s2_canonical_subset", """SELECT match_id, season, match_date, team_home, team_away, result, odds_avg_home,
  odds_avg_draw, odds_avg_away FROM matches WHERE season = '2001'""")
def _(spark, d):
    return load_matches(spark, d).where(F.col("season") == HOLDOUT_SEASON).select(
        "match_id", "season", "match_date", "team_home", "team_away", "result",
        "odds_avg_home", "odds_avg_draw", "odds_avg_away")


@query("s3_landing_by_season", "SELECT * FROM matches")
def _(spark, d):
    path = files.scratch(spark)
    matches = load_matches(spark, d)
    files.write_by_season(matches, path)
    return spark.read.schema(matches.schema).parquet(path).select(*matches.columns)


@query("s4_fixture_scan", """SELECT concat('F', CAST(match_id AS VARCHAR)) AS fixture_id, season,
  CAST(match_date AS TIMESTAMP) AS datetime, team_home, team_away, odds_avg_home AS odds_home,
  odds_avg_draw AS odds_draw, odds_avg_away AS odds_away FROM matches WHERE season = '2001'""")
def _(spark, d):
    return stored_fixtures(spark, load_matches(spark, d))


def stored_fixtures(spark, matches):
    """The holdout season as a fixture file with odds, read back with the checked schema."""
    path = files.scratch(spark)
    fixtures = matches.where(F.col("season") == HOLDOUT_SEASON).select(
        F.concat(F.lit("F"), F.col("match_id")).alias("fixture_id"), "season",
        F.date_format("match_date", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "team_home", "team_away",
        F.col("odds_avg_home").alias("odds_home"), F.col("odds_avg_draw").alias("odds_draw"),
        F.col("odds_avg_away").alias("odds_away"))
    fixtures.write.option("header", True).csv(path)
    return files.read_fixtures(spark, path)


@query("s5_player_tables", """
SELECT 'standard' AS stats, season, team, player, goals AS first_value, assists AS second_value FROM player_standard
UNION ALL SELECT 'shooting', season, team, player, shots, shots_on_target FROM player_shooting""",
       ("player_standard", "player_shooting"))
def _(spark, d):
    who = ["season", "team", "player"]
    pick = lambda df, name, a, b: df.select(F.lit(name).alias("stats"), *who, F.col(a).alias("first_value"),
                                            F.col(b).alias("second_value"))
    return pick(load_player_standard(spark, d), "standard", "goals", "assists").unionByName(
        pick(load_player_shooting(spark, d), "shooting", "shots", "shots_on_target"))


@query("s6_fresh_rating_histories", """
WITH f AS (
  SELECT n.n_name AS club, max(CAST(o.o_orderdate AS DATE)) AS fetched_at FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1)
SELECT r.club, r.from_date, r.rating, f.fetched_at FROM ratings_outside r JOIN f ON f.club = r.club
WHERE f.fetched_at > (SELECT max(fetched_at) FROM f) - INTERVAL 7 DAY""", ("ratings_outside",))
def _(spark, d):
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(
        table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    fetched = orders.groupBy(F.col("n_name").alias("club")).agg(F.max(F.to_date("o_orderdate")).alias("fetched_at"))
    now = fetched.agg(F.max("fetched_at")).first()[0]
    ratings = load_external_ratings(spark, d).join(fetched, "club")
    return files.fresh_ratings(ratings, now).select("club", "from_date", "rating", "fetched_at")


@query("s7_prediction_sink", """
SELECT match_id, season, model, round(CASE WHEN season = '2001' THEN prob_draw ELSE prob_home END, 9) AS prob_home
FROM predictions""", ("predictions",))
def _(spark, d):
    path = files.scratch(spark)
    rows = settle(predictions_of(settle(load_matches(spark, d))).select("match_id", "season", "model", "prob_home", "prob_draw"))
    files.write_predictions(rows.drop("prob_draw"), path)
    again = rows.where(F.col("season") == HOLDOUT_SEASON)
    files.write_predictions(again.select("match_id", "season", "model", F.col("prob_draw").alias("prob_home")), path)
    return spark.read.schema("match_id long, prob_home double, season string, model string").parquet(path).select(
        "match_id", "season", "model", F.round("prob_home", 9).alias("prob_home"))


@query("s8_run_metadata", """
SELECT count(*) AS matches, count(*) FILTER (season <> '2001') AS training_matches,
  count(*) FILTER (season = '2001') AS holdout_matches, string_agg(DISTINCT season, ',' ORDER BY season) AS seasons,
  CAST(min(match_date) AS VARCHAR) AS first_date, CAST(max(match_date) AS VARCHAR) AS last_date,
  0.0018e0 AS time_decay, '""" + ",".join(FEATURE_COLUMNS) + """' AS features, 'H=0,D=1,A=2' AS targets FROM matches""")
def _(spark, d):
    m = load_matches(spark, d)
    held = (F.col("season") == HOLDOUT_SEASON).cast("long")
    facts = m.agg(
        F.count("*").alias("matches"), F.sum(1 - held).alias("training_matches"), F.sum(held).alias("holdout_matches"),
        F.array_join(F.array_sort(F.collect_set("season")), ",").alias("seasons"),
        F.min("match_date").cast("string").alias("first_date"), F.max("match_date").cast("string").alias("last_date")
    ).withColumns({"time_decay": F.lit(TIME_DECAY), "features": F.array(*[F.lit(c) for c in FEATURE_COLUMNS]),
                   "targets": F.struct(*[F.lit(k).alias(c) for k, c in enumerate(CLASSES)])})
    path = files.scratch(spark)
    facts.write.json(path)
    stored = spark.read.schema(facts.schema).json(path)
    named = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(f"targets.{c}")) for c in CLASSES])
    return stored.withColumns({"features": F.array_join("features", ","), "targets": named})


@query("s10_optional_source", """
SELECT n.model, count(p.match_id) AS n, count(p.match_id) > 0 AS available
FROM (SELECT unnest(['market', 'uniform', 'form', 'base_rate', 'absent_model']) AS model) n
LEFT JOIN predictions p ON p.model = n.model GROUP BY n.model""", ("predictions",))
def _(spark, d):
    present = predictions_of(settle(load_matches(spark, d)))
    absent = files.read_optional(spark, files.scratch(spark), present.schema)
    summary = stable_summary(present.unionByName(absent), MODELS)
    return summary.select("model", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "available")


_CLEAN = """
WITH c AS (
  SELECT season, "Div" AS competition, CASE WHEN contains("Date", '/') THEN CAST(strptime("Date", '%d/%m/%Y') AS DATE)
      ELSE CAST("Date" AS DATE) END AS "date", "Time" AS tm,
    regexp_replace(trim("HomeTeam"), '\\s+', ' ', 'g') AS th, regexp_replace(trim("AwayTeam"), '\\s+', ' ', 'g') AS ta,
    TRY_CAST("FTHG" AS INT) AS goals_home, TRY_CAST("FTAG" AS INT) AS goals_away,
    TRY_CAST("HS" AS INT) AS shots_home, "Referee" AS referee, odds_avg_home FROM raw),
n AS (SELECT *, CASE th WHEN 'N 1' THEN 'NATION_1' WHEN 'N 7' THEN 'NATION_7' WHEN 'N 12' THEN 'NATION_12'
      ELSE th END AS team_home, CASE ta WHEN 'N 1' THEN 'NATION_1' WHEN 'N 7' THEN 'NATION_7'
      WHEN 'N 12' THEN 'NATION_12' ELSE ta END AS team_away FROM c)
SELECT concat(strftime("date", '%Y%m%d'), '-', replace(lower(team_home), '_', '-'), '-',
    replace(lower(team_away), '_', '-')) AS match_id, competition, season,
  coalesce(strptime(strftime("date", '%Y-%m-%d') || ' ' || tm, '%Y-%m-%d %H:%M'), CAST("date" AS TIMESTAMP)) AS datetime,
  "date", team_home, team_away, goals_home, goals_away,
  CASE WHEN goals_home > goals_away THEN 'H' WHEN goals_home < goals_away THEN 'A' ELSE 'D' END AS result,
  shots_home, referee, odds_avg_home, CAST(NULL AS INT) AS half_time_goals_home, CAST(NULL AS DOUBLE) AS odds_b365_home
FROM n WHERE goals_home IS NOT NULL AND goals_away IS NOT NULL"""


def _cleaned(spark, d):
    raw = normalize_columns(_seasons_of(spark, d))
    seasons = [raw.where(F.col("season") < "1998").drop("time"), raw.where(F.col("season") >= "1998")]
    return clean_matches(seasons, F.col("div"), SHORT_NAMES)


@query("p1_p9_clean_matches", _CLEAN.replace('"Time" AS tm', 'CASE WHEN season >= \'1998\' THEN "Time" END AS tm'), ("raw",))
def _(spark, d):
    return _cleaned(spark, d).select(
        "match_id", "competition", "season", "datetime", "date", "team_home", "team_away", "goals_home", "goals_away",
        "result", "shots_home", "referee", "odds_avg_home", "half_time_goals_home", "odds_b365_home")


@query("p1_header_names", """
SELECT unnest(['div', 'date', 'time', 'team_home', 'team_away', 'goals_home', 'goals_away', 'result', 'shots_home',
  'shots_away', 'corners_home', 'corners_away', 'referee', 'odds_avg_home', 'odds_avg_draw', 'odds_avg_away',
  'bbmx_over_2_5', 'season']) AS column_name, (SELECT count(*) FROM matches) AS rows""")
def _(spark, d):
    raw = raw_copy(load_matches(spark, d)).select(*[f"`{c}`" for c in RAW_HEADER], "season")
    names = normalize_columns(raw).columns
    return raw.agg(F.count("*").alias("rows")).select(F.explode(F.array(*map(F.lit, names))).alias("column_name"), "rows")


@query("p5_team_names", """SELECT DISTINCT team_home AS team FROM matches""")
def _(spark, d):
    raw = normalize_columns(raw_copy(load_matches(spark, d)))
    return raw.select(team_name(F.col("team_home"), SHORT_NAMES).alias("team")).distinct()


@query("p7_completed_only", """SELECT season, count(*) AS raw_rows,
  count(*) FILTER (NOT (corners_home = 0 AND corners_away = 0)) AS completed FROM matches GROUP BY season""")
def _(spark, d):
    raw = normalize_columns(raw_copy(load_matches(spark, d)))
    whole = F.lit(True)
    for c in CORE:
        whole = whole & (F.expr(f"try_cast({c} AS INT)").isNotNull() if c.startswith("goals") else F.col(c).isNotNull())
    return raw.groupBy("season").agg(F.count("*").alias("raw_rows"), F.sum(whole.cast("long")).alias("completed"))


@query("p8_result_from_score", "SELECT match_id, result FROM matches")
def _(spark, d):
    gh, ga = F.col("goals_home"), F.col("goals_away")
    return load_matches(spark, d).select("match_id", F.when(gh > ga, "H").when(gh < ga, "A").otherwise("D").alias("result"))


@query("p10_train_holdout_split", """SELECT match_id, season, CASE WHEN season = '2001' THEN 'holdout' ELSE 'train' END
  AS part FROM matches""")
def _(spark, d):
    return load_matches(spark, d).select(
        "match_id", "season", F.when(F.col("season") == HOLDOUT_SEASON, "holdout").otherwise("train").alias("part"))


@query("p11_season_flag", "SELECT match_id, CAST(season = '1998' AS INT) AS is_empty_stadium FROM matches")
def _(spark, d):
    return load_matches(spark, d).select(
        "match_id", F.col("season").isin(*EMPTY_STADIUM_SEASONS).cast("int").alias("is_empty_stadium"))


@query("p15_season_label", """SELECT match_id, concat(CAST(year(match_date) - CAST(month(match_date) < 7 AS INT) AS VARCHAR), '-',
  CAST(year(match_date) - CAST(month(match_date) < 7 AS INT) + 1 AS VARCHAR)) AS season_label FROM matches""")
def _(spark, d):
    start = F.year("match_date") - (F.month("match_date") < 7).cast("int")
    return load_matches(spark, d).select("match_id", F.concat_ws("-", start, start + 1).alias("season_label"))


@query("p16_prediction_time", None)
def _(spark, d):
    last = load_matches(spark, d).agg(F.max("match_date").alias("last_match"))
    after = F.date_add("last_match", 1).cast("timestamp")
    return last.select("last_match", F.greatest(F.date_trunc("minute", F.current_timestamp()), after).alias("predict_at"))


@query("p23_team_outcomes", "SELECT competition, match_id, team, opponent, venue, gf, ga, outcome, points FROM t", ("t",))
def _(spark, d):
    return team_view(load_matches(spark, d)).select(
        "competition", "match_id", "team", "opponent", "venue", "gf", "ga", "outcome", "points")


@query("u2_team_universe", "SELECT DISTINCT team FROM t", ("t",))
def _(spark, d):
    return team_universe(load_matches(spark, d))


@query("u8_team_view", "SELECT * FROM t", ("t",))
def _(spark, d):
    return team_view(load_matches(spark, d)).select(
        "competition", "season", "match_date", "match_id", "team", "opponent", "venue", "gf", "ga", "outcome", "points")


@query("u11_known_teams", "SELECT DISTINCT team FROM t ORDER BY team", ("t",))
def _(spark, d):
    return team_universe(load_matches(spark, d)).orderBy("team")


@query("k1_canonical_order", "SELECT match_date, match_id, competition, team_home, team_away FROM matches ORDER BY match_date, match_id")
def _(spark, d):
    return load_matches(spark, d).select("match_date", "match_id", "competition", "team_home", "team_away").orderBy(
        "match_date", "match_id")
