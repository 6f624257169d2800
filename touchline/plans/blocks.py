"""SQL blocks (name: needed blocks, text) that the checks share."""

BLOCKS: dict[str, tuple] = {}

BLOCKS["matches"] = ((), """
  WITH la AS (
    SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q,
           CAST(sum(l_partkey) AS BIGINT) AS p, CAST(sum(l_suppkey) AS BIGINT) AS s
    FROM lineitem GROUP BY l_orderkey),
  m AS (
    SELECT o.o_orderkey AS match_id, o.o_orderpriority AS competition, year(o.o_orderdate) AS yr,
           CAST(o.o_orderdate AS DATE) AS d, hn.n_name AS th, an.n_name AS ta, o.o_custkey AS ck,
           la.n, la.q, la.p, la.s, CAST(la.q % 5 AS INT) AS gh, CAST(la.p % 4 AS INT) AS ga
    FROM orders o JOIN la ON la.l_orderkey = o.o_orderkey
    JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN nation hn ON hn.n_nationkey = c.c_nationkey
    JOIN nation an ON an.n_nationkey = la.s % 25
    WHERE hn.n_nationkey <> an.n_nationkey
      AND (hn.n_nationkey + year(o.o_orderdate)) % 5 <> 0
      AND (an.n_nationkey + year(o.o_orderdate)) % 5 <> 0)
  SELECT match_id, competition, CAST(yr AS STRING) AS season, d AS match_date, th AS team_home, ta AS team_away,
    gh AS goals_home, ga AS goals_away,
    CASE WHEN gh > ga THEN 'H' WHEN gh < ga THEN 'A' ELSE 'D' END AS result,
    CAST(gh + 3 + p % 11 AS INT) AS shots_home, CAST(ga + 3 + q % 9 AS INT) AS shots_away,
    CAST(gh + p % 3 AS INT) AS shots_on_target_home, CAST(ga + q % 3 AS INT) AS shots_on_target_away,
    CAST(s % 12 AS INT) AS corners_home, CAST(s % 9 AS INT) AS corners_away,
    CAST(n % 5 AS INT) AS yellow_cards_home, CAST(p % 4 AS INT) AS yellow_cards_away,
    CASE WHEN p % 23 = 0 THEN 1 ELSE 0 END AS red_cards_home, CASE WHEN q % 29 = 0 THEN 1 ELSE 0 END AS red_cards_away,
    concat('R', CAST(ck % 300 AS STRING)) AS referee,
    1.2E0 + CAST(q % 37 AS DOUBLE) / 10 AS odds_avg_home,
    2.5E0 + CAST(n % 9 AS DOUBLE) / 10 AS odds_avg_draw,
    1.3E0 + CAST(p % 41 AS DOUBLE) / 10 AS odds_avg_away
  FROM m""", "MATERIALIZED ")

BLOCKS["t"] = (("matches",), """
  SELECT competition, season, match_date, match_id, team_home AS team, team_away AS opponent, 'home' AS venue,
    CAST(goals_home AS BIGINT) AS gf, CAST(goals_away AS BIGINT) AS ga,
    CASE result WHEN 'H' THEN 'W' WHEN 'A' THEN 'L' ELSE 'D' END AS outcome,
    CAST(CASE result WHEN 'H' THEN 3 WHEN 'A' THEN 0 ELSE 1 END AS BIGINT) AS points FROM matches
  UNION ALL
  SELECT competition, season, match_date, match_id, team_away, team_home, 'away',
    CAST(goals_away AS BIGINT), CAST(goals_home AS BIGINT),
    CASE result WHEN 'A' THEN 'W' WHEN 'H' THEN 'L' ELSE 'D' END,
    CAST(CASE result WHEN 'A' THEN 3 WHEN 'H' THEN 0 ELSE 1 END AS BIGINT) FROM matches""", "MATERIALIZED ")

# Last five matches per team before the day: the frame of the day's first row serves the whole day.
BLOCKS["form"] = (("t",), """
  WITH w AS (
    SELECT competition, team, match_date, match_id,
      count(*) OVER five AS p, count(*) FILTER (outcome = 'W') OVER five AS w,
      count(*) FILTER (outcome = 'D') OVER five AS d, count(*) FILTER (outcome = 'L') OVER five AS l,
      sum(gf - ga) OVER five AS gd,
      row_number() OVER (PARTITION BY competition, team, match_date ORDER BY match_id) AS k
    FROM t WINDOW five AS (PARTITION BY competition, team ORDER BY match_date, match_id
                           ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
  SELECT competition, team, match_date, p AS form5_played, w AS form5_wins, d AS form5_draws, l AS form5_losses,
    CAST(coalesce(gd, 0) AS BIGINT) AS form5_goal_difference FROM w WHERE k = 1""", "MATERIALIZED ")

BLOCKS["h2h"] = (("matches",), """
  WITH w AS (
    SELECT match_id, competition, match_date, team_home, team_away, least(team_home, team_away) AS lo,
      greatest(team_home, team_away) AS hi,
      CASE result WHEN 'H' THEN team_home WHEN 'A' THEN team_away ELSE '' END AS winner FROM matches),
  f AS (
    SELECT competition, lo, hi, match_date, list(winner) OVER (
        PARTITION BY competition, lo, hi ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ws,
      row_number() OVER (PARTITION BY competition, lo, hi, match_date ORDER BY match_id) AS k FROM w)
  SELECT w.match_id, CAST(coalesce(len(f.ws), 0) AS BIGINT) AS h2h_played,
    CAST(coalesce(len(list_filter(f.ws, lambda x: x = w.team_home)), 0) AS BIGINT) AS h2h_home_wins,
    CAST(coalesce(len(list_filter(f.ws, lambda x: x = '')), 0) AS BIGINT) AS h2h_draws,
    CAST(coalesce(len(list_filter(f.ws, lambda x: x = w.team_away)), 0) AS BIGINT) AS h2h_away_wins
  FROM w JOIN f ON f.competition = w.competition AND f.lo = w.lo AND f.hi = w.hi
    AND f.match_date = w.match_date AND f.k = 1""", "MATERIALIZED ")

BLOCKS["split"] = (("t",), """
  SELECT DISTINCT competition, season, team, venue, match_date,
    count(*) OVER b AS played, count(*) FILTER (outcome = 'W') OVER b AS wins,
    count(*) FILTER (outcome = 'D') OVER b AS draws, count(*) FILTER (outcome = 'L') OVER b AS losses,
    round(CAST(sum(points) OVER b AS DOUBLE) / count(*) OVER b, 9) AS points_per_game,
    round(CAST(sum(gf - ga) OVER b AS DOUBLE) / count(*) OVER b, 9) AS goal_difference_per_game
  FROM t WINDOW b AS (PARTITION BY competition, season, team, venue ORDER BY match_date
                      RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""", "MATERIALIZED ")

# The same rule over one row a team, venue and day: running sums over rows of a day left its equal rows to chance on large tables.
BLOCKS["split_by_day"] = (("t",), """
  WITH d AS (
    SELECT competition, season, team, venue, match_date, count(*) AS n, count(*) FILTER (outcome = 'W') AS w,
      count(*) FILTER (outcome = 'D') AS d, count(*) FILTER (outcome = 'L') AS l, sum(points) AS pts, sum(gf - ga) AS gd
    FROM t GROUP BY ALL),
  c AS (
    SELECT competition, season, team, venue, match_date, CAST(coalesce(sum(n) OVER b, 0) AS BIGINT) AS played,
      CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS wins, CAST(coalesce(sum(d) OVER b, 0) AS BIGINT) AS draws,
      CAST(coalesce(sum(l) OVER b, 0) AS BIGINT) AS losses, sum(pts) OVER b AS pts, sum(gd) OVER b AS gd
    FROM d WINDOW b AS (PARTITION BY competition, season, team, venue ORDER BY match_date
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT competition, season, team, venue, match_date, played, wins, draws, losses,
    round(CAST(pts AS DOUBLE) / played, 9) AS points_per_game,
    round(CAST(gd AS DOUBLE) / played, 9) AS goal_difference_per_game FROM c""", "MATERIALIZED ")

BLOCKS["rest"] = (("t",), """
  SELECT competition, team, match_date,
    CAST(date_diff('day', lag(match_date) OVER (PARTITION BY competition, team ORDER BY match_date), match_date)
         AS BIGINT) AS rest_days
  FROM (SELECT DISTINCT competition, team, match_date FROM t)""", "MATERIALIZED ")

BLOCKS["league"] = (("t",), """
  WITH g AS (
    SELECT a.competition, a.season, a.team, b.match_date FROM (SELECT DISTINCT competition, season, team FROM t) a
    JOIN (SELECT DISTINCT competition, season, match_date FROM t) b USING (competition, season)),
  s AS (
    SELECT g.competition, g.season, g.team, g.match_date, count(t.match_id) AS n,
      CAST(coalesce(sum(t.points), 0) AS BIGINT) AS pts, CAST(coalesce(sum(t.gf - t.ga), 0) AS BIGINT) AS gd,
      CAST(coalesce(sum(t.gf), 0) AS BIGINT) AS gf
    FROM g LEFT JOIN t USING (competition, season, team, match_date) GROUP BY ALL),
  c AS (
    SELECT competition, season, team, match_date, CAST(coalesce(sum(n) OVER b, 0) AS BIGINT) AS league_played,
      CAST(coalesce(sum(pts) OVER b, 0) AS BIGINT) AS league_points,
      coalesce(sum(gd) OVER b, 0) AS gd, coalesce(sum(gf) OVER b, 0) AS gf
    FROM s WINDOW b AS (PARTITION BY competition, season, team ORDER BY match_date
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT competition, season, team, match_date, league_points, league_played,
    rank() OVER (PARTITION BY competition, season, match_date ORDER BY league_points DESC, gd DESC, gf DESC)
      AS league_position FROM c""", "MATERIALIZED ")

_SIDE = lambda s: f"""
    {s}f.form5_played AS {s}_form5_played, {s}f.form5_wins AS {s}_form5_wins, {s}f.form5_draws AS {s}_form5_draws,
    {s}f.form5_losses AS {s}_form5_losses, {s}f.form5_goal_difference AS {s}_form5_goal_difference"""
_SPLIT = lambda s: f"""
    {s}s.played AS {s}_{s}_played, {s}s.wins AS {s}_{s}_wins, {s}s.draws AS {s}_{s}_draws,
    {s}s.losses AS {s}_{s}_losses, {s}s.points_per_game AS {s}_{s}_points_per_game,
    {s}s.goal_difference_per_game AS {s}_{s}_goal_difference_per_game"""
_LEAGUE = lambda s: f"""
    {s}l.league_position AS {s}_league_position, {s}l.league_points AS {s}_league_points,
    {s}l.league_played AS {s}_league_played"""
_JOINS = "".join(f"""
  JOIN form {s}f ON {s}f.competition = m.competition AND {s}f.team = m.team_{s} AND {s}f.match_date = m.match_date
  JOIN split {s}s ON {s}s.competition = m.competition AND {s}s.season = m.season AND {s}s.team = m.team_{s}
    AND {s}s.venue = '{s}' AND {s}s.match_date = m.match_date
  JOIN rest {s}r ON {s}r.competition = m.competition AND {s}r.team = m.team_{s} AND {s}r.match_date = m.match_date
  JOIN league {s}l ON {s}l.competition = m.competition AND {s}l.season = m.season AND {s}l.team = m.team_{s}
    AND {s}l.match_date = m.match_date""" for s in ("home", "away"))
BLOCKS["features"] = (("matches", "form", "h2h", "split", "rest", "league"), f"""
  SELECT m.match_id, m.competition, m.season, m.match_date, m.team_home, m.team_away,
    {_SIDE('home')}, {_SIDE('away')}, h.h2h_played, h.h2h_home_wins, h.h2h_draws, h.h2h_away_wins,
    {_SPLIT('home')}, {_SPLIT('away')}, homer.rest_days AS home_rest_days, awayr.rest_days AS away_rest_days,
    {_LEAGUE('home')}, {_LEAGUE('away')}, CAST(m.season = '1998' AS INT) AS is_empty_stadium, m.result
  FROM matches m JOIN h2h h ON h.match_id = m.match_id {_JOINS}""", "MATERIALIZED ")

BLOCKS["features_by_day"] = (
    tuple("split_by_day" if b == "split" else b for b in BLOCKS["features"][0]),
    BLOCKS["features"][1].replace("JOIN split ", "JOIN split_by_day "), "MATERIALIZED ")

BLOCKS["raw"] = (("matches",), """
  SELECT season, competition AS "Div", CASE WHEN shots_home = shots_away THEN strftime(match_date, '%d/%m/%Y')
      ELSE strftime(match_date, '%Y-%m-%d') END AS "Date",
    CASE WHEN goals_home > 0 THEN concat(12 + goals_home, ':30') END AS "Time",
    concat('  ', replace(CASE team_home WHEN 'NATION_1' THEN 'N 1' WHEN 'NATION_7' THEN 'N 7'
      WHEN 'NATION_12' THEN 'N 12' ELSE team_home END, ' ', '   ')) AS "HomeTeam",
    concat(CASE team_away WHEN 'NATION_1' THEN 'N 1' WHEN 'NATION_7' THEN 'N 7'
      WHEN 'NATION_12' THEN 'N 12' ELSE team_away END, ' ') AS "AwayTeam",
    CASE WHEN NOT (corners_home = 0 AND corners_away = 0) THEN CAST(goals_home AS VARCHAR) END AS "FTHG",
    CASE WHEN NOT (corners_home = 0 AND corners_away = 0) THEN CAST(goals_away AS VARCHAR) ELSE 'n/a' END AS "FTAG",
    'H' AS "FTR", CAST(shots_home AS VARCHAR) AS "HS", CAST(shots_away AS VARCHAR) AS "AS",
    CAST(corners_home AS VARCHAR) AS "HC", CAST(corners_away AS VARCHAR) AS "AC", referee AS "Referee",
    odds_avg_home, odds_avg_draw, odds_avg_away, '1.9' AS "BbMx>2.5" FROM matches""")

BLOCKS["predictions"] = (("matches", "form"), """
  WITH c AS (
    SELECT competition, season, count(*) FILTER (result = 'H') AS h, count(*) FILTER (result = 'D') AS d,
      count(*) FILTER (result = 'A') AS a FROM matches GROUP BY ALL),
  r AS (
    SELECT competition, season, CAST(sum(h) OVER b AS DOUBLE) AS h, CAST(sum(d) OVER b AS DOUBLE) AS d,
      CAST(sum(a) OVER b AS DOUBLE) AS a
    FROM c WINDOW b AS (PARTITION BY competition ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  w AS (
    SELECT m.*, 1e0 / odds_avg_home AS ih, 1e0 / odds_avg_draw AS idr, 1e0 / odds_avg_away AS ia,
      CAST(hf.form5_wins + 1 AS DOUBLE) AS fh, CAST(hf.form5_draws + af.form5_draws + 1 AS DOUBLE) AS fd,
      CAST(af.form5_wins + 1 AS DOUBLE) AS fa, r.h, r.d, r.a
    FROM matches m JOIN form hf ON hf.competition = m.competition AND hf.team = m.team_home AND hf.match_date = m.match_date
    JOIN form af ON af.competition = m.competition AND af.team = m.team_away AND af.match_date = m.match_date
    JOIN r ON r.competition = m.competition AND r.season = m.season)
  SELECT match_id, competition, season, match_date, team_home, team_away, result, 'market' AS model,
    ih / (ih + idr + ia) AS prob_home, idr / (ih + idr + ia) AS prob_draw, ia / (ih + idr + ia) AS prob_away FROM w
  UNION ALL SELECT match_id, competition, season, match_date, team_home, team_away, result, 'uniform',
    1e0 / 3, 1e0 / 3, 1e0 / 3 FROM w
  UNION ALL SELECT match_id, competition, season, match_date, team_home, team_away, result, 'form',
    fh / (fh + fd + fa), fd / (fh + fd + fa), fa / (fh + fd + fa) FROM w
  UNION ALL SELECT match_id, competition, season, match_date, team_home, team_away, result, 'base_rate',
    coalesce(h / (h + d + a), 1e0 / 3), coalesce(d / (h + d + a), 1e0 / 3), coalesce(a / (h + d + a), 1e0 / 3) FROM w
""", "MATERIALIZED ")

_IS = lambda c: f"(CASE WHEN result = '{c}' THEN 1e0 ELSE 0e0 END)"
BLOCKS["scores"] = (("predictions",), f"""
  SELECT *, ((prob_home - {_IS('H')}) ** 2 + (prob_home + prob_draw - {_IS('H')} - {_IS('D')}) ** 2) / 2 AS rps,
    (prob_home - {_IS('H')}) ** 2 + (prob_draw - {_IS('D')}) ** 2 + (prob_away - {_IS('A')}) ** 2 AS brier,
    -ln(least(greatest(CASE result WHEN 'H' THEN prob_home WHEN 'D' THEN prob_draw ELSE prob_away END, 1e-15), 1))
      AS log_loss,
    CASE WHEN prob_home >= prob_draw AND prob_home >= prob_away THEN 'H' WHEN prob_draw >= prob_away THEN 'D'
      ELSE 'A' END AS predicted_result,
    CAST(result = CASE WHEN prob_home >= prob_draw AND prob_home >= prob_away THEN 'H'
      WHEN prob_draw >= prob_away THEN 'D' ELSE 'A' END AS BIGINT) AS correct
  FROM predictions""", "MATERIALIZED ")

for _name, _sql in {
    "ratings_outside": """
  SELECT n.n_name AS club, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS from_date,
    CAST(1400 + 7 * (count(*) % 60) AS DOUBLE) AS rating
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  GROUP BY 1, 2""",
    "player_standard": """
  SELECT CAST(year(o.o_orderdate) AS STRING) AS season, n.n_name AS team, c.c_name AS player,
    CAST(sum(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS goals,
    CAST(sum(CASE WHEN o.o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS assists
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  GROUP BY 1, 2, 3""",
    "player_shooting": """
  SELECT CAST(year(o.o_orderdate) AS STRING) AS season, n.n_name AS team, c.c_name AS player,
    count(*) AS shots, CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS shots_on_target
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  GROUP BY 1, 2, 3""",
    "player_matches": """
  SELECT o.o_orderkey AS match_id, CAST(o.o_orderdate AS DATE) AS match_date, n.n_name AS team, c.c_name AS player,
    CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS sot
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  GROUP BY 1, 2, 3, 4""",
}.items():
    BLOCKS[_name] = ((), _sql, "MATERIALIZED ")
