"""Folds, walk-forward experiments and model selection."""

from pyspark.sql import functions as F

from touchline.functions.probability import log_loss
from touchline.operators import checks, counts, folds, grids, ratings, selection, walkforward as wf
from touchline.operators.metrics import model_metrics
from touchline.plans import ratings as _rating_plans  # noqa: F401  (defines the SQL blocks)
from touchline.plans.blocks import BLOCKS
from touchline.plans.cleaning import MODELS, predictions_of
from touchline.plans.count_blocks import cells_block, expected_block, grid_sql, rates_block, rho_block
from touchline.plans.counts import split_matches
from touchline.plans.metrics import rounded
from touchline.plans.registry import query
from touchline.schema import DECAY_GRID
from touchline.session import settle
from touchline.sources.derived import EMPTY_STADIUM_SEASONS, HOLDOUT_SEASON, load_matches

ARMS = ("goals", "shots", "goal_per_shot", "sot_per_shot", "goal_per_sot")
cells_block("fold_cells", ("goals",), folds=True)
rates_block("fold_rates", "fold_cells", folds=True)
cells_block("arm_cells", ARMS, DECAY_GRID, folds=True)
rates_block("arm_rates", "arm_cells", folds=True)
cells_block("rate_cells", ARMS)
rates_block("rate_rates", "rate_cells")
BLOCKS["fold_pairs"] = (("matches", "season_roles"), """SELECT DISTINCT m.competition, r.fold, team_home, team_away FROM matches m
  JOIN season_roles r ON r.season = m.season AND r.part = 'validation'""", "MATERIALIZED ")
expected_block("fold_expected", "fold_pairs", "fold_rates", folds=True)
expected_block("arm_expected", "fold_pairs", "arm_rates", folds=True)
_FOLD_KEY = "competition, fold, xi, model, team_home, team_away"
TRACK_MODELS = ("poisson", wf.LOW_SCORE, "elo")


def _forecast_block(name, chains, expected, rho=None):
    """1X2 per fold pairing and model from chained rates, low-score term included where ``rho`` names its block."""
    rows = " UNION ALL ".join(
        f"SELECT competition, fold, xi, '{m}' AS model, team_home, team_away, bool_or(cold_start) AS cold_start, product(expected_home) AS expected_home, "
        f"product(expected_away) AS expected_away FROM {expected} WHERE target IN ({', '.join(repr(t) for t in chain)}) GROUP BY ALL"
        for m, chain in chains.items())
    grid = f"g AS ({grid_sql('cr', _FOLD_KEY, rho='rho')})" if rho else f"g AS ({grid_sql('c', _FOLD_KEY)})"
    term = f"cr AS (SELECT c.*, r.rho FROM c JOIN {rho} r USING (competition, fold)), " if rho else ""
    BLOCKS[name] = ((expected, "matches", "season_roles") + ((rho,) if rho else ()), f"""
  WITH c AS ({rows}), {term}{grid},
  p AS (SELECT {_FOLD_KEY}, sum(p) FILTER (i > j) AS h, sum(p) FILTER (i = j) AS d, sum(p) FILTER (i < j) AS a FROM g GROUP BY ALL)
  SELECT m.match_id, m.match_date, m.result, p.fold, p.xi, p.model, m.season, c.cold_start, h AS prob_home, d AS prob_draw, a AS prob_away
  FROM matches m JOIN season_roles r ON r.season = m.season AND r.part = 'validation'
  JOIN p ON p.competition = m.competition AND p.fold = r.fold AND p.team_home = m.team_home AND p.team_away = m.team_away
  JOIN c ON c.competition = p.competition AND c.fold = p.fold AND c.xi = p.xi AND c.model = p.model AND c.team_home = p.team_home AND c.team_away = p.team_away""", "MATERIALIZED ")


def _score_block(name, source, keys):
    is_ = lambda c: f"(CASE WHEN result = '{c}' THEN 1e0 ELSE 0e0 END)"
    pred = "CASE WHEN prob_home >= prob_draw AND prob_home >= prob_away THEN 'H' WHEN prob_draw >= prob_away THEN 'D' ELSE 'A' END"
    BLOCKS[name] = ((source,), f"""SELECT {keys}, count(*) AS n,
    avg(-ln(least(greatest(CASE result WHEN 'H' THEN prob_home WHEN 'D' THEN prob_draw ELSE prob_away END, 1e-15), 1))) AS log_loss,
    avg(((prob_home - {is_('H')}) ** 2 + (prob_home + prob_draw - {is_('H')} - {is_('D')}) ** 2) / 2) AS rps,
    avg(CASE WHEN result = {pred} THEN 1e0 ELSE 0e0 END) AS accuracy, count(*) FILTER (result = 'D' AND {pred} = 'D') / greatest(count(*) FILTER (result = 'D'), 1) AS draw_recall,
    count(*) FILTER ({pred} = 'D') AS draw_predictions FROM {source} GROUP BY ALL""", "MATERIALIZED ")


_forecast_block("fold_forecast", {"poisson": ("goals",)}, "fold_expected")
_forecast_block("arm_forecast", wf.VARIANTS, "arm_expected")
rho_block("fold_rho", "fold_rates", folds=True)
_forecast_block("fold_rho_forecast", {wf.LOW_SCORE: ("goals",)}, "fold_expected", "fold_rho")
BLOCKS["track_forecast"] = (("fold_forecast", "fold_rho_forecast", "plain_elo_probs", "season_roles"), """
  SELECT match_id, result, fold, model, season, prob_home, prob_draw, prob_away FROM fold_forecast
  UNION ALL SELECT match_id, result, fold, model, season, prob_home, prob_draw, prob_away FROM fold_rho_forecast
  UNION ALL SELECT e.match_id, e.result, r.fold, 'elo', e.season, prob_home, prob_draw, prob_away FROM plain_elo_probs e
  JOIN season_roles r ON r.season = e.season AND r.part = 'validation'""", "MATERIALIZED ")
_score_block("track_scores", "track_forecast", "fold, season AS validation_season, model")
_score_block("arm_scores", "arm_forecast", "fold, model, xi")

_FOLDS = """
dd AS (SELECT match_date, row_number() OVER (ORDER BY match_date) - 1 AS r, count(*) OVER () AS d FROM (SELECT DISTINCT match_date FROM matches WHERE season <> '2001')),
roles AS (SELECT match_date, k AS fold, CASE WHEN r < d - (6 - k) * (d // 6) THEN 'train' WHEN r < d - (6 - k) * (d // 6) + d // 6 THEN 'validation' END AS part
  FROM dd, (SELECT unnest([1, 2, 3, 4, 5]) AS k))"""


@query("w11_date_folds", f"WITH {_FOLDS} SELECT match_date, CAST(fold AS BIGINT) AS fold, part FROM roles WHERE part IS NOT NULL")
def _(spark, d):
    return folds.date_membership(load_matches(spark, d).where(F.col("season") != HOLDOUT_SEASON))


@query("w12_season_folds", """WITH s AS (SELECT season, lag(season) OVER (ORDER BY season) AS p, row_number() OVER (ORDER BY season) AS r
  FROM (SELECT DISTINCT season FROM matches WHERE season <> '2001')) SELECT r - 4 AS fold, p AS last_train_season, season AS validation_season FROM s WHERE r > 4""")
def _(spark, d):
    return folds.season_folds(load_matches(spark, d), HOLDOUT_SEASON)


@query("j16_fold_membership", """SELECT m.match_id, r.fold, r.part FROM matches m JOIN season_roles r ON r.season = m.season""", ("matches", "season_roles"))
def _(spark, d):
    m = settle(load_matches(spark, d))
    return m.join(settle(folds.season_membership(m, HOLDOUT_SEASON)), "season").select("match_id", "fold", "part")


@query("v6_fold_time_order", f"""WITH {_FOLDS} SELECT CAST(fold AS BIGINT) AS fold, max(m.match_date) FILTER (part = 'train') AS last_train, min(m.match_date) FILTER (part = 'validation') AS first_validation,
  count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'validation') AS validation_rows, CAST(0 AS BIGINT) AS overlap
FROM matches m JOIN roles USING (match_date) WHERE part IS NOT NULL AND m.season <> '2001' GROUP BY fold""")
def _(spark, d):
    m = settle(load_matches(spark, d).where(F.col("season") != HOLDOUT_SEASON))
    return checks.check_split(m.join(settle(folds.date_membership(m)), "match_date"))


def _track(spark, d):
    """Season walk-forward of the goal model, its low-score variant and the unseeded ratings, labels joined by match."""
    m = settle(load_matches(spark, d))
    poisson = wf.walk_forward(m, HOLDOUT_SEASON, {"poisson": ("goals",)}, low_score=True)
    names = ["match_id", "result", "fold", "model", "season", "cold_start", "prob_home", "prob_draw", "prob_away"]
    done = ratings.rate(m.where(F.col("season") != HOLDOUT_SEASON)).where("kind = 'match'")
    elo = ratings.rating_probabilities(done).join(
        settle(folds.season_folds(m, HOLDOUT_SEASON).select("fold", F.col("validation_season").alias("season"))), "season")
    elo = elo.withColumns({"model": F.lit("elo"), "cold_start": F.lit(False)})
    return m, settle(poisson.select(*names).unionByName(elo.select(*names)))


def _track_scores(spark, d):
    m, rows = _track(spark, d)
    return m, wf.fold_scores(rows.withColumnRenamed("season", "validation_season"), ["fold", "validation_season", "model"])


_S6 = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)


@query("m21_season_walk_forward", f"""SELECT fold, validation_season, model, n, {_S6('log_loss', 'rps', 'accuracy', 'draw_recall')}, draw_predictions FROM track_scores""", ("track_scores",))
def _(spark, d):
    return rounded(_track_scores(spark, d)[1].select("fold", "validation_season", "model", "n", "log_loss", "rps", "accuracy", "draw_recall", "draw_predictions"), 6)


@query("a14_fold_summary", "SELECT model, count(DISTINCT fold) AS folds, " + ", ".join(
    f"round({f}({x}), 6) AS {x}_{n}" for x in ("log_loss", "rps", "accuracy") for f, n in (("avg", "mean"), ("stddev_samp", "std"))) + " FROM track_scores GROUP BY model", ("track_scores",))
def _(spark, d):
    return rounded(folds.summarize_folds(_track_scores(spark, d)[1], ["log_loss", "rps", "accuracy"]), 6)


@query("j10_paired_fold_delta", """SELECT a.model, count(*) AS folds, round(avg(a.log_loss - b.log_loss), 6) AS delta_mean, round(stddev_samp(a.log_loss - b.log_loss), 6) AS delta_std,
  count(*) FILTER (a.log_loss < b.log_loss) AS folds_better FROM track_scores a JOIN track_scores b ON b.fold = a.fold AND b.model = 'poisson' WHERE a.model <> 'poisson' GROUP BY a.model""", ("track_scores",))
def _(spark, d):
    return rounded(folds.compare_folds(settle(_track_scores(spark, d)[1]), "poisson"), 6)


def _arms(spark, d):
    m = settle(load_matches(spark, d))
    rows = wf.walk_forward(m, HOLDOUT_SEASON, wf.VARIANTS, DECAY_GRID)
    return settle(wf.fold_scores(rows, ["fold", "model", "xi"]))


@query("m23_decay_grid", f"SELECT fold, model, xi, n, {_S6('log_loss', 'rps', 'accuracy')} FROM arm_scores", ("arm_scores",))
def _(spark, d):
    return rounded(_arms(spark, d).select("fold", "model", "xi", "n", "log_loss", "rps", "accuracy"), 6)


@query("a22_best_decay", """WITH g AS (SELECT model, xi, avg(log_loss) AS m FROM arm_scores GROUP BY ALL)
SELECT model, min_by(xi, struct_pack(a := round(m, 9), b := xi)) AS best_xi, round(min(m), 6) AS best_log_loss FROM g GROUP BY model""", ("arm_scores",))
def _(spark, d):
    best = folds.best_decay(_arms(spark, d))
    return best.withColumn("best_log_loss", F.round("best_log_loss", 6))


@query("a23_fold_model_pivot", "SELECT fold, " + ", ".join(f"round(max(log_loss) FILTER (model = '{m}'), 6) AS {m}" for m in TRACK_MODELS) + " FROM track_scores GROUP BY fold", ("track_scores",))
def _(spark, d):
    scores = _track_scores(spark, d)[1]
    return rounded(scores.groupBy("fold").pivot("model", list(TRACK_MODELS)).agg(F.max("log_loss")), 6)


@query("m42_goals_arm", f"SELECT fold, xi, n, {_S6('log_loss', 'rps', 'accuracy')} FROM arm_scores WHERE model = 'poisson'", ("arm_scores",))
def _(spark, d):
    m = settle(load_matches(spark, d))
    rows = wf.walk_forward(m, HOLDOUT_SEASON, {"poisson": ("goals",)}, DECAY_GRID)
    return rounded(wf.fold_scores(rows, ["fold", "xi"]).select("fold", "xi", "n", "log_loss", "rps", "accuracy"), 6)


@query("m14_exposure_rates", """SELECT competition, target, team, round(attack, 6) AS attack, round(-defense, 6) AS defense, round(home_advantage, 6) AS home_advantage
FROM rate_rates WHERE target IN ('goal_per_shot', 'sot_per_shot', 'goal_per_sot')""", ("rate_rates",))
def _(spark, d):
    _, train, _ = split_matches(spark, d)
    fitted = counts.fit_rates(counts.fit_cells(counts.day_cells(train, counts.RATES)))
    # Published as strength (subtracted), stored as weakness (added).
    return rounded(fitted.withColumn("defense", -F.col("defense")).drop("xi"), 6)


BLOCKS["hold_pairs"] = (("matches",), "SELECT DISTINCT competition, team_home, team_away FROM matches WHERE season = '2001'", "MATERIALIZED ")
expected_block("hold_expected", "hold_pairs", "rate_rates")


@query("m15_chained_expectations", " UNION ALL ".join(
    f"SELECT competition, team_home, team_away, '{m}' AS model, round(product(expected_home), 6) AS expected_home, round(product(expected_away), 6) AS expected_away "
    f"FROM hold_expected WHERE target IN ({', '.join(repr(t) for t in chain)}) GROUP BY ALL" for m, chain in wf.VARIANTS.items()), ("hold_expected",))
def _(spark, d):
    _, train, holdout = split_matches(spark, d)
    rates = settle(counts.fit_rates(counts.fit_cells(counts.day_cells(train, ARMS))))
    rows = counts.expected_counts(holdout.select(*wf.PAIR).distinct(), rates)
    return rounded(wf.chained_expectations(rows, wf.PAIR, wf.VARIANTS).drop("cold_start"), 6)


@query("m43_rates_of_fixture", """SELECT competition, team_home, team_away, round(max(expected_home) FILTER (target = 'goal_per_shot'), 6) AS quality_home,
  round(max(expected_away) FILTER (target = 'goal_per_shot'), 6) AS quality_away, round(max(expected_home) FILTER (target = 'shots'), 6) AS volume_home,
  round(max(expected_away) FILTER (target = 'shots'), 6) AS volume_away FROM hold_expected GROUP BY ALL""", ("hold_expected",))
def _(spark, d):
    _, train, holdout = split_matches(spark, d)
    rates = settle(counts.fit_rates(counts.fit_cells(counts.day_cells(train, ("shots", "goal_per_shot")))))
    rows = counts.expected_counts(holdout.select(*wf.PAIR).distinct(), rates)
    of = lambda t, s: F.max(F.when(F.col("target") == t, F.col(f"expected_{s}")))
    return rounded(rows.groupBy(*wf.PAIR).agg(*[of(t, s).alias(f"{n}_{s}") for n, t in (("quality", "goal_per_shot"), ("volume", "shots")) for s in ("home", "away")]), 6)


BLOCKS["profile"] = (("matches", "train_rates"), """
  WITH b AS (SELECT competition, max(match_date) AS base_date FROM matches WHERE season <> '2001' GROUP BY 1)
  SELECT m.competition, m.match_id, CASE WHEN m.season = '1998' THEN 'empty' ELSE 'normal' END AS subset,
    exp(-0.0018e0 * date_diff('day', match_date, base_date)) * goals_home AS scored,
    exp(-0.0018e0 * date_diff('day', match_date, base_date)) * exp(h.attack + a.defense) AS expected
  FROM matches m JOIN b USING (competition) JOIN train_rates h ON h.target = 'goals' AND h.competition = m.competition AND h.team = m.team_home
  JOIN train_rates a ON a.target = 'goals' AND a.competition = m.competition AND a.team = m.team_away WHERE m.season <> '2001'""", "MATERIALIZED ")


def profile_rows(spark, d):
    _, train, _ = split_matches(spark, d)
    rates = settle(counts.fit_rates(counts.fit_cells(counts.day_cells(train))))
    subset = F.when(F.col("season").isin(*EMPTY_STADIUM_SEASONS), "empty").otherwise("normal")
    return train, rates, subset


@query("m16_profiled_home_advantage", "SELECT competition, subset, count(*) AS matches, round(ln(sum(scored) / sum(expected)), 6) AS home_advantage FROM profile GROUP BY ALL", ("profile",))
def _(spark, d):
    return rounded(wf.home_advantage_by_subset(*profile_rows(spark, d)), 6)


BLOCKS["hfa_forecast"] = (("matches", "season_roles", "fold_rates"), f"""
  WITH tr AS (SELECT m.*, r.fold FROM matches m JOIN season_roles r ON r.season = m.season AND r.part = 'train'),
  b AS (SELECT competition, fold, max(match_date) AS base_date FROM tr GROUP BY ALL),
  pr AS (SELECT tr.competition, tr.fold, tr.season = '1998' AS e, exp(-0.0018e0 * date_diff('day', match_date, base_date)) AS w, goals_home, exp(h.attack + a.defense) AS x
    FROM tr JOIN b USING (competition, fold) JOIN fold_rates h ON h.competition = tr.competition AND h.fold = tr.fold AND h.team = tr.team_home
    JOIN fold_rates a ON a.competition = tr.competition AND a.fold = tr.fold AND a.team = tr.team_away),
  hf AS (SELECT competition, fold, ln(sum(w * goals_home) FILTER (e) / sum(w * x) FILTER (e)) AS he, ln(sum(w * goals_home) FILTER (NOT e) / sum(w * x) FILTER (NOT e)) AS hn FROM pr GROUP BY ALL),
  l AS (SELECT competition, fold, avg(attack) AS ma, avg(defense) AS md, any_value(home_advantage) AS hg FROM fold_rates GROUP BY ALL),
  va AS (SELECT m.match_id, m.season, m.result, r.fold, m.season = '1998' AS nf, hg, hn, he, exp(coalesce(h.attack, ma) + coalesce(a.defense, md)) AS x0, exp(coalesce(a.attack, ma) + coalesce(h.defense, md)) AS expected_away
    FROM matches m JOIN season_roles r ON r.season = m.season AND r.part = 'validation' JOIN l ON l.competition = m.competition AND l.fold = r.fold JOIN hf ON hf.competition = m.competition AND hf.fold = r.fold
    LEFT JOIN fold_rates h ON h.competition = m.competition AND h.fold = r.fold AND h.team = m.team_home LEFT JOIN fold_rates a ON a.competition = m.competition AND a.fold = r.fold AND a.team = m.team_away),
  v AS (SELECT match_id, season, result, fold, nf, he, expected_away, unnest(['baseline', 'variant_a', 'variant_b']) AS model,
    x0 * exp(unnest([hg, hn, CASE WHEN nf THEN he ELSE hn END])) AS expected_home FROM va),
  g AS ({grid_sql('v', 'match_id, model')})
  SELECT v.fold, v.season, v.match_id, v.model, v.result, v.nf, v.he, sum(p) FILTER (i > j) AS prob_home, sum(p) FILTER (i = j) AS prob_draw, sum(p) FILTER (i < j) AS prob_away
  FROM v JOIN g USING (match_id, model) GROUP BY v.fold, v.season, v.match_id, v.model, v.result, v.nf, v.he""", "MATERIALIZED ")
_score_block("hfa_scores", "hfa_forecast", "fold, season, model")


@query("m35_seasonal_home_advantage", "SELECT fold, season AS validation_season, any_value(n) AS n_matches, season = '1998' AS validation_is_no_fans, true AS applicable, CAST(NULL AS VARCHAR) AS skip_reason, "
       + ", ".join(f"round(max({c}) FILTER (model = '{m}'), 6) AS {m}_{c}" for m in ("baseline", "variant_a", "variant_b") for c in ("log_loss", "rps")) + " FROM hfa_scores GROUP BY fold, season", ("hfa_scores",))
def _(spark, d):
    return rounded(wf.seasonal_home_advantage(settle(load_matches(spark, d)), HOLDOUT_SEASON, EMPTY_STADIUM_SEASONS), 6)


@query("u4_v7_fold_differences", """WITH s AS (SELECT season, lag(season) OVER (ORDER BY season) AS p, row_number() OVER (ORDER BY season) AS r FROM (SELECT DISTINCT season FROM matches WHERE season <> '2001')),
e AS (SELECT r - 4 AS fold, p AS last_train_season, season AS validation_season FROM s WHERE r > 4),
s2 AS (SELECT season, lag(season) OVER (ORDER BY season) AS p, row_number() OVER (ORDER BY season) AS r FROM (SELECT DISTINCT season FROM matches WHERE season <> '1995')),
o AS (SELECT r - 4 AS fold, p AS last_train_season, season AS validation_season FROM s2 WHERE r > 4)
SELECT *, 'stale' AS problem FROM (SELECT * FROM o EXCEPT SELECT * FROM e) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM e EXCEPT SELECT * FROM o)""")
def _(spark, d):
    m = settle(load_matches(spark, d))
    return folds.fold_differences(folds.season_folds(m, "1995"), folds.season_folds(m, HOLDOUT_SEASON))


@query("u10_fold_pairs", """WITH s AS (SELECT season, lag(season) OVER (ORDER BY season) AS p, row_number() OVER (ORDER BY season) AS r FROM (SELECT DISTINCT season FROM matches WHERE season <> '2001'))
SELECT r - 4 AS fold, p AS last_train_season, season AS validation_season FROM s WHERE r > 4""")
def _(spark, d):
    m = settle(load_matches(spark, d))
    pairs = folds.season_folds(m, HOLDOUT_SEASON).withColumnRenamed("validation_season", "season")
    rows = m.select("match_id", "season").join(pairs, "season").withColumnRenamed("season", "validation_season")
    return folds.fold_pairs(rows)


_SELECTION = """
WITH g AS (SELECT model, avg(log_loss) AS cv_log_loss_mean, stddev_samp(log_loss) AS cv_log_loss_std, avg(accuracy) AS cv_accuracy_mean, stddev_samp(accuracy) AS cv_accuracy_std,
  count(DISTINCT fold) AS folds FROM track_scores GROUP BY model),
b AS (SELECT model, season, avg(log_loss) AS ll, avg(correct) AS ac FROM scores WHERE season <> '2001' GROUP BY ALL),
c AS (SELECT model, avg(ll) AS cv_log_loss_mean, stddev_samp(ll) AS cv_log_loss_std, avg(ac) AS cv_accuracy_mean, stddev_samp(ac) AS cv_accuracy_std, count(*) AS folds FROM b GROUP BY model)"""
_SEL = "round(cv_log_loss_mean, 6) AS cv_log_loss_mean, round(cv_log_loss_std, 6) AS cv_log_loss_std, round(cv_accuracy_mean, 6) AS cv_accuracy_mean, round(cv_accuracy_std, 6) AS cv_accuracy_std"


BLOCKS["train_pairs"] = (("matches",), "SELECT DISTINCT competition, team_home, team_away FROM matches WHERE season <> '2001'", "MATERIALIZED ")
expected_block("train_expected", "train_pairs", "train_rates")
BLOCKS["train_goals"] = (("train_expected", "rho"), """
  SELECT e.competition, team_home, team_away, expected_home, expected_away, unnest(['poisson', 'dixon_coles']) AS model, unnest([0e0, r.rho]) AS rho
  FROM train_expected e JOIN rho r ON r.competition = e.competition WHERE target = 'goals'""", "MATERIALIZED ")
BLOCKS["in_sample_forecast"] = (("matches", "train_goals", "plain_elo_probs"), f"""
  WITH g AS ({grid_sql('train_goals', 'competition, team_home, team_away, model', rho='rho')}),
  p AS (SELECT competition, team_home, team_away, model, sum(p) FILTER (i > j) AS prob_home, sum(p) FILTER (i = j) AS prob_draw, sum(p) FILTER (i < j) AS prob_away FROM g GROUP BY ALL)
  SELECT m.result, model, prob_home, prob_draw, prob_away FROM matches m JOIN p USING (competition, team_home, team_away) WHERE m.season <> '2001'
  UNION ALL SELECT result, 'elo', prob_home, prob_draw, prob_away FROM plain_elo_probs WHERE season <> '2001'""", "MATERIALIZED ")
_score_block("in_sample_scores", "in_sample_forecast", "model")


def in_sample_scores(m):
    """Scores of the track's models on the rows they were fitted to: what selection falls back to without a record."""
    train = settle(m.where(F.col("season") != HOLDOUT_SEASON))
    rates = settle(counts.fit_rates(counts.fit_cells(counts.day_cells(train))))
    rho = settle(counts.low_score_correlation(train, rates).select("competition", "rho"))
    pairs = counts.expected_counts(train.select(*wf.PAIR).distinct(), rates).join(rho, "competition")
    arms = [F.struct(F.lit("poisson").alias("model"), F.lit(0.0).alias("rho")), F.struct(F.lit(wf.LOW_SCORE).alias("model"), F.col("r").alias("rho"))]
    pairs = grids.outcome_probabilities(pairs.withColumnRenamed("rho", "r").select("*", F.inline(F.array(*arms))))
    names = ["model", "result", "prob_home", "prob_draw", "prob_away"]
    goals = train.select("match_id", "result", *wf.PAIR).join(pairs, wf.PAIR).select(*names)
    elo = ratings.rating_probabilities(ratings.rate(train).where("kind = 'match'")).withColumn("model", F.lit("elo")).select(*names)
    return model_metrics(goals.unionByName(elo), ["model"])


@query("m37_in_sample_fallback", f"""SELECT model, 'Track A' AS track, round(log_loss, 6) AS cv_log_loss_mean, CAST(NULL AS DOUBLE) AS cv_log_loss_std, round(accuracy, 6) AS cv_accuracy_mean,
  CAST(NULL AS DOUBLE) AS cv_accuracy_std, '{selection.IN_SAMPLE}' AS selection_basis, concat('In-sample log loss (not out-of-fold): ', printf('%.6f', round(log_loss, 6))) AS label FROM in_sample_scores""", ("in_sample_scores",))
def _(spark, d):
    m = settle(load_matches(spark, d))
    track = selection.guarded_or_in_sample(None, folds.season_folds(m, HOLDOUT_SEASON), HOLDOUT_SEASON, "", lambda: in_sample_scores(m))
    return rounded(selection.selection_table({"Track A": track}), 6).withColumn("label", selection.metric_label())


def selection_table(spark, d):
    m, track = _track_scores(spark, d)
    # The record says what each fold trained on; the guard derives the folds anew from the seasons.
    trained = wf.last_train_seasons(folds.season_membership(m, HOLDOUT_SEASON))
    stored = settle(track.join(trained, "fold"))
    rows = predictions_of(m).where(F.col("season") != HOLDOUT_SEASON)
    other = model_metrics(rows, ["model", "season"]).withColumnRenamed("season", "fold")
    return settle(selection.selection_table({
        "Track A": selection.guarded_or_in_sample(
            stored, folds.season_folds(m, HOLDOUT_SEASON), HOLDOUT_SEASON, "walk-forward by season, training seasons only",
            lambda: in_sample_scores(m)), "Track B": (other, "season folds")}))


@query("m37_selection_table", f"""{_SELECTION} SELECT model, 'Track A' AS track, {_SEL}, concat('walk-forward by season, training seasons only, ', folds, ' folds (out-of-sample)') AS selection_basis FROM g
UNION ALL SELECT model, 'Track B', {_SEL}, concat('season folds, ', folds, ' folds (out-of-sample)') FROM c""", ("track_scores", "scores"))
def _(spark, d):
    return rounded(selection_table(spark, d), 6)


@query("k2_select_best_model", f"""{_SELECTION}, a AS (SELECT * FROM g UNION ALL SELECT * FROM c) SELECT model, round(cv_log_loss_mean, 6) AS cv_log_loss_mean, round(cv_accuracy_mean, 6) AS cv_accuracy_mean
FROM a WHERE model IN ('poisson', 'dixon_coles', 'elo', 'form', 'base_rate') ORDER BY cv_log_loss_mean, cv_accuracy_mean DESC, model LIMIT 1""", ("track_scores", "scores"))
def _(spark, d):
    best = selection.select_best_model(selection_table(spark, d), [*TRACK_MODELS, "form", "base_rate"])
    return rounded(best.select("model", "cv_log_loss_mean", "cv_accuracy_mean"), 6)


@query("p20_metric_labels", f"""{_SELECTION}, a AS (SELECT model, cv_log_loss_mean, 'CV log loss: ' AS l FROM g UNION ALL SELECT model, cv_log_loss_mean, 'CV log loss: ' FROM c)
SELECT model, concat(l, printf('%.6f', round(cv_log_loss_mean, 6))) AS label FROM a""", ("track_scores", "scores"))
def _(spark, d):
    table = selection_table(spark, d).withColumn("cv_log_loss_mean", F.round("cv_log_loss_mean", 6))
    return table.select("model", selection.metric_label().alias("label"))
