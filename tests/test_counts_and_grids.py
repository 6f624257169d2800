"""Count fits, grids and folds against NumPy and each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import counts, folds, grids
from touchline.operators.walkforward import VARIANTS, walk_forward


def test_joined_sweeps_equal_in_task_sweeps(matches):
    cells = counts.fit_cells(counts.day_cells(matches, ("goals", "goal_per_shot")))
    keys = ["competition", "target", "team"]
    a = {tuple(r[k] for k in keys): r for r in counts.fit_rates(cells, sweeps=3).collect()}
    b = {tuple(r[k] for k in keys): r for r in counts.fit_rates(cells, sweeps=3, limit=1).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in ("attack", "defense", "home_advantage"):
            assert a[k][c] == pytest.approx(b[k][c], abs=1e-9)


def test_fit_is_a_maximum_and_normalised(matches):
    cells = counts.fit_cells(counts.day_cells(matches.where("competition = 'A'")))
    rates = counts.fit_rates(cells, sweeps=200).collect()
    attack = {r["team"]: r["attack"] for r in rates}
    defense = {r["team"]: r["defense"] for r in rates}
    h = rates[0]["home_advantage"]
    assert np.mean(list(attack.values())) == pytest.approx(1.0)
    data = cells.collect()

    def ll(att, dfn, hfa):
        return sum(c["wy"] * (att[c["team"]] + dfn[c["opponent"]] + hfa * c["is_home"])
                   - c["we"] * math.exp(att[c["team"]] + dfn[c["opponent"]] + hfa * c["is_home"]) for c in data)

    best = ll(attack, defense, h)
    for team in attack:
        for step in (-0.01, 0.01):
            assert ll(attack | {team: attack[team] + step}, defense, h) < best
            assert ll(attack, defense | {team: defense[team] + step}, h) < best
    assert ll(attack, defense, h + 0.01) < best and ll(attack, defense, h - 0.01) < best


def test_grid_sums_match_a_dense_grid(spark):
    row = spark.sql("SELECT 1.8D AS expected_home, 1.2D AS expected_away, -0.08D AS rho, 1 AS id")
    k = np.arange(15)
    pmf = lambda m: np.array([math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in k])
    g = np.outer(pmf(1.8), pmf(1.2))
    plain = g / g.sum()
    g[0, 0] *= 1 + 0.08 * 1.8 * 1.2
    g[0, 1] *= 1 - 0.08 * 1.8
    g[1, 0] *= 1 - 0.08 * 1.2
    g[1, 1] *= 1.08
    g /= g.sum()
    p = grids.outcome_probabilities(row).first()
    assert [p["prob_home"], p["prob_draw"], p["prob_away"]] == pytest.approx([np.tril(g, -1).sum(), np.trace(g), np.triu(g, 1).sum()], abs=1e-12)
    assert grids.both_score(row).first()["btts"] == pytest.approx(g[1:, 1:].sum(), abs=1e-12)
    total = k[:, None] + k[None, :]
    for line in (2.5, 3.0, 0.5):
        o = grids.over_under(row, line).first()
        assert [o["over"], o["under"], o["push"]] == pytest.approx(
            [plain[total > line].sum(), plain[total < line].sum(), plain[total == line].sum()], abs=1e-12)
    top = grids.top_scores(row).orderBy("score_rank").collect()
    order = sorted(((-g[i, j], i, j) for i in k for j in k))[:3]
    assert [(t["score_home"], t["score_away"]) for t in top] == [(i, j) for _, i, j in order]


def test_unknown_team_gets_the_league_mean(spark, matches):
    rates = counts.fit_rates(counts.fit_cells(counts.day_cells(matches)))
    ask = spark.sql("SELECT 'A' AS competition, 'T1' AS team_home, 'nobody' AS team_away")
    row = counts.expected_counts(ask, rates).first()
    league = rates.where("competition = 'A'").agg(F.avg("attack"), F.avg("defense"), F.first("home_advantage")).first()
    t1 = rates.where("competition = 'A' AND team = 'T1'").first()
    assert row["cold_start"]
    assert row["expected_home"] == pytest.approx(math.exp(league[2] + t1["attack"] + league[1]))
    assert row["expected_away"] == pytest.approx(math.exp(league[0] + t1["defense"]))


def test_folds_are_forward_only(matches):
    rows = matches.join(folds.date_membership(matches), "match_date")
    edges = rows.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("match_date"))).alias("a"),
                                     F.min(F.when(F.col("part") == "validation", F.col("match_date"))).alias("b")).collect()
    assert len(edges) == 5 and all(e["a"] < e["b"] for e in edges)
    season = folds.season_folds(matches, "2003", 1).collect()
    assert [(r["fold"], r["last_train_season"], r["validation_season"]) for r in season] == [(1, "2001", "2002")]


def test_walk_forward_ignores_the_validation_season_and_later(matches, monkeypatch):
    from touchline.operators import walkforward
    plain = folds.season_membership
    monkeypatch.setattr(walkforward, "season_membership", lambda m, h: plain(m, h, 1))
    changed = matches.withColumn("goals_home", F.when(F.col("season") >= "2002", F.lit(4)).otherwise(F.col("goals_home")))
    names = ["match_id", "model", "prob_home", "prob_draw"]
    a = {(r[0], r[1]): (r[2], r[3]) for r in walk_forward(matches, "2003", {"poisson": VARIANTS["poisson"]}).select(*names).collect()}
    b = {(r[0], r[1]): (r[2], r[3]) for r in walk_forward(changed, "2003", {"poisson": VARIANTS["poisson"]}).select(*names).collect()}
    assert a and a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)


@pytest.mark.parametrize("target", ["goals", "goal_per_sot"])
def test_fit_without_home_cells_keeps_every_team(spark, target):
    cells = spark.createDataFrame([("A", target, 0.0, "x", "y", 0, 3.0, 9.0), ("A", target, 0.0, "y", "x", 0, 1.0, 8.0)],
                                  "competition string, target string, xi double, team string, opponent string, is_home int, wy double, we double")
    one, other = ({r.team: (round(r.attack, 9), round(r.defense, 9), r.home_advantage) for r in counts.fit_rates(cells, sweeps=4, limit=n).collect()}
                  for n in (0, 250_000))
    assert one == other and set(one) == {"x", "y"} and all(v[2] == 0.0 for v in one.values())


@pytest.fixture()
def short_folds(monkeypatch):
    """Folds after one training season, so that three seasons give two."""
    from touchline.operators import walkforward
    plain = folds.season_membership
    monkeypatch.setattr(walkforward, "season_membership", lambda m, h: plain(m, h, 1))
    return plain


def test_low_score_arm_shifts_only_low_scores_by_its_own_training_rows(matches, short_folds):
    rows = walk_forward(matches, "none", {"poisson": VARIANTS["poisson"]}, low_score=True)
    assert "rho" not in rows.columns
    got = {(r.match_id, r.model): r for r in rows.collect()}
    ids = {i for i, _ in got}
    assert ids and set(got) == {(i, m) for i in ids for m in ("poisson", "dixon_coles")}
    roles = short_folds(matches, "none", 1)
    train = matches.join(roles.where("part = 'train'").select("season", "fold"), "season")
    rates = counts.fit_rates(counts.fit_cells(counts.day_cells(matches), roles))
    rho = {(r.competition, r.fold): r.rho for r in counts.low_score_correlation(train, rates).collect()}
    assert len(rho) == 4
    for i in ids:
        a, b = got[i, "poisson"], got[i, "dixon_coles"]
        lam, mu, low = b.expected_home, b.expected_away, rho[b.competition, b.fold]
        k = np.arange(15)
        pmf = lambda m: np.array([math.exp(-m + n * math.log(m) - math.lgamma(n + 1)) for n in k])
        g = np.outer(pmf(lam), pmf(mu))
        g[0, 0] *= 1 - lam * mu * low
        g[0, 1] *= 1 + lam * low
        g[1, 0] *= 1 + mu * low
        g[1, 1] *= 1 - low
        g /= g.sum()
        assert (a.expected_home, a.expected_away) == (lam, mu)
        assert [b.prob_home, b.prob_draw, b.prob_away] == pytest.approx([np.tril(g, -1).sum(), np.trace(g), np.triu(g, 1).sum()], abs=1e-12)


def test_low_score_arm_needs_the_goal_model_and_one_decay(matches):
    for variants, decays in (({"shots": ("shots",)}, (0.0018,)), ({"poisson": ("goals",)}, (0.0, 0.0018))):
        with pytest.raises(ValueError, match="low-score"):
            walk_forward(matches, "2003", variants, decays, low_score=True)


def _record(spark, matches, holdout):
    """Fold scores with what the folds of that holdout trained on."""
    from touchline.operators.walkforward import last_train_seasons
    pairs = folds.season_folds(matches, holdout, 1).select("fold", "validation_season")
    return pairs.join(last_train_seasons(folds.season_membership(matches, holdout, 1)), "fold").select(
        "fold", "last_train_season", "validation_season", F.lit("poisson").alias("model"), F.lit(1.0).alias("log_loss"), F.lit(0.5).alias("accuracy"))


def test_stale_and_contaminated_records_are_refused(spark, matches):
    from touchline.operators import selection
    never = lambda: pytest.fail("a record that is refused is not replaced")
    now = folds.season_folds(matches, "2003", 1)
    good, basis = selection.guarded_or_in_sample(_record(spark, matches, "2003"), now, "2003", "walk-forward", never)
    assert good.count() == 1 and basis == "walk-forward"
    with pytest.raises(ValueError, match="holdout season 2003"):  # written when another season was held out
        selection.guarded_or_in_sample(_record(spark, matches, "none"), now, "2003", "walk-forward", never)
    with pytest.raises(ValueError, match="other folds"):  # stops a season early
        selection.guarded_or_in_sample(_record(spark, matches.where("season < '2003'"), "2002"), now, "2003", "walk-forward", never)
    with pytest.raises(ValueError, match="other folds"):  # trained up to another season than today's fold does
        moved = _record(spark, matches, "2003").withColumn("last_train_season", F.lit("1999"))
        selection.guarded_or_in_sample(moved, now, "2003", "walk-forward", never)


def test_selection_without_a_record_is_labelled_in_sample(spark, matches):
    from touchline.operators import selection
    fitted = spark.sql("SELECT 'poisson' AS model, 0.9D AS log_loss, 0.6D AS accuracy")
    old = _record(spark, matches, "2003").drop("last_train_season")
    for stored in (None, old):
        track = selection.guarded_or_in_sample(stored, folds.season_folds(matches, "2003", 1), "2003", "walk-forward", lambda: fitted)
        row = selection.selection_table({"Track A": track}).withColumn("label", selection.metric_label()).first()
        assert (row.cv_log_loss_mean, row.cv_log_loss_std, row.cv_accuracy_mean) == (0.9, None, 0.6)
        assert row.label == "In-sample log loss (not out-of-fold): 0.900000"
