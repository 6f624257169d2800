"""Time-decayed log-linear count models: attack, defense and home advantage per competition.

log rate = attack(team) + defense(opponent) + home advantage, fitted by weighted Poisson maximum
likelihood. The likelihood needs only the weighted successes and exposures of each (team, opponent,
venue) cell, so matches are summed to cells in one pass and the fit never sees a match row again.
Each sweep then solves the three score equations in turn, each in closed form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.schema import TIME_DECAY
from touchline.session import settle

# Successes and exposure of each model; no exposure column means one per match.
TARGETS = {
    "goals": ("goals", None), "corners": ("corners", None), "yellow": ("yellow_cards", None), "red": ("red_cards", None),
    "shots": ("shots", None), "goal_per_shot": ("goals", "shots"), "sot_per_shot": ("shots_on_target", "shots"),
    "goal_per_sot": ("goals", "shots_on_target"),
}
RATES = ("goal_per_shot", "sot_per_shot", "goal_per_sot")
SWEEPS = 20
LEAST_MASS = 0.01  # weighted successes credited to a team that has none
CELLS_IN_ONE_TASK = 250_000
CELL = ["team", "opponent", "is_home"]


def day_cells(matches: DataFrame, targets: tuple = ("goals",)) -> DataFrame:
    """Successes and exposure per target, day, team, opponent and venue."""

    def side(team, opponent, home, s):
        values = []
        for t in targets:
            won, tried = TARGETS[t]
            exposure = F.col(f"{tried}_{s}") if tried else F.lit(1)
            kept = F.col(f"{won}_{s}").isNotNull() & (exposure >= 1)
            values += [F.when(kept, F.col(f"{won}_{s}")).cast("double").alias(f"y_{t}"), F.when(kept, exposure).cast("double").alias(f"e_{t}")]
        return F.struct(F.col(team).alias("team"), F.col(opponent).alias("opponent"), F.lit(home).alias("is_home"), *values)

    keys = ["competition", "season", "match_date", *CELL]
    rows = matches.select("competition", "season", "match_date", F.inline(F.array(
        side("team_home", "team_away", 1, "home"), side("team_away", "team_home", 0, "away"))))
    sums = rows.groupBy(*keys).agg(*[F.sum(f"{c}_{t}").alias(f"{c}_{t}") for t in targets for c in "ye"])
    long = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"y_{t}").alias("y"), F.col(f"e_{t}").alias("e")) for t in targets])
    return sums.select(*keys, F.inline(long)).where(F.col("e") > 0)


def decay_weight(xi, base="base_date", day="match_date"):
    xi = F.col(xi) if isinstance(xi, str) else F.lit(float(xi))
    return F.exp(-xi * F.datediff(base, day))


def membership_key(membership: DataFrame) -> str:
    """Folds are lists of seasons, or of days."""
    return "season" if "season" in membership.columns else "match_date"


def fit_cells(days: DataFrame, membership: DataFrame | None = None, decays: tuple = (TIME_DECAY,)) -> DataFrame:
    """Weighted cells of every fit: competition x target x decay, and fold when a membership of seasons or days is given.

    Days are fanned out to the folds they train by an equi-join on season or day, after the matches of a
    day are already summed. Weights count back from the last training day.
    """
    keys = ["competition", "target", "xi"]
    if membership is not None:
        on = membership_key(membership)
        days = days.join(membership.where(F.col("part") == "train").select(on, "fold"), on)
        keys.append("fold")
    scope = [k for k in keys if k in ("competition", "fold")]
    last = settle(days.groupBy(*scope).agg(F.max("match_date").alias("base_date")))  # its true size decides the join
    rows = days.join(last, scope).withColumn("xi", F.explode(F.array(*[F.lit(float(x)) for x in decays])))
    w = decay_weight("xi")
    return rows.groupBy(*keys, *CELL).agg(F.sum(w * F.col("y")).alias("wy"), F.sum(w * F.col("e")).alias("we"))


def _solve(wy, we, team, opponent, home, floor_at_zero, sweeps):
    """Attack, defense and home advantage of one fit from its cells."""
    n = max(team.max(), opponent.max()) + 1
    attack, defense, advantage = np.zeros(n), np.zeros(n), 0.0
    total = lambda idx, v: np.bincount(idx, v, n)
    won, lost = np.maximum(total(team, wy), LEAST_MASS), np.maximum(total(opponent, wy), LEAST_MASS)
    at_home = max((wy * home).sum(), LEAST_MASS)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(sweeps):
            attack = np.log(won / total(team, we * np.exp(defense[opponent] + advantage * home)))
            attack[~np.isfinite(attack)] = 0.0
            defense = np.log(lost / total(opponent, we * np.exp(attack[team] + advantage * home)))
            defense[~np.isfinite(defense)] = 0.0
            exposure = (we * home * np.exp(attack[team] + defense[opponent])).sum()
            advantage = np.log(at_home / exposure) if exposure > 0 else 0.0  # a fit without home cells has none
            if floor_at_zero:
                advantage = max(advantage, 0.0)
    return attack, defense, advantage


def _fit_in_tasks(cells: DataFrame, keys: list, sweeps: int) -> DataFrame:
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", team string, attack double, defense double, home_advantage double"

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([frame["team"], frame["opponent"]]).astype(str), return_inverse=True)
        team, opponent = codes[: len(frame)], codes[len(frame):]
        attack, defense, advantage = _solve(
            frame["wy"].to_numpy(), frame["we"].to_numpy(), team, opponent, frame["is_home"].to_numpy(dtype=float),
            frame["target"].iloc[0] in RATES, sweeps)
        out = pd.DataFrame({"team": names, "attack": attack, "defense": defense, "home_advantage": advantage})
        for k in reversed(keys):
            out.insert(0, k, frame[k].iloc[0])
        return out

    return cells.groupBy(*keys).applyInPandas(one, schema)


def _fit_by_joins(cells: DataFrame, keys: list, sweeps: int) -> DataFrame:
    """The same sweeps as joins and sums, for fits with too many cells for one task."""
    teams = settle(cells.select(*keys, F.explode(F.array("team", "opponent")).alias("team")).distinct())
    state = teams.withColumns({"attack": F.lit(0.0), "defense": F.lit(0.0), "home_advantage": F.lit(0.0)})
    mass = lambda c: F.greatest(F.sum(c), F.lit(LEAST_MASS))

    def update(of: str, other: str, known: str, new: str):
        lookup = state.select(*keys, F.col("team").alias(other), F.col(known).alias("v"), "home_advantage")
        rates = cells.join(lookup, keys + [other]).groupBy(*keys, F.col(of).alias("team")).agg(F.ln(
            mass("wy") / F.sum(F.col("we") * F.exp(F.col("v") + F.col("home_advantage") * F.col("is_home")))).alias("new"))
        return settle(state.join(rates, keys + ["team"], "left").withColumn(new, F.coalesce("new", F.lit(0.0))).drop("new"))

    for _ in range(sweeps):
        state = update("team", "opponent", "defense", "attack")
        state = update("opponent", "team", "attack", "defense")
        attack = state.select(*keys, "team", "attack")
        defense = state.select(*keys, F.col("team").alias("opponent"), "defense")
        home = cells.where("is_home = 1").join(attack, keys + ["team"]).join(defense, keys + ["opponent"]).groupBy(*keys).agg(
            F.ln(mass("wy") / F.sum(F.col("we") * F.exp(F.col("attack") + F.col("defense")))).alias("h"))
        bounded = F.when(F.col("target").isin(*RATES), F.greatest("h", F.lit(0.0))).otherwise(F.col("h"))
        state = settle(state.drop("home_advantage").join(home, keys, "left").withColumn(
            "home_advantage", F.coalesce(bounded, F.lit(0.0))).drop("h"))
    return state


def fit_rates(cells: DataFrame, sweeps: int = SWEEPS, limit: int = CELLS_IN_ONE_TASK) -> DataFrame:
    """Parameters of every fit, scaled to mean attack 1: keys, team, attack, defense, home_advantage.

    A fit whose cells fit in one task is solved there; a larger one by joins.
    """
    keys = [c for c in ("competition", "target", "xi", "fold") if c in cells.columns]
    cells = settle(cells)
    large = cells.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit).drop("n")
    if large.limit(1).count():
        large = settle(large)
        fitted = _fit_in_tasks(cells.join(large, keys, "left_anti"), keys, sweeps).unionByName(
            _fit_by_joins(cells.join(large, keys, "left_semi"), keys, sweeps).select(
                *keys, "team", "attack", "defense", "home_advantage"))
    else:
        fitted = _fit_in_tasks(cells, keys, sweeps)
    fitted = settle(fitted)
    shift = fitted.groupBy(*keys).agg((1 - F.avg("attack")).alias("shift"))
    return fitted.join(shift, keys).withColumn("attack", F.col("attack") + F.col("shift")).withColumn(
        "defense", F.col("defense") - F.col("shift")).drop("shift")


def team_strengths(rates: DataFrame, teams: DataFrame) -> DataFrame:
    """Parameters of every (competition, team); a team without a fit gets the league mean."""
    keys = [c for c in ("competition", "target", "xi", "fold") if c in rates.columns]
    league = rates.groupBy(*keys).agg(F.avg("attack").alias("mean_attack"), F.avg("defense").alias("mean_defense"),
                                      F.first("home_advantage").alias("home_advantage"))
    universe = teams.join(league, "competition")
    fitted = rates.select(*keys, "team", "attack", "defense")
    return universe.join(fitted, keys + ["team"], "left").select(
        *keys, "team", F.coalesce("attack", "mean_attack").alias("attack"), F.coalesce("defense", "mean_defense").alias("defense"),
        "home_advantage", F.when(F.col("attack").isNull(), "cold_start_league_average").otherwise("fitted").alias("parameter_source"))


def expected_counts(fixtures: DataFrame, rates: DataFrame) -> DataFrame:
    """Rates of both sides for every fixture and fit; an unknown team gets the league mean, flagged.

    ``fixtures`` holds competition (and fold when the fits have one), team_home and team_away.
    """
    keys = [c for c in ("competition", "fold") if c in rates.columns]
    fit = keys + [c for c in ("target", "xi") if c in rates.columns]
    league = settle(rates.groupBy(*fit).agg(F.avg("attack").alias("ma"), F.avg("defense").alias("md"),
                                            F.first("home_advantage").alias("home_advantage")))  # its true size decides the join
    rows = fixtures.join(league, keys)
    for side, s in (("home", "h"), ("away", "a")):
        rows = rows.join(rates.select(*fit, F.col("team").alias(f"team_{side}"), F.col("attack").alias(f"{s}a"),
                                      F.col("defense").alias(f"{s}d")), fit + [f"team_{side}"], "left")
    pick = lambda c, mean: F.coalesce(F.col(c), F.col(mean))
    return rows.withColumns({
        "expected_home": F.exp(F.col("home_advantage") + pick("ha", "ma") + pick("ad", "md")),
        "expected_away": F.exp(pick("aa", "ma") + pick("hd", "md")),
        "cold_start": F.col("ha").isNull() | F.col("aa").isNull(),
    }).drop("ha", "hd", "aa", "ad", "ma", "md", "home_advantage")


def low_score_correlation(matches: DataFrame, rates: DataFrame, xi: float = TIME_DECAY,
                          grid: tuple = tuple(round(-0.2 + 0.01 * k, 2) for k in range(41))) -> DataFrame:
    """Low-score dependence per competition (and fold): the grid value with the largest weighted likelihood gain.

    Only scores with at most one goal a side carry information; they are summed per pair first.
    """
    keys = [c for c in ("competition", "fold") if c in rates.columns]
    last = settle(matches.groupBy(*keys).agg(F.max("match_date").alias("base_date")))
    low = matches.where((F.col("goals_home") <= 1) & (F.col("goals_away") <= 1)).join(last, keys)
    cells = low.groupBy(*keys, "team_home", "team_away", "goals_home", "goals_away").agg(
        F.sum(decay_weight(xi)).alias("w"))
    rows = expected_counts(cells, rates).withColumn("rho", F.explode(F.array(*[F.lit(r) for r in grid])))
    gain = rows.groupBy(*keys, "rho").agg(F.sum(F.col("w") * F.ln(F.greatest(
        low_score_factor("goals_home", "goals_away", "expected_home", "expected_away", "rho"), F.lit(1e-10)))).alias("gain"))
    return gain.groupBy(*keys).agg(
        F.min_by("rho", F.struct(F.round(-F.col("gain"), 7), F.abs("rho"), "rho")).alias("rho"), F.max("gain").alias("gain"))


def low_score_factor(i, j, home, away, rho):
    i, j, home, away, rho = (F.col(c) for c in (i, j, home, away, rho))
    return (F.when((i == 0) & (j == 0), 1 - home * away * rho).when((i == 0) & (j == 1), 1 + home * rho)
            .when((i == 1) & (j == 0), 1 + away * rho).when((i == 1) & (j == 1), 1 - rho).otherwise(1.0))
