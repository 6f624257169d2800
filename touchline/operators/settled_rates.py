"""Count models fitted until they settle, alone or jointly with the low-score dependence.

A sweep solves the score equations of attack, defense and home advantage in turn, so the change it makes is the
logarithm of observed over expected: the gap of a fit is the largest change of its last sweep. Attack is kept at mean 0,
as only its sum with defense matters; where credits for teams without events make the sums of both sides differ, the
equations cannot all hold at once, and the fit settles where plain sweeps lead. Two sweeps give a step that is lengthened
by the ratio of their changes; a fit is done when its gap is within the tolerance, and only open fits are swept again.
The rule is the same where a fit is solved inside a task and where it is solved by joins.

With low-score sums a fit also has a dependence ``rho``. Its terms enter the score equations as corrections to the
successes of the few lowest scores, taken at the state before the sweep, and ``rho`` takes one Newton step a sweep inside
the range where every pair of the fit keeps positive probabilities. A settled fit solves all equations at once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.counts import CELL, CELLS_IN_ONE_TASK, LEAST_MASS, RATES, decay_weight, membership_key
from touchline.schema import TIME_DECAY
from touchline.session import settle

TOLERANCE = 1e-9
MAX_ROUNDS = 200  # of two sweeps; a fit still open then is returned with settled = false
LONGEST_STEP = 1000.0
WORSE = 2.0  # a gap that grew by more is followed by a plain step
LEAST_SHARE = 0.1  # of its successes that a team keeps under the low-score corrections
INSIDE = 0.999  # of the way from 0 to a border of rho
LOW = ("w00", "w01", "w10", "w11")
FITTED = ("attack", "defense", "home_advantage", "rho")


def low_score_sums(matches: DataFrame, membership: DataFrame | None = None, decays: tuple = (TIME_DECAY,)) -> DataFrame:
    """Weights of the scores 0-0, 0-1, 1-0 and 1-1 of every pair, home side first, per fit of the goal model.

    Pairs without such a score stay, with zeros: they bound the range of ``rho``.
    """
    played = matches.where(F.col("goals_home").isNotNull() & F.col("goals_away").isNotNull())
    scope = ["competition"]
    if membership is not None:
        on = membership_key(membership)
        played = played.join(membership.where("part = 'train'").select(on, "fold"), on)
        scope.append("fold")
    last = settle(played.groupBy(*scope).agg(F.max("match_date").alias("base_date")))
    rows = played.join(last, scope).withColumn("xi", F.explode(F.array(*[F.lit(float(x)) for x in decays])))
    of = lambda i, j: F.coalesce(F.sum(F.when((F.col("goals_home") == i) & (F.col("goals_away") == j), decay_weight("xi"))), F.lit(0.0))
    return rows.groupBy(*scope, "xi", "team_home", "team_away").agg(
        *[of(int(c[1]), int(c[2])).alias(c) for c in LOW]).withColumn("target", F.lit("goals"))


class _Fit:
    """One fit inside a task: its cells and low-score sums as arrays, and one sweep over them."""

    def __init__(self, cells: pd.DataFrame, low: pd.DataFrame | None):
        self.names, codes = np.unique(np.concatenate([cells["team"], cells["opponent"]]).astype(str), return_inverse=True)
        self.n = len(self.names)
        self.team, self.opponent = codes[: len(cells)], codes[len(cells):]
        self.we, self.home = cells["we"].to_numpy(), cells["is_home"].to_numpy(dtype=float)
        wy = cells["wy"].to_numpy()
        self.won = np.maximum(self._by(self.team, wy), LEAST_MASS)
        self.lost = np.maximum(self._by(self.opponent, wy), LEAST_MASS)
        self.at_home = max((wy * self.home).sum(), LEAST_MASS)
        self.floored = cells["target"].iloc[0] in RATES
        self.low = None
        if low is not None and len(low):
            self.low = low[list(LOW)].to_numpy().T
            self.host, self.guest = (np.searchsorted(self.names, low[c].astype(str)) for c in ("team_home", "team_away"))

    def _by(self, index, values):
        return np.bincount(index, values, self.n)

    def _pair_rates(self, attack, defense, advantage):
        return np.exp(attack[self.host] + defense[self.guest] + advantage), np.exp(attack[self.guest] + defense[self.host])

    def sweep(self, x):
        attack, defense, advantage, rho = x[: self.n], x[self.n: -2], x[-2], x[-1]
        won, lost, at_home = self.won, self.lost, self.at_home
        if self.low is not None:
            a, b = self._pair_rates(attack, defense, advantage)
            both = -self.low[0] * a * b * rho / (1 - a * b * rho)
            host, guest = both + self.low[1] * a * rho / (1 + a * rho), both + self.low[2] * b * rho / (1 + b * rho)
            corrected = lambda base, change: np.maximum(base + change, LEAST_SHARE * base)
            won = corrected(won, self._by(self.host, host) + self._by(self.guest, guest))
            lost = corrected(lost, self._by(self.guest, host) + self._by(self.host, guest))
            at_home = corrected(at_home, host.sum())
        finite = lambda v: np.where(np.isfinite(v), v, 0.0)
        attack = finite(np.log(won / self._by(self.team, self.we * np.exp(defense[self.opponent] + advantage * self.home))))
        defense = finite(np.log(lost / self._by(self.opponent, self.we * np.exp(attack[self.team] + advantage * self.home))))
        exposure = (self.we * self.home * np.exp(attack[self.team] + defense[self.opponent])).sum()
        advantage = np.log(at_home / exposure) if exposure > 0 else 0.0
        if self.floored:
            advantage = max(advantage, 0.0)
        if self.low is not None:
            a, b = self._pair_rates(attack, defense, advantage)
            least, most = -INSIDE / max(a.max(), b.max()), INSIDE * min(1 / (a * b).max(), 1.0)
            rho = min(max(rho, least), most)
            slopes = np.stack([-a * b, a, b, np.full_like(a, -1.0)])
            ratio = slopes / (1 + slopes * rho)
            bend = (self.low * ratio ** 2).sum()
            new = rho + (self.low * ratio).sum() / bend if bend > 0 else rho
            rho = (rho + least) / 2 if new < least else (rho + most) / 2 if new > most else new
        attack, defense = attack - attack.mean(), defense + attack.mean()
        return np.concatenate([attack, defense, [advantage, rho]])

    def settled(self, rounds: int, tolerance: float):
        x, before, gap, sweeps = np.zeros(2 * self.n + 2), np.inf, np.inf, 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(rounds):
                one = self.sweep(x)
                two = self.sweep(one)
                sweeps += 2
                gap = np.abs(two - one).max()
                if gap <= tolerance:
                    return two, gap, sweeps
                change = one - x
                bend = two - one - change
                length = np.sqrt((bend ** 2).sum())
                step = min(max(np.sqrt((change ** 2).sum()) / length, 1.0), LONGEST_STEP) if length > 0 and gap <= WORSE * before else 1.0
                x, before = x + 2 * step * change + step ** 2 * bend, gap
        return two, gap, sweeps


def _in_tasks(cells: DataFrame, low: DataFrame | None, keys: list, rounds: int, tolerance: float) -> DataFrame:
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + (
        ", team string, attack double, defense double, home_advantage double, rho double, gap double, sweeps int")

    def solve(frame: pd.DataFrame, sums: pd.DataFrame | None) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})
        fit = _Fit(frame, sums)
        x, gap, sweeps = fit.settled(rounds, tolerance)
        out = pd.DataFrame({"team": fit.names, "attack": x[: fit.n], "defense": x[fit.n: -2], "home_advantage": x[-2],
                            "rho": x[-1], "gap": gap, "sweeps": sweeps})
        for k in reversed(keys):
            out.insert(0, k, frame[k].iloc[0])
        return out

    # Few bytes, much work per fit: adaptive execution would put all fits into one task.
    tasks = max(1, min(cells.select(*keys).distinct().count(), int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cells = cells.repartition(tasks, *keys)
    if low is None:
        return cells.groupBy(*keys).applyInPandas(lambda frame: solve(frame, None), schema)
    low = low.repartition(tasks, *keys)
    return cells.groupBy(*keys).cogroup(low.groupBy(*keys)).applyInPandas(solve, schema)


def _start(cells: DataFrame, keys: list) -> DataFrame:
    """Successes of every team and fit, and all parameters at 0."""
    sides = cells.select(*keys, F.inline(F.array(
        F.struct(F.col("team").alias("team"), F.col("wy").alias("won"), F.lit(0.0).alias("lost"), (F.col("wy") * F.col("is_home")).alias("h")),
        F.struct(F.col("opponent").alias("team"), F.lit(0.0).alias("won"), F.col("wy").alias("lost"), F.lit(0.0).alias("h")))))
    teams = settle(sides.groupBy(*keys, "team").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"), F.sum("h").alias("h")))
    least = lambda c: F.greatest(F.col(c), F.lit(LEAST_MASS))
    fits = teams.groupBy(*keys).agg(F.greatest(F.sum("h"), F.lit(LEAST_MASS)).alias("at_home"))
    return settle(teams.join(fits, keys).select(*keys, "team", least("won").alias("won"), least("lost").alias("lost"), "at_home",
                                                *[F.lit(0.0).alias(c) for c in FITTED]))


def _pairs(low: DataFrame, state: DataFrame, keys: list) -> DataFrame:
    """Low-score sums with both rates, ``a`` of the home side and ``b`` of the other."""
    of = lambda s, *more: state.select(*keys, F.col("team").alias(f"team_{s}"), F.col("attack").alias(f"{s}_a"), F.col("defense").alias(f"{s}_d"), *more)
    return low.join(of("home", "home_advantage", "rho"), keys + ["team_home"]).join(of("away"), keys + ["team_away"]).withColumns({
        "a": F.exp(F.col("home_a") + F.col("away_d") + F.col("home_advantage")), "b": F.exp(F.col("away_a") + F.col("home_d"))})


def _corrected(low: DataFrame, state: DataFrame, keys: list) -> DataFrame:
    """``state`` with the successes that the low-score terms leave, as won_now, lost_now and at_home_now."""
    a, b, r = F.col("a"), F.col("b"), F.col("rho")
    both = -F.col("w00") * a * b * r / (1 - a * b * r)
    rows = _pairs(low, state, keys).withColumns({"host": both + F.col("w01") * a * r / (1 + a * r), "guest": both + F.col("w10") * b * r / (1 + b * r)})
    side = lambda team, mine, other, home: F.struct(F.col(team).alias("team"), F.col(mine).alias("dw"), F.col(other).alias("dl"), home.alias("dh"))
    teams = settle(rows.select(*keys, F.inline(F.array(side("team_home", "host", "guest", F.col("host")), side("team_away", "guest", "host", F.lit(0.0)))))
                   .groupBy(*keys, "team").agg(F.sum("dw").alias("dw"), F.sum("dl").alias("dl"), F.sum("dh").alias("dh")))
    fits = teams.groupBy(*keys).agg(F.sum("dh").alias("fit_dh"))
    now = lambda c, d: F.greatest(F.col(c) + F.coalesce(F.col(d), F.lit(0.0)), F.col(c) * LEAST_SHARE).alias(f"{c}_now")
    return state.join(teams, keys + ["team"], "left").join(fits, keys, "left").select(
        *state.columns, now("won", "dw"), now("lost", "dl"), now("at_home", "fit_dh"))


def _next_rho(low: DataFrame, state: DataFrame, keys: list) -> DataFrame:
    a, b, r = F.col("a"), F.col("b"), F.col("rho")
    rows = settle(_pairs(low, state, keys).select(*keys, *LOW, "a", "b", "rho"))
    edges = rows.groupBy(*keys).agg((-INSIDE / F.greatest(F.max(a), F.max(b))).alias("least"),
                                    (INSIDE * F.least(1 / F.max(a * b), F.lit(1.0))).alias("most"))
    kept = rows.join(settle(edges), keys).withColumn("rho", F.least(F.greatest(r, "least"), "most"))
    slopes = dict(zip(LOW, (-a * b, a, b, F.lit(-1.0)), strict=True))
    total = lambda power: F.sum(sum(F.col(c) * F.pow(s / (1 + s * r), F.lit(power)) for c, s in slopes.items()))
    steps = kept.groupBy(*keys, "least", "most", "rho").agg(total(1.0).alias("slope"), total(2.0).alias("bend"))
    new = F.when(F.col("bend") > 0, r + F.col("slope") / F.col("bend")).otherwise(r)
    return steps.select(*keys, F.when(new < F.col("least"), (r + F.col("least")) / 2).when(
        new > F.col("most"), (r + F.col("most")) / 2).otherwise(new).alias("next_rho"))


def _sweep(cells: DataFrame, low: DataFrame | None, state: DataFrame, keys: list) -> DataFrame:
    """One sweep over all fits of ``state``: the same updates as inside a task, as joins and sums."""
    columns = state.columns
    state = settle(_corrected(low, state, keys)) if low is not None else state.withColumns({f"{c}_now": F.col(c) for c in ("won", "lost", "at_home")})

    def update(of: str, other: str, known: str, new: str, mass: str):
        lookup = state.select(*keys, F.col("team").alias(other), F.col(known).alias("v"), "home_advantage")
        expected = cells.join(lookup, keys + [other]).groupBy(*keys, F.col(of).alias("team")).agg(
            F.sum(F.col("we") * F.exp(F.col("v") + F.col("home_advantage") * F.col("is_home"))).alias("expected"))
        return settle(state.join(expected, keys + ["team"], "left").withColumn(
            new, F.coalesce(F.ln(F.col(mass) / F.col("expected")), F.lit(0.0))).drop("expected"))

    state = update("team", "opponent", "defense", "attack", "won_now")
    state = update("opponent", "team", "attack", "defense", "lost_now")
    attack = state.select(*keys, "team", "attack")
    defense = state.select(*keys, F.col("team").alias("opponent"), "defense")
    home = cells.where("is_home = 1").join(attack, keys + ["team"]).join(defense, keys + ["opponent"]).groupBy(*keys).agg(
        F.sum(F.col("we") * F.exp(F.col("attack") + F.col("defense"))).alias("exposure"))
    level = state.groupBy(*keys).agg(F.avg("attack").alias("level"))
    found = F.ln(F.col("at_home_now") / F.col("exposure"))
    bounded = F.when(F.col("target").isin(*RATES), F.greatest(found, F.lit(0.0))).otherwise(found)
    state = settle(state.join(home, keys, "left").join(level, keys).withColumns({
        "home_advantage": F.coalesce(bounded, F.lit(0.0)), "attack": F.col("attack") - F.col("level"),
        "defense": F.col("defense") + F.col("level")}).select(*columns))
    if low is not None:
        state = settle(state.join(_next_rho(low, state, keys), keys, "left").withColumn("rho", F.coalesce("next_rho", "rho")).select(*columns))
    return state


def _by_joins(cells: DataFrame, low: DataFrame | None, keys: list, rounds: int, tolerance: float) -> DataFrame:
    state = _start(cells, keys).withColumn("before", F.lit(float("inf")))
    done, out = [], [*keys, "team", *FITTED, "gap", "sweeps"]
    fixed = [*keys, "team", "won", "lost", "at_home", "before"]
    for n in range(1, rounds + 1):
        one = _sweep(cells, low, state, keys)
        two = _sweep(cells, low, one, keys)
        named = lambda df, p: df.select(*keys, "team", *[F.col(c).alias(f"{p}_{c}") for c in FITTED])
        rows = state.join(named(one, "one"), keys + ["team"]).join(named(two, "two"), keys + ["team"])
        change = {c: F.col(f"one_{c}") - F.col(c) for c in FITTED}
        bend = {c: F.col(f"two_{c}") - F.col(f"one_{c}") - change[c] for c in FITTED}
        squares = lambda of: F.sum(of["attack"] ** 2 + of["defense"] ** 2) + F.max(of["home_advantage"] ** 2 + of["rho"] ** 2)
        fits = settle(rows.groupBy(*keys).agg(
            F.max(F.greatest(*[F.abs(F.col(f"two_{c}") - F.col(f"one_{c}")) for c in FITTED])).alias("gap"),
            F.sqrt(squares(change)).alias("moved"), F.sqrt(squares(bend)).alias("bent")))
        rows = settle(rows.join(fits, keys))
        closed = F.lit(True) if n == rounds else F.col("gap") <= tolerance
        done.append(rows.where(closed).select(*keys, "team", *[F.col(f"two_{c}").alias(c) for c in FITTED], "gap", F.lit(2 * n).alias("sweeps")))
        if n == rounds or not fits.where(~closed).limit(1).count():
            break
        step = F.when((F.col("bent") > 0) & (F.col("gap") <= WORSE * F.col("before")), F.least(
            F.greatest(F.col("moved") / F.col("bent"), F.lit(1.0)), F.lit(LONGEST_STEP))).otherwise(F.lit(1.0))
        state = settle(rows.where(~closed).withColumn("step", step).select(
            *fixed[:-1], F.col("gap").alias("before"), *[(F.col(c) + 2 * F.col("step") * change[c] + F.col("step") ** 2 * bend[c]).alias(c) for c in FITTED]))
        if fits.where(closed).limit(1).count():
            cells = settle(cells.join(fits.where(~closed).select(*keys), keys, "left_semi"))
    return reduce(DataFrame.unionByName, done).select(*out)


def settled_rates(cells: DataFrame, low: DataFrame | None = None, rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE,
                  limit: int = CELLS_IN_ONE_TASK) -> DataFrame:
    """Parameters of every fit, scaled to mean attack 1: keys, team, attack, defense, home_advantage, rho, gap, sweeps, settled.

    ``cells`` come from ``fit_cells``; with ``low`` from ``low_score_sums`` the goal models are fitted jointly with ``rho``,
    which is 0 elsewhere. A team without successes or concessions is credited with 0.01, one without exposure has
    effect 0. A fit with at most ``limit`` cells is solved inside a task, a larger one by joins, both until they settle.
    """
    keys = [c for c in ("competition", "target", "xi", "fold") if c in cells.columns]
    cells = settle(cells.select(*keys, *CELL, "wy", "we"))
    low = settle(low.select(*keys, "team_home", "team_away", *LOW)) if low is not None else None
    large = settle(cells.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit).drop("n"))
    if large.limit(1).count():
        part = lambda df, how: df.join(large, keys, how) if df is not None else None
        fitted = _in_tasks(part(cells, "left_anti"), part(low, "left_anti"), keys, rounds, tolerance).unionByName(
            _by_joins(settle(part(cells, "left_semi")), settle(part(low, "left_semi")) if low is not None else None, keys, rounds, tolerance))
    else:
        fitted = _in_tasks(cells, low, keys, rounds, tolerance)
    fitted = settle(fitted)
    shift = fitted.groupBy(*keys).agg((1 - F.avg("attack")).alias("shift"))
    return fitted.join(shift, keys).withColumns({
        "attack": F.col("attack") + F.col("shift"), "defense": F.col("defense") - F.col("shift"),
        "settled": F.col("gap") <= tolerance}).drop("shift")


def fit_report(rates: DataFrame) -> DataFrame:
    """One row per fit: teams, sweeps, largest change of the last sweep, and whether it settled."""
    keys = [c for c in ("competition", "target", "xi", "fold") if c in rates.columns]
    return rates.groupBy(*keys).agg(F.count("*").alias("n_teams"), F.max("sweeps").alias("sweeps"), F.max("gap").alias("gap"),
                                    F.max("rho").alias("rho"), F.min("settled").alias("settled"))
