"""Probabilities read off the joint distribution of two Poisson counts.

Everything is a projection of one row: the two marginals are short arrays, sums over the grid
collapse to running products, and the low-score correction touches four cells only. No row is
multiplied into its grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.schema import MAX_GOALS


def pmf(rate: Column, size: int) -> Column:
    """Poisson probabilities 0 .. size-1 as an array."""
    log_factorial = F.array(*[F.lit(math.lgamma(k + 1.0)) for k in range(size)])
    return F.transform(log_factorial, lambda lf, k: F.exp(-rate + k * F.ln(rate) - lf))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _marginals(rows: DataFrame, size: int) -> DataFrame:
    rows = rows.withColumns({"hp": pmf(F.col("expected_home"), size), "ap": pmf(F.col("expected_away"), size)})
    if "rho" not in rows.columns:
        rows = rows.withColumn("rho", F.lit(0.0)).withColumn("_no_rho", F.lit(1))
    h, a = (lambda k: F.col("hp")[k]), (lambda k: F.col("ap")[k])
    lam, mu, rho = F.col("expected_home"), F.col("expected_away"), F.col("rho")
    return rows.withColumns({
        "d00": -h(0) * a(0) * lam * mu * rho, "d01": h(0) * a(1) * lam * rho,
        "d10": h(1) * a(0) * mu * rho, "d11": -h(1) * a(1) * rho,
        "mass": total(F.col("hp")) * total(F.col("ap")),
    }).withColumn("mass", F.col("mass") + F.col("d00") + F.col("d01") + F.col("d10") + F.col("d11"))


def _done(rows: DataFrame) -> DataFrame:
    extra = ["hp", "ap", "d00", "d01", "d10", "d11", "mass", "_run", "_no_rho"] + (["rho"] if "_no_rho" in rows.columns else [])
    return rows.drop(*extra)


def outcome_probabilities(rows: DataFrame, size: int = MAX_GOALS, names: tuple = ("prob_home", "prob_draw", "prob_away")) -> DataFrame:
    """P(home > away), P(equal), P(home < away) from expected_home, expected_away and, if present, rho."""
    rows = _marginals(rows, size)
    pairs = F.arrays_zip("hp", "ap")
    start = F.struct(F.lit(0.0).alias("home"), F.lit(0.0).alias("draw"), F.lit(0.0).alias("below"))
    run = F.aggregate(pairs, start, lambda s, x: F.struct(
        (s["home"] + x["hp"] * s["below"]).alias("home"), (s["draw"] + x["hp"] * x["ap"]).alias("draw"),
        (s["below"] + x["ap"]).alias("below")))
    rows = rows.withColumn("_run", run)
    home = (F.col("_run.home") + F.col("d10")) / F.col("mass")
    draw = (F.col("_run.draw") + F.col("d00") + F.col("d11")) / F.col("mass")
    return _done(rows.withColumns({names[0]: home, names[1]: draw, names[2]: 1 - home - draw}))


def both_score(rows: DataFrame, size: int = MAX_GOALS, name: str = "btts") -> DataFrame:
    rows = _marginals(rows, size)
    some = lambda c: total(F.col(c)) - F.col(c)[0]
    return _done(rows.withColumn(name, (some("hp") * some("ap") + F.col("d11")) / F.col("mass")))


def over_under(rows: DataFrame, line: float, size: int = MAX_GOALS, prefix: str = "") -> DataFrame:
    """P(total above, below, exactly at the line); a push exists only on a whole line. No low-score term."""
    rows = _marginals(rows.drop("rho"), size)
    below = math.ceil(line) - 1

    def at_most(m: int) -> Column:
        if m < 0:
            return F.lit(0.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(min(m, size - 1))), F.lit(0.0), lambda s, i: s + F.element_at("hp", i + 1) * total(
            F.slice("ap", F.lit(1), F.lit(m) - i + 1)))

    under = at_most(below) / F.col("mass")
    push = (at_most(int(line)) - at_most(below)) / F.col("mass") if line == int(line) else F.lit(0.0)
    rows = rows.withColumns({f"{prefix}under": under, f"{prefix}push": push})
    return _done(rows.withColumn(f"{prefix}over", 1 - F.col(f"{prefix}under") - F.col(f"{prefix}push")))


def top_scores(rows: DataFrame, count: int = 3, size: int = MAX_GOALS) -> DataFrame:
    """The likeliest exact scores of each row, rows multiplied by ``count`` only."""
    rows = _marginals(rows, size)
    at = lambda i, j: F.when(i > 1, 0.0).when(j > 1, 0.0).when((i == 0) & (j == 0), F.col("d00")).when(
        i == 0, F.col("d01")).when(j == 0, F.col("d10")).otherwise(F.col("d11"))
    each = F.sequence(F.lit(0), F.lit(size - 1))
    cells = F.flatten(F.transform(each, lambda i: F.transform(each, lambda j: F.struct(
        (-F.round((F.element_at("hp", i + 1) * F.element_at("ap", j + 1) + at(i, j)) / F.col("mass"), 9)).alias("p"),
        i.cast("long").alias("i"), j.cast("long").alias("j")))))
    best = F.slice(F.array_sort(cells), 1, count)
    keep = [c for c in _done(rows).columns]
    return rows.select(*keep, F.posexplode(best).alias("pos", "cell")).select(
        *keep, (F.col("pos") + 1).cast("long").alias("score_rank"), F.col("cell.i").alias("score_home"),
        F.col("cell.j").alias("score_away"), (-F.col("cell.p")).alias("probability"))
