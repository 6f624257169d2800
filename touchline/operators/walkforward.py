"""Season walk-forward of count models: every fold, decay and variant in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.probability import row_scores
from touchline.operators import counts, grids
from touchline.operators import settled_rates as sr
from touchline.operators.folds import season_membership
from touchline.operators.metrics import draw_report, model_metrics
from touchline.schema import TIME_DECAY
from touchline.session import settle

# Goal rate of each variant as a chain of fitted rates.
VARIANTS = {"poisson": ("goals",), "shot_volume": ("shots", "goal_per_shot"),
            "shots_on_target": ("shots", "sot_per_shot", "goal_per_sot")}
LOW_SCORE = "dixon_coles"
PAIR = ["competition", "team_home", "team_away"]


def chained_expectations(expected: DataFrame, keys: list, variants: dict) -> DataFrame:
    """Multiply the rates of each variant's chain; one row per key and variant."""
    targets = sorted({t for chain in variants.values() for t in chain})
    one = lambda side, t: F.max(F.when(F.col("target") == t, F.col(f"expected_{side}"))).alias(f"{side}_{t}")
    wide = expected.groupBy(*keys).agg(*[one(s, t) for s in ("home", "away") for t in targets],
                                       F.max("cold_start").alias("cold_start"))

    def product(side, chain):
        out = F.col(f"{side}_{chain[0]}")
        for t in chain[1:]:
            out = out * F.col(f"{side}_{t}")
        return out

    rows = [F.struct(F.lit(name).alias("model"), product("home", chain).alias("expected_home"),
                     product("away", chain).alias("expected_away")) for name, chain in variants.items()]
    return wide.select(*keys, "cold_start", F.inline(F.array(*rows)))


def fold_rates(matches: DataFrame, roles: DataFrame, targets: tuple, decays: tuple = (TIME_DECAY,)) -> DataFrame:
    return settle(counts.fit_rates(counts.fit_cells(counts.day_cells(matches, targets), roles, decays)))


def expected_goal_inputs(matches: DataFrame, membership: DataFrame) -> DataFrame:
    """Out-of-fold expected goals of every validation match of ``membership`` (folds of seasons or days): four inputs.

    Two come from the goal model, two from its joint fit with the low-score dependence, whose team effects differ;
    both are fitted until they settle on the days before the fold's validation days only.
    """
    on = counts.membership_key(membership)
    cells = settle(counts.fit_cells(counts.day_cells(matches), membership))
    asked = settle(matches.join(membership.where("part = 'validation'").select(on, "fold"), on).select("match_id", "fold", *PAIR))
    pairs = asked.select("fold", *PAIR).distinct()
    out = asked
    for name, low in (("goals", None), ("joint", sr.low_score_sums(matches, membership))):
        rates = settle(sr.settled_rates(cells, low).drop("rho"))
        out = out.join(counts.expected_counts(pairs, rates).select("fold", *PAIR, *[
            F.col(f"expected_{s}").alias(f"{name}_expected_{s}") for s in ("home", "away")]), ["fold", *PAIR])
    return out.drop(*PAIR)


def last_train_seasons(roles: DataFrame) -> DataFrame:
    """The newest season that each fold really trains on; one row per fold."""
    return roles.where("part = 'train'").groupBy("fold").agg(F.max("season").alias("last_train_season"))


def walk_forward(matches: DataFrame, holdout: str, variants: dict = VARIANTS, decays: tuple = (TIME_DECAY,),
                 low_score: bool = False) -> DataFrame:
    """Validation-season probabilities of each (fold, decay, variant), trained on earlier seasons only.

    ``low_score`` adds a model ``dixon_coles``: the rates of ``poisson`` with the low-score dependence that the
    fold's own training matches make likeliest. It needs the variant ``poisson`` and the default decay.
    """
    if low_score and ("poisson" not in variants or tuple(decays) != (TIME_DECAY,)):
        raise ValueError("the low-score model needs the variant 'poisson' and the default decay")
    roles = settle(season_membership(matches, holdout))
    rates = fold_rates(matches, roles, tuple(sorted({t for c in variants.values() for t in c})), decays)
    validation = matches.join(roles.where("part = 'validation'").select("season", "fold"), "season").select(
        "fold", "season", "match_id", "match_date", *PAIR, "result")
    pairs = counts.expected_counts(validation.select("fold", *PAIR).distinct(), rates)
    keys = ["fold", "xi", *PAIR]
    rows = chained_expectations(pairs, keys, variants)
    if low_score:
        train = matches.join(roles.where("part = 'train'").select("season", "fold"), "season")
        rho = settle(counts.low_score_correlation(train, rates.where("target = 'goals'")).select("competition", "fold", "rho"))
        corrected = rows.where("model = 'poisson'").withColumn("model", F.lit(LOW_SCORE)).join(rho, ["competition", "fold"])
        rows = rows.withColumn("rho", F.lit(0.0)).unionByName(corrected)
    forecasts = grids.outcome_probabilities(rows).drop("rho")
    return validation.join(forecasts, ["fold", *PAIR])


def fold_scores(predictions: DataFrame, keys: list) -> DataFrame:
    """Metrics of each key (model and fold, and decay) plus how draws and unseen teams fared."""
    extra = predictions.groupBy(*keys).agg(F.sum(F.col("cold_start").cast("long")).alias("cold_start_matches"))
    return model_metrics(predictions, keys).join(draw_report(predictions, keys).select(
        *keys, F.col("draw_recall_or_zero").alias("draw_recall"), "draw_predictions"), keys).join(extra, keys)


def home_advantage_by_subset(matches: DataFrame, rates: DataFrame, subset, xi: float = TIME_DECAY, keys: list | None = None) -> DataFrame:
    """Home advantage of each subset with team effects frozen, in closed form: one sum per subset."""
    keys = keys or ["competition"]
    return profile_sums(matches, rates, subset, xi, keys).groupBy(*keys, "subset").agg(
        F.count("*").alias("matches"), F.ln(F.sum("scored") / F.sum("expected")).alias("home_advantage"))


def profile_sums(matches: DataFrame, rates: DataFrame, subset, xi: float = TIME_DECAY, keys: list | None = None) -> DataFrame:
    """Per match the weighted home goals and the weighted home rate without home advantage."""
    keys = keys or ["competition"]
    last = settle(matches.groupBy(*keys).agg(F.max("match_date").alias("base_date")))
    frozen = rates.withColumn("home_advantage", F.lit(0.0))
    rows = counts.expected_counts(matches.join(last, keys).withColumn("subset", subset), frozen)
    w = counts.decay_weight(xi)
    return rows.select(*keys, "match_id", "subset", (w * F.col("goals_home")).alias("scored"),
                       (w * F.col("expected_home")).alias("expected"))


def seasonal_home_advantage(matches: DataFrame, holdout: str, empty_seasons: tuple) -> DataFrame:
    """Per fold: global home advantage against one profiled on normal seasons (a), and for matches
    without spectators the one profiled on such seasons (b). Folds whose training has none are skipped
    with a reason.
    """
    roles = settle(season_membership(matches, holdout))
    rates = fold_rates(matches, roles, ("goals",))
    train = matches.join(roles.where("part = 'train'").select("season", "fold"), "season")
    empty = F.col("season").isin(*empty_seasons)
    keys = ["competition", "fold"]
    profiled = settle(home_advantage_by_subset(train, rates, F.when(empty, "empty").otherwise("normal"), keys=keys).groupBy(*keys).agg(
        F.max(F.when(F.col("subset") == "normal", F.col("home_advantage"))).alias("hfa_normal"),
        F.max(F.when(F.col("subset") == "empty", F.col("home_advantage"))).alias("hfa_empty")))
    validation = matches.join(roles.where("part = 'validation'").select("season", "fold"), "season").withColumn("no_fans", empty)
    league = settle(rates.groupBy(*keys).agg(F.first("home_advantage").alias("hfa_global")))
    rows = counts.expected_counts(validation, rates).join(league, keys).join(profiled, keys)
    shifts = [F.struct(F.lit(n).alias("model"), h.alias("hfa")) for n, h in (
        ("baseline", F.col("hfa_global")), ("variant_a", F.col("hfa_normal")),
        ("variant_b", F.when(F.col("no_fans"), F.col("hfa_empty")).otherwise(F.col("hfa_normal"))))]
    rows = rows.select("*", F.inline(F.array(*shifts))).withColumn(
        "expected_home", F.col("expected_home") * F.exp(F.coalesce("hfa", "hfa_global") - F.col("hfa_global")))
    scored = row_scores(grids.outcome_probabilities(rows))
    of = lambda m, c: F.avg(F.when(F.col("model") == m, F.col(c)))
    usable = F.min(F.col("hfa_empty").isNotNull())
    value = lambda c: F.when(usable, c)
    return scored.groupBy("fold", F.col("season").alias("validation_season")).agg(
        F.countDistinct("match_id").alias("n_matches"), F.max("no_fans").alias("validation_is_no_fans"), usable.alias("applicable"),
        F.when(~usable, "no season without spectators in training").alias("skip_reason"),
        *[value(of(m, c)).alias(f"{m}_{c}") for m in ("baseline", "variant_a", "variant_b") for c in ("log_loss", "rps")])
