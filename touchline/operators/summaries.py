"""Descriptive aggregates, hypothesis tests, promotion, referees and players."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import tails
from touchline.operators.teams import team_view
from touchline.schema import CLASSES, REFEREE_MIN_MATCHES, REFEREE_OTHER, REFEREE_PRIOR
from touchline.session import settle


def result_distribution(matches: DataFrame) -> DataFrame:
    counts = matches.groupBy("result").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def season_crosstab(matches: DataFrame) -> DataFrame:
    table = matches.groupBy("season").pivot("result", list(CLASSES)).agg(F.count("match_id")).na.fill(0)
    total = F.col("H") + F.col("D") + F.col("A")
    return table.select("season", *[F.col(c).alias(f"n_{c}") for c in CLASSES],
                        *[(100 * F.col(c) / total).alias(f"percent_{c}") for c in CLASSES])


def season_goal_gap(matches: DataFrame) -> DataFrame:
    return matches.groupBy("season").agg(F.avg(F.col("goals_home") - F.col("goals_away")).alias("mean_goal_gap"))


def home_advantage_tests(matches: DataFrame) -> DataFrame:
    """Win-rate gap with its binomial z, goal gap with its one-sample t; both from one pass of sums."""
    gap = F.col("goals_home") - F.col("goals_away")
    sums = matches.agg(
        F.count("*").alias("n"), F.sum((F.col("result") == "H").cast("long")).alias("home_wins"),
        F.sum((F.col("result") == "A").cast("long")).alias("away_wins"),
        F.sum(gap.cast("long")).alias("s"), F.sum((gap * gap).cast("long")).alias("ss"))
    n, h, a = F.col("n"), F.col("home_wins"), F.col("away_wins")
    mean = F.col("s") / n
    spread = F.sqrt((F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1))
    return sums.select(
        "n", "home_wins", "away_wins", (100 * (h - a) / n).alias("win_rate_gap"), mean.alias("mean_goal_gap"),
        (mean / (spread / F.sqrt(n.cast("double")))).alias("t_goals"),
        ((h - (h + a) / 2) / F.sqrt((h + a) / 4)).alias("z_wins"))


def tail_probabilities(matches: DataFrame) -> DataFrame:
    """One-sided p-values of the home advantage (exact binomial over decided matches, t over goal gaps) and of the independence
    of season and result."""
    tests, table = (part.withColumn("of", F.lit("all matches")) for part in (home_advantage_tests(matches), season_result_chi_square(matches)))
    wins, decided = F.col("home_wins"), F.col("home_wins") + F.col("away_wins")
    return tests.join(table, "of").select(  # one row each
        tails.binomial_at_least(wins, decided).alias("p_wins"), tails.t_above(F.col("t_goals"), F.col("n") - 1).alias("p_goals"),
        tails.chi_square_above(F.col("chi_square"), F.col("degrees")).alias("p_seasons"))


def season_result_chi_square(matches: DataFrame) -> DataFrame:
    """Chi-square of independence between season and result, from the table of counts."""
    cells = matches.groupBy("season").agg(*[F.sum((F.col("result") == c).cast("long")).alias(c) for c in CLASSES])
    long = cells.select("season", F.inline(F.array(*[F.struct(F.lit(c).alias("result"), F.col(c).alias("n")) for c in CLASSES])))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    expected = F.sum("n").over(Window.partitionBy("season")) * F.sum("n").over(Window.partitionBy("result")) / total
    seen = long.withColumn("e", expected)
    return seen.agg(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("chi_square"),
                    ((F.countDistinct("season") - 1) * (F.countDistinct("result") - 1)).alias("degrees"))


def season_completeness(matches: DataFrame, expected_matches: int = 380, expected_teams: int = 20) -> DataFrame:
    """Matches and teams of each season against what a full season has."""
    by_team = team_view(matches).groupBy("competition", "season", "team").agg(
        F.sum((F.col("venue") == "home").cast("long")).alias("n"))
    return by_team.groupBy("competition", "season").agg(
        F.sum("n").alias("matches"), F.count("*").alias("teams")).withColumns({
            "matches_missing": F.lit(expected_matches).cast("long") - F.col("matches"),
            "teams_missing": F.lit(expected_teams).cast("long") - F.col("teams")})


def volume_and_conversion(matches: DataFrame) -> DataFrame:
    """Home-to-away ratios of shots, shots on target, and goals per shot: where home advantage sits."""
    names = ("goals", "shots", "shots_on_target")
    sums = matches.agg(*[F.sum(F.col(f"{c}_{s}").cast("long")).alias(f"{c}_{s}") for c in names for s in ("home", "away")])
    rate = lambda s, by: F.col(f"goals_{s}") / F.col(f"{by}_{s}")
    return sums.select(
        *[(F.col(f"{c}_home") / F.col(f"{c}_away")).alias(f"{c}_ratio") for c in names],
        *[(rate("home", by) / rate("away", by)).alias(f"goals_per_{by}_ratio") for by in names[1:]])


def promoted_teams(matches: DataFrame) -> DataFrame:
    """Teams of a season that were absent from the season before; none in the first season."""
    present = team_view(matches).select("competition", "season", "team").distinct()
    seasons = present.select("competition", "season").distinct().withColumn(
        "previous", F.lag("season").over(Window.partitionBy("competition").orderBy("season"))).where(
        F.col("previous").isNotNull())
    before = present.withColumnRenamed("season", "previous")
    return present.join(seasons, ["competition", "season"]).join(
        before, ["competition", "previous", "team"], "left_anti").select("competition", "season", "team")


def rating_as_of(requests: DataFrame, ratings: DataFrame) -> DataFrame:
    """Latest rating strictly before each (club, as_of) request, NULL where there is none.

    Distinct days of requests and ratings share one ordered window per club, so the work is linear
    and a window holds no more than a club's calendar.
    """
    points = ratings.groupBy("club", F.col("from_date").alias("day")).agg(F.max("rating").alias("rating")).withColumn(
        "hit", F.struct(F.col("day").alias("rating_date"), F.col("rating").alias("raw_rating"))).select("club", "day", "hit")
    asked = requests.select("club", F.col("as_of").alias("day")).distinct()
    days = points.join(asked.withColumn("asked", F.lit(True)), ["club", "day"], "full")
    earlier = Window.partitionBy("club").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    found = days.withColumn("hit", F.last("hit", ignorenulls=True).over(earlier)).where("asked").select(
        "club", F.col("day").alias("as_of"), "hit.rating_date", "hit.raw_rating")
    return requests.join(found, ["club", "as_of"], "left")


def referee_card_factors(train: DataFrame, label: str = "yellow", home: str = "yellow_cards_home",
                         away: str = "yellow_cards_away", minimum: int = REFEREE_MIN_MATCHES,
                         prior: float = REFEREE_PRIOR) -> DataFrame:
    """Multiplier per referee: card rate shrunk to the league rate; rare referees get the league rate."""
    cards = F.coalesce(F.col(home), F.lit(0)) + F.coalesce(F.col(away), F.lit(0))
    named = F.when(F.trim("referee") != "", F.col("referee"))
    by_referee = settle(train.groupBy(named.alias("referee")).agg(
        F.count("*").alias("training_matches"), F.sum(cards.cast("long")).alias("total_cards"))).withColumn("one", F.lit(1))
    league = by_referee.groupBy("one").agg((F.sum("total_cards") / F.sum("training_matches")).alias("league_rate"),
                                           F.count("referee").alias("named"))  # one row, joined back
    n, rate = F.col("training_matches"), F.col("raw_rate")
    rare = n < minimum
    return (
        by_referee.join(settle(league.where("named > 0")), "one").drop("one", "named")
        .withColumn("raw_rate", F.col("total_cards") / n)
        .withColumn("category", F.when(rare, REFEREE_OTHER).otherwise(F.col("referee")))
        .withColumn("prior_weight", F.when(rare, 0.0).otherwise(prior))
        .withColumn("shrunk_rate", F.when(rare, F.col("league_rate")).otherwise(
            (n * rate + prior * F.col("league_rate")) / (n + prior)))
        .withColumn("factor", F.when(F.col("league_rate") > 0, F.col("shrunk_rate") / F.col("league_rate")).otherwise(1.0))
        .withColumn("label", F.lit(label))
    )


def run_metadata(train: DataFrame, models: dict) -> DataFrame:
    """What each model was fitted on: rows that hold all of its columns, their seasons and first and last day.

    ``models`` maps a model to its target columns; one pass over the matches serves all models.
    """
    def facts(columns):
        there = F.lit(True)
        for c in columns:
            there = there & F.col(c).isNotNull()
        kept = lambda c: F.when(there, F.col(c))
        return F.struct(F.count(F.when(there, 1)).alias("training_rows"),
                        F.array_join(F.array_sort(F.collect_set(kept("season"))), ",").alias("seasons"),
                        F.min(kept("match_date")).alias("first_date"), F.max(kept("match_date")).alias("last_date"))

    one_row = train.agg(*[facts(columns).alias(name) for name, columns in models.items()])
    return one_row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("facts")) for n in models]))).select(
        "model", "facts.*")


def training_consistency(runs: DataFrame) -> DataFrame:
    """Whether the models of a set of runs saw the same period and the same number of rows."""
    found = runs.agg(F.count("*").alias("models"), F.countDistinct(F.struct("first_date", "last_date")).alias("periods"),
                     F.countDistinct("training_rows").alias("sizes"))
    return found.withColumn("inconsistent", (F.col("periods") > 1) | (F.col("sizes") > 1))


def fixture_warnings(fixtures: DataFrame, coverage: DataFrame, draw_recall: DataFrame, least_matches: int = 100,
                     least_recall: float = 0.1) -> DataFrame:
    """Comma-joined warnings per fixture, in this order: for each side little history and an old last season,
    then a team the fit never saw, then a classifier that hardly finds draws. Empty where there is none.

    ``coverage`` is one row per team of the training matches, ``draw_recall`` one row (``draw_recall``, NULL without draws).
    """
    latest = settle(coverage.agg(F.max("last_season").alias("latest")).withColumn("one", F.lit(1)))
    recall = settle(draw_recall.select("draw_recall").withColumn("one", F.lit(1)))
    rows, warnings = fixtures.withColumn("one", F.lit(1)).join(latest, "one").join(recall, "one"), []
    for side in ("home", "away"):
        rows = rows.join(coverage.select(F.col("team").alias(f"team_{side}"), F.col("matches").alias(f"{side}_matches"),
                                         F.col("seasons").alias(f"{side}_seasons"), F.col("last_season").alias(f"{side}_last")), f"team_{side}", "left")
        few = (F.col(f"{side}_seasons") <= 1) | (F.col(f"{side}_matches") < least_matches)
        warnings += [F.when(few, f"{side}_limited_history"), F.when(F.col(f"{side}_last") < F.col("latest"), f"{side}_stale_season")]
    unseen = F.col("home_matches").isNull() | F.col("away_matches").isNull()
    warnings += [F.when(unseen, "cold_start"), F.when(F.col("draw_recall") < least_recall, "low_draw_recall")]
    return rows.select(*fixtures.columns, F.concat_ws(",", *warnings).alias("warnings"))


def with_referee_factor(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Attach the factor of the row's referee, 1.0 for an unknown one."""
    known = factors.where(F.col("referee").isNotNull()).select("referee", "factor")
    return rows.join(known, "referee", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))


def shots_conceded(matches: DataFrame) -> DataFrame:
    """Shots on target conceded per match: half the home mean plus half the away mean, 0 for a missing side."""
    rows = matches.select(F.inline(F.array(
        F.struct(F.col("team_home").alias("team"), F.col("shots_on_target_away").cast("long").alias("h"),
                 F.lit(None).cast("long").alias("a")),
        F.struct(F.col("team_away").alias("team"), F.lit(None).cast("long").alias("h"),
                 F.col("shots_on_target_home").cast("long").alias("a")))))
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return rows.groupBy("team").agg(((zero("h") + zero("a")) / 2).alias("conceded"))


def player_season(standard: DataFrame, shooting: DataFrame) -> DataFrame:
    return standard.join(shooting, ["season", "team", "player"], "left")


def key_players(players: DataFrame, top: int = 3) -> DataFrame:
    """Best players per team and season by goals plus assists, then goals, then assists."""
    order = Window.partitionBy("season", "team").orderBy(
        F.desc("goal_contribution"), F.desc("goals"), F.desc("assists"), "player")
    return players.withColumn("goal_contribution", F.col("goals") + F.col("assists")).withColumn(
        "player_rank", F.row_number().over(order)).where(F.col("player_rank") <= top).withColumn(
        "player_rank", F.col("player_rank").cast("long"))


def recent_team_matches(player_matches: DataFrame, size: int = 5) -> DataFrame:
    """Player rows of each team's last matches."""
    played = player_matches.select("team", "match_id", "match_date").distinct()
    newest = Window.partitionBy("team").orderBy(F.desc("match_date"), F.desc("match_id"))
    last = played.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= size)
    return player_matches.join(last.select("team", "match_id"), ["team", "match_id"])


def player_shot_ranges(player_matches: DataFrame, conceded: DataFrame, meetings: DataFrame, size: int = 5) -> DataFrame:
    """Expected range of a player's shots on target against each opponent the team is to meet."""
    recent = recent_team_matches(player_matches, size).where(F.col("sot").isNotNull()).groupBy("team", "player").agg(
        F.count("*").alias("matches_used"), F.avg("sot").alias("mean"), F.stddev_pop("sot").alias("deviation"))
    league = F.avg("conceded").over(Window.partitionBy(F.lit(1)))  # one row per team
    opponents = conceded.select(F.col("team").alias("opponent"), "conceded", (F.col("conceded") / league).alias("adjust"))
    deviation = F.when(F.col("matches_used") > 1, F.col("deviation")).otherwise(0.3)
    adjusted = F.col("mean") * F.col("adjust")
    per_team = meetings.select("team", "opponent").distinct().join(opponents, "opponent")
    return recent.join(per_team, "team").select(
        "team", "player", "opponent", "matches_used", F.round("mean", 2).alias("avg_sot_raw"),
        F.round(adjusted, 2).alias("avg_sot_adjusted"),
        F.greatest(F.lit(0.0), F.round(adjusted - deviation, 1)).alias("sot_range_low"),
        F.round(adjusted + deviation, 1).alias("sot_range_high"), F.round("conceded", 2).alias("opponent_conceded"))
