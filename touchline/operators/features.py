"""Point-in-time features: only matches on strictly earlier dates count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.teams import DAY, team_days, team_view
from touchline.schema import FEATURE_COLUMNS, FORM_WINDOW
from touchline.session import settle
from touchline.sources.derived import EMPTY_STADIUM_SEASONS

TEAM = ["competition", "team"]
PAIR = ["competition", "team_low", "team_high"]


def _latest_of_day(rows: DataFrame, keys: list, value: Column, size: int) -> DataFrame:
    """The last ``size`` values of each key and day, newest first; the limit acts before the shuffle."""
    newest = Window.partitionBy(*keys, "match_date").orderBy(F.desc("match_id"))
    return (
        rows.select(*keys, "match_date", "match_id", value.alias("value"))
        .withColumn("k", F.row_number().over(newest)).where(F.col("k") <= size)
        .groupBy(*keys, "match_date")
        .agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("latest"))
        .withColumn("latest", F.transform("latest", lambda x: x["value"]))
    )


def _state_after_day(daily: DataFrame, keys: list, size: int) -> DataFrame:
    """The last ``size`` values up to and including the day: each of ``size`` match days has one or more."""
    days = Window.partitionBy(*keys).orderBy("match_date").rowsBetween(1 - size, 0)
    recent = F.slice(F.flatten(F.reverse(F.collect_list("latest").over(days))), 1, size)
    return daily.select(*keys, "match_date", recent.alias("state"))


def _before(keys: list) -> Window:
    return Window.partitionBy(*keys).orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)


def _count(values: Column, wanted: str) -> Column:
    return F.size(F.filter(values, lambda x: x == wanted)).cast("long")


def team_day_features(history: DataFrame, targets: DataFrame | None = None, window: int = FORM_WINDOW) -> DataFrame:
    """Form, rest and season-to-date venue record of each team before each of its match days."""
    t = team_view(history)
    value = F.struct(F.col("outcome").alias("outcome"), (F.col("gf") - F.col("ga")).alias("gd"))
    state = _state_after_day(_latest_of_day(t, TEAM, value, window), TEAM, window)
    won = lambda o: F.size(F.filter("state", lambda x: x["outcome"] == o)).cast("long")
    summary = F.struct(
        F.size("state").cast("long").alias("played"), won("W").alias("wins"), won("D").alias("draws"), won("L").alias("losses"),
        F.aggregate("state", F.lit(0).cast("long"), lambda a, x: a + x["gd"]).alias("goal_difference"))
    state = state.select(*TEAM, "match_date", summary.alias("state"))
    days = team_days(history, targets).join(state, TEAM + ["match_date"], "left")
    earlier, season = _before(TEAM), _before(["competition", "season", "team"])
    had_match = (F.col("home_played") + F.col("away_played")) > 0
    days = days.withColumns(
        {"form": F.last("state", ignorenulls=True).over(earlier),
         "last_day": F.last(F.when(had_match, F.col("match_date")), ignorenulls=True).over(earlier)}
        | {f"{v}_{c}_before": F.coalesce(F.sum(f"{v}_{c}").over(season), F.lit(0).cast("long"))
           for v in ("home", "away") for c in ("played", "wins", "draws", "points", "gf", "ga")}
    )
    columns = {f"form5_{c}": F.coalesce(F.col(f"form.{c}"), F.lit(0).cast("long"))
               for c in ("played", "wins", "draws", "losses", "goal_difference")} | {
        "rest_days": F.datediff("match_date", "last_day").cast("long"),
    }
    for v in ("home", "away"):
        before = lambda c: F.col(f"{v}_{c}_before")
        ratio = lambda x: F.when(before("played") > 0, x / before("played"))
        columns |= {
            f"{v}_split_played": before("played"),
            f"{v}_split_wins": before("wins"),
            f"{v}_split_draws": before("draws"),
            f"{v}_split_losses": before("played") - before("wins") - before("draws"),
            f"{v}_split_points_per_game": ratio(before("points")),
            f"{v}_split_goal_difference_per_game": ratio(before("gf") - before("ga")),
        }
    return days.select(*DAY, *[c.alias(n) for n, c in columns.items()])


def head_to_head(history: DataFrame, targets: DataFrame | None = None, window: int = FORM_WINDOW) -> DataFrame:
    """Winners of the last meetings of a pair before each day on which the pair meets."""
    pair = [F.least("team_home", "team_away").alias("team_low"), F.greatest("team_home", "team_away").alias("team_high")]
    met = history.select("competition", "match_date", "match_id", *pair,
                         F.when(F.col("result") == "H", F.col("team_home"))
                         .when(F.col("result") == "A", F.col("team_away")).otherwise("").alias("winner"))
    state = _state_after_day(_latest_of_day(met, PAIR, F.col("winner"), window), PAIR, window)
    wanted = (history if targets is None else targets).select("competition", "match_date", *pair).distinct()
    days = state if targets is None else state.join(wanted, PAIR + ["match_date"], "full")
    won = F.coalesce(F.col("winners"), F.array().cast("array<string>"))
    side = lambda name: F.size(F.filter(won, lambda x: x == F.col(name))).cast("long")
    return (
        days.withColumn("winners", F.last("state", ignorenulls=True).over(_before(PAIR)))
        .select(*PAIR, "match_date", F.size(won).cast("long").alias("met"), side("team_low").alias("low_wins"),
                side("team_high").alias("high_wins"), _count(won, "").alias("drawn"))
    )


def league_by_day(history: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Points, matches and shared position of every season team before each day of the season.

    The calendar is laid out per team (days of a season times its teams, never rows times rows);
    a team that has only fixtures in a season appears on its fixture days alone.
    """
    season = ["competition", "season"]
    days = team_days(history, targets).select(
        *DAY, (F.col("home_played") + F.col("away_played")).alias("played"),
        (F.col("home_points") + F.col("away_points")).alias("points"),
        (F.col("home_gf") + F.col("away_gf")).alias("gf"), (F.col("home_ga") + F.col("away_ga")).alias("ga"))
    calendar = days.groupBy(*season).agg(F.collect_set("match_date").alias("dates"))
    teams = days.where("played > 0").select(*season, "team").distinct()
    laid_out = teams.join(calendar, season).select(*season, "team", F.explode("dates").alias("match_date"))
    if targets is not None:
        laid_out = laid_out.unionByName(days.select(*DAY)).distinct()
    running = _before(season + ["team"])
    total = lambda c: F.coalesce(F.sum(c).over(running), F.lit(0).cast("long"))
    table = laid_out.join(days, DAY, "left").select(
        *DAY, total("played").alias("league_played"), total("points").alias("league_points"),
        (total("gf") - total("ga")).alias("goal_difference"), total("gf").alias("goals_for"))
    order = Window.partitionBy(*season, "match_date").orderBy(
        F.desc("league_points"), F.desc("goal_difference"), F.desc("goals_for"))
    return table.select(*DAY, F.rank().over(order).cast("long").alias("league_position"),
                        "league_points", "league_played")


def _attach(matches: DataFrame, side: str, days: DataFrame, names: dict) -> DataFrame:
    keys = {"competition": "competition", "season": "season", "team": f"team_{side}", "match_date": "match_date"}
    return matches.join(days.select(*[F.col(k).alias(v) for k, v in keys.items()],
                                    *[F.col(c).alias(n) for c, n in names.items()]), list(keys.values()), "left")


def generate_features(history: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """All pre-match features, one row per match of ``targets`` (by default of ``history`` itself)."""
    rows = (history if targets is None else targets).select(
        "match_id", "competition", "season", "match_date", "team_home", "team_away",
        *(["result"] if targets is None else []))
    # Written once: both sides read it, and its true size (teams times calendar days) decides how it is joined.
    days = settle(team_day_features(history, targets).join(league_by_day(history, targets), DAY))
    for side in ("home", "away"):
        names = {c: f"{side}_{c}" for c in days.columns if c.startswith(("form5_", "league_")) or c == "rest_days"}
        names |= {f"{side}_split_{c}": f"{side}_{side}_{c}" for c in (
            "played", "wins", "draws", "losses", "points_per_game", "goal_difference_per_game")}
        rows = _attach(rows, side, days, names)
    met = head_to_head(history, targets)
    rows = rows.withColumn("team_low", F.least("team_home", "team_away")).withColumn(
        "team_high", F.greatest("team_home", "team_away")).join(met, PAIR + ["match_date"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    home_low = F.col("team_home") == F.col("team_low")
    rows = rows.withColumns({
        "h2h_played": zero(F.col("met")),
        "h2h_home_wins": zero(F.when(home_low, F.col("low_wins")).otherwise(F.col("high_wins"))),
        "h2h_draws": zero(F.col("drawn")),
        "h2h_away_wins": zero(F.when(home_low, F.col("high_wins")).otherwise(F.col("low_wins"))),
        "is_empty_stadium": F.col("season").isin(*EMPTY_STADIUM_SEASONS).cast("int"),
    })
    return rows.select("match_id", "competition", "season", "match_date", "team_home", "team_away",
                       *FEATURE_COLUMNS, *(["result"] if targets is None else []))
