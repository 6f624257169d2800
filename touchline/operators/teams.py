"""The team-perspective view of matches and what can be counted on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = ["competition", "season", "team", "match_date"]


def team_view(matches: DataFrame, home: str = "goals_home", away: str = "goals_away") -> DataFrame:
    """Two rows per match, home and away perspective, made in one pass without a shuffle."""

    def side(venue: str, team: str, opponent: str, gf: str, ga: str) -> Column:
        return F.struct(
            F.col(team).alias("team"), F.col(opponent).alias("opponent"), F.lit(venue).alias("venue"),
            F.col(gf).cast("long").alias("gf"), F.col(ga).cast("long").alias("ga"))

    rows = F.array(side("home", "team_home", "team_away", home, away),
                   side("away", "team_away", "team_home", away, home))
    gf, ga = F.col("gf"), F.col("ga")
    return (
        matches.select("competition", "season", "match_date", "match_id", F.inline(rows))
        .withColumn("outcome", F.when(gf > ga, "W").when(gf < ga, "L").otherwise("D"))
        .withColumn("points", F.when(gf > ga, 3).when(gf < ga, 0).otherwise(1).cast("long"))
    )


def team_universe(matches: DataFrame) -> DataFrame:
    return matches.select(F.explode(F.array("team_home", "team_away")).alias("team")).distinct()


def team_coverage(matches: DataFrame) -> DataFrame:
    """Matches, distinct seasons and last appearance of each team."""
    return (
        team_view(matches).groupBy("team", "season")
        .agg(F.count("*").alias("n"), F.max("match_date").alias("last_date"))
        .groupBy("team")
        .agg(F.sum("n").alias("matches"), F.count("*").alias("seasons"),
             F.max("season").alias("last_season"), F.max("last_date").alias("last_date"))
    )


def final_table(matches: DataFrame) -> DataFrame:
    """League table of each season at its end; ties in the record share a position."""
    table = team_view(matches).groupBy("competition", "season", "team").agg(
        F.count("*").alias("played"),
        F.sum("points").alias("points"),
        F.sum(F.col("gf") - F.col("ga")).alias("goal_difference"),
        F.sum("gf").alias("goals_for"),
    )
    order = Window.partitionBy("competition", "season").orderBy(
        F.desc("points"), F.desc("goal_difference"), F.desc("goals_for"))
    return table.withColumn("position", F.rank().over(order).cast("long"))


def team_days(history: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row per team and match day with that day's summed record, split by venue.

    Days are the unit of every running total below: a window over one team then holds at most one
    row per calendar day however many matches the team has, and sums reach the shuffle already
    combined. ``targets`` adds days without results, such as those of fixtures.
    """
    t = team_view(history)
    at = lambda venue, value: F.when(F.col("venue") == venue, value).otherwise(0).cast("long")
    stats = {}
    for v in ("home", "away"):
        stats |= {
            f"{v}_played": at(v, 1),
            f"{v}_wins": at(v, (F.col("outcome") == "W").cast("long")),
            f"{v}_draws": at(v, (F.col("outcome") == "D").cast("long")),
            f"{v}_points": at(v, F.col("points")),
            f"{v}_gf": at(v, F.col("gf")),
            f"{v}_ga": at(v, F.col("ga")),
        }
    rows = t.select(*DAY, *[c.alias(n) for n, c in stats.items()])
    if targets is not None:
        empty = _target_days(targets).select(*DAY, *[F.lit(0).cast("long").alias(n) for n in stats])
        rows = rows.unionByName(empty)
    return rows.groupBy(*DAY).agg(*[F.sum(n).alias(n) for n in stats])


def _target_days(targets: DataFrame) -> DataFrame:
    return targets.select(
        "competition", "season", F.explode(F.array("team_home", "team_away")).alias("team"), "match_date")
