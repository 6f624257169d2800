"""Match, rating and player tables derived from the retail star schema of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import settle

HOLDOUT_SEASON = "2001"
EMPTY_STADIUM_SEASONS = ("1998",)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_matches(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with two different nations active in its year."""
    baskets = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("n"),
            F.sum("l_quantity").cast("long").alias("q"),
            F.sum("l_partkey").alias("p"),
            F.sum("l_suppkey").alias("s"),
        )
    )
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    home = nation.select(F.col("n_nationkey").alias("hk"), F.col("n_name").alias("team_home"))
    away = nation.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("team_away"))
    orders = table(spark, folder, "orders").withColumn("yr", F.year("o_orderdate"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    active = lambda key: (F.col(key) + F.col("yr")) % 5 != 0
    n, q, p, s = (F.col(c) for c in "nqps")
    gh, ga = (q % 5).cast("int"), (p % 4).cast("int")
    return (
        orders.join(baskets, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(home, F.col("hk") == F.col("c_nationkey"))
        .join(away, F.col("ak") == s % 25)
        .where((F.col("hk") != F.col("ak")) & active("hk") & active("ak"))
        .select(
            F.col("o_orderkey").alias("match_id"),
            F.col("o_orderpriority").alias("competition"),
            F.col("yr").cast("string").alias("season"),
            F.to_date("o_orderdate").alias("match_date"),
            "team_home",
            "team_away",
            gh.alias("goals_home"),
            ga.alias("goals_away"),
            F.when(gh > ga, "H").when(gh < ga, "A").otherwise("D").alias("result"),
            (gh + 3 + p % 11).cast("int").alias("shots_home"),
            (ga + 3 + q % 9).cast("int").alias("shots_away"),
            (gh + p % 3).cast("int").alias("shots_on_target_home"),
            (ga + q % 3).cast("int").alias("shots_on_target_away"),
            (s % 12).cast("int").alias("corners_home"),
            (s % 9).cast("int").alias("corners_away"),
            (n % 5).cast("int").alias("yellow_cards_home"),
            (p % 4).cast("int").alias("yellow_cards_away"),
            F.when(p % 23 == 0, 1).otherwise(0).alias("red_cards_home"),
            F.when(q % 29 == 0, 1).otherwise(0).alias("red_cards_away"),
            F.concat(F.lit("R"), (F.col("o_custkey") % 300).cast("string")).alias("referee"),
            (F.lit(1.2) + (q % 37).cast("double") / 10).alias("odds_avg_home"),
            (F.lit(2.5) + (n % 9).cast("double") / 10).alias("odds_avg_draw"),
            (F.lit(1.3) + (p % 41).cast("double") / 10).alias("odds_avg_away"),
        )
    )


def _orders_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    )


def load_external_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Dated outside ratings per club, one point a month."""
    return (
        _orders_by_nation(spark, folder)
        .groupBy(F.col("n_name").alias("club"), F.trunc(F.to_date("o_orderdate"), "month").alias("from_date"))
        .agg((F.lit(1400) + 7 * (F.count("*") % 60)).cast("double").alias("rating"))
    )


def load_player_standard(spark: SparkSession, folder: str) -> DataFrame:
    flag = lambda v: F.sum((F.col("o_orderstatus") == v).cast("long"))
    return (
        _orders_by_nation(spark, folder)
        .groupBy(F.year("o_orderdate").cast("string").alias("season"), F.col("n_name").alias("team"),
                 F.col("c_name").alias("player"))
        .agg(flag("F").alias("goals"), flag("O").alias("assists"))
    )


def load_player_shooting(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _orders_by_nation(spark, folder)
        .join(table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.year("o_orderdate").cast("string").alias("season"), F.col("n_name").alias("team"),
                 F.col("c_name").alias("player"))
        .agg(F.count("*").alias("shots"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("shots_on_target"))
    )


def load_player_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Shots on target of one player in one match: the returned lines of each order."""
    return (
        _orders_by_nation(spark, folder)
        .join(table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("match_date"),
                 F.col("n_name").alias("team"), F.col("c_name").alias("player"))
        .agg(F.sum((F.col("l_returnflag") == "R").cast("double")).alias("sot"))
    )


# Short spellings used in the raw copy of the match table.
SHORT_NAMES = {"N 1": "NATION_1", "N 7": "NATION_7", "N 12": "NATION_12"}
RAW_HEADER = ["Div", "Date", "Time", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "HS", "AS", "HC", "AC",
              "Referee", "AvgH", "AvgD", "AvgA", "BbMx>2.5"]


def raw_copy(matches: DataFrame) -> DataFrame:
    """The match table as a careless source would publish it: text, odd spacing, wrong results, gaps."""
    short = lambda c: F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for k, v in SHORT_NAMES.items() for x in (v, k)]), F.col(c)), F.col(c))
    text = lambda c: F.col(c).cast("string")
    played = ~((F.col("corners_home") == 0) & (F.col("corners_away") == 0))
    day = F.when(F.col("shots_home") == F.col("shots_away"), F.date_format("match_date", "dd/MM/yyyy")).otherwise(
        F.date_format("match_date", "yyyy-MM-dd"))
    return matches.select(
        "season", F.col("competition").alias("Div"), day.alias("Date"),
        F.when(F.col("goals_home") > 0, F.concat(12 + F.col("goals_home"), F.lit(":30"))).alias("Time"),
        F.concat(F.lit("  "), F.regexp_replace(short("team_home"), " ", "   ")).alias("HomeTeam"),
        F.concat(short("team_away"), F.lit(" ")).alias("AwayTeam"),
        F.when(played, text("goals_home")).alias("FTHG"), F.when(played, text("goals_away")).otherwise("n/a").alias("FTAG"),
        F.lit("H").alias("FTR"), text("shots_home").alias("HS"), text("shots_away").alias("AS"),
        text("corners_home").alias("HC"), text("corners_away").alias("AC"), F.col("referee").alias("Referee"),
        text("odds_avg_home").alias("AvgH"), text("odds_avg_draw").alias("AvgD"), text("odds_avg_away").alias("AvgA"),
        F.lit("1.9").alias("BbMx>2.5"))


def load_predictions(matches: DataFrame, form: DataFrame) -> DataFrame:
    """Forecasts of four simple models for every match: decoded odds, uniform, recent form, earlier seasons."""
    from pyspark.sql import Window

    third = F.lit(1.0) / 3
    earlier = Window.partitionBy("competition").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    rates = settle(
        matches.groupBy("competition", "season")
        .agg(*[F.sum((F.col("result") == r).cast("long")).alias(r) for r in "HDA"])
        .select("competition", "season", *[F.sum(r).over(earlier).alias(r) for r in "HDA"])
    )  # its true size decides the join
    keys = lambda side: [F.col("competition"), F.col("team").alias(f"team_{side}"), F.col("match_date"),
                         *[F.col(c).alias(f"{side}_{c}") for c in ("form5_wins", "form5_draws")]]
    wide = matches.select("match_id", "competition", "season", "match_date", "team_home", "team_away", "result",
                          "odds_avg_home", "odds_avg_draw", "odds_avg_away")
    for side in ("home", "away"):
        wide = wide.join(form.select(*keys(side)), ["competition", f"team_{side}", "match_date"])
    wide = wide.join(rates, ["competition", "season"])
    inverse = [F.lit(1.0) / F.col(f"odds_avg_{o}") for o in ("home", "draw", "away")]
    whole = inverse[0] + inverse[1] + inverse[2]
    hw, dd, aw = F.col("home_form5_wins") + 1, F.col("home_form5_draws") + F.col("away_form5_draws") + 1, \
        F.col("away_form5_wins") + 1
    n = F.col("H") + F.col("D") + F.col("A")
    rows = [("market", [i / whole for i in inverse]), ("uniform", [third] * 3),
            ("form", [x / (hw + dd + aw) for x in (hw, dd, aw)]),
            ("base_rate", [F.coalesce(F.col(r) / n, third) for r in "HDA"])]
    struct = [F.struct(F.lit(m).alias("model"), *[p.alias(c) for p, c in zip(ps, ("prob_home", "prob_draw", "prob_away"))])
              for m, ps in rows]
    return wide.select("match_id", "competition", "season", "match_date", "team_home", "team_away", "result",
                       F.inline(F.array(*struct)))
