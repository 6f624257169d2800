"""Sequential team ratings with seeding of promoted teams.

A rating update needs the two ratings left by every earlier match, so a competition is one long
recurrence. Its history is cut into blocks of days. Block k of all competitions is folded at once,
from the ratings that block k - 1 left, and only its own rows are written: n blocks cost n folds,
serial within a competition and parallel over competitions. A fold streams over sorted rows and
keeps one number per team in memory. A competition of one block, the usual case, needs one pass.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.summaries import promoted_teams, rating_as_of
from touchline.operators.teams import final_table
from touchline.schema import (
    DRAW_BASE, DRAW_WIDTH, ELO_HOME, ELO_K, ELO_START, RESCALE_INTERCEPT, RESCALE_SLOPE)
from touchline.session import settle

ROWS_PER_BLOCK = 1_000_000
BLOCK = ["competition", "block"]
RATED = ("home_pre", "away_pre", "home_post", "away_post")
_OUT = ("competition string, block long, kind string, season string, match_date date, match_id long, team string, "
        "opponent string, result string, home_pre double, away_pre double, home_post double, away_post double")


def seed_requests(matches: DataFrame, outside: DataFrame | None) -> DataFrame:
    """What each promoted team starts a season with: a rescaled outside rating, else the mean rating
    of last season's bottom three (by points, goal difference, goals; the name breaks ties)."""
    promoted = promoted_teams(matches)
    opening = matches.groupBy("competition", "season").agg(F.min("match_date").alias("as_of"))
    rows = promoted.join(opening, ["competition", "season"])
    if outside is None:
        rows = rows.withColumns({"rating_date": F.lit(None).cast("date"), "raw_rating": F.lit(None).cast("double")})
    else:
        rows = rating_as_of(rows.withColumn("club", F.col("team")), outside).drop("club")
    worst = Window.partitionBy("competition", "season").orderBy("points", "goal_difference", "goals_for", "team")
    bottom = final_table(matches).withColumn("k", F.row_number().over(worst)).where(F.col("k") <= 3).groupBy(
        "competition", F.col("season").alias("previous")).agg(F.array_sort(F.collect_list("team")).alias("bottom"))
    order = Window.partitionBy("competition").orderBy("season")
    before = matches.select("competition", "season").distinct().withColumn("previous", F.lag("season").over(order))
    return rows.join(before, ["competition", "season"]).join(bottom, ["competition", "previous"], "left").withColumn(
        "rescaled", RESCALE_INTERCEPT + RESCALE_SLOPE * F.col("raw_rating")).drop("previous")


def _blocks(matches: DataFrame, rows_per_block: int) -> DataFrame:
    """Block number of each day of a competition, from daily counts (one row per calendar day)."""
    daily = matches.groupBy("competition", "season", "match_date").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("competition").orderBy("season", "match_date")) - F.col("n")
    return daily.select("competition", "season", "match_date", F.floor(before / rows_per_block).cast("long").alias("block"))


def _fold(k: float, home: float, start: float):
    """Ratings along sorted events. Only what a rating needs becomes Python values; the other columns pass through as they are."""
    schema = pa.schema([("competition", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("season", pa.string()), ("match_date", pa.date32()),
                        ("match_id", pa.int64()), *[(c, pa.string()) for c in ("team", "opponent", "result")], *[(c, pa.float64()) for c in RATED]])
    points = {"H": 1.0, "D": 0.5}

    def values(column):  # few distinct names: each becomes a Python value once a batch
        encoded = column.dictionary_encode()
        names = [*encoded.dictionary.to_pylist(), None]
        return map(names.__getitem__, encoded.indices.fill_null(len(names) - 1).to_numpy().tolist())

    def ends(key, ratings):
        rows = {"competition": [key[0]] * len(ratings), "block": [key[1]] * len(ratings), "kind": ["end"] * len(ratings),
                "team": list(ratings), "home_pre": list(ratings.values())}
        return pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * len(ratings)), f.type) for f in schema], schema=schema)

    def run(batches):
        key, ratings = None, {}
        for batch in batches:
            kept, kinds, made = [], [], []
            events = zip(*[values(batch.column(c)) for c in (*BLOCK, "kind", "team", "opponent", "result")])
            for i, (comp, block, kind, team, opponent, result) in enumerate(events):
                if (comp, block) != key:
                    if key is not None:
                        yield ends(key, ratings)
                    key, ratings = (comp, block), {}
                if kind == 2:
                    h, a = ratings.get(team, start), ratings.get(opponent, start)
                    gain = k * (points.get(result, 0.0) - 1.0 / (1.0 + 10.0 ** (-(h + home - a) / 400.0)))
                    ratings[team], ratings[opponent] = h + gain, a - gain
                    kinds.append("match")
                    made.append((h, a, h + gain, a - gain))
                else:  # a rating at the start of the block, or a promoted team
                    value = batch.column("value")[i].as_py()
                    if kind == 1 and (value is None or value != value):
                        known = [ratings[t] for t in batch.column("bottom")[i].as_py() if t in ratings]
                        value = sum(known) / len(known) if known else start
                    ratings[team] = value
                    if kind == 0:
                        continue
                    kinds.append("seed")
                    made.append((value, None, None, None))
                kept.append(i)
            if kept:
                own = batch if len(kept) == batch.num_rows else batch.take(pa.array(kept, pa.int64()))
                columns = {"kind": pa.array(kinds, pa.string()), **{c: pa.array(v, pa.float64()) for c, v in zip(RATED, zip(*made))}}
                yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else own.column(f.name) for f in schema], schema=schema)
        if key is not None:
            yield ends(key, ratings)

    return run


def rate(matches: DataFrame, seeds: DataFrame | None = None, k: float = ELO_K, home: float = ELO_HOME,
         start: float = ELO_START, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Ratings before and after every match and of every seed; column ``kind`` is match, seed or end."""
    # never null: Spark's Arrow writer takes time with the square of the null lists of a batch
    nobody = F.array().cast("array<string>")
    blocks = settle(_blocks(matches, rows_per_block))
    events = matches.join(blocks, ["competition", "season", "match_date"]).select(
        *BLOCK, F.lit(2).alias("kind"), "season", "match_date", "match_id", F.col("team_home").alias("team"),
        F.col("team_away").alias("opponent"), "result", F.lit(None).cast("double").alias("value"),
        nobody.alias("bottom"))
    empty = lambda c, t: F.lit(None).cast(t).alias(c)
    if seeds is not None:
        first = blocks.groupBy("competition", "season").agg(F.min("block").alias("block"))
        events = events.unionByName(seeds.join(first, ["competition", "season"]).select(
            *BLOCK, F.lit(1).alias("kind"), "season", empty("match_date", "date"), empty("match_id", "long"), "team",
            empty("opponent", "string"), empty("result", "string"), F.col("rescaled").alias("value"), F.coalesce("bottom", nobody).alias("bottom")))
    last = settle(blocks.groupBy("competition").agg(F.max("block").alias("last_block")))
    passes = blocks.agg(F.max("block")).first()[0]
    events = settle(events.repartition(*BLOCK)) if passes else events  # a task writes blocks of bounded size, not a block of every competition

    def fold(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition(*BLOCK).sortWithinPartitions(
            *BLOCK, F.when(F.col("kind") == 0, "").otherwise(F.col("season")), "kind", "match_date", "match_id", "team")
        return settle(ordered.mapInArrow(_fold(k, home, start), _OUT))

    if not passes:
        return fold(events)
    done = part = fold(events.where(F.col("block") == 0))
    for number in range(1, passes + 1):
        begin = part.where("kind = 'end'").join(last.where(F.col("last_block") >= number), "competition").select(
            "competition", F.lit(number).cast("long").alias("block"), F.lit(0).alias("kind"), empty("season", "string"),
            empty("match_date", "date"), empty("match_id", "long"), "team", empty("opponent", "string"), empty("result", "string"),
            F.col("home_pre").alias("value"), nobody.alias("bottom"))
        part = fold(events.where(F.col("block") == number).unionByName(begin))
        done = done.unionByName(part)
    return done


def rating_history(done: DataFrame) -> DataFrame:
    """Two rows per match, each from one team's side."""
    view = lambda venue, t, o, pre, opp, post: F.struct(
        F.lit(venue).alias("venue"), F.col(t).alias("team"), F.col(o).alias("opponent"), F.col(pre).alias("elo_pre"),
        F.col(opp).alias("opponent_elo_pre"), (F.col(pre) - F.col(opp)).alias("elo_gap_pre"), F.col(post).alias("elo_post"))
    return done.where("kind = 'match'").withColumnsRenamed({"team": "th", "opponent": "ta"}).select(
        "competition", "season", "match_date", "match_id", "result", F.inline(F.array(
            view("home", "th", "ta", "home_pre", "away_pre", "home_post"), view("away", "ta", "th", "away_pre", "home_pre", "away_post"))))


def current_ratings(done: DataFrame) -> DataFrame:
    """Latest rating of each team with its rank in the competition."""
    ends = done.where("kind = 'end'").groupBy("competition", "team").agg(F.max_by("home_pre", "block").alias("rating"))
    order = Window.partitionBy("competition").orderBy(F.desc(F.round("rating", 6)), "team")
    as_of = done.where("kind = 'match'").groupBy("competition").agg(F.max("match_date").alias("as_of"))
    return ends.withColumn("rating_rank", F.row_number().over(order).cast("long")).join(as_of, "competition")


def seed_log(done: DataFrame, seeds: DataFrame) -> DataFrame:
    """Where each promoted team's starting rating came from."""
    used = done.where("kind = 'seed'").select("competition", "season", "team", F.col("home_pre").alias("rating"))
    return seeds.join(used, ["competition", "season", "team"]).select(
        "competition", "season", "team", F.when(F.col("rescaled").isNull(), "fallback_bottom3").otherwise("outside").alias("source"),
        "rating_date", "raw_rating", "rescaled", "rating")


def rating_probabilities(rows: DataFrame, home: str = "home_pre", away: str = "away_pre", advantage: float = ELO_HOME,
                         base: float = DRAW_BASE, width: float = DRAW_WIDTH) -> DataFrame:
    """Home/draw/away from two ratings: the draw share falls with the gap, the rest follows expectancy."""
    gap = F.col(home) + advantage - F.col(away)
    expected = 1 / (1 + F.pow(F.lit(10.0), -gap / 400))
    draw = base * F.exp(-F.pow(gap / width, F.lit(2.0)) / 2)
    return rows.withColumns({"prob_home": (1 - draw) * expected, "prob_draw": draw, "prob_away": (1 - draw) * (1 - expected)})
