"""From raw season files to the canonical match table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.schema import MATCH_SCHEMA
from touchline.sources.names import RAW_COLUMNS, SLUGGED_COLUMNS, TEAM_NAMES

CORE = ["date", "team_home", "team_away", "goals_home", "goals_away"]


def slug_header(name: str) -> str:
    name = name.lower().replace(">", "_over_").replace("<", "_under_")
    return re.sub("[^a-z0-9]+", "_", name).strip("_")


def normalize_columns(raw: DataFrame) -> DataFrame:
    """Canonical column names whichever reader produced the file."""
    first = [RAW_COLUMNS.get(c, c) for c in raw.columns]
    slugs = [slug_header(c) for c in first]
    return raw.toDF(*[SLUGGED_COLUMNS.get(c, c) for c in slugs])


def day_first_date(text: Column) -> Column:
    """Day-first date; text in no known form becomes NULL."""
    forms = ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")
    return F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]))


def team_name(text: Column, names: dict = TEAM_NAMES) -> Column:
    """Trim, squeeze white space, then replace known short names."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), clean), clean) if pairs else clean


def name_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_matches(frames: list, competition: str | Column | None = None, names: dict = TEAM_NAMES) -> DataFrame:
    """One canonical table from season frames: aligned columns, parsed dates, derived results and keys."""
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    for field in MATCH_SCHEMA.fields:
        if field.name not in raw.columns:
            raw = raw.withColumn(field.name, F.lit(None).cast("string"))
    date = day_first_date(F.col("date").cast("string"))
    clock = F.try_to_timestamp(F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), F.col("time").cast("string"))) \
        if "time" in raw.columns else F.lit(None).cast("timestamp")
    goals_home, goals_away = F.col("goals_home"), F.col("goals_away")
    number = lambda c, t: F.expr(f"try_cast({c} AS {t})")
    rows = (
        raw.withColumn("date", date)
        .withColumn("datetime", F.coalesce(F.try_to_timestamp(F.col("datetime").cast("string")), clock,
                                           F.col("date").cast("timestamp")))
        .withColumns({c: team_name(F.col(c), names) for c in ("team_home", "team_away")})
        .withColumns({f.name: number(f.name, f.dataType.simpleString()) for f in MATCH_SCHEMA.fields
                      if f.dataType.simpleString() in ("int", "double")})
        .dropna(subset=CORE)
        .withColumn("result", F.when(goals_home > goals_away, "H").when(goals_home < goals_away, "A").otherwise("D"))
        .withColumn("match_id", F.concat_ws("-", F.date_format("date", "yyyyMMdd"), name_slug(F.col("team_home")),
                                            name_slug(F.col("team_away"))))
    )
    if competition is not None:
        rows = rows.withColumn("competition", competition if isinstance(competition, Column) else F.lit(competition))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MATCH_SCHEMA.fields])
