"""File sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import shared_folder

# What a fixture file must hold.
FIXTURE_SCHEMA = T.StructType([
    T.StructField("fixture_id", T.StringType()),
    T.StructField("season", T.StringType()),
    T.StructField("datetime", T.TimestampType()),
    T.StructField("team_home", T.StringType()),
    T.StructField("team_away", T.StringType()),
    T.StructField("odds_home", T.DoubleType()),
    T.StructField("odds_draw", T.DoubleType()),
    T.StructField("odds_away", T.DoubleType()),
])


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def read_season_csv(spark: SparkSession, path: str, columns: list) -> DataFrame:
    """Raw season files under ``season=...`` folders, read as text by header name; a BOM does no harm."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", False)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("season", T.StringType())])
    return raw.schema(schema).csv(path)


def write_season_csv(raw: DataFrame, path: str) -> None:
    raw.write.partitionBy("season").option("header", True).csv(path)


def write_by_season(matches: DataFrame, path: str) -> None:
    """Canonical table, one folder per season; seasons are spread over tasks by match as well."""
    matches.write.mode("overwrite").partitionBy("season").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Replace only the (season, model) folders that ``predictions`` holds."""
    (predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("season", "model").parquet(path))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Fixtures with odds; a file without one of the required columns is an error."""
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(FIXTURE_SCHEMA.names) - set(header))
    if missing:
        raise ValueError(f"fixture file lacks columns: {missing}")
    types = {f.name: f.dataType for f in FIXTURE_SCHEMA.fields}
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    return spark.read.option("header", True).schema(schema).csv(path).select(*FIXTURE_SCHEMA.names)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or no rows of the same schema when it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def fresh_ratings(ratings: DataFrame, now, days: int = 7) -> DataFrame:
    """Rating histories fetched less than ``days`` before ``now``."""
    return ratings.where(F.col("fetched_at") > F.date_sub(now if isinstance(now, Column) else F.lit(now), days))
