"""The driver's star-schema tables in the roles of the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial_id, event_code, x): a trial's samples as one array of doubles."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial_id"), F.col("label").alias("event_code"), x.alias("x"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial_id, event_code, t_idx, value): the long form; t_idx counts from 1."""
    return to_long(epochs(spark, sf_dir))


def to_long(epochs: DataFrame) -> DataFrame:
    return epochs.select("trial_id", "event_code", F.posexplode("x").alias("p", "value")).select("trial_id", "event_code", (F.col("p") + 1).alias("t_idx"), "value")


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, event, time_ms, value, event_id): the event log with millisecond times."""
    ms = F.expr("cast(round(unix_micros(cast(ts as timestamp)) / 1000.0D) as bigint)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("event"), ms.alias("time_ms"), "value", "event_id")
