"""Text sources and sinks: behaviour logs, electrode files, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochal.functions import text as T
from epochal.operators.results import next_run

LOG_COLUMNS = ["subject", "trial", "event_type", "code", "time", "ttime", "uncertainty", "duration", "req_time", "req_dur"]
TIMES = ["time", "ttime", "uncertainty", "duration", "req_time", "req_dur"]


def presentation_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tab-separated experiment logs: file, subject, trial, event_type, code and the six times in milliseconds.

    Header and blank lines have no numeric time and go; spaces in names become underscores; ticks of a tenth
    of a millisecond are rounded to milliseconds; short rows keep the fields that they have.
    """
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), *[F.try_element_at(parts, F.lit(i + 1)).alias(c) for i, c in enumerate(LOG_COLUMNS)])
    times = [F.round(F.col(c).try_cast("double") / 10).cast("long").alias(f"{c}_ms") for c in TIMES]
    return rows.where(F.col("time").try_cast("double").isNotNull()).select("file", "subject", F.col("trial").try_cast("int").alias("trial"), T.underscored("event_type").alias("event_type"), "code", *times)


def psychopy_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV logs with a header, one file a session; ``session`` is the file's name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return spark.read.csv(path, header=True, schema=schema).withColumn("session", name)


def electrodes(spark: SparkSession, path: str) -> DataFrame:
    """(label, x, y, z) of ``.ced`` (tab, header) and ``.sfp`` (white space) files."""
    if path.lower().endswith(".ced"):
        ced = spark.read.csv(path, sep="\t", header=True)
        return ced.select(F.trim("labels").alias("label"), *[F.col(c.upper()).cast("double").alias(c) for c in "xyz"])
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 4).select(parts[0].alias("label"), *[parts[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])


def write_results(results: DataFrame, path: str, by: list[str], iteration: int | None = None) -> int:
    """Result tables by condition, channel set or frequency, and by run: returns the run's number.

    Without a number a run takes the smallest that is free; with one it replaces what that run wrote before, so
    a repeated run doubles nothing.
    """
    spark = results.sparkSession
    if iteration is None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        iteration = next_run(spark.read.parquet(path)).first()[0] if there else 1
    numbered = results.withColumn("iteration", F.lit(iteration))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iteration", *by).parquet(path)
    return iteration


def write_clusters(clusters: DataFrame, path: str) -> None:
    """``key: value`` lines, a cluster a paragraph."""
    line = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in clusters.columns])
    clusters.select(F.concat(line, F.lit("\n")).alias("value")).write.text(path)


def first_at_zero(events: DataFrame, by: str = "epoch") -> DataFrame:
    """The first code at latency exactly 0 of each epoch; an epoch without one stops the job."""
    w = Window.partitionBy(by).orderBy(F.when(F.col("latency_ms") == 0, 0).otherwise(1), "place")
    firsts = events.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    found = F.when(F.col("latency_ms") == 0, F.col("latency_ms")).otherwise(F.raise_error(F.lit("an epoch has no event code at latency 0")).cast(events.schema["latency_ms"].dataType))
    return firsts.withColumn("latency_ms", found)
