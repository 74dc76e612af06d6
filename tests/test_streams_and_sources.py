"""Streams against the batch; readers on small files."""

import pytest
from pyspark.sql import functions as F

from epochal.sources import readers
from epochal.streaming import events as S

DATA = "/root/testdata/sf0.001"


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "events")
    batch.orderBy("ts").coalesce(1).write.parquet(folder)
    return batch, spark.readStream.schema(batch.schema).parquet(folder)


def test_quality_windows(spark, stream):
    batch, live = stream
    found = drain(S.quality_windows(live), "quality", "complete")
    expected = batch.groupBy(F.window("ts", "1 hour", "20 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    key = lambda df: {(r[0].start, r[1], r[2]) for r in df.select("window", "event_type", "n").collect()}
    assert key(found) == key(expected)


def test_responses(spark, stream):
    batch, live = stream
    found = drain(S.responses(live.where("event_type = 'view'"), live.where("event_type = 'click'"), 1000, 7_200_000), "answers")
    s, r = batch.where("event_type = 'view'").alias("s"), batch.where("event_type = 'click'").alias("r")
    expected = s.join(r, F.expr("s.user_id = r.user_id and r.ts between s.ts + interval 1 second and s.ts + interval 2 hours"))
    assert found.count() == expected.count() > 0


def test_sessions(spark, stream):
    batch, live = stream
    found = drain(S.sessions(live), "sessions", "complete")
    assert found.agg(F.sum("n")).first()[0] == batch.count()


def test_presentation_log(spark, tmp_path):
    (tmp_path / "a.log").write_text("Scenario\tx\nLog\ty\n\nSubject\tTrial\tEvent Type\tCode\tTime\tTTime\n\nS1\t1\tPicture One\t12\t10004\t5\t1\t2500\t0\tnext\nS1\t2\tResponse\t1\t10016\nS1\tx\n")
    rows = readers.presentation_log(spark, str(tmp_path / "a.log")).orderBy("time_ms").collect()
    assert [(r.event_type, r.code, r.time_ms, r.ttime_ms, r.duration_ms, r.req_dur_ms) for r in rows] == [("Picture_One", "12", 1000, 1, 250, None), ("Response", "1", 1002, None, None, None)]


def test_psychopy_and_electrodes(spark, tmp_path):
    (tmp_path / "s01.csv").write_text("trial,rt\n1,0.5\n2,0.7\n")
    assert {(r.trial, r.session) for r in readers.psychopy_logs(spark, str(tmp_path / "*.csv"), "trial int, rt double").collect()} == {(1, "s01"), (2, "s01")}
    (tmp_path / "cap.sfp").write_text("Cz 0 0 1\nPz  0 -1 0.5\n")
    assert {r.label: r.z for r in readers.electrodes(spark, str(tmp_path / "cap.sfp")).collect()} == {"Cz": 1.0, "Pz": 0.5}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "cond string, cluster int, p double")
    place = str(tmp_path / "r")
    assert [readers.write_results(rows, place, ["cond"]) for _ in range(3)] == [1, 2, 3]
    assert readers.write_results(rows, place, ["cond"], iteration=2) == 2  # again: nothing is doubled
    assert [(r.iteration, r["count"]) for r in spark.read.parquet(place).groupBy("iteration").count().orderBy("iteration").collect()] == [(1, 2), (2, 2), (3, 2)]
    readers.write_clusters(rows, str(tmp_path / "c"))
    assert "cluster: 2" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "c")).collect())
