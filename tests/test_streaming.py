"""Streams against their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import temporal as T
from chronopanel.streaming import hourly


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_hourly_features(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = drain(hourly.hourly_features(stream, "user_id", "ts", "value"), "hourly_features", "complete").count()
    assert got == events.groupBy("user_id", F.window("ts", "1 hour")).count().count()


def test_refractory(spark, tmp_path):
    rows = spark.createDataFrame([(1, h) for h in (1, 3, 6, 7, 12, 13, 20)] + [(2, 5)], "k long, h long")
    rows.coalesce(1).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "a"))
    got = sorted(map(tuple, drain(hourly.refractory_stream(stream, "k", "h", 6), "refractory_alerts", "append").collect()))
    assert got == sorted(map(tuple, T.refractory_alerts(rows, "k", "h", 6).collect()))
