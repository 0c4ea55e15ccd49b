"""Queries of alignment, simulation and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import alignment
from millrace.plans.catalog import add
from millrace.plans.stats import rounded, table
from millrace.plans.trajectories import events
from millrace.sources.tables import shared_folder
from millrace.streaming import adaptive, kernels

SEQ = "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events"


@add(
    "batch_resample",
    f"""WITH s AS ({SEQ}), p AS (SELECT user_id, n, i AS position, i * (n - 1) / 19.0 AS w FROM (SELECT DISTINCT user_id, n FROM s), range(20) t(i)),
    j AS (SELECT p.user_id, position, w - floor(w + 1e-9) AS share, floor(w + 1e-9) AS k FROM p)
    SELECT j.user_id, position::INT AS position, round(a.value + CASE WHEN b.value IS NULL THEN 0 ELSE share * (b.value - a.value) END, 5) AS value FROM j JOIN s a ON a.user_id = j.user_id AND a.k = j.k LEFT JOIN s b ON b.user_id = j.user_id AND b.k = j.k + 1""",
)
def resample(spark, sf_dir):
    return rounded(alignment.resample(events(spark, sf_dir).select("user_id", "event_id", "value"), "user_id", "event_id", ["value"], 20), 5)


@add("find_reference_batch", "WITH l AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), m AS (SELECT quantile_cont(n, 0.5) AS m FROM l) SELECT user_id FROM l, m ORDER BY abs(n - m), n DESC, user_id LIMIT 1")
def reference(spark, sf_dir):
    return spark.createDataFrame([(alignment.find_average_length(table(spark, sf_dir, "events"), "user_id"),)], "user_id long")


@add("find_reference_batch_pca")
def central(spark, sf_dir):
    return spark.createDataFrame([(alignment.find_reference_batch(events(spark, sf_dir), "user_id", "event_id", ["value"]),)], "user_id long")


def visits(spark, sf_dir):
    """Each user's events in order, with the logarithm of the seconds since the one before."""
    before = F.lag("at").over(W.partitionBy("user_id").orderBy("event_id"))
    gap = F.coalesce(F.col("at") - before, F.lit(0.0))
    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return rows.select("user_id", "event_id", "value", F.log1p(F.abs(gap)).alias("gap"))


@add("batch_dtw")
def dtw(spark, sf_dir):
    """Users are batches of unequal lengths."""
    return alignment.batch_dtw(visits(spark, sf_dir), "user_id", "event_id", ["value", "gap"])[0]


def event_stream(spark, sf_dir):
    """The events as a stream from their files; the pattern names one table, which may be a file or a folder."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def to_the_end(spark, rows):
    """A stream read to its end into files of a new shared folder, and read from there."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.writeStream.format("parquet").option("path", f"{folder}/rows").outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@add("streaming_adaptive_pca")
def streaming(spark, sf_dir):
    rows = event_stream(spark, sf_dir).withColumn("a", F.col("value")).withColumn("b", F.col("value") * (1 + F.col("user_id") % 5)).select("event_type", "ts", "a", "b")
    return to_the_end(spark, adaptive.adaptive_pca(rows, "event_type", "ts", ["a", "b"], 1))


@add("streaming_adaptive_pls")
def streaming_pls(spark, sf_dir):
    """Two responses of a value, the time of day and the user, a model for each type of event."""
    hour = F.hour(F.col("ts").cast("timestamp")) + F.minute(F.col("ts").cast("timestamp")) / 60
    rows = event_stream(spark, sf_dir).select("event_type", "ts", "value", hour.cast("double").alias("hour"), (F.col("user_id") % 5).cast("double").alias("kind"))
    rows = rows.withColumn("total", F.col("value") * (1 + F.col("kind"))).withColumn("rest", 100 - F.col("value") + F.col("hour"))
    return to_the_end(spark, kernels.adaptive_pls(rows, "event_type", "ts", ["value", "hour", "kind"], ["total", "rest"], 2))


@add(
    "streaming_shewhart",
    """WITH w AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(value) AS n, avg(value) AS m, date_trunc('day', ts) + INTERVAL 1 DAY AS ends FROM events GROUP BY ALL)
    SELECT event_type, day, n, round(m, 6) AS mean, abs(m - 50) > 3 * 28 / sqrt(n) AS out_of_control FROM w WHERE ends <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def streaming_shewhart(spark, sf_dir):
    """Windows that the watermark has not passed are not closed, and so not among the rows."""
    source = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = to_the_end(spark, adaptive.windowed_shewhart(source, "event_type", "ts", "value", 50.0, 28.0, "1 day"))
    return rounded(rows.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "mean", "out_of_control"))
