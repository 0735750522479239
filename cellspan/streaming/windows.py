"""Event-time windows; the same plans run on a batch and, under a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a zoned timestamp, as watermarks need."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream of Parquet files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _aggregated(df: DataFrame, window, *keys: str) -> DataFrame:
    out = df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("until"), *keys, "n", "mean")


def tumbling(df: DataFrame, size: str = "1 day") -> DataFrame:
    return _aggregated(df, F.window("ts", size), "event_type")


def sliding(df: DataFrame, size: str = "12 hours", step: str = "6 hours") -> DataFrame:
    return _aggregated(df, F.window("ts", size, step), "event_type")


def sessions(df: DataFrame, gap: str = "4 hours") -> DataFrame:
    return _aggregated(df, F.session_window("ts", gap), "user_id")


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First arrival of each event_id within the watermark; later ones are late and dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def asof_static(df: DataFrame, static: DataFrame, value: str, by: str = "user_id", on: str = "ts") -> DataFrame:
    """df (a batch or a stream) with the static row of its key that was last in force: static has `since` and `until` (null:
    still), so the join is one of equality and a filter, which a stream can have without state."""
    own = static.select(F.col(by).alias("__key"), "since", "until", value)
    inside = (F.col("since") <= F.col(on)) & (F.col("until").isNull() | (F.col(on) < F.col("until")))
    return df.join(own, (F.col(by) == F.col("__key")) & inside, "left").drop("__key", "since", "until")


def in_force(changes: DataFrame, by: str = "user_id", at: str = "ts") -> DataFrame:
    """Rows of changes with the time from (since) and to (until) which they hold."""
    w = Window.partitionBy(by).orderBy(at, "event_id")
    return changes.withColumns({"since": F.col(at), "until": F.lead(at).over(w)}).where(F.col("until").isNull() | (F.col("until") > F.col("since")))


TUMBLING_SQL = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS until, event_type, count(*) AS n, round(avg(value), 7) AS mean FROM events GROUP BY ALL"
SLIDING_SQL = """WITH x AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - unnest([0, 1]) * INTERVAL 6 HOUR AS start, event_type, value FROM events)
SELECT start, start + INTERVAL 12 HOUR AS until, event_type, count(*) AS n, round(avg(value), 7) AS mean FROM x GROUP BY ALL"""
SESSION_SQL = """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS until, user_id, count(*) AS n, round(avg(value), 7) AS mean FROM s GROUP BY user_id, g"""
