"""Streaming (inventory ST-01 to ST-05): telemetry roll-ups, late data, exactly-once evidence and monotone state. Incremental ingest is in `ingest`.

Batch and stream share one definition of each roll-up, so a stream that has read all its input gives the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.plans.shared import shared_dir


def timed(events: DataFrame) -> DataFrame:
    """Event time as TIMESTAMP, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """ST-02: count and sum by window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_evidence(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """ST-03: the first of rows with equal keys within the watermark, in a stream; of all rows, in a batch."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def monotone_status(events: DataFrame) -> DataFrame:
    """ST-04: per user the kinds of events seen so far, which only grow, and the events counted; one row at each change."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, n = state.get if state.exists else ("", 0)
        flags = set(filter(None, seen.split(",")))
        for f in frames:
            flags |= set(f["event_type"])
            n += len(f)
        state.update((",".join(sorted(flags)), n))
        yield pd.DataFrame({"user_id": [key[0]], "kinds": [",".join(sorted(flags))], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, kinds string, n long", "kinds string, n long", "update", GroupStateTimeout.NoTimeout)


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all input there is and returns what it wrote (to the shared folder)."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, n: int) -> None:
            batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/batch={n:06d}")

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; a file or a folder of files."""
    one = spark.read.parquet(f"{sf_dir}/events.parquet")
    return timed(spark.readStream.schema(one.schema).parquet(f"{sf_dir}/{'events.parquet'}*"))


def _events(spark, sf):
    return timed(spark.read.parquet(f"{sf}/events.parquet"))


def tumbling_window(spark, sf):
    return tumbling(_events(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def sliding_window(spark, sf):
    return sliding(_events(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def session_window(spark, sf):
    return sessions(_events(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def stream_monotone_status(spark, sf):
    """The last state of each user, from a stream."""
    rows = finished(monotone_status(event_stream(spark, sf).select("user_id", "event_type")), "status", "update")
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("kinds", "n").alias("kinds"))


def stream_distinct_evidence(spark, sf):
    """Users that appear, each once, by a stream with a watermark longer than the data."""
    return finished(distinct_evidence(event_stream(spark, sf).select("ts", "user_id"), ["user_id"], "400 days").select("user_id"), "distinct")


def stream_tumbling(spark, sf):
    """Windows that a stream has closed: all of the batch result that end before the watermark."""
    s = finished(tumbling(event_stream(spark, sf)), "tumbling")
    return s.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", "total")


QUERIES = {
    "tumbling_window": (tumbling_window, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"),
    "sliding_window": (sliding_window, "SELECT strftime(s, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT unnest([w, w - INTERVAL 1 DAY]) AS s FROM (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS w FROM events)) GROUP BY 1"),
    "session_window": (session_window, "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"),
    "stream_monotone_status": (stream_monotone_status, "SELECT user_id, count(*) AS n, array_to_string(list_sort(list_distinct(array_agg(event_type))), ',') AS kinds FROM events GROUP BY 1"),
    "stream_distinct_evidence": (stream_distinct_evidence, "SELECT DISTINCT user_id FROM events"),
    "stream_tumbling": (stream_tumbling, "SELECT strftime(d, '%Y-%m-%d') AS start, event_type, n, total FROM (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2) WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"),
}
