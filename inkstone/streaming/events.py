"""Event streams: elapsed stages, feedback, windows, and postings of arriving documents.

All functions take a table or a stream; on a stream they keep bounded state by
watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.operators.retrieve import postings


def stages(events: DataFrame) -> DataFrame:
    """(thread_id, stage, started, seconds) of (thread_id, event, ts) by pairs of <stage>_start and <stage>_done.

    A done without a start before it is ignored, a start without done has no seconds.
    """
    marked = events.select("thread_id", "ts", F.regexp_extract("event", r"^(.*)_(start|done)$", 1).alias("stage"), F.regexp_extract("event", r"_(start|done)$", 1).alias("kind"))
    seq = Window.partitionBy("thread_id", "stage").orderBy("ts", F.col("kind").desc())
    paired = marked.where("kind <> ''").withColumn("next_kind", F.lead("kind").over(seq)).withColumn("next_ts", F.lead("ts").over(seq)).where("kind = 'start'")
    return paired.select("thread_id", "stage", F.col("ts").alias("started"), F.when(F.col("next_kind") == "done", F.expr("timestampdiff(MICROSECOND, ts, next_ts)") / 1e6).alias("seconds"))


def stream_stages(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``stages`` on a stream: starts joined with the dones of the same thread and stage within ``delay``."""
    marked = events.withWatermark("ts", delay).select("thread_id", "ts", F.regexp_extract("event", r"^(.*)_(start|done)$", 1).alias("stage"), F.regexp_extract("event", r"_(start|done)$", 1).alias("kind"))
    start = marked.where("kind = 'start'").select(F.col("thread_id").alias("t"), F.col("stage").alias("s"), F.col("ts").alias("started"))
    done = marked.where("kind = 'done'")
    return start.join(done, F.expr(f"thread_id = t and stage = s and ts >= started and ts <= started + interval {delay}")).select("thread_id", "stage", "started", (F.unix_micros("ts") - F.unix_micros("started")).alias("micros"))


def feedback_counts(feedbacks: DataFrame) -> DataFrame:
    """(verdict, n, commented): 1 is up, anything else down."""
    return feedbacks.groupBy(F.when(F.col("value") == 1, "up").otherwise("down").alias("verdict")).agg(F.count("*").alias("n"), F.count("comment").alias("commented"))


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type of event."""
    return sliding(events, width, width, delay)


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per sliding window and type of event."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", width) if width == slide else F.window("ts", width, slide)
    return t.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of users, ended by a gap without events."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return t.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event once, repeats within the watermark dropped."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return t.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if t.isStreaming else t.dropDuplicates(["event_id"])


def index_arrivals(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the postings of arriving (scope, item, text) to an index, each batch once."""

    def add(batch: DataFrame, epoch: int) -> None:
        postings(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
