"""Event streams with Structured Streaming, and the ledger of what a turn ran and cited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of a turn's events and their fields (fixed format of the stream).
EVENT = "type string, conversation long, turn long, seq long, call string, text string, source string, cited array<string>, url string"
KINDS = ("start", "call", "result", "url", "segment", "error", "end")


def read_turns(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """NDJSON events; a malformed line or an unknown type is an error."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(EVENT).option("mode", "FAILFAST").json(path)
    return rows.withColumn("type", F.when(F.col("type").isin(*KINDS), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce("type", F.lit("null"))))))


def decoded_props(events: DataFrame) -> DataFrame:
    """events with props (JSON text) as the column k."""
    return events.withColumn("k", F.from_json("props", "k int")["k"])


def call_ids(turns: DataFrame, part: str, order: list[str]) -> DataFrame:
    """q1, q2, ... within each part."""
    return turns.withColumn("call", F.concat(F.lit("q"), F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("string")))


def audited(segments: DataFrame, ran: DataFrame, keys: list[str]) -> DataFrame:
    """segments (keys, segment, source, cited) with label: model stays model; kb and web only where something is cited and all of it ran, else unverified.

    ran: (keys, call). The check is an anti join of exploded citations, so neither side is gathered.
    """
    each = segments.select(*keys, "segment", F.explode("cited").alias("call"))
    unknown = each.join(ran.select(*keys, "call").distinct(), [*keys, "call"], "left_anti").select(*keys, "segment").distinct().withColumn("__bad", F.lit(True))
    joined = segments.join(unknown, [*keys, "segment"], "left")
    good = F.col("__bad").isNull() & (F.size(F.coalesce("cited", F.array().cast("array<string>"))) > 0)
    return joined.withColumn("label", F.when(F.col("source") == "model", "model").when(F.col("source").isin("kb", "web") & good, F.col("source")).otherwise("unverified")).drop("__bad")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows; on a stream, state older than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("started"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows of each user, on a stream or a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "user_id", "n")
