"""The log of partition-landed messages, as a table or as a stream.

Both give (event_id, ts, topic, value): offset, arrival time, topic and JSON text. A stream confirms its
offsets in the checkpoint after the work is done, so a crash repeats messages and loses none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.schemas import FRONTIER_TOPICS

LOG_SCHEMA = "event_id long, ts timestamp_ntz, topic string, value string"


def kafka_options(servers: str, topics=FRONTIER_TOPICS, per_trigger: int = 5_000_000) -> dict[str, str]:
    """Subscription from the earliest offset; a micro-batch takes a bounded number of messages."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": str(per_trigger),
    }


def from_kafka(rows: DataFrame, topics=FRONTIER_TOPICS) -> DataFrame:
    """Kafka's own columns in the common shape. An offset is unique only in its partition, so the id holds all
    three: offset, then place of the topic in the subscription (16 at most), then partition (65,536 at most)."""
    place = F.array_position(F.lit(list(topics)), F.col("topic"))
    return rows.select(
        (F.shiftleft("offset", 20) + F.shiftleft(place.cast("long"), 16) + F.col("partition")).alias("event_id"),
        F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        "topic",
        F.col("value").cast("string").alias("value"),
    )


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(LOG_SCHEMA).load(path)


def stream_log(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.format(fmt).schema(LOG_SCHEMA)
        .option("maxFilesPerTrigger", str(files_per_trigger)).load(path)
    )


def stream_kafka(spark: SparkSession, servers: str, topics=FRONTIER_TOPICS) -> DataFrame:
    """Needs the Kafka connector on the classpath."""
    return from_kafka(spark.readStream.format("kafka").options(**kafka_options(servers, topics)).load(), topics)
