"""The main path as a stream: messages in, composed runs out, for as long as messages come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.functions import calendar as cal
from tagloom.operators.runs import composed
from tagloom.schemas import DEBOUNCE_SECONDS
from tagloom.streaming.readiness import readiness_stream


def start(log: DataFrame, frequencies: DataFrame, needs: DataFrame, required: DataFrame, definitions: DataFrame,
          target: str, checkpoint: str, schedule: cal.Schedule = cal.DEFAULT, available_now: bool = False) -> StreamingQuery:
    """Write the composed run of every readiness below ``target``.

    Each micro-batch owns a partition of the output and replaces it when it is repeated after a failure, so
    every run is written once. The trigger interval plays the part of the submit delay.
    """
    ready = readiness_stream(log, frequencies, needs, required, schedule)

    def write(batch: DataFrame, batch_id: int) -> None:
        tags = batch.join(definitions.select("tag_id", "sql", "started", "traced"), "tag_id")
        runs = composed(tags, F.to_date("ready_ts"), schedule)
        runs.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    trigger = {"availableNow": True} if available_now else {"processingTime": f"{DEBOUNCE_SECONDS} seconds"}
    return (
        ready.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**trigger).foreachBatch(write).start()
    )


def composed_rows(spark: SparkSession, target: str) -> DataFrame:
    """What the stream has written so far."""
    return spark.read.parquet(target)
