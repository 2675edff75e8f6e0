"""The main path as a stream with everything in it: messages, run reports and changed definitions in; runs to launch, start
and finish messages, transitions, reports of unfinished tags and late rows out, as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.functions import calendar as cal
from tagloom.functions import messages as msg
from tagloom.operators.runs import composed
from tagloom.schemas import DEBOUNCE_SECONDS, FINISH_MESSAGE
from tagloom.session import FREED, settings
from tagloom.sources import sinks
from tagloom.streaming import live

KEYS = "array<struct<freq:string,dbt:string,part:string>>"
STARTED = f"start_time long, need {KEYS}"
FINISHED = ("start_time long, finish_time long, is_success boolean, "
            f"received {FINISH_MESSAGE['receive_msgs'].dataType.simpleString()}")
LATE = "watermark long, row string"


def to_launch(acts: DataFrame, definitions: DataFrame, schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """The composed run of every readiness and of every new attempt; the as-of day is that of the row that caused it. A tag
    without a definition keeps its row, with the status ``undefined``."""
    due = acts.filter((F.col("kind") == "transition") & F.col("reason").isin("ready", "retry"))
    rows = due.select("tag_id", "update_frequency", "cycle", "reason", "event_id", "ts").join(
        definitions.select("tag_id", "sql", "started", "traced"), "tag_id", "left").withColumn("unknown", F.col("sql").isNull())
    return composed(rows, F.to_date("ts"), schedule).withColumn(
        "status", F.when(F.col("unknown"), "undefined").otherwise(F.col("status"))).drop("unknown")


def _said(acts: DataFrame, kind: str, fields: str) -> DataFrame:
    return acts.filter(F.col("kind") == kind).select("tag_id", "event_id", "ts", "update_frequency", F.from_json("body", fields).alias("b")).select(
        "tag_id", "event_id", "ts", "update_frequency", "b.*")


def start_messages(acts: DataFrame) -> DataFrame:
    message = msg.start_message(F.col("tag_id"), F.col("start_time"), F.col("need"))
    return _said(acts, "start", STARTED).select("tag_id", "event_id", message.alias("message"))


def finish_messages(acts: DataFrame) -> DataFrame:
    """One per success and per give-up, with the distinct messages that the run held."""
    message = msg.finish_message(
        F.col("tag_id"), F.col("update_frequency"), cal.day_text(F.to_date(F.timestamp_seconds("finish_time"))),
        F.col("start_time"), F.col("finish_time"), F.col("is_success"), F.col("received"))
    return _said(acts, "finish", FINISHED).select("tag_id", "event_id", message.alias("message"))


def late_rows(acts: DataFrame) -> DataFrame:
    """Rows behind the watermark: where they came from, what they were, and the watermark that had passed them."""
    rows = acts.filter(F.col("kind") == "late").withColumn("b", F.from_json("body", LATE))
    return rows.select(F.col("reason").alias("source"), "event_id", "tag_id", "ts",
                       F.timestamp_micros("b.watermark").alias("watermark"), F.col("b.row").alias("row"))


def unfinished_rows(acts: DataFrame) -> DataFrame:
    """Shortly before each cutoff: awake tags and the tables that they still wait for. A report's number is its day's."""
    return acts.filter(F.col("kind") == "unfinished").select(
        "tag_id", F.date_from_unix_date(F.col("event_id").cast("int")).alias("report_day"), F.col("ts").alias("report_ts"),
        F.array_join(F.from_json("body", "array<string>"), ",").alias("missing"))


TABLES = ("actions", "runs", "start", "finish", "late", "unfinished")


def start(inputs: DataFrame, initial: DataFrame, definitions: Callable[[], DataFrame], target: str, checkpoint: str,
          schedule: cal.Schedule = cal.DEFAULT, available_now: bool = False, slices: int = live.SLICES) -> StreamingQuery:
    """Run the tags and write six tables below ``target``.

    A micro-batch owns one partition of each and replaces it when it is repeated after a failure, so every row is
    written once. What the batch did is written first and read back for the others. ``definitions`` is asked in each
    batch, so that a run is launched with the dictionary's present text.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def put(rows: DataFrame, name: str) -> None:
            rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")

        put(batch, "actions")
        acts = spark.read.schema(batch.schema).parquet(f"{target}/actions/batch={batch_id}")
        put(to_launch(acts, definitions(), schedule), "runs")
        put(sinks.start_rows(start_messages(acts), F.col("message")), "start")
        put(sinks.finish_rows(finish_messages(acts), F.col("message")), "finish")
        put(late_rows(acts), "late")
        put(unfinished_rows(acts), "unfinished")

    trigger = {"availableNow": True} if available_now else {"processingTime": f"{DEBOUNCE_SECONDS} seconds"}
    # a slice has a partition of its own, and there are no empty ones, which would take their time in each micro-batch
    with settings(inputs.sparkSession, dict([live.AHEAD]) | {"spark.sql.shuffle.partitions": str(slices), FREED: "true"}):
        return (
            live.actions(inputs, initial, slices, schedule).writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(write).start()
        )


def written(spark: SparkSession, target: str, name: str) -> DataFrame:
    """One of the tables so far."""
    return spark.read.parquet(f"{target}/{name}").drop("batch")
