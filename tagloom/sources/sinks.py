"""Where runs and messages are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.codecs import to_text
from tagloom.operators.runs import run_file_name
from tagloom.schemas import COMPOSED_FIELDS, FINISH_TOPIC, PRODUCER_KEY, START_TOPIC


def spool_rows(runs: DataFrame) -> DataFrame:
    """Composed runs as spooled: name and compact JSON."""
    return runs.select(
        "execute_date",
        run_file_name(F.col("tag_id"), F.col("execute_date")).alias("name"),
        to_text(F.struct(*COMPOSED_FIELDS)).alias("value"),
    )


def write_runs(runs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One table partitioned by execute date in place of one file per run; a rerun of a day replaces it."""
    (
        runs.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("execute_date").save(path)
    )


def message_rows(rows: DataFrame, topic: str, message: Column) -> DataFrame:
    """Kafka-shaped rows of a message struct."""
    return rows.select(
        F.lit(topic).alias("topic"),
        F.lit(PRODUCER_KEY).alias("key"),
        to_text(message).alias("value"),
    )


def start_rows(rows: DataFrame, message: Column) -> DataFrame:
    return message_rows(rows, START_TOPIC, message)


def finish_rows(rows: DataFrame, message: Column) -> DataFrame:
    return message_rows(rows, FINISH_TOPIC, message)


def write_messages(rows: DataFrame, target: str, fmt: str = "kafka") -> None:
    """To Kafka (``target`` names the servers) or, appended, to files."""
    if fmt == "kafka":
        rows.write.format("kafka").option("kafka.bootstrap.servers", target).save()
    else:
        rows.write.format(fmt).mode("append").save(target)
