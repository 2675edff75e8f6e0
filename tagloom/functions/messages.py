"""Expressions that read and write the JSON messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.schemas import FINISH_MESSAGE, PRODUCER_NAME, START_MESSAGE


def expand(rows: DataFrame, value: str, schema: T.StructType) -> DataFrame:
    """Add the fields of a JSON text as columns; all null where the text is not JSON.

    Goes through a generator so that the text is parsed once per row; as plain field accesses each field
    would be parsed for itself.
    """
    return rows.select("*", F.inline(F.array(F.from_json(value, schema))))


def is_complete(schema: T.StructType) -> Column:
    """Every field is there with its type, and every member of its lists."""
    there = [F.col(name).isNotNull() for name in schema.fieldNames()]
    members = [F.forall(f.name, lambda m: m.isNotNull()) for f in schema.fields if isinstance(f.dataType, T.ArrayType)]
    return reduce(lambda a, b: a & b, there + [F.coalesce(m, F.lit(False)) for m in members])


def need_message(key: Column) -> Column:
    """A message key in the shape of the start message's need list."""
    return F.struct(
        key["freq"].alias("update_frequency"), key["dbt"].alias("value"), key["part"].alias("partition_fields")
    )


def job_id(tag_id: Column, start_time: Column) -> Column:
    return F.concat_ws("_", tag_id, start_time)


def start_message(tag_id: Column, start_time: Column, need: Column) -> Column:
    return F.struct(
        F.lit(PRODUCER_NAME).alias("hippo_name"),
        tag_id.alias("job_name"),
        job_id(tag_id, start_time).alias("job_id"),
        F.transform(need, need_message).alias("need_msgs"),
        start_time.alias("start_time"),
    ).cast(START_MESSAGE)


def finish_message(tag_id: Column, frequency: Column, execute_date: Column, start_time: Column,
                   finish_time: Column, success: Column, received: Column) -> Column:
    return F.struct(
        F.lit(PRODUCER_NAME).alias("hippo_name"),
        tag_id.alias("job_name"),
        job_id(tag_id, start_time).alias("job_id"),
        frequency.alias("update_frequency"),
        execute_date.alias("execute_time"),
        (finish_time - start_time).alias("duration_time"),
        finish_time.alias("finish_time"),
        success.alias("is_success"),
        received.alias("receive_msgs"),
    ).cast(FINISH_MESSAGE)
