"""From raw partition-landed messages to the tags that wait for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import calendar as cal
from tagloom.functions.messages import expand, is_complete
from tagloom.operators.keys import key_join, split_join
from tagloom.schemas import DAILY, FINISH_TOPIC, FRONTIER, FRONTIER_TOPICS, KEY, MONTHLY

TAG_MESSAGE = ["event_id", "ts", "topic", *KEY, "pvalue", "finish_time"]


def on_frontier(raw: DataFrame, topics=FRONTIER_TOPICS, excluded=(FINISH_TOPIC,)) -> DataFrame:
    """Only the subscribed topics that are not our own output."""
    return raw.filter(F.col("topic").isin(*[t for t in topics if t not in excluded]))


def _dbt() -> Column:
    return F.concat("db", F.lit("."), "table")


def parsed(raw: DataFrame) -> DataFrame:
    """Frontier messages with their fields; those that are not valid JSON are left out."""
    fields = expand(raw, "value", FRONTIER).filter(is_complete(FRONTIER))
    return fields.select("event_id", "ts", "topic", *FRONTIER.fieldNames(), _dbt().alias("dbt"))


def with_frequency(messages: DataFrame, frequencies: DataFrame, how: str = "inner") -> DataFrame:
    """Attach the table's frequency; ``left`` keeps messages of unknown tables."""
    return messages.join(frequencies, "dbt", how)


def _unpartitioned() -> Column:
    return F.array_contains("partition_fields", "") | F.array_contains("partition_values", "")


def _first(name: str) -> Column:
    return F.get(F.col(name), F.lit(0))


def rejection(schedule: cal.Schedule = cal.DEFAULT) -> Column:
    """Why a message with a known or unknown frequency cannot be used; null when it can."""
    pair_missing = _first("partition_fields").isNull() | _first("partition_values").isNull()
    partitioned = (F.col("freq") == MONTHLY) | ~_unpartitioned()
    return (
        F.when(F.col("freq").isNull(), "unknown_table")
        .when(partitioned & pair_missing, "empty_partition")
        .when((F.col("freq") == DAILY) & ~_unpartitioned() & ~cal.is_month_text(_first("partition_values")), "bad_month")
    )


def normalise(messages: DataFrame, schedule: cal.Schedule = cal.DEFAULT, fixed_day: str | None = None) -> DataFrame:
    """Tag messages in the common shape: key, partition value and finish time.

    A daily table's month partition becomes the day it stands for on the arrival day. A daily message
    with an empty partition field or value is unpartitioned; a monthly message keeps its first pair
    as it is, empty or not.
    """
    day = cal.as_of(F.col("ts"), fixed_day)
    daily, bare = F.col("freq") == DAILY, _unpartitioned()
    real = cal.day_text(cal.month_to_date(_first("partition_values"), day, schedule))
    shape = F.struct(
        F.upper("freq").alias("freq"),
        F.col("dbt").alias("dbt"),
        F.when(~(daily & bare), _first("partition_fields")).alias("part"),
        F.when(daily & bare, F.lit(None)).when(daily, real).otherwise(_first("partition_values")).alias("pvalue"),
        F.col("exec_date").alias("finish_time"),
    )
    # through a generator, or every later filter would carry a copy of these expressions
    return messages.filter(rejection(schedule).isNull()).select("event_id", "ts", "topic", F.inline(F.array(shape)))


def tag_messages(raw: DataFrame, frequencies: DataFrame, schedule: cal.Schedule = cal.DEFAULT,
                 fixed_day: str | None = None) -> DataFrame:
    """The whole way: topic filter, parse, frequency, common shape."""
    return normalise(with_frequency(parsed(on_frontier(raw)), frequencies), schedule, fixed_day)


def quarantine(raw: DataFrame, frequencies: DataFrame, schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """Every frontier message that the normal path drops, with the reason."""
    fields = expand(on_frontier(raw).select("event_id", "value"), "value", FRONTIER)
    known = fields.withColumn("dbt", _dbt()).join(frequencies, "dbt", "left")
    reason = F.when(~is_complete(FRONTIER), "bad_json").otherwise(rejection(schedule))
    return known.select("event_id", "value", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _target(schedule: cal.Schedule, fixed_day: str | None) -> Column:
    """The partition value that satisfies a message's key on the day it arrives."""
    day = cal.as_of(F.col("ts"), fixed_day)
    return F.when(F.col("freq") == DAILY, cal.day_text(cal.daily_date(day, schedule))).otherwise(
        cal.last_month(day, schedule))


def counts(schedule: cal.Schedule = cal.DEFAULT, fixed_day: str | None = None) -> Column:
    """Whether a normalised message satisfies its key on the day it arrives.

    There is no watermark in the rule: a daily value equals the target of the day, a monthly one contains it
    (``20180801`` stands for 201808), or the message is ignored. Only daily messages may come without a
    partition.
    """
    bare = (F.col("freq") == DAILY) & F.col("part").isNull() & F.col("pvalue").isNull()
    target = _target(schedule, fixed_day)
    meets = F.when(F.col("freq") == MONTHLY, F.contains("pvalue", target)).otherwise(F.col("pvalue") == target)
    hit = F.col("part").isNotNull() & meets
    return bare | F.coalesce(hit, F.lit(False))


def miss_reason(schedule: cal.Schedule = cal.DEFAULT, fixed_day: str | None = None) -> Column:
    """Why a normalised message does not count; null when it counts."""
    value, bare, daily = F.col("pvalue"), F.col("part").isNull(), F.col("freq") == DAILY
    behind = value < _target(schedule, fixed_day)
    return (
        F.when(counts(schedule, fixed_day), F.lit(None).cast("string"))
        .when(bare & daily, "value_without_partition")
        .when(bare, "unpartitioned_monthly")
        .when(value.isNull(), "future_month")
        .when(behind, "behind_target")
        .otherwise("ahead_of_target")
    )


def counted(messages: DataFrame, schedule: cal.Schedule = cal.DEFAULT, fixed_day: str | None = None) -> DataFrame:
    """Messages that satisfy their key on the day they arrive."""
    return messages.filter(counts(schedule, fixed_day))


def ignored(messages: DataFrame, schedule: cal.Schedule = cal.DEFAULT, fixed_day: str | None = None) -> DataFrame:
    """The complement of ``counted``, with the reason."""
    return messages.withColumn("reason", miss_reason(schedule, fixed_day)).filter(F.col("reason").isNotNull())


def message_keys(messages: DataFrame) -> DataFrame:
    return messages.select("event_id", *KEY)


def message_views(messages: DataFrame) -> DataFrame:
    """Blank state (value and time absent) and display form of each message."""
    blank = F.struct(F.lit(None).cast("string").alias("topic"), *KEY, F.lit(None).cast("string").alias("pvalue"))
    return messages.select("event_id", blank.alias("blank"), shown().alias("shown"))


def shown() -> Column:
    """A message as the finish report lists it."""
    return F.struct(
        F.col("topic").alias("kafkaTopic"),
        F.col("freq").alias("update_frequency"),
        F.col("dbt").alias("value"),
        F.col("part").alias("partition_fields"),
        F.col("pvalue").alias("partition_values"),
        "finish_time",
    )


def route(messages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row per message and tag that needs it.

    A table may be needed by a third of all tags; its messages are cut into slices so that no task has
    to produce the whole product for that key.
    """
    return split_join(messages, dependencies, KEY, ["event_id"], ["tag_id"])


def without_subscriber(messages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Messages nobody needs."""
    return key_join(messages, dependencies.select(*KEY).distinct(), "left_anti")


def activations(messages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """First message that wakes each tag.

    Reduced to the first message per key before the fan-out, so the join sees one row per key.
    """
    first = messages.groupBy(*KEY).agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return (
        key_join(dependencies, first)
        .groupBy("tag_id")
        .agg(F.min("first").alias("first"))
        .select("tag_id", F.col("first.ts").alias("first_message_ts"), F.col("first.event_id").alias("event_id"))
    )
