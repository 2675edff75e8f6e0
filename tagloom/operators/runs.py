"""Composed runs, their reports, attempts and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import calendar as cal
from tagloom.functions import messages as msg
from tagloom.functions import text
from tagloom.operators.keys import split_join
from tagloom.schemas import (
    ATTEMPTS, COMPOSED_FIELDS, DAILY, DEBOUNCE_SECONDS, FINISH, KEY, MONTHLY, NON_FINISH, START,
)


def composed(tags: DataFrame, day: Column, schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """Add window, status and final SQL. Text that asks for a window the tag does not have is an error row."""
    status = text.compose_status(F.col("sql"), F.col("started"), F.col("traced"))
    return (
        tags.withColumn("status", status)
        .withColumn("_start", F.when(F.col("status") == "dated", cal.window_start(
            F.col("update_frequency"), day, F.col("started"), schedule)))
        .withColumn("_end", cal.window_end(F.col("update_frequency"), F.col("_start"), F.col("traced")))
        .withColumn("start_date", cal.day_text(F.col("_start")))
        .withColumn("end_date", cal.day_text(F.col("_end")))
        .withColumn("sql", F.when(F.col("status") != "error", text.fill_window(
            F.col("sql"), F.col("start_date"), F.col("end_date"))))
        .drop("_start", "_end")
    )


def composed_runs(dictionary: DataFrame, day: Column, schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """Dictionary rows as 15-column runs for the as-of day; rows that cannot be composed are left out."""
    ready = composed(dictionary.withColumn("update_frequency", F.upper("update_frequency")), day, schedule)
    return ready.filter(F.col("status") != "error").withColumn("execute_date", cal.day_text(day)).select(
        *COMPOSED_FIELDS
    )


def compose_errors(dictionary: DataFrame) -> DataFrame:
    """Tags whose SQL asks for a window but that define none."""
    status = text.compose_status(F.col("sql"), F.col("started"), F.col("traced"))
    return dictionary.filter(status == "error")


def run_file_name(tag_id: Column, execute_date: Column) -> Column:
    return F.concat_ws("_", tag_id, execute_date)


RUN = ["tag_id", "execute_date"]  # what names a run, in its file and in its reports


def outcomes(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Each report with its run."""
    return runs.join(reports, RUN)


def pending(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Runs that have not succeeded; those are kept in the spool, the others are cleared."""
    return runs.join(reports.filter(F.col("status") == FINISH), RUN, "left_anti")


def durations(reports: DataFrame) -> DataFrame:
    """Run time in whole seconds, per tag."""
    seconds = F.col("finish_time") - F.col("start_time")
    return reports.filter(F.col("status") == FINISH).groupBy("tag_id").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.min(seconds).alias("min_seconds"),
        F.max(seconds).alias("max_seconds"),
        F.sum(seconds).alias("sum_seconds"),
    )


def retry_accounting(reports: DataFrame, slice_width: int = 100_000) -> DataFrame:
    """For every failed attempt: which attempt it was, and whether the tag is retried or given up.

    The counter is the number of failures since the tag's last success, modulo the allowed attempts.
    One tag may own a third of all reports, so no window spans a whole tag: the reports are numbered
    inside slices of ``seq`` (``slice_width`` rows of a tag at most) and each slice starts from the
    count carried out of the earlier ones.
    """
    rows = reports.filter(F.col("status").isin(FINISH, NON_FINISH)).select(
        "tag_id", "seq",
        (F.col("status") == FINISH).cast("int").alias("done"),
        F.floor(F.col("seq") / slice_width).alias("slice"),
    )
    inside = Window.partitionBy("tag_id", "slice").orderBy("seq")
    numbered = (
        rows.withColumn("failures", F.sum(1 - F.col("done")).over(inside))
        .withColumn("at_success", F.max(F.when(F.col("done") == 1, F.col("failures"))).over(inside))
        .withColumn("failed", F.col("failures") - F.coalesce("at_success", F.lit(0)))
        .withColumn("reset", F.col("at_success").isNotNull())
    )
    # one row per slice: whether it has a success, and the failures after the last one
    earlier = Window.partitionBy("tag_id").orderBy("slice")
    carried = (
        numbered.groupBy("tag_id", "slice").agg(F.max(F.struct("seq", "reset", "failed")).alias("end"))
        .withColumn("era", F.sum(F.col("end.reset").cast("int")).over(earlier))
        .withColumn("run", F.sum("end.failed").over(Window.partitionBy("tag_id", "era").orderBy("slice")))
        .select("tag_id", "slice", F.coalesce(F.lag("run").over(earlier), F.lit(0)).alias("carry"))
    )
    count = F.col("failed") + F.when(F.col("reset"), 0).otherwise(F.col("carry"))
    attempt = (F.pmod(count - 1, F.lit(ATTEMPTS)) + 1).cast("int")
    return (
        numbered.filter(F.col("done") == 0)
        .join(carried, ["tag_id", "slice"])
        .withColumn("attempt", attempt)
        .select("tag_id", "seq", "attempt",
                F.when(F.col("attempt") == ATTEMPTS, "give_up").otherwise("retry").alias("action"))
    )


def give_ups(reports: DataFrame, slice_width: int = 100_000) -> DataFrame:
    """The failed attempts after which a tag is given up for this cycle."""
    return retry_accounting(reports, slice_width).filter(F.col("action") == "give_up")


def schedule_batches(requests: DataFrame, key: str, gap_seconds: int = DEBOUNCE_SECONDS,
                     slice_seconds: int = 600, times: str | None = None) -> DataFrame:
    """Requests submitted together: a batch closes when no request came for the gap. A row stands for one request, or for
    as many as its column ``times`` says.

    There are few keys, so a key's requests are counted per moment and cut into slices of time. Sessions inside a slice that
    touch neither its first nor its last request are final; only the two outer ones of each slice are
    looked at again across slices.
    """
    gap, width = gap_seconds * 1_000_000, slice_seconds * 1_000_000
    moments = requests.groupBy(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(
        (F.sum(times) if times else F.count(F.lit(1))).alias("n"))
    rows = moments.withColumn("slice", F.floor(F.col("us") / width))
    inside = Window.partitionBy(key, "slice").orderBy("us")
    opens = (F.col("us") - F.lag("us").over(inside) >= gap).cast("int")
    sessions = (
        rows.withColumn("opens", F.coalesce(opens, F.lit(0)))
        .withColumn("session", F.sum("opens").over(inside))
        .groupBy(key, "slice", "session")
        .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("n").alias("n"))
    )
    last = F.max("session").over(Window.partitionBy(key, "slice"))
    sessions = sessions.withColumn("inner", (F.col("session") > 0) & (F.col("session") < last))
    final = sessions.filter("inner").select(key, "first_us", "last_us", "n")
    across = Window.partitionBy(key).orderBy("first_us")
    apart = (F.col("first_us") - F.lag("last_us").over(across) >= gap).cast("int")
    merged = (
        sessions.filter(~F.col("inner"))
        .withColumn("opens", F.coalesce(apart, F.lit(0)))
        .withColumn("batch", F.sum("opens").over(across))
        .groupBy(key, "batch")
        .agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"))
        .drop("batch")
    )
    return final.unionByName(merged).withColumn("submit_us", F.col("last_us") + gap)


def ignored_while_running(messages: DataFrame, dependencies: DataFrame, runs: DataFrame,
                          bucket_seconds: int = 600) -> DataFrame:
    """(event_id, tag_id) of messages that arrive while the tag is running and so are not counted.

    ``runs`` has ``start_time`` and ``finish_time`` in epoch seconds. Each run is placed into the time
    buckets it touches, which makes the interval condition an equi-join on key and bucket; messages are
    never routed to tags that are idle.
    """
    span = F.sequence(F.floor(F.col("start_time") / bucket_seconds), F.floor(F.col("finish_time") / bucket_seconds))
    busy = runs.select("tag_id", "start_time", "finish_time", F.explode(span).alias("bucket")).join(
        dependencies.select("tag_id", *KEY), "tag_id")
    arrived = messages.select("event_id", "ts", *KEY).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn(
        "bucket", F.floor(F.col("us") / (bucket_seconds * 1_000_000)))
    # a table that a third of the tags need meets every running one of them
    met = split_join(arrived, busy, [*KEY, "bucket"], ["event_id"], ["tag_id"])
    within = (F.col("us") >= F.col("start_time") * 1_000_000) & (F.col("us") < F.col("finish_time") * 1_000_000)
    return met.filter(within).select("event_id", "tag_id").distinct()


def reset_after_success(reports: DataFrame, dependencies: DataFrame, schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """What each success clears: (tag_id, seq, key, cleared, remembered).

    A daily tag with both sides keeps its monthly flags; any other tag loses all. A monthly tag
    remembers the month it ran for.
    """
    both = dependencies.groupBy("tag_id").agg((F.countDistinct("freq") == 2).alias("both"))
    month = cal.last_month(F.to_date(F.timestamp_seconds("finish_time")), schedule)
    done = reports.filter(F.col("status") == FINISH).select("tag_id", "seq", month.alias("month"))
    cleared = ~((F.col("update_frequency") == DAILY) & F.col("both") & (F.col("freq") == MONTHLY))
    return done.join(dependencies, "tag_id").join(both, "tag_id").select(
        "tag_id", "seq", *KEY, cleared.alias("cleared"),
        F.when(F.col("update_frequency") == MONTHLY, F.col("month")).alias("remembered"),
    )


def reset_after_give_up(reports: DataFrame, dependencies: DataFrame, slice_width: int = 100_000) -> DataFrame:
    """What each give-up clears: the daily flags; monthly flags and the remembered month stay."""
    return give_ups(reports, slice_width).select("tag_id", "seq").join(dependencies, "tag_id").select(
        "tag_id", "seq", *KEY, (F.col("freq") == DAILY).alias("cleared")
    )


def start_messages(reports: DataFrame, required: DataFrame) -> DataFrame:
    """A start message per started run, with the keys its tag needs (a tag that needs nothing has none)."""
    started = reports.filter(F.col("status") == START).join(required.select("tag_id", "need"), "tag_id")
    message = msg.start_message(F.col("tag_id"), F.col("start_time"), F.col("need"))
    return started.select("tag_id", "seq", message.alias("message"))


def received_lists(held: DataFrame, schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """(need_id, run_day, received): per requirement set and day it became ready the messages that its run held.

    Equal messages are one entry, in order of first arrival, so a list is bounded by the set's keys and the finish times
    they came with. ``held`` comes from ``received_until_ready``. Lists are made per set, not per tag.
    """
    entry = F.struct(
        F.col("topic").alias("kafkaTopic"), F.col("freq").alias("update_frequency"), F.col("dbt").alias("value"),
        F.col("part").alias("partition_fields"), F.col("pvalue").alias("partition_values"), "finish_time",
    )
    first = F.min(F.struct("ts", "event_id")).alias("first")
    once = held.select("need_id", cal.cycle_day(F.col("ready_ts"), schedule).alias("run_day"), entry.alias("entry"), "ts", "event_id").groupBy(
        "need_id", "run_day", "entry").agg(first)
    listed = F.sort_array(F.collect_list(F.struct("first", "entry")))
    return once.groupBy("need_id", "run_day").agg(F.transform(listed, lambda m: m["entry"]).alias("received"))


def finish_messages(reports: DataFrame, registered: DataFrame, required: DataFrame, received: DataFrame,
                    slice_width: int = 100_000, schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """A finish message per success and per give-up, with what that run held. ``registered`` gives each tag's
    frequency, ``required`` its requirement set; a report belongs to the run of the day it started on."""
    failed = give_ups(reports, slice_width).select("tag_id", "seq")
    ended = (
        reports.filter(F.col("status") == FINISH).withColumn("is_success", F.lit(True))
        .unionByName(reports.join(failed, ["tag_id", "seq"], "left_semi").withColumn("is_success", F.lit(False)))
    )
    started = F.timestamp_seconds("start_time").cast("timestamp_ntz")
    rows = (
        ended.withColumn("run_day", cal.cycle_day(started, schedule))
        .join(registered.select("tag_id", "update_frequency"), "tag_id")
        .join(required.select("tag_id", "need_id"), "tag_id", "left").join(received, ["need_id", "run_day"], "left")
    )
    nothing = F.array().cast(received.schema["received"].dataType)
    message = msg.finish_message(
        F.col("tag_id"), F.col("update_frequency"), cal.day_text(F.to_date(F.timestamp_seconds("finish_time"))),
        F.col("start_time"), F.col("finish_time"), F.col("is_success"), F.coalesce("received", nothing))
    return rows.select("tag_id", "seq", message.alias("message"))
