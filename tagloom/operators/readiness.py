"""Which tags have all their inputs, and when.

Flags live in cycles: a daily key's flag from one cutoff to the next, a monthly key's flag until the
cutoff of the reset day. Within a cycle only the first arrival of a key matters, so messages are reduced
to one row per key and cycle before anything is joined (a partial aggregate, so a table that sends a third
of all messages costs no more than the others). Tags with equal requirement sets share one history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import calendar as cal
from tagloom.operators.keys import key_join, split_join
from tagloom.operators.routing import counted, counts
from tagloom.schemas import DAILY, KEY, MONTHLY
from tagloom.session import stable

CYCLES = 400  # cycles a key commonly has in a log, a year of days and months; shapes slices only


def first_arrivals(messages: DataFrame, schedule: cal.Schedule = cal.DEFAULT,
                   fixed_day: str | None = None) -> DataFrame:
    """(key, cycle, first_ts) over the messages that count; a repeated message changes nothing."""
    return (
        counted(messages, schedule, fixed_day)
        .withColumn("cycle", cal.cycle(F.col("freq"), F.col("ts"), schedule))
        .groupBy(*KEY, "cycle")
        .agg(F.min("ts").alias("first_ts"))
    )


def received(arrivals: DataFrame, dependencies: DataFrame) -> DataFrame:
    """First arrival per (tag, key, cycle)."""
    return split_join(dependencies, arrivals, KEY, ["tag_id"], ["cycle"], right_rows=CYCLES).select(
        "tag_id", *KEY, "cycle", "first_ts")


def sides(arrivals: DataFrame, needs: DataFrame) -> DataFrame:
    """(need_id, freq, cycle) in which one whole side of a requirement set has arrived, and when."""
    needed = F.when(F.col("freq") == DAILY, F.col("n_daily")).otherwise(F.col("n_monthly"))
    return (
        split_join(needs, arrivals, KEY, ["need_id"], ["cycle"], right_rows=CYCLES)
        .groupBy("need_id", "freq", "cycle", "n_daily", "n_monthly")
        .agg(F.count(F.lit(1)).alias("n"), F.max("first_ts").alias("done_ts"))
        .filter(F.col("n") == needed)
        .drop("n")
    )


def ready_needs(arrivals: DataFrame, needs: DataFrame, schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """First readiness of every requirement set in every cycle.

    Sets with daily keys are ready once per daily cycle at most, sets with monthly keys only once per
    monthly cycle. A mixed set also needs its monthly side complete by then. A monthly cycle has at most
    31 daily ones, so the two sides meet in one bounded group per set and month.
    """
    month = F.when(F.col("freq") == DAILY, cal.last_month(F.try_to_date("cycle", "yyyy-MM-dd"), schedule))
    days = F.collect_list(F.when(F.col("freq") == DAILY, F.struct("cycle", F.col("done_ts").alias("ready_ts"))))
    merged = (
        sides(arrivals, needs)
        .withColumn("month", F.coalesce(month, F.col("cycle")))
        .groupBy("need_id", "n_daily", "n_monthly", "month")
        .agg(days.alias("days"), F.max(F.when(F.col("freq") == MONTHLY, F.col("done_ts"))).alias("tm"))
    )
    tm = F.col("tm")
    whole_month = F.array(F.struct(F.col("month").alias("cycle"), tm.alias("ready_ts")))
    in_time = F.filter("days", lambda d: cal.cycle_day(tm, schedule) <= F.to_date(d["cycle"]))
    both = F.transform(in_time, lambda d: F.struct(d["cycle"].alias("cycle"), F.greatest(d["ready_ts"], tm).alias("ready_ts")))
    ready = (
        F.when(F.col("n_monthly") == 0, F.col("days"))
        .when(F.col("n_daily") == 0, whole_month)
        .when(tm.isNotNull(), both)
    )
    return merged.select("need_id", F.explode(ready).alias("ready")).select("need_id", "ready.*")


def ready_tags(ready: DataFrame, required: DataFrame, schedule: cal.Schedule = cal.DEFAULT,
               guard: bool = True) -> DataFrame:
    """Readiness of the sets handed to their tags: (tag_id, update_frequency, cycle, ready_ts, target_month)."""
    timed = timed_needs(ready, schedule, guard)
    tags = required.select("tag_id", "update_frequency", "need_id")
    return split_join(tags, timed, ["need_id", "update_frequency"], ["tag_id"], ["cycle"], right_rows=CYCLES).select(
        "tag_id", "update_frequency", "cycle", "ready_ts", "target_month"
    )


def ready_counts(ready: DataFrame, required: DataFrame, schedule: cal.Schedule = cal.DEFAULT, guard: bool = True) -> DataFrame:
    """(update_frequency, ready_ts, n): how many tags become ready with a set, without a row per tag."""
    sizes = required.groupBy("need_id", "update_frequency").agg(F.count(F.lit(1)).alias("n"))
    return timed_needs(ready, schedule, guard).join(sizes, ["need_id", "update_frequency"]).select("update_frequency", "ready_ts", "n")


def timed_needs(ready: DataFrame, schedule: cal.Schedule = cal.DEFAULT, guard: bool = True) -> DataFrame:
    """When tags of either frequency become ready with a set: (need_id, target_month, update_frequency, cycle, ready_ts).

    With ``guard`` a monthly tag is ready once per target month. The guard is applied per set (a set is
    ready once a day at most, so a group here has some 31 rows), before the fan-out to tags.
    """
    moment = F.struct("ready_ts", "cycle")
    per_month = (
        ready.withColumn("target_month", cal.last_month(F.to_date("ready_ts"), schedule))
        .groupBy("need_id", "target_month").agg(F.collect_list(moment).alias("all"))
    )

    def as_rows(frequency: str, moments: Column) -> Column:
        return F.transform(moments, lambda m: F.struct(F.lit(frequency).alias("update_frequency"), m["cycle"].alias("cycle"),
                                                       m["ready_ts"].alias("ready_ts")))

    first = F.array(F.array_min("all")) if guard else F.col("all")
    rows = F.explode(F.concat(as_rows(DAILY, F.col("all")), as_rows(MONTHLY, first))).alias("r")
    return per_month.select("need_id", "target_month", rows).select("need_id", "target_month", "r.*")


def flags_at(moment: Column, dependencies: DataFrame, messages: DataFrame,
             schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """State at a moment, for the cycles it falls in: (tag_id, key, satisfied, first_ts, pvalue, finish_time)
    with the last finish time seen."""
    present = (
        counted(messages.filter(F.col("ts") <= moment), schedule)
        .filter(cal.cycle(F.col("freq"), F.col("ts"), schedule) == cal.cycle(F.col("freq"), moment, schedule))
        .groupBy(*KEY)
        .agg(F.min("ts").alias("first_ts"), F.max("pvalue").alias("pvalue"), F.max("finish_time").alias("finish_time"))
    )
    return key_join(dependencies, present, "left").withColumn("satisfied", F.col("first_ts").isNotNull())


def is_ready(flags: DataFrame) -> DataFrame:
    """Per tag: all daily flags true and all monthly flags true; an empty side counts as true."""
    def side(freq: str) -> Column:
        return F.coalesce(F.bool_and(F.when(F.col("freq") == freq, F.col("satisfied"))), F.lit(True))

    return flags.groupBy("tag_id").agg((side(DAILY) & side(MONTHLY)).alias("is_ready"))


def monthly_clear(flags: DataFrame) -> DataFrame:
    """Per tag: no monthly flag is true, so the tag may stop."""
    any_monthly = F.bool_or(F.when(F.col("freq") == MONTHLY, F.col("satisfied")))
    return flags.groupBy("tag_id").agg((~F.coalesce(any_monthly, F.lit(False))).alias("monthly_clear"))


def carry_over(flags: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Requirement change: flags of keys still needed are kept, new keys start false."""
    kept = flags.select("tag_id", *KEY, "satisfied")
    return key_join(dependencies, kept, "left", ["tag_id", *KEY]).withColumn(
        "satisfied", F.coalesce("satisfied", F.lit(False))
    )


def stale_reset(flags: DataFrame, day: Column, schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """On revival a flag survives only if its value is the day's target; unpartitioned flags stay."""
    target = F.when(F.col("freq") == DAILY, cal.day_text(cal.daily_date(day, schedule))).otherwise(
        cal.last_month(day, schedule)
    )
    survives = F.col("pvalue").isNull() | (F.col("pvalue") == target)
    return flags.withColumn("revived", F.when(survives, F.col("satisfied")).otherwise(F.lit(False)))


def cutoff_resets(messages: DataFrame, schedule: cal.Schedule) -> DataFrame:
    """For each message the cycles its flag lives in and which sides the closing cutoff clears."""
    close = cal.cycle_close(F.col("ts"), schedule)
    return messages.withColumn("as_of", F.to_date("ts")).withColumn("cycle_close", close).withColumn(
        "cycle_month", cal.cycle_month(F.col("ts"), schedule)
    ).withColumn("cleared", F.when(cal.is_reset_day(close, schedule), "both").otherwise("daily"))


def active(moment: Column, messages: DataFrame, dependencies: DataFrame,
           schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """Tags awake at a moment: woken by any message since the last cutoff, or kept awake over it by a
    monthly flag of the present monthly cycle."""
    today = cal.cycle_day(F.col("ts"), schedule) == cal.cycle_day(moment, schedule)
    held = (
        (F.col("freq") == MONTHLY) & counts(schedule)
        & (cal.cycle_month(F.col("ts"), schedule) == cal.cycle_month(moment, schedule))
    )
    keys = messages.filter((F.col("ts") <= moment) & (today | held)).select(*KEY).distinct()
    return key_join(dependencies, keys, "left_semi").select("tag_id").distinct()


def unfinished(messages: DataFrame, required: DataFrame, needs: DataFrame, schedule: cal.Schedule,
               lead_minutes: int = 2) -> DataFrame:
    """Shortly before each cutoff: awake tags and the inputs they still miss.

    Worked out per requirement set and only for the days on which it is awake (the rule of ``active`` at the
    moment of the report): the keys of the set, minus what had arrived in the cycle by then.
    """
    lead = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lead_minutes), F.lit(0))
    # one pass over the log; the rest works on this table of one row per key and day
    seen = stable(
        messages.withColumn("cycle", cal.cycle(F.col("freq"), F.col("ts"), schedule))
        .withColumn("opened", cal.cycle_day(F.col("ts"), schedule)).groupBy(*KEY, "cycle", "opened").agg(
            F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
            F.min(F.when(counts(schedule), F.col("ts"))).alias("first_ts"))
    )
    last = seen.agg(F.to_date(F.max("last_seen"))).scalar()

    def report_ts(day: Column) -> Column:
        return day.cast("timestamp_ntz") + schedule.cutoff_interval - lead

    def reported(rows: DataFrame) -> DataFrame:
        return rows.withColumn("report_ts", report_ts(F.col("report_day"))).filter(F.col("report_day") <= last)

    arrived = seen.filter(F.col("first_ts").isNotNull()).groupBy(*KEY, "cycle").agg(F.min("first_ts").alias("first_ts"))
    # a report falls on the day after the cutoff that opened its cycle, or on the same day if the lead reaches back
    near = F.explode(F.sequence("opened", F.date_add("opened", 1)))
    today = reported(seen.select(*KEY, "opened", "first_seen", near.alias("report_day"))).filter(
        (cal.cycle_day(F.col("report_ts"), schedule) == F.col("opened")) & (F.col("first_seen") <= F.col("report_ts")))
    # a counted monthly message keeps its tags awake to the end of the monthly cycle, 31 days at most
    month = F.explode(F.sequence(F.to_date("first_ts"), F.date_add(F.to_date("first_ts"), 32)))
    held = reported(arrived.filter(F.col("freq") == MONTHLY).withColumn("report_day", month)).filter(
        (cal.cycle_month(F.col("report_ts"), schedule) == F.col("cycle")) & (F.col("first_ts") <= F.col("report_ts")))
    awake = today.select(*KEY, "report_day").unionByName(held.select(*KEY, "report_day")).distinct()
    days = split_join(needs, awake, KEY, ["need_id"], ["report_day"], right_rows=CYCLES).select("need_id", "report_day").distinct()
    wanted = reported(needs.join(days, "need_id")).withColumn(
        "cycle", cal.cycle(F.col("freq"), F.col("report_ts"), schedule))
    state = key_join(wanted, arrived, "left", [*KEY, "cycle"])
    missing = state.filter(F.col("first_ts").isNull() | (F.col("first_ts") > F.col("report_ts")))
    listed = missing.groupBy("need_id", "report_day").agg(  # at most the keys of one tag's SQL text
        F.array_join(F.sort_array(F.collect_set("dbt")), ",").alias("missing")
    )
    return required.select("tag_id", "need_id").join(listed, "need_id").select("tag_id", "report_day", "missing")


def received_until_ready(messages: DataFrame, ready: DataFrame, needs: DataFrame,
                         schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """(need_id, cycle, message) of all messages held when a set became ready, as rows.

    A message that came several times is held several times, so this is no list of bounded length.
    ``ready`` has ``need_id``, ``cycle`` and ``ready_ts``.
    """
    both = F.array(F.struct(F.lit(DAILY).alias("freq"), cal.day_text(cal.cycle_day(F.col("ready_ts"), schedule)).alias("held")),
                   F.struct(F.lit(MONTHLY).alias("freq"), cal.cycle_month(F.col("ready_ts"), schedule).alias("held")))
    spans = ready.withColumn("s", F.explode(both)).select("need_id", "cycle", "ready_ts", "s.freq", "s.held")
    wanted = spans.join(needs.select("need_id", *KEY), ["need_id", "freq"])
    held = counted(messages, schedule).withColumn("held", cal.cycle(F.col("freq"), F.col("ts"), schedule))
    return split_join(held, wanted, [*KEY, "held"], ["event_id"], ["need_id", "cycle"]).filter(F.col("ts") <= F.col("ready_ts")).select(
        "need_id", "cycle", "ready_ts", "event_id", "ts", "topic", *KEY, "pvalue", "finish_time"
    )


def monthly_once(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Starts of monthly tags that the once-per-month guard lets through.

    A start is blocked when an earlier run of the tag already succeeded for the same target month. Both
    sides carry ``tag_id``, ``target_month`` and ``seq``.
    """
    first = finishes.groupBy("tag_id", "target_month").agg(F.min("seq").alias("first_finish"))
    later = F.col("seq") > F.col("first_finish")
    return starts.join(first, ["tag_id", "target_month"], "left").filter(
        F.col("first_finish").isNull() | ~later
    ).drop("first_finish")
