"""The registered queries: each operator over the whole tables, with flat columns for comparison.

Arrays and structs are shown as JSON, days as text, moments as epoch microseconds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import calendar as cal
from tagloom.functions import codecs, text
from tagloom.functions.messages import expand, is_complete, need_message
from tagloom.operators import dependencies as dp
from tagloom.operators import dictionary as td
from tagloom.operators import evaluate as ev
from tagloom.operators import mapping as mp
from tagloom.operators import readiness as rd
from tagloom.operators import rounds, runs
from tagloom.operators import routing as rt
from tagloom.operators.keys import split_join
from tagloom.plans import live_status, status_flow, tag_change
from tagloom.plans import status_stream as status_stream_plan
from tagloom.schemas import FINISH, FRONTIER, KEY
from tagloom.session import fresh_dir, stable, tune
from tagloom.sources import frontier, sinks, tables
from tagloom.streaming import live, windows
from tagloom.streaming import readiness as sr
from workload import fixtures as fx

FIXED_DAY = "1998-09-22"
CUTOFF = cal.Schedule(cutoff="12:07:00")

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Inputs:
    """The derived inputs of one scale, and the frames most queries share."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = tune(spark), sf

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not hasattr(fx, name):
            raise AttributeError(name)
        return getattr(fx, name)(self.spark, self.sf)

    def table(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.sf, name)

    @cached_property
    def dictionary(self) -> DataFrame:
        return self.stored_dictionary

    @cached_property
    def views(self) -> DataFrame:
        return mp.view_map(self.mapping)

    @cached_property
    def frequencies(self) -> DataFrame:
        return mp.table_frequency(self.mapping)

    @cached_property
    def deps(self) -> DataFrame:
        return dp.resolve(self.dictionary, self.views)

    @cached_property
    def required(self) -> DataFrame:
        return dp.requirements(self.deps)

    @cached_property
    def needs(self) -> DataFrame:
        return dp.need_sets(self.required)

    @cached_property
    def messages(self) -> DataFrame:
        return rt.tag_messages(self.frontier, self.frequencies)

    @cached_property
    def arrivals(self) -> DataFrame:
        return rd.first_arrivals(self.messages)

    @cached_property
    def end(self) -> Column:
        """The last arrival in the log: the moment present state is asked for."""
        return self.table("events").agg(F.max("ts")).scalar()

    @cached_property
    def flags(self) -> DataFrame:
        return rd.flags_at(self.end, self.deps, self.messages)

    @property
    def feed(self) -> DataFrame:
        return self.changes

    def broken(self) -> DataFrame:
        return fx.frontier(self.spark, self.sf, broken=True)


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    REGISTRY[build.__name__] = lambda spark, sf: build(Inputs(spark, sf))
    return build


def us(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def js(name: str) -> Column:
    return F.to_json(F.col(name), {"ignoreNullFields": "false"})


def fixed_day() -> Column:
    return F.lit(FIXED_DAY).cast("date")


def day_columns(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: cal.day_text(F.col(name)) for name in names})


# ---- dictionary ----

def shown_row(frame: DataFrame) -> DataFrame:
    flat = {"tag_type": js("tag_type"), "tickets": js("tickets"), "disable_flag": F.col("disable_flag").cast("string")}
    return frame.withColumns(flat)


@query
def dict_scan(x):
    return shown_row(td.scan(x.dictionary))


@query
def dict_get(x):
    ids = x.feed.select(F.col("target_id").alias("tag_id"))
    return td.get_many(x.dictionary, ids).select("tag_id", "found", "row_seq", "update_frequency", "sql")


@query
def dict_history_scan(x):
    return shown_row(td.scan(x.history)).select("row_seq", "tag_id", "tag_type", "tickets", "sql", "system_name")


def _written(frame: DataFrame) -> DataFrame:
    return frame.select("row_seq", "tag_id", "update_frequency", "sql", "attribute", "system_name", "started")


@query
def dict_insert(x):
    return _written(td.insert(x.dictionary, x.feed))


@query
def dict_replace(x):
    return _written(td.replace(x.dictionary, x.feed))


@query
def dict_upsert(x):
    _, changed = td.upsert(x.dictionary, x.feed)
    return _written(changed)


@query
def dict_upsert_table(x):
    table, _ = td.upsert(x.dictionary, x.feed)
    return _written(table)


@query
def dict_remove(x):
    return _written(td.remove(x.dictionary, x.feed.select(F.col("target_id").alias("tag_id"))))


@query
def dict_missing(x):
    return td.missing_ids(x.dictionary, x.feed.select(F.col("target_id").alias("tag_id")))


@query
def history_insert(x):
    return _written(td.insert(x.history, x.dictionary))


@query
def history_replace(x):
    return _written(td.replace(x.history, x.dictionary.withColumn("target_id", F.col("tag_id"))))


@query
def history_remove(x):
    return _written(td.remove(x.history, x.dictionary))


@query
def dict_search(x):
    rows = td.search(x.dictionary, update_frequency="D", score_method="sum", source_item="ECONOMY")
    return rows.select("tag_id", "source_type", "tag_name")


@query
def dict_search_type(x):
    rows = td.search(x.dictionary, tag_type=[("Brand#2", "ECONOMY")], score_method="sum")
    return rows.select("tag_id", "source_type", "tag_name")


@query
def system_filter(x):
    return td.of_system(x.feed).select("row_seq", "system_name")


@query
def dict_store_normalise(x):
    rows = td.scan(x.feed.withColumn("tickets", F.when(F.col("row_seq") % 13 > 0, F.col("tickets"))))
    return rows.select("row_seq", "tag_id", F.size("tag_type").alias("n_types"), F.size("tickets").alias("n_tickets"))


@query
def dynamic_to_dictionary(x):
    return x.feed.select("row_seq", codecs.is_complete().alias("complete"))


@query
def dict_json_validate(x):
    return codecs.read_dictionary(x.dictionary_text).select(
        "row_seq", F.col("row").isNotNull().alias("accepted"), "row.tag_id", "row.started")


@query
def dict_json_write(x):
    rows = td.scan(x.dictionary)
    return rows.select("row_seq", codecs.to_text(F.struct(*td.DICTIONARY_FIELDS)).alias("value"))


# ---- mapping ----

@query
def mapping_scan(x):
    return x.mapping


@query
def mapping_enabled(x):
    return mp.enabled(x.mapping).select("row_seq", "view_id")


@query
def mapping_classify(x):
    return mp.classify(mp.enabled(x.mapping)).select("row_seq", "freq", "dbt", "part")


@query
def view_split(x):
    return mp.split_views(x.mapping).select("row_seq", "view")


@query
def view_map_last_wins(x):
    return x.views


@query
def table_freq_last_wins(x):
    return x.frequencies


@query
def frequency_conflicts(x):
    return mp.frequency_conflicts(x.mapping)


# ---- dependencies and registry ----

@query
def sql_table_refs(x):
    return x.dictionary.select("tag_id", F.posexplode(text.table_refs(F.col("sql"))).alias("pos", "view"))


@query
def dependency_resolve(x):
    return x.deps


@query
def dependency_unresolved(x):
    return dp.unresolved(x.dictionary, x.views)


@query
def requirement_null_guard(x):
    return dp.without_requirement(x.dictionary, x.deps).select("tag_id")


@query
def reverse_index(x):
    return dp.reverse_index(x.deps)


@query
def reverse_index_sizes(x):
    return dp.subscriber_counts(x.deps)


@query
def forward_index(x):
    return dp.forward_index(x.deps).withColumn("need", js("need"))


@query
def registry_counts(x):
    return dp.counts(x.dictionary, x.deps)


@query
def need_messages(x):
    need = F.transform("need", need_message)
    return x.required.select("tag_id", F.to_json(need, {"ignoreNullFields": "false"}).alias("need_msgs"))


@query
def registry_lookup(x):
    return dp.lookup_tags(dp.register(x.dictionary), x.feed.select(F.col("target_id").alias("tag_id")))


@query
def registry_lookup_message(x):
    return dp.lookup_messages(x.deps, x.messages)


def _definitions(x) -> DataFrame:
    return td.complete(x.feed)


@query
def requirement_update(x):
    updated = dp.update(x.deps, dp.register(x.dictionary), _definitions(x), x.views)
    return rd.carry_over(x.flags, updated).select("tag_id", *KEY, "satisfied")


@query
def registry_add(x):
    return dp.add(x.deps, dp.register(x.dictionary), _definitions(x), x.views)


@query
def registry_update(x):
    return dp.update(x.deps, dp.register(x.dictionary), _definitions(x), x.views)


@query
def registry_remove(x):
    return dp.remove(x.deps, x.feed.select(F.col("target_id").alias("tag_id")))


@query
def registry_stop(x):
    awake = rd.active(x.end, x.messages, x.deps).withColumn("status", F.lit("active"))
    status = dp.register(x.dictionary).select("tag_id").join(awake, "tag_id", "left").fillna("inactive", ["status"])
    return dp.stop(status, x.feed.select(F.col("target_id").alias("tag_id")))


@query
def tag_change_flow(x):
    return tag_change.tag_change_flow(x.dictionary, x.deps, x.feed, x.views)[1]


@query
def registry_diff(x):
    after = dp.update(x.deps, dp.register(x.dictionary), _definitions(x), x.views)
    return dp.diff(x.deps, after)


# ---- messages ----

@query
def frontier_source(x):
    path = fresh_dir(x.spark, "log")
    x.frontier.write.parquet(path)
    out = sr.drain(frontier.stream_log(x.spark, path))
    return out.select("event_id", us("ts").alias("us"), "topic", "value")


@query
def frontier_topic_filter(x):
    return rt.on_frontier(x.frontier).select("event_id", "topic")


@query
def message_json_parse(x):
    body = expand(x.broken(), "value", FRONTIER).filter(is_complete(FRONTIER))
    return body.select("event_id", "table", "db", "method", "exec_date", js("partition_fields").alias("partition_fields"),
                       js("partition_values").alias("partition_values"))


@query
def message_frequency_lookup(x):
    return rt.with_frequency(rt.parsed(rt.on_frontier(x.frontier)), x.frequencies).select("event_id", "dbt", "freq")


@query
def message_unmatched(x):
    return rt.quarantine(x.broken(), x.frequencies).select("event_id", "reason")


@query
def message_normalise(x):
    return x.messages.withColumn("ts", us("ts"))


@query
def message_key(x):
    return rt.message_keys(x.messages)


@query
def message_views(x):
    return rt.message_views(x.messages).withColumns({"blank": js("blank"), "shown": js("shown")})


@query
def message_gate(x):
    return rt.counted(x.messages).select("event_id", *KEY, "pvalue")


@query
def late_messages(x):
    return rt.ignored(x.messages).select("event_id", "freq", "pvalue", "reason")


@query
def message_route(x):
    return rt.route(x.messages, x.deps).select("event_id", "tag_id", *KEY)


@query
def message_no_subscriber(x):
    return rt.without_subscriber(x.messages, x.deps).select("event_id", *KEY)


@query
def activate_on_message(x):
    return rt.activations(x.messages, x.deps).withColumn("first_message_ts", us("first_message_ts"))


# ---- calendar ----

def _days(x) -> DataFrame:
    return x.table("events").select("event_id", F.to_date("ts").alias("day"))


def _by_run(x) -> DataFrame:
    day = F.to_date(F.timestamp_seconds("start_time"))
    return x.reports.select("tag_id", "seq", day.alias("day")).join(
        x.dictionary.select("tag_id", "update_frequency", "started", "traced"), "tag_id")


@query
def as_of_date(x):
    rows = x.table("events").select("event_id", cal.as_of(F.col("ts")).alias("as_of"),
                                    cal.as_of(F.col("ts"), FIXED_DAY).alias("as_of_fixed"))
    return day_columns(rows, "as_of", "as_of_fixed")


@query
def daily_date(x):
    return x.table("orders").select("o_orderkey", cal.day_text(cal.daily_date(F.to_date("o_orderdate"))).alias("daily_date"))


@query
def last_month(x):
    day = F.to_date("o_orderdate")
    late = cal.Schedule(daily=-12)
    return x.table("orders").select("o_orderkey", cal.last_month(day).alias("last_month"),
                                    cal.last_month(day, late).alias("last_month_12"))


@query
def month_to_date(x):
    body = rt.parsed(rt.on_frontier(x.frontier))
    value = F.get("partition_values", F.lit(0))
    real = cal.month_to_date(value, F.to_date("ts"))
    return body.select("event_id", value.alias("value"), cal.day_text(real).alias("real_date"))


@query
def window_start(x):
    start = cal.window_start(F.col("update_frequency"), F.col("day"), F.col("started"))
    return _by_run(x).select("tag_id", "seq", cal.day_text(start).alias("window_start"))


@query
def window_end(x):
    start = cal.window_start(F.col("update_frequency"), F.col("day"), F.col("started"))
    end = cal.window_end(F.col("update_frequency"), start, F.col("traced"))
    return _by_run(x).select("tag_id", "seq", cal.day_text(end).alias("window_end"))


@query
def current_month(x):
    return _days(x).select("event_id", cal.month_text(F.col("day")).alias("current_month"))


@query
def day_of_month(x):
    number = (F.col("event_id") % 28 + 1).cast("int")
    return _days(x).select("event_id", cal.day_text(cal.day_of_month(F.col("day"), number)).alias("day_of_month"))


@query
def reset_day_flag(x):
    day = F.to_date("o_orderdate")
    return x.table("orders").select("o_orderkey", cal.is_reset_day(day).alias("reset_day"),
                                    cal.is_reset_day(day, cal.Schedule(daily=-12)).alias("reset_day_12"))


# ---- readiness ----

@query
def readiness(x):
    ready = rd.ready_needs(x.arrivals, x.needs)
    rows = rd.ready_tags(ready, x.required, guard=False)
    return rows.select("tag_id", "update_frequency", "cycle", us("ready_ts").alias("ready_us"))


@query
def readiness_cutoff(x):
    arrivals = rd.first_arrivals(x.messages, CUTOFF)
    ready = rd.ready_needs(arrivals, x.needs, CUTOFF)
    rows = rd.ready_tags(ready, x.required, CUTOFF)
    return rows.select("tag_id", "update_frequency", "cycle", us("ready_ts").alias("ready_us"), "target_month")


@query
def readiness_now(x):
    return rd.is_ready(x.flags)


@query
def monthly_clear(x):
    return rd.monthly_clear(x.flags)


@query
def active_tags(x):
    return rd.active(x.end, x.messages, x.deps)


@query
def receive_message(x):
    return rd.received(x.arrivals, x.deps).select("tag_id", *KEY, "cycle", us("first_ts").alias("first_us"))


@query
def receive_messages(x):
    hits = stable(rt.counted(x.messages))
    ready = rd.ready_needs(rd.first_arrivals(hits), x.needs)
    held = rd.received_until_ready(hits, ready, x.needs)
    tags = x.required.select("tag_id", "need_id")
    return split_join(stable(held), tags, ["need_id"], ["event_id"], ["tag_id"]).select("tag_id", "cycle", "event_id", *KEY, "pvalue", "finish_time")


@query
def stale_reset(x):
    revived = rd.stale_reset(x.flags, F.date_add(F.to_date(x.end), 1))
    return revived.select("tag_id", *KEY, "pvalue", "satisfied", "revived")


@query
def cutoff_reset(x):
    rows = rd.cutoff_resets(x.messages, CUTOFF).select("event_id", "as_of", "cycle_close", "cycle_month", "cleared")
    return day_columns(rows, "as_of", "cycle_close")


@query
def unfinished_report(x):
    return day_columns(rd.unfinished(x.messages, x.required, x.needs, CUTOFF), "report_day")


@query
def monthly_once_guard(x):
    month = cal.last_month(F.to_date(F.timestamp_seconds("start_time")))
    monthly = dp.register(x.dictionary).filter(F.col("update_frequency") == "M").select("tag_id")
    rows = x.reports.withColumn("target_month", month).join(monthly, "tag_id").select("tag_id", "seq", "status", "target_month")
    return rd.monthly_once(rows.filter(F.col("status") == "Start").drop("status"), rows.filter(F.col("status") == FINISH))


def _tag_tables(x):
    """Requirements as written tables: what a standing job keeps beside its stream."""
    required = stable(x.required)
    return required.drop("need"), stable(dp.need_sets(required))


@query
def readiness_rounds(x):
    rows = rounds.tag_rounds(x.messages, *_tag_tables(x))
    return rows.select("tag_id", "update_frequency", "cycle", "event_id", us("ready_ts").alias("ready_us"))


def _streamed_log(x) -> DataFrame:
    """The log as files, in no order, and a later message of an unknown table that moves the watermark past its end."""
    path = fresh_dir(x.spark, "log")
    log = x.frontier
    closing = log.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), "ts", F.lit("frontier-adw").alias("topic"),
        F.lit('{"table":"end","partition_fields":[""],"partition_values":[""],"db":"of","method":"log","exec_date":0}').alias("value"))
    log.repartition(4, F.xxhash64("event_id")).unionByName(closing).write.parquet(path)
    return frontier.stream_log(x.spark, path)


@query
def readiness_stream(x):
    required, needs = _tag_tables(x)
    out = sr.drain(sr.readiness_stream(_streamed_log(x), stable(x.frequencies), needs, required))
    return out.select("tag_id", "update_frequency", "cycle", "event_id", us("ready_ts").alias("ready_us"))


@query
def transition_log(x):
    """State changes with run reports fed back: the reports join the messages in one stream per tag."""
    reports_path = fresh_dir(x.spark, "reports")
    late = F.unix_seconds(F.col("ts").cast("timestamp")) + 86400 * 3
    closing = x.table("events").agg(F.max("ts").alias("ts")).select(
        F.lit("none").alias("tag_id"), F.lit(-1).cast("long").alias("seq"), F.lit("Start").alias("status"),
        late.alias("start_time"), late.alias("finish_time"))
    x.recent_reports.unionByName(closing).write.parquet(reports_path)
    required, needs = _tag_tables(x)
    messages = rt.tag_messages(sr.timed(_streamed_log(x)), stable(x.frequencies))
    schema = x.recent_reports.schema
    reports = sr.report_times(x.spark.readStream.schema(schema).parquet(reports_path).withColumnRenamed("tag_id", "unit"))
    sizes = stable(required.join(needs.select("need_id", "n_daily", "n_monthly").distinct(), "need_id").select(
        F.col("tag_id").alias("unit"), "update_frequency", "n_daily", "n_monthly"))
    events = sr.message_events(messages, sr.tag_units(required, needs)).unionByName(sr.report_events(reports, sizes))
    out = sr.drain(sr.transitions(events, instant=False))
    return out.select(F.col("unit").alias("tag_id"), us("ts").alias("us"), "event_id", "seq", "from_state", "to_state", "reason")


@query
def status_stream(x):
    """The main path as a stream: messages in, composed runs out."""
    target = fresh_dir(x.spark, "status")
    required, needs = _tag_tables(x)
    definitions = stable(status_flow.registered(x.dictionary))
    query = status_stream_plan.start(_streamed_log(x), stable(x.frequencies), needs, required,
                                     definitions, target, fresh_dir(x.spark, "status-state"), available_now=True)
    query.awaitTermination()
    return status_stream_plan.composed_rows(x.spark, target).select(
        "tag_id", "update_frequency", "cycle", "event_id", "status", "sql", "start_date", "end_date")


SLICES = 8


def _live(x, log: DataFrame, with_reports: bool = True, schedule: cal.Schedule = cal.DEFAULT) -> str:
    """The live tags over a log and the run reports; gives the folder of what was written."""
    inputs = live.message_input(log, stable(x.frequencies), schedule)
    if with_reports:
        path = fresh_dir(x.spark, "reports")
        x.recent_reports.write.parquet(path)
        inputs = inputs.unionByName(live.report_input(x.spark.readStream.schema(x.recent_reports.schema).parquet(path)))
    target = fresh_dir(x.spark, "live")
    definitions = stable(status_flow.registered(x.dictionary))
    tags = stable(live.registry_state(x.required))
    query = live_status.start(inputs, tags, lambda: definitions, target, fresh_dir(x.spark, "live-state"), schedule,
                              available_now=True, slices=live.slices_for(tags.count(), SLICES))
    query.awaitTermination()
    return target


@query
def live_transitions(x):
    """The tags of a stream that gets messages and run reports: every change of state."""
    acts = live_status.written(x.spark, _live(x, _streamed_log(x)), "actions").filter(F.col("kind") == "transition")
    return acts.select("tag_id", us("ts").alias("us"), "event_id", "seq", "from_state", "to_state", "reason")


@query
def live_runs(x):
    """What that stream launches: first and repeated attempts."""
    rows = live_status.written(x.spark, _live(x, _streamed_log(x)), "runs")
    return rows.select("tag_id", "event_id", "reason", us("ts").alias("us"))


def _late_log(x) -> DataFrame:
    """The log in files of three days, one to a micro-batch; every fiftieth message comes one or two files later."""
    path = fresh_dir(x.spark, "log")
    place = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (72 * 3_600_000_000))
    behind = F.when(F.col("event_id") % 50 == 0, F.col("event_id") % 2 + 1).otherwise(0)
    apart = fresh_dir(x.spark, "log-apart")
    x.frontier.withColumn("file", place + behind).repartition("file").write.partitionBy("file").parquet(apart)
    rows = x.spark.read.schema(f"{frontier.LOG_SCHEMA}, file long").parquet(apart)
    for (number,) in sorted(rows.select("file").distinct().collect()):  # a file per three days, in the order of arrival
        rows.filter(F.col("file") == number).drop("file").coalesce(1).write.mode("append").parquet(path)
    return frontier.stream_log(x.spark, path, files_per_trigger=1)


@query
def live_late(x):
    """Messages that came behind the watermark of a stream, with the watermark that had passed them."""
    rows = live_status.written(x.spark, _live(x, _late_log(x), with_reports=False), "late")
    return rows.select("event_id", "source", us("ts").alias("us"), us("watermark").alias("watermark_us"))


@query
def live_unfinished(x):
    """What that stream reports before each cutoff, up to the log's last day."""
    rows = live_status.written(x.spark, _live(x, _streamed_log(x), with_reports=False, schedule=CUTOFF), "unfinished")
    last = x.messages.agg(F.to_date(F.max("ts"))).scalar()
    return day_columns(rows.filter(F.col("report_day") <= last).select("tag_id", "report_day", "missing"), "report_day")


# ---- runs ----

@query
def sql_compose(x):
    rows = runs.composed(x.dictionary, fixed_day())
    return rows.select("tag_id", "status", "sql", "start_date", "end_date")


@query
def compose_projection(x):
    return runs.composed_runs(td.scan(x.dictionary), fixed_day()).withColumn("tag_type", js("tag_type"))


@query
def compose_json_validate(x):
    rows = sinks.spool_rows(runs.composed_runs(td.scan(x.dictionary), fixed_day()))
    return codecs.read_composed(rows).select("name", F.col("row").isNotNull().alias("accepted"))


def _runs(x) -> DataFrame:
    return runs.composed_runs(td.scan(x.dictionary), fixed_day())


def _runs_of_two_days(x) -> DataFrame:
    rows = td.scan(x.dictionary)
    return runs.composed_runs(rows, fixed_day()).unionByName(runs.composed_runs(rows, F.date_add(fixed_day(), 1)))


@query
def composed_run_sink(x):
    path = fresh_dir(x.spark, "composed_run")
    sinks.write_runs(sinks.spool_rows(_runs(x)), path)
    return tables.read(x.spark, path).select("name", "value", F.col("execute_date").cast("string").alias("execute_date"))


@query
def spool_cleanup(x):
    left = runs.pending(_runs_of_two_days(x), x.run_reports)
    return left.select(runs.run_file_name(F.col("tag_id"), F.col("execute_date")).alias("name"))


@query
def run_report_join(x):
    return runs.outcomes(_runs_of_two_days(x), x.run_reports).select("tag_id", "seq", "status", "execute_date", "start_time")


@query
def run_duration(x):
    return runs.durations(x.reports)


@query
def retry_accounting(x):
    return runs.retry_accounting(x.reports)


@query
def schedule_batches(x):
    requests = rd.ready_counts(rd.ready_needs(x.arrivals, x.needs), x.required)
    return runs.schedule_batches(requests.withColumnRenamed("ready_ts", "ts"), "update_frequency", times="n")


@query
def submit_batches_stream(x):
    """The batches in which a stream's ready tags are submitted: the table that one stream writes is the next one's input."""
    required, needs = _tag_tables(x)
    ready = sr.drain(sr.readiness_stream(_streamed_log(x), stable(x.frequencies), needs, required)).withColumnRenamed("ready_ts", "ts")
    closing = ready.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts")).select(F.lit(None).cast("string").alias("update_frequency"), "ts")
    path = fresh_dir(x.spark, "requests")
    ready.select("update_frequency", "ts").unionByName(closing).write.parquet(path)
    stream = x.spark.readStream.schema("update_frequency string, ts timestamp").parquet(path)
    return sr.drain(windows.submit_batches(stream, "update_frequency"))


@query
def messages_ignored_stream(x):
    """The same messages from a stream of messages and one of run reports."""
    path = fresh_dir(x.spark, "reports")
    x.recent_reports.filter(F.col("status") != "Start").write.parquet(path)
    reports = x.spark.readStream.schema(x.recent_reports.schema).parquet(path)
    messages = rt.tag_messages(_streamed_log(x), stable(x.frequencies))
    return sr.drain(windows.ignored_messages(messages, stable(x.deps), reports)).select("event_id", "tag_id").distinct()


@query
def messages_ignored(x):
    busy = x.recent_reports.filter(F.col("status") != "Start")
    return runs.ignored_while_running(x.messages, x.deps, busy)


@query
def post_success_reset(x):
    return runs.reset_after_success(x.reports, x.deps)


@query
def failed_reset(x):
    return runs.reset_after_give_up(x.reports, x.deps)


@query
def start_message(x):
    return runs.start_messages(x.reports, x.required).withColumn("message", js("message"))


def _finish(x) -> DataFrame:
    hits = stable(rt.counted(x.messages))
    held = rd.received_until_ready(hits, rd.ready_needs(rd.first_arrivals(hits), x.needs), x.needs)
    return runs.finish_messages(x.recent_reports, dp.register(x.dictionary), x.required, runs.received_lists(held))


@query
def finish_message(x):
    return _finish(x).withColumn("message", js("message"))


@query
def start_message_sink(x):
    path = fresh_dir(x.spark, "start")
    rows = runs.start_messages(x.reports, x.required)
    sinks.write_messages(sinks.start_rows(rows, F.col("message")), path, "json")
    return tables.read(x.spark, path, "json", "topic string, key string, value string")


@query
def finish_message_sink(x):
    path = fresh_dir(x.spark, "finish")
    sinks.write_messages(sinks.finish_rows(_finish(x), F.col("message")), path, "json")
    return tables.read(x.spark, path, "json", "topic string, key string, value string")


# ---- evaluation ----

def _own_sql(x):
    """What became ready is run: the flow's own output, several days of each tag."""
    x.nation_facts.createOrReplaceTempView("tag_facts")
    ready = stable(status_flow.tag_status_flow(x.mapping, x.nation_tags, x.frontier).filter(F.col("status") != "error"))
    return ev.run_tags(x.spark, ready.withColumn("execute_date", cal.day_text(F.col("as_of"))), fresh_dir(x.spark, "tag_result"))


@query
def run_ready_tags(x):
    return _own_sql(x)[0].withColumn("score", F.round("score", 2))


@query
def run_ready_tags_report(x):
    return _own_sql(x)[1].select("tag_id", "execute_date", "status")  # one row per start and end of an attempt


@query
def run_windowed_tags(x):
    return ev.run_windowed(x.facts, _runs(x), amount="double")


@query
def tag_coverage(x):
    return ev.coverage(x.facts, _runs(x))


@query
def tag_status_flow(x):
    rows = status_flow.tag_status_flow(x.mapping, x.dictionary, x.frontier)
    return rows.select("tag_id", "update_frequency", "cycle", us("ready_ts").alias("ready_us"), "target_month",
                       "status", "start_date", "end_date", "sql")
