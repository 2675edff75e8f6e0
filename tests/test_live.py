"""Tags that live in a stream, against the machine applied row by row and against the batch operators."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagloom.operators import readiness as rd
from tagloom.plans import live_status
from tagloom.schemas import RECEIVING, RUNNING, WAITING
from tagloom.session import fresh_dir, stable
from tagloom.sources import frontier
from tagloom.streaming import live
from tagloom.streaming import readiness as sr
from tagloom.streaming.machine import Tag
from tests.conftest import rows

CHANGES = "tag_id string, change_id long, ts timestamp_ntz, update_frequency string, need array<struct<freq:string,dbt:string,part:string>>"
REPORTS = "tag_id string, seq long, status string, start_time long, finish_time long"
REQUIRED = "tag_id string, update_frequency string, need array<struct<freq:string,dbt:string,part:string>>"
START = datetime(2018, 9, 22, 8)
A, B, C = (json.dumps({"freq": "D", "dbt": f"d.{t}"}, separators=(",", ":")) for t in "abc")


def body(table, minute):
    return '{"table":"%s","partition_fields":[""],"partition_values":[""],"db":"d","method":"x","exec_date":%d}' % (table, minute)


class Stream:
    """A log, reports and changes as folders of files, and the live tags over them."""

    def __init__(self, spark, required, initial=None):
        self.spark = spark
        self.log, self.reports, self.changes, self.target, self.state = (fresh_dir(spark, n) for n in ("l", "r", "c", "t", "s"))
        self.frequencies = spark.createDataFrame([(f"d.{t}", "D") for t in "abc"], "dbt string, freq string")
        self.required = spark.createDataFrame(required, REQUIRED)
        self.initial = stable(initial or live.registry_state(self.required))
        self.definitions = stable(self.required.select("tag_id", F.lit("select 1").alias("sql"), F.lit(None).cast("int").alias("started"),
                                                       F.lit(None).cast("int").alias("traced")))
        for path, schema in ((self.reports, REPORTS), (self.changes, CHANGES)):
            spark.createDataFrame([], schema).write.parquet(path)

    def add(self, messages=(), reports=(), changes=()):
        at = [(minute, START + timedelta(minutes=minute), "frontier-adw", body(t, minute)) for minute, t in messages]
        self.spark.createDataFrame(at, frontier.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self.log)
        if reports:
            self.spark.createDataFrame(reports, REPORTS).coalesce(1).write.mode("append").parquet(self.reports)
        if changes:
            self.spark.createDataFrame(changes, CHANGES).coalesce(1).write.mode("append").parquet(self.changes)

    def run(self):
        inputs = live.message_input(frontier.stream_log(self.spark, self.log), self.frequencies).unionByName(
            live.report_input(self.spark.readStream.schema(REPORTS).parquet(self.reports))).unionByName(
            live.change_input(self.spark.readStream.schema(CHANGES).parquet(self.changes)))
        live_status.start(inputs, self.initial, lambda: self.definitions, self.target, self.state, available_now=True, slices=3).awaitTermination()

    def table(self, name):
        return live_status.written(self.spark, self.target, name)

    def steps(self):
        acts = self.table("actions").filter("kind IN ('transition', 'change')").orderBy("ts", "event_id", "seq").collect()
        out = {}
        for r in acts:
            out.setdefault(r["tag_id"], []).append(r["reason"])
        return out


def need(*tables):
    return [("D", f"d.{t}", None) for t in tables]


def seconds(minute):
    return int((START + timedelta(minutes=minute) - datetime(1970, 1, 1)).total_seconds())


@pytest.fixture(scope="module")
def flow(spark):
    """Reports that finish, fail and come from another run; a change before and one during a run; a late message."""
    s = Stream(spark, [(t, "D", need("a", "b")) for t in ("same", "changed", "failing", "busy", "gone")])
    s.add([(0, "a"), (30, "x")],
          [("busy", 9, "Start", seconds(12), seconds(12))],
          [("changed", 1, START + timedelta(minutes=5), "D", need("a", "c")), ("fresh", 2, START + timedelta(minutes=6), "D", need("b")),
           ("gone", 3, START + timedelta(minutes=7), "D", [])])
    s.add([(1, "a"), (10, "b"), (10, "b"), (40, "x"), (200, "x")],
          [(t, 10, "Finish", seconds(11), seconds(20)) for t in ("same", "nobody")]
          + [("failing", 20 + i, "NonFinish", seconds(11), seconds(21 + i)) for i in range(3)],
          [("busy", 4, START + timedelta(minutes=13), "D", need("c"))])
    s.run()
    s.add([(15, "c"), (210, "c"), (500, "x")], [("busy", 30, "Finish", seconds(11), seconds(220))])
    s.run()
    return s


def test_changes_reports_and_late_rows_in_one_stream(flow):
    assert flow.steps() == {
        "same": ["first_message", "ready", "finished", "stopped"],
        "changed": ["first_message", "changed", "ready"],
        "failing": ["first_message", "ready", "retry", "retry", "gave_up"],
        "fresh": ["added", "first_message", "ready"],
        "busy": ["first_message", "ready", "changed", "finished", "stopped"],
        "gone": ["first_message", "removed"],
    }
    late = flow.table("late").collect()
    assert [(r["source"], r["event_id"], json.loads(r["row"])["message"]["value"]) for r in late] == [("message", 15, "d.c")]
    assert late[0]["ts"] <= late[0]["watermark"]


def test_runs_and_messages_are_written_once(flow):
    runs = [(r["tag_id"], r["reason"]) for r in flow.table("runs").collect()]
    assert sorted(runs) == sorted([(t, "ready") for t in ("same", "changed", "failing", "busy", "fresh")] + [("failing", "retry")] * 2)
    assert {r["tag_id"] for r in flow.table("runs").filter("status = 'undefined'").collect()} == {"fresh"}
    start = [json.loads(r["value"]) for r in flow.table("start").collect()]
    assert [(m["job_name"], [k["value"] for k in m["need_msgs"]]) for m in start] == [("busy", ["d.a", "d.b"])]
    finish = {m["job_name"]: m for m in (json.loads(r["value"]) for r in flow.table("finish").collect())}
    assert {t: m["is_success"] for t, m in finish.items()} == {"same": True, "failing": False, "busy": True}
    for m in finish.values():  # equal messages once, those with another finish time each
        assert sorted((k["value"], k["finish_time"]) for k in m["receive_msgs"]) == [("d.a", 0), ("d.a", 1), ("d.b", 10)]
    before = {n: rows(flow.table(n)) for n in live_status.TABLES}
    flow.run()  # nothing new
    assert {n: rows(flow.table(n)) for n in live_status.TABLES} == before


def test_a_repeated_batch_changes_nothing(spark, flow):
    before = {n: rows(flow.table(n)) for n in live_status.TABLES}
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(flow.state + "/commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    assert fs.delete(last, False)  # as if the process had died after writing
    flow.run()
    assert {n: rows(flow.table(n)) for n in live_status.TABLES} == before


def test_checkpoint_is_a_table_of_tags(spark, flow):
    now = {r["tag_id"]: r["state"] for r in live.tags_now(spark, flow.state).collect()}
    assert now == {"same": WAITING, "changed": RUNNING, "failing": RECEIVING, "fresh": RUNNING, "busy": WAITING}
    assert {r["tag_id"] for r in live.active_now(spark, flow.state).collect()} == {"changed", "failing", "fresh"}


def test_change_keeps_flags_as_the_batch_operator_does(spark):
    """Flags after a change are those of ``carry_over``."""
    entry = live.Entry("D", [A, B], Tag(RECEIVING, {A, B}, set(), "2018-09-22", "201808"))
    entry.require([B, C])
    entry.settle()
    schema = "tag_id string, freq string, dbt string, part string"
    flags = spark.createDataFrame([("t", "D", "d.a", None), ("t", "D", "d.b", None)], schema).withColumn("satisfied", F.lit(True))
    now = spark.createDataFrame([("t", "D", "d.b", None), ("t", "D", "d.c", None)], schema)
    kept = {r["k"] for r in rd.carry_over(flags, now).filter("satisfied").select(live.key_text().alias("k")).collect()}
    assert entry.tag.daily == kept == {B}


def test_a_run_keeps_what_it_began_with(spark):
    entry = live.Entry("D", [A], Tag(RUNNING, {A}, set(), "2018-09-22", "201808", run_day="2018-09-22"),
                       ['{"key": %s, "message": {"value": "d.a"}}' % json.dumps(A)])
    entry.require([B])
    entry.settle()
    assert entry.tag.daily == {A} and len(entry.held) == 1
    moment = {"day": "2018-09-22", "month": "201808", "target_month": "201808"}
    out = live.moved(entry, {"tag_id": "t", "status": "Finish", "start_time": 1, "finish_time": 2, "run_day": "2018-09-22", **moment})
    assert [k for k, *_ in out] == ["transition", "transition", "finish"] and out[2][2]["received"] == [{"value": "d.a"}]
    assert entry.tag.state == WAITING and entry.held == [] and entry.need == [B]


def test_recovery_from_tables_goes_on_as_the_old_stream_would(spark):
    """Half a cycle in one stream; then a new checkpoint from the flags of the batch operators, and the rest."""
    required = [("t1", "D", need("a", "b")), ("t2", "D", need("b", "c")), ("t3", "D", need("c"))]
    first, rest = [(0, "a"), (5, "x")], [(70, "b"), (80, "c"), (600, "x")]
    old = Stream(spark, required)
    old.add(first)
    old.run()
    old.add(rest)
    old.run()
    log = spark.createDataFrame([(m, START + timedelta(minutes=m), "frontier-adw", body(t, m)) for m, t in first], frontier.LOG_SCHEMA)
    from tagloom.operators.routing import tag_messages

    deps = old.required.select("tag_id", F.explode("need").alias("k")).select("tag_id", "k.*")
    moment = F.lit(START + timedelta(minutes=60)).cast("timestamp_ntz")
    flags = rd.stale_reset(rd.flags_at(moment, deps, tag_messages(log, old.frequencies)), F.to_date(moment))
    months = spark.createDataFrame([], "tag_id string, run_month string")
    new = Stream(spark, required, live.revived_state(old.required, flags, months, moment))
    new.add(rest)
    new.run()
    ready = [(r["tag_id"], r["event_id"]) for r in old.table("actions").filter("reason = 'ready'").collect()]
    assert sorted(ready) == [("t1", 70), ("t2", 80), ("t3", 80)]
    assert sorted((r["tag_id"], r["event_id"]) for r in new.table("actions").filter("reason = 'ready'").collect()) == sorted(ready)


def test_readiness_stream_and_its_late_messages_are_the_log(spark, inputs):
    """Files hours apart, some rows far behind: what is not late gives what a batch over those rows gives."""
    from tagloom.operators import rounds
    from workload.queries import _late_log

    frequencies, needs, required = stable(inputs.frequencies), stable(inputs.needs), stable(inputs.required.drop("need"))
    stream = sr.readiness_actions(_late_log(inputs), frequencies, needs, required)
    state, out = fresh_dir(spark, "state"), fresh_dir(spark, "out")
    acts = sr.drain(stream, state, out)
    late = stable(sr.late_messages(acts))
    assert late.count() > 10
    in_time = inputs.messages.join(late.select("event_id"), "event_id", "left_anti")
    last = acts.agg(F.max("ts")).first()[0]  # the end of the log still waits for the watermark
    columns = ["tag_id", "update_frequency", "cycle", "event_id"]
    expected = rounds.tag_rounds(in_time, inputs.required, inputs.needs).filter(F.col("ready_ts").cast("timestamp") <= F.lit(last))
    assert rows(sr.ready_rows(acts, required), *columns) == rows(expected, *columns)


def test_cycles_of_one_moment_are_those_of_the_columns(spark):
    from tagloom.functions import calendar as cal

    days = [datetime(2018, m, d, h, n) for m in (1, 2, 3, 12) for d in (1, 2, 3, 28) for h, n in ((0, 0), (5, 59), (6, 0), (23, 59))]
    frame = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz")
    for schedule in (cal.DEFAULT, cal.Schedule(cutoff="06:00:00"), cal.Schedule(daily=-12, monthly=-2, cutoff="06:00:00")):
        got = frame.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), cal.day_text(cal.cycle_day(F.col("ts"), schedule)).alias("d"),
                           cal.cycle_month(F.col("ts"), schedule).alias("m")).collect()
        for r in got:
            assert cal.cycles_at(r["us"], schedule) == (r["d"], r["m"])


def test_reports_before_the_cutoff_come_from_rows_and_from_timers(spark):
    """A woken tag is reported with what it misses; one that runs, one asleep and one without a message are not."""
    s = Stream(spark, [("waits", "D", need("a", "b", "c")), ("runs", "D", need("a")), ("asleep", "D", need("c"))])
    day = 24 * 60
    s.add([(0, "a"), (5, "b"), (60, "x")])
    s.run()
    assert s.table("unfinished").count() == 0  # the cutoff is far
    s.add([(2 * day, "x")])  # no row of these tags: a timer brings the report up
    s.run()
    first = [("waits", "2018-09-23", "d.c")]
    listed = lambda: rows(s.table("unfinished").select("tag_id", F.col("report_day").cast("string"), "missing"))
    assert listed() == first
    assert {str(r["report_ts"]) for r in s.table("unfinished").collect()} == {"2018-09-22 23:58:00"}
    s.add([(2 * day + 30, "b"), (5 * day, "x")])  # rows and report in one micro-batch; the flag of a is of a past day
    s.run()
    s.run()
    assert listed() == first + [("waits", "2018-09-25", "d.a,d.c")]


def test_a_slice_reads_and_writes_its_state_in_bulk(spark, monkeypatch):
    """Rows wait by the hour and in parts, tags and keys are read together, and the rows that come out are the same."""
    tags = [(f"t{i}", "D", need("a", "b") if i % 2 else need("b", "c")) for i in range(12)]
    messages = [(m, "abc"[m % 3]) for m in range(0, 200, 7)] + [(900, "x")]

    def run():
        s = Stream(spark, tags)
        s.add(messages)
        s.run()
        stored = spark.read.format("statestore").option("stateVarName", "waiting").load(s.state)
        return rows(s.table("actions").select("kind", "tag_id", "ts", "event_id", "seq", "reason")), stored

    whole, stored = run()
    assert stored.columns and "hour" in stored.select("user_map_key.*").columns
    for name, value in (("SINGLE", 1), ("HOLD", 2), ("OUT", 1)):
        monkeypatch.setattr(live, name, value)
    assert run()[0] == whole and len(whole) > 12
