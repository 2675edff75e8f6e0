"""The stream gives what the batch gives, also when stopped and started again."""

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from tagloom.operators import rounds
from tagloom.operators import routing as rt
from tagloom.session import fresh_dir, stable
from tagloom.sources import frontier
from tagloom.streaming import readiness as sr
from tagloom.streaming.machine import Event, Tag, advance
from tests.conftest import rows

COLUMNS = ["tag_id", "update_frequency", "cycle", "event_id"]


def statics(inputs):
    return stable(inputs.frequencies), stable(inputs.needs), stable(inputs.required.drop("need"))


def closing(log):
    """A later message of an unknown table, which moves the watermark past the log."""
    return log.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), "ts", F.lit("frontier-adw").alias("topic"),
        F.lit('{"table":"end","partition_fields":[""],"partition_values":[""],"db":"of","method":"x","exec_date":0}').alias("value"))


def test_stream_equals_batch_out_of_order_and_over_a_restart(spark, inputs):
    """Rows are shuffled over files within the delay, one file per micro-batch, with a restart between."""
    frequencies, needs, required = statics(inputs)
    path, state, out = (fresh_dir(spark, n) for n in ("log", "state", "out"))
    log = inputs.frontier
    # three hours per file, each row up to four hours early or late
    hours = F.unix_seconds(F.col("ts").cast("timestamp")) / 3600 + F.pmod(F.xxhash64("event_id"), F.lit(8)) - 4
    parts = log.withColumn("part", F.floor(hours / 72))
    numbers = sorted(r[0] for r in parts.select("part").distinct().collect())

    def run():
        stream = frontier.stream_log(spark, path, files_per_trigger=1)
        return sr.drain(sr.readiness_stream(stream, frequencies, needs, required, delay="9 hours"), state, out)

    def write(some):
        for n in some:
            parts.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(path)

    write(numbers[:len(numbers) // 2])
    first = run().count()
    write(numbers[len(numbers) // 2:])
    closing(log).write.mode("append").parquet(path)
    both = rows(run(), *COLUMNS)
    assert 0 < first < len(both)
    assert both == rows(rounds.tag_rounds(inputs.messages, inputs.required, inputs.needs), *COLUMNS)
    assert rows(run(), *COLUMNS) == both  # nothing new, nothing twice


def test_first_rounds_are_the_closed_form(inputs):
    """The first round of each cycle is what the readiness operator gives without rounds."""
    from tagloom.operators.readiness import ready_needs

    first = rounds.need_rounds(inputs.messages, inputs.needs).groupBy("need_id", "cycle").agg(F.min("ready_ts").alias("ready_ts"))
    closed = ready_needs(inputs.arrivals, inputs.needs)
    assert rows(first.select("need_id", "cycle", "ready_ts")) == rows(closed.select("need_id", "cycle", "ready_ts"))


def event(status="", uf="D", freq="D", key=0, counts=True, nd=1, nm=0, day="2018-09-22", month="201808", target="201808", run="2018-09-22"):
    return Event(status, uf, freq, key, counts, nd, nm, day, month, target, run)


def reasons(steps):
    return [s.reason for s in steps]


def test_run_finish_and_stop():
    tag = Tag()
    assert reasons(advance(tag, event(), False)) == ["first_message", "ready"]
    assert advance(tag, event(), False) == []  # while running messages are ignored
    assert reasons(advance(tag, event("Start"), False)) == []
    assert reasons(advance(tag, event("Finish"), False)) == ["finished", "stopped"]
    assert tag.state == "Waiting" and not tag.daily


def test_a_lost_report_frees_the_tag_at_the_cutoff():
    tag = Tag()
    advance(tag, event(), False)
    assert tag.state == "Running"
    late = event("Finish", day="2018-09-26", run="2018-09-22")
    assert reasons(advance(tag, event(day="2018-09-23", nd=2), False)) == ["cutoff", "stopped", "first_message"]
    assert reasons(advance(tag, late, False)) == ["cutoff", "stopped", "other_run"]


def test_a_report_of_another_run_changes_nothing():
    tag = Tag()
    advance(tag, event(), False)
    assert reasons(advance(tag, event("Finish", run="2018-09-21"), False)) == ["other_run"] and tag.state == "Running"
    assert reasons(advance(tag, event("Finish"), False)) == ["finished", "stopped"]


def test_three_failures_give_up_and_keep_monthly_flags():
    tag = Tag()
    advance(tag, event(freq="M", key=1, nm=1), False)
    assert reasons(advance(tag, event(nm=1), False)) == ["ready"]
    failed = [reasons(advance(tag, event("NonFinish", nm=1), False)) for _ in range(3)]
    assert failed == [["retry"], ["retry"], ["gave_up"]]
    assert tag.state == "Receiving" and tag.daily == set() and tag.monthly == {1} and tag.failures == 0
    assert reasons(advance(tag, event(nm=1), False)) == ["ready"]


def test_mixed_daily_tag_keeps_monthly_flags_after_success():
    tag = Tag()
    advance(tag, event(freq="M", key=1, nm=1), True)
    assert reasons(advance(tag, event(nm=1), True)) == ["ready", "finished", "monthly_held"]
    assert tag.monthly == {1} and tag.state == "Receiving"


def test_monthly_tag_runs_once_per_target_month():
    tag = Tag()
    monthly = dict(uf="M", freq="M", nd=0, nm=1)
    assert "ready" in reasons(advance(tag, event(**monthly), True))
    assert advance(tag, event(**monthly), True) == []
    later = dict(monthly, day="2018-10-05", month="201809", target="201809")
    assert "ready" in reasons(advance(tag, event(**later), True))


def test_cutoff_wipes_daily_flags_and_the_reset_day_both():
    tag = Tag()
    advance(tag, event(nd=2, nm=2), True)
    advance(tag, event(freq="M", key=2, nd=2, nm=2), True)
    assert reasons(advance(tag, event(key=1, nd=2, nm=2, day="2018-09-23"), True)) == ["cutoff", "monthly_held"]
    assert tag.daily == {1} and tag.monthly == {2}
    steps = advance(tag, event(key=1, nd=2, nm=2, day="2018-10-02", month="201809", target="201809"), True)
    assert reasons(steps) == ["cutoff", "stopped", "first_message"] and tag.monthly == set()


def test_duplicates_and_misses_change_nothing():
    tag = Tag()
    advance(tag, event(nd=2), True)
    before = (tag.state, set(tag.daily))
    assert advance(tag, event(nd=2), True) == [] and advance(tag, event(nd=2, key=1, counts=False), True) == []
    assert (tag.state, tag.daily) == before


def test_reports_reach_the_stream(spark):
    """A tag that fails three times is given up, another one finishes; a report that arrives before its run's last
    message is still worked off after it."""
    ts = datetime(2018, 9, 22, 10)
    body = '{"table":"%s","partition_fields":[""],"partition_values":[""],"db":"d","method":"x","exec_date":1}'
    log = [(1, ts, "frontier-adw", body % "t"), (2, datetime(2018, 9, 25), "frontier-adw", body % "end")]
    path, reports_path = fresh_dir(spark, "log"), fresh_dir(spark, "reports")
    for row in reversed(log):
        spark.createDataFrame([row], frontier.LOG_SCHEMA).write.mode("append").parquet(path)
    at = int(ts.timestamp()) + 60
    schema = "unit string, seq long, status string, start_time long, finish_time long"
    spark.createDataFrame(
        [("bad", 1, "NonFinish", at, at), ("bad", 2, "NonFinish", at, at + 1), ("bad", 3, "NonFinish", at, at + 2),
         ("good", 4, "Finish", at, at), ("good", 5, "Finish", at, at + 9), ("none", 6, "Start", at, at + 3 * 86400)],
        schema).write.parquet(reports_path)
    frequencies = spark.createDataFrame([("d.t", "D")], "dbt string, freq string")
    units = spark.createDataFrame(
        [(u, "D", "D", "d.t", None, 0, 1, 0) for u in ("bad", "good")],
        "unit string, update_frequency string, freq string, dbt string, part string, key_no int, n_daily int, n_monthly int")
    sizes = units.select("unit", "update_frequency", "n_daily", "n_monthly")
    messages = rt.tag_messages(sr.timed(frontier.stream_log(spark, path)), frequencies)
    reports = sr.report_times(spark.readStream.schema(schema).parquet(reports_path))
    events = sr.message_events(messages, units).unionByName(sr.report_events(reports, sizes))
    out = sr.drain(sr.transitions(events, instant=False)).orderBy("ts", "event_id", "seq").collect()
    path_of = {u: [r["reason"] for r in out if r["unit"] == u] for u in ("bad", "good")}
    assert path_of == {"bad": ["first_message", "ready", "retry", "retry", "gave_up"],
                       "good": ["first_message", "ready", "finished", "stopped", "other_run"]}


def test_transition_log_matches_a_row_by_row_run(spark, inputs):
    """Messages and fed-back reports of all tags, against the machine applied to the collected rows."""
    from workload.queries import REGISTRY
    from tests.conftest import SMALL

    sizes = inputs.required.join(inputs.needs.select("need_id", "n_daily", "n_monthly").distinct(), "need_id").select(
        F.col("tag_id").alias("unit"), "update_frequency", "n_daily", "n_monthly")
    messages = inputs.messages.withColumn("ts", F.col("ts").cast("timestamp"))
    events = sr.message_events(messages, sr.tag_units(inputs.required, inputs.needs)).unionByName(
        sr.report_events(inputs.recent_reports.withColumnRenamed("tag_id", "unit").withColumn("ts", F.timestamp_seconds("finish_time")), sizes))
    tags, expected = {}, []
    for row in events.orderBy("unit", "ts", "event_id").collect():
        tag = tags.setdefault(row["unit"], Tag())
        for seq, step in enumerate(advance(tag, Event(*[row[n] for n in Event._fields]), False)):
            expected.append((row["unit"], row["event_id"], seq, *step))
    got = REGISTRY["transition_log"](spark, SMALL)
    assert rows(got, "tag_id", "event_id", "seq", "from_state", "to_state", "reason") == sorted(expected, key=repr)
    assert {"ready", "finished", "retry", "stopped", "monthly_held", "cutoff", "first_message", "other_run"} <= {r[-1] for r in expected}


class Kept:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]

    def keys(self):
        self.calls += 1
        return iter(list(self.held))


class Handle:
    def __init__(self):
        self.states, self.timer = {}, None

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Kept())

    def registerTimer(self, ms):
        self.timer = ms


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_of_the_state_do_not_grow_with_the_units():
    """Rows of 3000 units in five hours, out of order, a restart between: what each unit does, and some hundred calls."""
    start = 1_537_600_000_000_000 // sr.HOUR * sr.HOUR
    body = dict(zip(Event._fields, event(nd=2)))
    frame = pd.DataFrame([
        {"slice": 0, "us": start + h * sr.HOUR + n, "event_id": h * 3000 + n, "unit": f"u{n}", "cycle": "c", **body, "key_no": h % 2}
        for n in range(3000) for h in range(4)])
    frame = frame.sample(frac=1, random_state=1)
    handle, out = Handle(), []

    def call(rows, watermark):
        machine = sr.TagMachine(instant=False)
        machine.init(handle)
        out.extend(machine.handleInputRows((0,), iter(rows), Clock(watermark // 1000)))

    call([frame[:7000], frame[7000:]], 0)
    assert handle.timer == frame["us"].max() // 1000 + 1
    call([], start + 2 * sr.HOUR + 1_000_000)
    late = frame[:1].assign(unit="late", us=start, event_id=-1)
    call([late], start + 2 * sr.HOUR + 1_000_000)
    machine = sr.TagMachine(instant=False)
    machine.init(handle)
    out.extend(machine.handleExpiredTimer((0,), Clock(start // 1000 + 4 * 3_600_000), None))
    assert sum(s.calls for s in handle.states.values()) < 500
    found = pd.concat(out)
    assert found[found["reason"] == "late"]["event_id"].tolist() == [-1]
    expected = []
    for n in range(3000):
        tag = Tag()
        for h in range(4):
            for seq, step in enumerate(advance(tag, event(nd=2, key=h % 2), False)):
                expected.append((f"u{n}", h * 3000 + n, seq, step.reason))
    got = found[found["reason"] != "late"]
    assert sorted(zip(got["unit"], got["event_id"], got["seq"], got["reason"])) == sorted(expected)
    assert not handle.states["waiting"].held
