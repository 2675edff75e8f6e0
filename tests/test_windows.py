"""Session windows and the interval join of streams, against the batch operators, over several micro-batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tagloom.operators import runs
from tagloom.session import fresh_dir
from tagloom.streaming import readiness as sr
from tagloom.streaming import windows
from tests.conftest import rows

AT = datetime(2018, 9, 22, 8)
REQUESTS = "f string, ts timestamp_ntz"
MESSAGES = "event_id long, ts timestamp_ntz, freq string, dbt string, part string"
REPORTS = "tag_id string, seq long, start_time long, finish_time long"


def at(seconds):
    return AT + timedelta(seconds=seconds)


def epoch(seconds):
    return int((at(seconds) - datetime(1970, 1, 1)).total_seconds())


def put(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_batches_close_at_the_gap_and_over_restarts(spark):
    path, state, out = (fresh_dir(spark, n) for n in ("in", "state", "out"))
    first = [("D", at(0)), ("D", at(19)), ("D", at(39)), ("M", at(5)), ("M", at(25.000001)), ("D", at(100))]
    second = [("D", at(110)), ("D", at(110)), ("D", at(129.999999)), ("D", at(149.999999)), ("M", at(3500))]
    put(spark, path, first, REQUESTS)
    stream = spark.readStream.schema(REQUESTS).parquet(path)
    assert rows(sr.drain(windows.submit_batches(stream, "f"), state, out)) == []  # all may still grow
    put(spark, path, second, REQUESTS)
    sr.drain(windows.submit_batches(stream, "f"), state, out)
    put(spark, path, [(None, at(9000))], REQUESTS)
    got = sr.drain(windows.submit_batches(stream, "f"), state, out)
    expected = runs.schedule_batches(spark.createDataFrame(first + second, REQUESTS), "f")
    assert rows(got, "f", "first_us", "last_us", "n", "submit_us") == rows(expected, "f", "first_us", "last_us", "n", "submit_us")
    assert [r[3] for r in rows(got.filter("f = 'D'"), "f", "first_us", "last_us", "n")] == [2, 1, 4, 1]


def test_messages_during_runs_meet_whichever_comes_first(spark):
    log, path, state, out = (fresh_dir(spark, n) for n in ("log", "reports", "state", "out"))
    deps = spark.createDataFrame([("t", "D", "d.a", None), ("t", "M", "d.b", "p"), ("u", "D", "d.a", None)],
                                 "tag_id string, freq string, dbt string, part string")
    early = [(1, at(0), "D", "d.a", None), (2, at(700), "M", "d.b", "p"), (3, at(700), "M", "d.b", None), (4, at(1300), "D", "d.a", None)]
    later = [(5, at(1250), "D", "d.a", None), (6, at(1299), "M", "d.b", "p"), (7, at(5000), "D", "d.a", None)]
    reports = [("t", 1, epoch(0), epoch(1300)), ("u", 2, epoch(1300), epoch(1300))]
    more = [("u", 3, epoch(1240), epoch(1900)), ("u", 4, epoch(1200), epoch(1260)), ("nobody", 5, epoch(0), epoch(1900))]

    def run():
        messages = spark.readStream.schema(MESSAGES).parquet(log)
        return sr.drain(windows.ignored_messages(messages, deps, spark.readStream.schema(REPORTS).parquet(path)), state, out)

    put(spark, log, early, MESSAGES)
    put(spark, path, reports, REPORTS)
    assert rows(run()) == [(1, "t", 1), (2, "t", 1)]
    put(spark, log, later, MESSAGES)
    put(spark, path, more, REPORTS)
    got = run()
    assert rows(got)[2:] == [(4, "u", 3), (5, "t", 1), (5, "u", 3), (5, "u", 4), (6, "t", 1)]
    batch = runs.ignored_while_running(spark.createDataFrame(early + later, MESSAGES), deps, spark.createDataFrame(reports + more, REPORTS))
    assert rows(got.select("event_id", "tag_id").distinct()) == rows(batch, "event_id", "tag_id")
