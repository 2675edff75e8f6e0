import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagloom.operators import runs
from tagloom.schemas import COMPOSED
from tests.conftest import rows

REPORT = "tag_id string, seq long, status string, start_time long, finish_time long"


def reports(spark, n=600):
    """One tag owns a third of the reports."""
    pick = random.Random(5)
    data = [("hot" if i % 3 == 0 else f"t{pick.randrange(12)}", i, pick.choice(["Start", "Finish", "NonFinish", "NonFinish"]),
             100 * i, 100 * i + pick.randrange(50)) for i in range(n)]
    return data, spark.createDataFrame(data, REPORT)


@pytest.mark.parametrize("width", [1, 7, 50, 100_000])
def test_attempts_do_not_depend_on_the_slices(spark, width):
    data, frame = reports(spark)
    failures, expected = {}, []
    for tag, seq, status, _, _ in data:
        if status == "Finish":
            failures[tag] = 0
        elif status == "NonFinish":
            attempt = failures.get(tag, 0) + 1
            expected.append((tag, seq, attempt, "give_up" if attempt == 3 else "retry"))
            failures[tag] = attempt % 3
    assert rows(runs.retry_accounting(frame, width)) == sorted(expected, key=repr)


@pytest.mark.parametrize("width", [20, 45, 600, 86_400])
def test_batches_do_not_depend_on_the_slices(spark, width):
    pick, base = random.Random(3), datetime(2024, 1, 1)
    times = {k: sorted(pick.randrange(4000 * 1000) for _ in range(n)) for k, n in (("ATS", 500), ("B", 40), ("C", 1))}
    times["edge"] = [0, 19_999, 39_999, 40_000]  # milliseconds: a gap of exactly 20 s opens a batch
    data = [(k, base + timedelta(milliseconds=ms)) for k, all_ms in times.items() for ms in all_ms]
    expected = []
    for k, all_ms in times.items():
        batch = [all_ms[0]]
        for ms in all_ms[1:] + [10**12]:
            if ms - batch[-1] >= 20_000:
                expected.append((k, batch[-1] - batch[0], len(batch)))
                batch = []
            batch.append(ms)
    frame = runs.schedule_batches(spark.createDataFrame(data, "system string, ts timestamp_ntz"), "system", slice_seconds=width)
    got = frame.select("system", ((F.col("last_us") - F.col("first_us")) / 1000).cast("long").alias("ms"), "n")
    assert rows(got) == sorted(expected, key=repr)


def test_messages_during_a_run_are_found(spark):
    at = datetime(2024, 1, 1, 0, 0, 0)
    messages = spark.createDataFrame(
        [(1, at, "D", "a", None), (2, at + timedelta(seconds=1500), "D", "a", None), (3, at + timedelta(seconds=2000), "D", "a", None),
         (4, at + timedelta(seconds=1500), "D", "b", None)],
        "event_id long, ts timestamp_ntz, freq string, dbt string, part string")
    start = int((at - datetime(1970, 1, 1)).total_seconds())
    busy = spark.createDataFrame([("x", start, start + 2000), ("x", start + 1400, start + 1600), ("idle", start, start + 9000)],
                                 "tag_id string, start_time long, finish_time long")
    deps = spark.createDataFrame([("x", "D", "D", "a", None), ("y", "D", "D", "a", None)],
                                 "tag_id string, update_frequency string, freq string, dbt string, part string")
    assert rows(runs.ignored_while_running(messages, deps, busy)) == [(1, "x"), (2, "x")]


def run_row(sql, started, traced, freq="D"):
    return ("t", "s", "i", [("a", "b")], "n", sql, freq, started, traced, "d", "c", "u", None, "sum", "a", "w", False, "ATS", ["x"])


def compose(spark, *definitions):
    from tagloom.schemas import DICTIONARY
    frame = spark.createDataFrame([run_row(*d) for d in definitions], DICTIONARY)
    return runs.composed(frame, F.lit("2018-09-22").cast("date")).select("status", "sql", "start_date", "end_date").collect()


def test_composition(spark):
    got = compose(
        spark,
        ("x $start_date $start_dates $end_date", -3, 3), ("x", None, None), ("x", -1, 1),
        ("cost is 5$", -1, 1), ("x $start_date", None, 3), ("x $start_date", -1, 1, "m"),
    )
    assert [tuple(r) for r in got] == [
        ("dated", "x 2018-09-18 2018-09-18s 2018-09-20", "2018-09-18", "2018-09-20"),
        ("plain", "x", None, None), ("plain", "x", None, None),
        ("dated", "cost is 5$", "2018-09-20", "2018-09-20"), ("error", None, None, None),
        ("dated", "x 2018-08-01", "2018-08-01", "2018-08-31"),
    ]


def test_composed_run_has_the_fifteen_columns(spark, inputs):
    frame = runs.composed_runs(inputs.dictionary, F.lit("2018-09-22").cast("date"))
    assert frame.dtypes == [(f.name, f.dataType.simpleString()) for f in COMPOSED]
