from datetime import date

import pytest
from pyspark.sql import functions as F

from tagloom.functions import calendar as cal

# fixed values: as-of, two days back, last month, started, traced, daily window, monthly window
GOLDEN = [
    ("2016-03-01", "2016-02-28", "201601", -1, 1, "2016-02-28", "2016-02-28", "2016-01-01", "2016-01-31"),
    ("2016-03-01", "2016-02-28", "201601", -3, 3, "2016-02-26", "2016-02-28", "2015-11-01", "2016-01-31"),
    ("2016-03-02", "2016-02-29", "201602", -3, 3, "2016-02-27", "2016-02-29", "2015-12-01", "2016-02-29"),
    ("2016-03-31", "2016-03-29", "201602", -1, 1, "2016-03-29", "2016-03-29", "2016-02-01", "2016-02-29"),
    ("2018-01-01", "2017-12-30", "201711", -3, 3, "2017-12-28", "2017-12-30", "2017-09-01", "2017-11-30"),
    ("2018-01-02", "2017-12-31", "201712", -1, 1, "2017-12-31", "2017-12-31", "2017-12-01", "2017-12-31"),
    ("2018-09-01", "2018-08-30", "201807", -1, 1, "2018-08-30", "2018-08-30", "2018-07-01", "2018-07-31"),
    ("2018-09-02", "2018-08-31", "201808", -3, 3, "2018-08-29", "2018-08-31", "2018-06-01", "2018-08-31"),
    ("2018-09-03", "2018-09-01", "201808", -1, 1, "2018-09-01", "2018-09-01", "2018-08-01", "2018-08-31"),
    ("2018-09-22", "2018-09-20", "201808", -3, 3, "2018-09-18", "2018-09-20", "2018-06-01", "2018-08-31"),
]


def test_golden_dates(spark):
    frame = spark.createDataFrame([(g[0], g[3], g[4]) for g in GOLDEN], "d string, started int, traced int")
    day = F.to_date("d")
    columns = ["d", cal.day_text(cal.daily_date(day)), cal.last_month(day), "started", "traced"]
    for freq in ("D", "M"):
        start = cal.window_start(F.lit(freq), day, F.col("started"))
        columns += [cal.day_text(start), cal.day_text(cal.window_end(F.lit(freq), start, F.col("traced")))]
    assert [tuple(r) for r in frame.select(*columns).collect()] == GOLDEN


def test_month_to_date(spark):
    cases = [
        ("201809", "2018-09-22", date(2018, 9, 20)),  # the month of the day two days back
        ("201808", "2018-09-22", date(2018, 8, 31)),  # earlier: its last day
        ("201602", "2018-09-22", date(2016, 2, 29)),
        ("201810", "2018-09-22", None),  # still to come
        ("201809", "2018-09-01", None),  # two days back is in August
        ("201813", "2018-09-22", None), ("2018-09-20", "2018-09-22", None), ("", "2018-09-22", None),
        ("20180920", "2018-09-22", None),
    ]
    frame = spark.createDataFrame([c[:2] for c in cases], "v string, d string")
    got = [r[0] for r in frame.select(cal.month_to_date(F.col("v"), F.to_date("d"))).collect()]
    assert got == [c[2] for c in cases]


def test_window_is_not_empty_when_traced_is_positive(spark):
    frame = spark.range(0, 1200).selectExpr(
        "date_add(date'2015-01-01', cast(id as int)) as d", "cast(-(id % 7) as int) as started",
        "cast(1 + id % 5 as int) as traced", "if(id % 2 = 0, 'M', 'D') as f")
    start = cal.window_start(F.col("f"), F.col("d"), F.col("started"))
    assert frame.filter(start > cal.window_end(F.col("f"), start, F.col("traced"))).count() == 0


def test_two_digit_delay_has_no_special_day(spark):
    late = cal.Schedule(daily=-12)
    frame = spark.createDataFrame([("2018-09-12",), ("2018-09-13",)], "d string")
    assert [r[0] for r in frame.select(cal.last_month(F.to_date("d"), late)).collect()] == ["201807", "201808"]
    assert [r[0] for r in frame.select(cal.is_reset_day(F.to_date("d"), late)).collect()] == [True, False]


@pytest.mark.parametrize("cutoff,day,close,month", [
    ("00:00:00", "2018-09-02", "2018-09-03", "201808"),
    ("12:07:00", "2018-09-01", "2018-09-02", "201807"),
])
def test_cycle_of_a_morning_message(spark, cutoff, day, close, month):
    schedule = cal.Schedule(cutoff=cutoff)
    ts = F.lit("2018-09-02 12:06:59").cast("timestamp_ntz")
    got = spark.range(1).select(cal.day_text(cal.cycle_day(ts, schedule)), cal.day_text(cal.cycle_close(ts, schedule)),
                                cal.cycle_month(ts, schedule)).first()
    assert tuple(got) == (day, close, month)


def test_fixed_day_overrides_arrival(spark):
    ts = F.lit("2020-05-05 10:00:00").cast("timestamp_ntz")
    assert spark.range(1).select(cal.as_of(ts, "2018-09-22")).first()[0] == date(2018, 9, 22)
