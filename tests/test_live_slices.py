"""Slices of the live tags: their input, their number and their partitions."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tagloom.streaming import live, packed
from tests.test_live import Stream, need


def test_each_slice_has_a_partition(spark):
    """Spark's hash deals the numbers out evenly, and the live stream has no partitions but those."""
    for n in (1, 3, 11):
        numbers = spark.createDataFrame([(k,) for k in packed.spread(n)], "k int")
        assert sorted(r[0] for r in numbers.select(F.pmod(F.hash("k"), F.lit(n))).collect()) == list(range(n))
    s = Stream(spark, [(f"t{i}", "D", need("a")) for i in range(9)])
    s.add([(0, "a"), (200, "x")])
    s.run()
    state = s.state.removeprefix("file:")
    assert sorted(d for d in os.listdir(f"{state}/state/0") if d.isdigit()) == ["0", "1", "2"]
    assert {r["partition_id"] for r in spark.read.format("statestore").option("stateVarName", "tags").load(s.state).collect()} == {0, 1, 2}
    assert s.table("actions").filter("reason = 'ready'").count() == 9


def test_slices_grow_with_the_tags():
    assert live.slices_for(10, 8) == 8
    assert live.slices_for(1_000_000, 8) * live.TAGS_OF_SLICE >= 1_000_000


def test_live_input_says_what_the_rows_say(spark):
    """Late rows of all sorts show what came in: the packed form loses nothing."""
    s = Stream(spark, [("t", "D", need("a"))])
    s.add([(0, "a"), (500, "x")])
    s.run()
    at = datetime(2018, 9, 22, 8) + timedelta(minutes=5)
    second = int((at - datetime(1970, 1, 1)).total_seconds())
    s.add([(5, "a"), (510, "x")], [("t", 7, "Finish", second - 60, second)], [("t", 8, at, "D", need("b"))])
    s.run()
    read = {r["source"]: r["row"] for r in s.table("late").collect()}
    key = '{\\"freq\\":\\"D\\",\\"dbt\\":\\"d.a\\"}'
    dates = '"day":"2018-09-22","month":"201808","target_month":"201808"'
    assert read["message"] == ('{"key":"%s","freq":"D","counts":true,"message":{"kafkaTopic":"frontier-adw","update_frequency":"D",'
                               '"value":"d.a","finish_time":5},%s}' % (key, dates))
    assert read["report"] == '{"tag_id":"t","status":"Finish","start_time":%d,"finish_time":%d,%s,"run_day":"2018-09-22"}' % (second - 60, second, dates)
    assert read["change"] == '{"tag_id":"t","update_frequency":"D","need":["%s"]}' % key.replace("d.a", "d.b")
