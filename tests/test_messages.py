"""Odd cases of the message rules, one by one."""

import json
from datetime import datetime

import pytest

from tagloom.functions import calendar as cal
from tagloom.operators import mapping as mp
from tagloom.operators import readiness as rd
from tagloom.operators import routing as rt
from tests.conftest import rows

LOG = "event_id long, ts timestamp_ntz, topic string, value string"
AT = datetime(2018, 9, 22, 10)


def raw(spark, *bodies, topic="frontier-adw"):
    texts = [b if isinstance(b, str) or b is None else json.dumps(b) for b in bodies]
    return spark.createDataFrame([(i, AT, topic, t) for i, t in enumerate(texts)], LOG)


def body(table, fields, values, db="d", **more):
    return dict(table=table, partition_fields=fields, partition_values=values, db=db, method="m", exec_date=7) | more


@pytest.fixture(scope="module")
def frequencies(spark):
    return spark.createDataFrame([("d.day", "D"), ("d.month", "M")], "dbt string, freq string")


def test_normalised_shapes(spark, frequencies):
    log = raw(
        spark, body("day", ["yyyymm"], ["201809"]), body("day", ["yyyymm"], ["201808"]), body("day", ["yyyymm"], ["201810"]),
        body("day", [""], ["201809"]), body("day", ["yyyymm"], [""]), body("month", ["yyyymm", "x"], ["201808", "y"]),
        body("month", [""], [""]))
    assert rows(rt.tag_messages(log, frequencies), "event_id", "freq", "part", "pvalue", "finish_time") == [
        (0, "D", "yyyymm", "2018-09-20", 7), (1, "D", "yyyymm", "2018-08-31", 7), (2, "D", "yyyymm", None, 7),
        (3, "D", None, None, 7), (4, "D", None, None, 7), (5, "M", "yyyymm", "201808", 7), (6, "M", "", "", 7)]
    kept = rt.tag_messages(log, frequencies)
    assert rows(rt.counted(kept), "event_id") == [(0,), (3,), (4,), (5,)]
    assert rows(rt.ignored(kept), "event_id", "reason") == [(1, "behind_target"), (2, "future_month"), (6, "behind_target")]


def test_quarantine_reasons(spark, frequencies):
    good = body("day", ["yyyymm"], ["201809"])
    log = raw(spark, "nope", None, good, body("other", ["p"], ["v"]), body("day", [], []), body("month", ["p"], []),
              body("day", ["yyyymm"], ["2018-09-20"]), {k: v for k, v in good.items() if k != "db"}, good | {"exec_date": "x"},
              body("month", ["yyyymm"], ["anything"]))
    assert rows(rt.quarantine(log, frequencies), "event_id", "reason") == [
        (0, "bad_json"), (1, "bad_json"), (3, "unknown_table"), (4, "empty_partition"), (5, "empty_partition"),
        (6, "bad_month"), (7, "bad_json"), (8, "bad_json")]
    assert rows(rt.tag_messages(log, frequencies), "event_id") == [(2,), (9,)]


def test_own_output_is_not_read(spark):
    log = raw(spark, body("day", [""], [""]), topic="hippo-finish")
    assert rt.on_frontier(log).count() == 0
    assert rt.on_frontier(log, topics=("frontier-adw", "hippo-finish")).count() == 0


def test_empty_partition_key_never_meets_an_absent_one(spark, frequencies):
    log = rt.tag_messages(raw(spark, body("month", [""], [""])), frequencies)
    deps = spark.createDataFrame([("t", "M", "M", "d.month", None)], "tag_id string, update_frequency string, freq string, dbt string, part string")
    assert rt.route(log, deps).count() == 0
    assert rt.without_subscriber(log, deps).count() == 1


def mapping(spark, *entries):
    names = "row_seq long, view_id string, db_id string, table_id string, year_ind string, month_ind string, day_ind string, ref_ind string, partition_id string, disabled_ind string"
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], names)


def test_mapping_classes(spark):
    frame = mapping(
        spark,
        ("s.ref/s.also", "d", "r", "", "", "", "v", "", ""), ("s.both", "d", "b", "", "v", "v", "", "other", ""),
        ("s.mon", "d", "m", "", "v", "", "", "p", ""), ("s.day", "d", "y", "", "", "v", "", "", ""),
        ("s.year", "d", "z", "v", "", "", "", "p", ""), ("s.off", "d", "o", "", "", "v", "", "p", "v"),
        ("s.null", "d", "n", "", "", "v", "", "p", None), ("nodot", "d", "q", "", "", "v", "", None, ""),
        ("s.refmonth", "d", "k", "", "v", "v", "v", None, ""), ("s.mon", "d", "last", "", "", "v", "", "p", ""))
    assert rows(mp.view_map(frame)) == sorted([
        ("ref", "D", "d.r", None), ("also", "D", "d.r", None), ("both", "D", "d.b", "yyyymm"), ("mon", "D", "d.last", "p"),
        ("day", "D", "d.y", None), ("refmonth", "D", "d.k", None)], key=repr)
    assert ("d.q", "D") in rows(mp.table_frequency(frame))  # a name without a dot still gives its table a frequency


def test_hidden_frequency_is_reported(spark):
    frame = mapping(spark, ("s.a", "d", "t", "", "", "v", "", "p", ""), ("s.b", "d", "t", "", "v", "", "", "p", ""))
    assert rows(mp.frequency_conflicts(frame)) == [("d.t", "M", "D,M")]


def test_repeated_messages_change_no_readiness(inputs):
    doubled = inputs.messages.unionByName(inputs.messages)
    assert rows(rd.first_arrivals(doubled)) == rows(inputs.arrivals)


def test_more_messages_never_unset_a_flag(spark, inputs):
    end = inputs.end
    few = inputs.messages.filter("event_id % 2 = 0")
    before = rd.flags_at(end, inputs.deps, few).filter("satisfied").select("tag_id", "freq", "dbt", "part")
    after = rd.flags_at(end, inputs.deps, inputs.messages).filter("satisfied").select("tag_id", "freq", "dbt", "part")
    assert before.exceptAll(after).count() == 0


def test_stale_flags_fall_on_revival(spark):
    flags = spark.createDataFrame(
        [("t", "D", "a", "p", "2018-09-20", True), ("t", "D", "b", None, None, True), ("t", "M", "c", "p", "201808", True),
         ("t", "M", "d", "p", "201807", True)],
        "tag_id string, freq string, dbt string, part string, pvalue string, satisfied boolean")
    from pyspark.sql import functions as F
    day = F.lit("2018-09-23").cast("date")
    assert rows(rd.stale_reset(flags, day), "dbt", "revived") == [("a", False), ("b", True), ("c", True), ("d", False)]


def test_a_flag_before_the_cutoff_is_wiped_by_it(spark):
    log = [(1, datetime(2018, 9, 22, 12, 6), "D", "a", None, None), (2, datetime(2018, 9, 22, 12, 8), "D", "b", None, None)]
    messages = spark.createDataFrame(log, "event_id long, ts timestamp_ntz, freq string, dbt string, part string, pvalue string")
    needs = spark.createDataFrame([("n", "D", d, None, i, 2, 0) for i, d in enumerate("ab")],
                                  "need_id string, freq string, dbt string, part string, key_no int, n_daily int, n_monthly int")
    for cutoff, n in (("00:00:00", 1), ("12:07:00", 0)):
        schedule = cal.Schedule(cutoff=cutoff)
        assert rd.ready_needs(rd.first_arrivals(messages, schedule), needs, schedule).count() == n
