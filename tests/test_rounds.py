"""Rounds against a message-by-message simulation."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import calendar as cal
from tagloom.operators import rounds
from tagloom.operators.routing import counts
from tagloom.streaming.machine import Event, Tag, advance
from tagloom.streaming.readiness import MESSAGE_FIELDS, message_events, need_units
from tests.conftest import rows


def brute(keys, n_keys, held):
    seen, ends = set(held), []
    for position, key in enumerate(keys):
        seen.add(key)
        if len(seen) == n_keys:
            ends.append(position)
            seen = set()
    return ends


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5), st.lists(st.integers(0, 4), max_size=60), st.lists(st.integers(1, 20), max_size=8), st.data())
def test_slices_give_the_rounds_of_the_whole_sequence(n_keys, keys, widths, data):
    keys = [k % n_keys for k in keys]
    held = data.draw(st.sets(st.integers(0, n_keys - 1), max_size=n_keys - 1))
    cuts = [0] + [int(c) for c in np.cumsum(widths) if c < len(keys)] + [len(keys)]
    slices, found = [], []
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            entries, after, ends = rounds.solve_slice(np.array(keys[a:b]), n_keys)
            slices.append((a, entries, after, ends))
    picked = rounds.chain([(entries, after) for _, entries, after, _ in slices], n_keys, held)
    for (start, _, _, ends), entry in zip(slices, picked):
        found += [start + p for p, by in ends.items() if entry is not None and entry in by]
    assert sorted(found) == brute(keys, n_keys, held)


NEEDS = [
    # need_id, freq, dbt, part, key_no, n_daily, n_monthly
    ("one_day", "D", "a", None, 0, 1, 0),
    ("one_month", "M", "m", "yyyymm", 0, 0, 1),
    ("two_days", "D", "a", None, 0, 2, 0), ("two_days", "D", "b", "yyyymm", 1, 2, 0),
    ("two_months", "M", "m", "yyyymm", 0, 0, 2), ("two_months", "M", "o", "yyyymm", 1, 0, 2),
    ("mixed", "D", "a", None, 0, 2, 1), ("mixed", "D", "b", "yyyymm", 1, 2, 1), ("mixed", "M", "m", "yyyymm", 2, 2, 1),
    ("mixed_one", "D", "a", None, 0, 1, 2), ("mixed_one", "M", "m", "yyyymm", 1, 1, 2),
    ("mixed_one", "M", "o", "yyyymm", 2, 1, 2),
]


def message_log(spark, seed, n=400, days=40):
    """Messages over some weeks; every second one comes from one table."""
    pick, base, out = random.Random(seed), datetime(2024, 1, 25), []
    for event in range(n):
        ts = base + timedelta(seconds=pick.randrange(days * 86_400) // 60 * 60)
        kind = pick.choice(["a", "a", "a", "a", "b", "b", "m", "o"])
        two_back, month = ts - timedelta(days=2), (ts.replace(day=1) - timedelta(days=1)).strftime("%Y%m")
        if kind == "a":
            row = ("D", "a", None, None)
        elif kind == "b":
            row = ("D", "b", "yyyymm", pick.choice([two_back.strftime("%Y-%m-%d"), "2023-12-31"]))
        else:
            row = ("M", kind, "yyyymm", pick.choice([month, month, "202301"]))
        out.append((event, ts, "frontier-adw", *row, 0))
    return spark.createDataFrame(
        out, "event_id long, ts timestamp_ntz, topic string, freq string, dbt string, part string, pvalue string, finish_time long")


def simulate(messages, needs, schedule):
    """Apply the machine to every unit's messages, one by one."""
    units = need_units(needs, needs.select("need_id", F.lit("D").alias("update_frequency")).distinct())
    events = message_events(messages, units, schedule).orderBy("ts", "event_id").collect()
    tags, found = {}, []
    for row in events:
        tag = tags.setdefault(row["unit"], Tag())
        for step in advance(tag, Event(*[row[name] for name in Event._fields]), instant=True):
            if step.reason == "ready":
                found.append((row["unit"].removeprefix("D:"), row["event_id"]))
    return sorted(found, key=repr)


@pytest.mark.parametrize("cutoff,slice_rows,seed", [
    ("00:00:00", 10_000, 1), ("00:00:00", 2, 2), ("12:07:00", 3, 3), ("12:07:00", 10_000, 4),
])
def test_need_rounds_match_the_machine(spark, cutoff, slice_rows, seed):
    schedule = cal.Schedule(cutoff=cutoff)
    messages = message_log(spark, seed)
    needs = spark.createDataFrame(
        NEEDS, "need_id string, freq string, dbt string, part string, key_no int, n_daily int, n_monthly int")
    got = rows(rounds.need_rounds(messages, needs, schedule, slice_rows), "need_id", "event_id")
    expected = simulate(messages, needs, schedule)
    assert got == expected
    assert {need for need, _ in got} == {n[0] for n in NEEDS}


def test_messages_that_do_not_count_change_nothing(spark):
    messages = message_log(spark, 9)
    needs = spark.createDataFrame(
        NEEDS, "need_id string, freq string, dbt string, part string, key_no int, n_daily int, n_monthly int")
    good = messages.filter(counts())
    assert rows(rounds.need_rounds(messages, needs)) == rows(rounds.need_rounds(good, needs))


def test_message_events_carry_what_the_machine_needs(spark):
    needs = spark.createDataFrame(
        NEEDS, "need_id string, freq string, dbt string, part string, key_no int, n_daily int, n_monthly int")
    frame = message_events(message_log(spark, 1, 20), need_units(needs, needs.select("need_id", F.lit("D").alias("update_frequency")).distinct()))
    assert frame.columns == MESSAGE_FIELDS
    assert frame.filter(F.col("day").isNull() | F.col("month").isNull()).count() == 0


def test_a_burst_is_cut_too(spark):
    """No slice holds more than its bound, however many messages come in one moment, and slices follow the order."""
    from tagloom.operators.rounds import _sliced

    burst = spark.range(0, 20_000).selectExpr("id as event_id", "timestamp_ntz'2024-01-02 03:04:05' as ts").unionByName(
        spark.range(20_000, 20_050).selectExpr("id as event_id", "timestamp_ntz'2024-01-03 00:00:00' as ts"))
    cut = _sliced(burst, 10)
    sizes = [r["count"] for r in cut.groupBy("slice").count().collect()]
    assert max(sizes) <= 10 and sum(sizes) == 20_050
    bounds = sorted((r["slice"], r["a"], r["b"]) for r in cut.groupBy("slice").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).collect())
    assert all(x[2] < y[1] for x, y in zip(bounds, bounds[1:]))
