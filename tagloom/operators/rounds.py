"""Every readiness of a day, not only the first.

After a run a tag's flags are cleared and it collects again, so one daily cycle can hold many rounds: a
round ends with the message that completes the set since the last round's end. That is a sequential rule,
and one set may receive a third of all messages, so a cycle is cut into slices of time that are worked on
in parallel. Whatever flags are set when a slice begins, the first round in it can only end where one of
the keys occurs for the first time in the slice; so each slice is solved once per such entry point, the
few per-slice summaries of a cycle are chained in order, and the rounds of the entry point that really
applied are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import calendar as cal
from tagloom.operators.keys import key_join, split_join
from tagloom.operators.routing import counted
from tagloom.schemas import DAILY, KEY, MONTHLY
from tagloom.session import stable

SLICE_ROWS = 10_000  # messages a slice of the log holds at most
DAY_US = 86_400_000_000

# one row per slice; what the Python side reads and writes, a batch of slices at a time
SOLVED = """need_id string, cycle string, slice long, n_keys int,
    entry_keys array<int>, entry_after array<array<int>>,
    round_us array<long>, round_ids array<long>, round_by array<array<int>>"""
CHAIN = "need_id string, cycle string, slices array<long>, entries array<int>"


def solve_slice(keys: np.ndarray, n_keys: int) -> tuple[list[int], list[list[int]], dict[int, list[int]]]:
    """Entry points of one slice and the rounds that follow each.

    ``keys`` are the key numbers of the slice's messages in order. Gives the keys in order of their first
    occurrence, per key the keys seen after the last round that follows it, and for every possible round
    end (a position) the entry keys that lead to it.
    """
    present, first = np.unique(keys, return_index=True)
    places = {int(k): np.flatnonzero(keys == k) for k in present}

    def following(pos: int):
        """End of the round that starts behind ``pos``, or the keys seen until the slice is over."""
        nexts = {k: int(np.searchsorted(at, pos, side="right")) for k, at in places.items()}
        seen = [k for k, i in nexts.items() if i < len(places[k])]
        if len(seen) < n_keys:
            return None, sorted(seen)
        return max(int(places[k][nexts[k]]) for k in seen), None

    known: dict[int, tuple] = {}
    entries, after, ends = [], [], {}
    for i in np.argsort(first):
        entry, pos = int(present[i]), int(first[i])
        ends.setdefault(pos, []).append(entry)
        while True:
            if pos not in known:
                known[pos] = following(pos)
            end, left = known[pos]
            if end is None:
                break
            pos = end
            ends.setdefault(pos, []).append(entry)
        entries.append(entry)
        after.append(left)
    return entries, after, ends


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = {name: [] for name in ("entry_keys", "entry_after", "round_us", "round_ids", "round_by")}
        for keys, n_keys, times, ids in zip(rows["key_no"], rows["n_keys"], rows["us"], rows["event_id"]):
            entries, after, ends = solve_slice(np.asarray(keys), int(n_keys))
            places = sorted(ends)
            out["entry_keys"].append(entries)
            out["entry_after"].append(after)
            out["round_us"].append([times[p] for p in places])
            out["round_ids"].append([ids[p] for p in places])
            out["round_by"].append([ends[p] for p in places])
        yield rows[["need_id", "cycle", "slice", "n_keys"]].assign(**out)


def chain(slices: list[tuple[list[int], list[list[int]]]], n_keys: int, held: set[int]) -> list[int | None]:
    """Walk the slice summaries of one cycle in order; gives the entry key that applies in each slice."""
    seen, out = set(held), []
    for keys, after in slices:
        missing = [i for i, k in enumerate(keys) if k not in seen]
        if missing and len(seen) + len(missing) == n_keys:
            out.append(keys[missing[-1]])  # keys are in order of first occurrence
            seen = set(after[missing[-1]])
        else:
            out.append(None)
            seen.update(keys)
    return out


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        entries = [
            chain([([int(k) for k in keys], [[int(k) for k in left] for left in after]) for keys, after in zip(ks, afters)],
                  int(n_keys), set() if held is None else {int(k) for k in held})
            for ks, afters, n_keys, held in zip(rows["entry_keys"], rows["entry_after"], rows["n_keys"], rows["held"])
        ]
        yield pd.DataFrame({"need_id": rows["need_id"], "cycle": rows["cycle"], "slices": rows["slices"],
                            "entries": entries})


def _sliced(events: DataFrame, slice_rows: int) -> DataFrame:
    """Number the slices: a new one with each day and every ``slice_rows`` messages, however fast they come.

    The place of a message in the log's order is exact: rows are put in order by ranges, numbered where they
    lie, and the ranges' sizes, one small row each, are summed up.
    """
    ordered = stable(events.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id").withColumn(
        "_at", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY_US)
    number = F.floor((F.col("_start") + inside) / slice_rows)
    return ordered.withColumn("_part", part).join(starts, "_part").withColumn(
        "slice", day * 1_000_000_000_000 + number).drop("_at", "_part", "_start")


def need_rounds(messages: DataFrame, needs: DataFrame, schedule: cal.Schedule = cal.DEFAULT,
                slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(need_id, cycle, ready_ts, event_id) of every round, for sets that start over after each run."""
    # the messages that count are few beside the log; they are read several times below
    hits = _sliced(
        counted(messages, schedule).select("event_id", "ts", *KEY)
        .withColumn("cycle", cal.cycle(F.col("freq"), F.col("ts"), schedule)), slice_rows)
    # the side of a set that is collected again and again: its daily keys, or its monthly ones if it has no others
    mixed = (F.col("n_daily") > 0) & (F.col("n_monthly") > 0)
    round_keys = needs.filter((F.col("freq") == DAILY) | (F.col("n_daily") == 0)).withColumn(
        "n_keys", F.when(F.col("n_daily") > 0, F.col("n_daily")).otherwise(F.col("n_monthly")))
    matched = split_join(hits, round_keys, KEY, ["event_id"], ["need_id"])

    # a set of one key is complete with every message
    one = (F.col("n_keys") == 1) & ~mixed
    simple = matched.filter(one).select("need_id", "cycle", F.col("ts").alias("ready_ts"), "event_id")

    # a mixed set waits for its monthly side; daily messages before that moment only set flags
    month = F.when(F.col("freq") == DAILY, cal.last_month(F.try_to_date("cycle", "yyyy-MM-dd"), schedule))
    events = (
        matched.filter(~one).withColumn("month", month)
        .join(_monthly_done(hits, needs, schedule), ["need_id", "month"], "left")
        .filter(~mixed | F.col("done.ts").isNotNull())
    )
    waiting = F.coalesce(F.struct("ts", "event_id") < F.col("done"), F.lit(False))
    held = events.filter(waiting).groupBy("need_id", "cycle", "n_keys", "done").agg(
        F.collect_set("key_no").alias("held"))  # no more than the keys of the set
    at_month = (F.size("held") == F.col("n_keys")) & (
        cal.day_text(cal.cycle_day(F.col("done.ts"), schedule)) == F.col("cycle"))
    opened = held.filter(at_month).select(
        "need_id", "cycle", F.col("done.ts").alias("ready_ts"), F.col("done.event_id").alias("event_id"))
    start = held.filter(cal.day_text(cal.cycle_day(F.col("done.ts"), schedule)) == F.col("cycle")).select(
        "need_id", "cycle", F.when(F.size("held") < F.col("n_keys"), F.col("held")).alias("held"))

    message = F.struct("ts", "event_id", "key_no")
    slices = (
        events.filter(~waiting).groupBy("need_id", "cycle", "slice", "n_keys")
        .agg(F.sort_array(F.collect_list(message)).alias("m"))  # bounded by the slice
        .select("need_id", "cycle", "slice", "n_keys", "m.key_no", "m.event_id",
                F.transform("m.ts", lambda ts: F.unix_micros(ts.cast("timestamp"))).alias("us"))
    )
    solved = stable(slices.mapInPandas(_solve, SOLVED))
    summary = F.struct("slice", "entry_keys", "entry_after")
    steps = (
        solved.groupBy("need_id", "cycle", "n_keys").agg(F.sort_array(F.collect_list(summary)).alias("s"))  # per slice
        .join(start, ["need_id", "cycle"], "left")
        .select("need_id", "cycle", "n_keys", "held", F.col("s.slice").alias("slices"), "s.entry_keys", "s.entry_after")
        .mapInPandas(_chain, CHAIN)
        .select("need_id", "cycle", F.explode(F.arrays_zip("slices", "entries")).alias("z"))
        .select("need_id", "cycle", F.col("z.slices").alias("slice"), F.col("z.entries").alias("entry"))
        .filter(F.col("entry").isNotNull())
    )
    taken = (
        solved.select("need_id", "cycle", "slice", F.arrays_zip("round_us", "round_ids", "round_by").alias("rounds"))
        .join(steps, ["need_id", "cycle", "slice"])
        .select("need_id", "cycle", "entry", F.explode("rounds").alias("r"))
        .filter(F.array_contains("r.round_by", F.col("entry")))
        .select("need_id", "cycle", F.timestamp_micros("r.round_us").cast("timestamp_ntz").alias("ready_ts"),
                F.col("r.round_ids").alias("event_id"))
    )
    return simple.unionByName(opened).unionByName(taken)


def _monthly_done(hits: DataFrame, needs: DataFrame, schedule: cal.Schedule) -> DataFrame:
    """(need_id, month, done): the message that completes the monthly side of a mixed set."""
    mixed = needs.filter((F.col("n_daily") > 0) & (F.col("n_monthly") > 0) & (F.col("freq") == MONTHLY))
    first = (
        hits.filter(F.col("freq") == MONTHLY).groupBy(*KEY, F.col("cycle").alias("month"))
        .agg(F.min(F.struct("ts", "event_id")).alias("first"))
    )
    return (
        key_join(mixed, first).groupBy("need_id", "month", "n_monthly")
        .agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("done"))
        .filter(F.col("n") == F.col("n_monthly")).select("need_id", "month", "done")
    )


def tag_rounds(messages: DataFrame, required: DataFrame, needs: DataFrame,
               schedule: cal.Schedule = cal.DEFAULT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rounds of every tag: all of them for daily tags, the first per target month for monthly tags."""
    rounds = stable(need_rounds(messages, needs, schedule, slice_rows))
    daily = rounds.withColumn("update_frequency", F.lit(DAILY))
    once = (
        rounds.groupBy("need_id", cal.last_month(F.to_date("ready_ts"), schedule).alias("target_month"))
        .agg(F.min(F.struct("ready_ts", "event_id", "cycle")).alias("first"))
        .select("need_id", "first.cycle", "first.ready_ts", "first.event_id", F.lit(MONTHLY).alias("update_frequency"))
    )
    tags = required.select("tag_id", "update_frequency", "need_id")
    return split_join(daily.unionByName(once), tags, ["need_id", "update_frequency"], ["event_id"], ["tag_id"]).select(
        "tag_id", "update_frequency", "cycle", "ready_ts", "event_id"
    )
