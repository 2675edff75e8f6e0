"""Readiness over a stream of messages, with keyed state.

Messages of one tag come over several partitions and out of order, and what a tag does depends on the order. So
rows wait in the state until the watermark has passed them and are then worked off in order of time, whichever
micro-batch brought them. A row that comes behind the watermark comes out with the reason ``late`` and moves nothing, so the
rows in time give the same result however the log is cut into micro-batches. A source that falls silent holds its last rows back for the delay; a message
of any table, such as a heartbeat, moves the watermark on.

The state is kept per slice of the units, in bulk, so its calls do not grow with the units. Checkpoints of an earlier version
have other state and cannot be continued.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import tagloom
from tagloom.functions import calendar as cal
from tagloom.operators.keys import split_join
from tagloom.operators.routing import counted, counts, tag_messages
from tagloom.schemas import DAILY, KEY, MONTHLY
from tagloom.session import FREED, fresh_dir, settings
from tagloom.streaming import packed
from tagloom.streaming.machine import Event, Tag, advance
from tagloom.streaming.packed import HOUR, NULL, Coded, Waiting

TRANSITION = """unit string, ts timestamp, event_id long, seq int, cycle string, from_state string,
    to_state string, reason string"""
DELAY = "1 hour"  # how late a message may come
LATE = "late"
BATCH_ROWS = 100_000  # messages of one key that a micro-batch may bring; shapes slices only
MESSAGE_FIELDS = ["unit", "ts", "event_id", "cycle", *Event._fields]
NUMBERS, FORM = ["us", "event_id"], ["cycle", *Event._fields]  # of a packed row, with its unit
MOMENT = 2  # the order of waiting rows: time, then event
SLICES = 64  # groups of units that share keyed state; a checkpoint keeps them
PARTS = 64  # groups of the tags of a slice that are read and written together
HOLD = 1_000_000  # rows that a slice gathers before they go into the state
OUT = 20_000  # rows of one frame that comes out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["unit", "ts", "event_id", "seq", "cycle", "from_state", "to_state", "reason"])
    frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
    if (frame["event_id"] == NULL).any():
        frame["event_id"] = frame["event_id"].astype("Int64").mask(frame["event_id"] == NULL)
    return frame


def _blocks(chunk: pd.DataFrame) -> Iterator[list[packed.Column]]:
    """The blocks of a frame of packed rows, or of one that has the rows themselves."""
    if "rows" in chunk:
        yield from map(packed.load, chunk["rows"])
        return
    chunk = chunk[chunk["us"].notna()]
    each = np.arange(len(chunk))
    yield [*[chunk[name].fillna(NULL).to_numpy("int64") for name in NUMBERS], Coded(each, chunk["unit"].tolist()),
           Coded(each, list(zip(*[chunk[name].tolist() for name in FORM])))]


class TagMachine(StatefulProcessor):
    """Keeps a ``Tag`` per unit of its slice and the rows that wait for it; emits its transitions, all of them or those of one reason.

    A call of the state takes its time, so rows and tags go into it in bulk: rows by the hour in which they are due, tags by a
    hash of the unit. Hours are worked off one after another, so a slice holds its tags that move, an hour of rows and a
    bounded number of rows on their way in or out.
    """

    def __init__(self, instant: bool, reasons: tuple[str, ...] | None = None):
        self.instant, self.reasons = instant, reasons

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("tags", "part int", "tags binary")
        self.waiting = handle.getMapState("waiting", "hour long, part int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held, n, latest, waiting = [], 0, None, Waiting(self.waiting, MOMENT)
        for block in (block for chunk in rows for block in _blocks(chunk)):
            late = block[0] <= watermark
            if late.any():
                if self.reasons is None or LATE in self.reasons:
                    us, event_id, units, forms = packed.take(block, late)
                    out = [(unit, moment, event, 0, form[0], None, None, LATE) for unit, moment, event, form in zip(
                        units.column(), us.tolist(), event_id.tolist(), forms.column())]
                    for at in range(0, len(out), OUT):
                        yield _frame(out[at:at + OUT])
                block = packed.take(block, ~late)
            if not len(block[0]):
                continue
            latest = max(int(block[0].max()), latest or 0)
            held.append(block)
            n += len(block[0])
            if n >= HOLD:
                waiting.put(held)
                held, n = [], 0
        if held:
            waiting.put(held)
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        yield from self._due(watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(timerValues.getCurrentWatermarkInMs() * 1000)

    def _taken(self, watermark: int) -> Iterator[tuple]:
        """(us, event, unit, cycle, event) of the rows that are due, in order of time."""
        for us, event_id, units, forms in Waiting(self.waiting, MOMENT).taken(watermark):
            events = [(form[0], Event(*form[1:])) for form in forms.values]
            yield from zip(us.tolist(), event_id.tolist(), units.column(), Coded(forms.codes, events).column())

    def _tags(self, part: int) -> dict[str, Tag]:
        found = self.kept.getValue((part,)) if self.kept.containsKey((part,)) else None
        return {unit: Tag(state, set(daily), set(monthly), *rest)
                for unit, (state, daily, monthly, *rest) in (pickle.loads(found[0]) if found else {}).items()}

    def _due(self, watermark: int) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        parts: dict[int, dict[str, Tag]] = {}
        place: dict[str, Tag] = {}  # the tags that have moved
        instant, reasons = self.instant, self.reasons
        for us, event_id, unit, (cycle, event) in self._taken(watermark):
            tag = place.get(unit)
            if tag is None:
                part = crc32((unit or "").encode()) % PARTS
                if part not in parts:
                    parts[part] = self._tags(part)
                tag = place[unit] = parts[part].setdefault(unit, Tag())
            for seq, step in enumerate(advance(tag, event, instant)):
                if reasons is None or step.reason in reasons:
                    out.append((unit, us, event_id, seq, cycle, *step))
            if len(out) >= OUT:
                yield _frame(out)
                out = []
        for part, tags in parts.items():
            self.kept.updateValue((part,), (pickle.dumps({
                unit: (t.state, sorted(t.daily), sorted(t.monthly), t.day, t.month, t.run_month, t.failures, t.run_day)
                for unit, t in tags.items()}),))
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def timed(log: DataFrame, delay: str = DELAY) -> DataFrame:
    """A stream whose moments carry the watermark."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def dated(rows: DataFrame, schedule: cal.Schedule) -> DataFrame:
    """The dates the machine needs."""
    ts = F.col("ts")
    return rows.withColumns({
        "day": cal.day_text(cal.cycle_day(ts, schedule)),
        "month": cal.cycle_month(ts, schedule),
        "target_month": cal.last_month(F.to_date(ts), schedule),
    })


def message_events(messages: DataFrame, units: DataFrame, schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """Messages routed to units. ``units`` has one row per unit and needed key, with ``update_frequency``."""
    flagged = dated(messages, schedule).withColumn("counts", counts(schedule))
    routed = split_join(flagged, units, KEY, ["event_id"], ["unit"], left_rows=BATCH_ROWS)
    cycle = F.when(F.col("n_daily") > 0, F.col("day")).otherwise(F.col("month"))
    return routed.withColumns({"status": F.lit(""), "run_day": F.lit(""), "cycle": cycle}).select(*MESSAGE_FIELDS)


def report_events(reports: DataFrame, sizes: DataFrame, schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """Run reports (``unit``, ``seq``, ``status``, ``start_time`` and their moment ``ts``) as events; ``sizes`` has one
    row per unit. A report names its run by the daily cycle that it was started in."""
    started = F.timestamp_seconds("start_time")
    run_day = cal.day_text(cal.cycle_day(started, schedule))
    return dated(reports, schedule).join(sizes, "unit").select(
        "unit", "ts", F.col("seq").alias("event_id"),
        F.col("day").alias("cycle"), "status", "update_frequency", F.lit("").alias("freq"),
        F.lit(-1).alias("key_no"), F.lit(False).alias("counts"), "n_daily", "n_monthly", "day", "month", "target_month",
        run_day.alias("run_day"),
    )


def report_times(reports: DataFrame, delay: str = DELAY) -> DataFrame:
    """A stream of reports, each at the moment its attempt ended."""
    return reports.withColumn("ts", F.timestamp_seconds("finish_time")).withWatermark("ts", delay)


def transitions(events: DataFrame, instant: bool, reasons: tuple[str, ...] | None = None, slices: int = SLICES) -> DataFrame:
    """State changes of every unit, in the order of its rows' moments, and its late rows. The rows carry a watermark on ``ts``.

    Units are dealt into ``slices`` by a hash; a slice's state is one key, and all rows of a unit meet there, packed by the tasks
    that make them. The moment goes in as a plain number, as Spark would drop rows of a marked column behind the watermark unseen.
    """
    slice_of = F.pmod(F.xxhash64(F.lit("slice"), F.col("unit")), F.lit(slices)).cast("int").alias("slice")
    rows = events.withColumn("us", F.unix_micros("ts")).select(slice_of, *NUMBERS, "unit", *FORM).mapInArrow(
        packed.packer(NUMBERS, "unit", FORM), packed.PACKED)
    # Spark starts the processor on the driver first, in a process that does not see the files sent to the workers,
    # so this code goes along by value
    cloudpickle.register_pickle_by_value(tagloom)
    try:
        return rows.groupBy("slice").transformWithStateInPandas(
            statefulProcessor=TagMachine(instant, reasons), outputStructType=TRANSITION, outputMode="Append", timeMode="EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(tagloom)


def need_units(needs: DataFrame, required: DataFrame) -> DataFrame:
    """Without run reports all tags of one requirement set and frequency behave alike: one unit for them."""
    used = required.select("need_id", "update_frequency").distinct()
    return needs.join(used, "need_id").withColumn("unit", F.concat_ws(":", "update_frequency", "need_id")).drop("need_id")


def tag_units(required: DataFrame, needs: DataFrame) -> DataFrame:
    """One unit per tag, for runs whose reports come back."""
    return required.select(F.col("tag_id").alias("unit"), "update_frequency", "need_id").join(needs, "need_id").drop("need_id")


def readiness_stream(log: DataFrame, frequencies: DataFrame, needs: DataFrame, required: DataFrame,
                     schedule: cal.Schedule = cal.DEFAULT, delay: str = DELAY) -> DataFrame:
    """Ready tags from a message stream: (tag_id, update_frequency, cycle, ready_ts, event_id)."""
    return ready_rows(readiness_actions(log, frequencies, needs, required, schedule, delay), required)


def readiness_actions(log: DataFrame, frequencies: DataFrame, needs: DataFrame, required: DataFrame,
                      schedule: cal.Schedule = cal.DEFAULT, delay: str = DELAY) -> DataFrame:
    """What becomes ready and what comes too late, per requirement set and frequency.

    The mapping, the requirement sets and the tags are tables. Messages that do not count can only wake a tag,
    which nobody sees here, so they are dropped before the fan-out.
    """
    hits = counted(tag_messages(timed(log, delay), frequencies, schedule), schedule)
    events = message_events(hits, need_units(needs, required), schedule)
    return transitions(events, instant=True, reasons=("ready", LATE))


def late_messages(actions: DataFrame) -> DataFrame:
    """(event_id, ts) of the messages that some unit got too late; of a written table of actions."""
    return actions.filter(F.col("reason") == LATE).select("event_id", "ts").distinct()


def ready_rows(actions: DataFrame, required: DataFrame) -> DataFrame:
    """Readiness handed on to the tags."""
    ready = actions.filter(F.col("reason") == "ready")
    tags = required.select("tag_id", "update_frequency", F.concat_ws(":", "update_frequency", "need_id").alias("unit"))
    return ready.join(tags, "unit").select(
        "tag_id", "update_frequency", "cycle", F.col("ts").alias("ready_ts"), "event_id"
    )


def drain(stream: DataFrame, checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Run a stream over all input present and give what it wrote as a table.

    With the same ``checkpoint`` and ``target`` a later call goes on where this one ended.
    """
    spark = stream.sparkSession
    target = target or fresh_dir(spark, "stream-out")
    with settings(spark, {FREED: "true"}):
        query = (
            stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", checkpoint or fresh_dir(spark, "stream-state")).start(target)
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
