"""Tags that live in a stream: messages, run reports and changed definitions move them, and what they do comes out.

The state is kept per slice of the tags, which a hash of the tag id deals out evenly. Every slice sees all messages (few:
a table lands once a day) and hands each to its own tags that need it, so a changed definition takes effect where it stands
in the order of time. Reports and changes go to the slice of their tag. Spark holds what a slice gets of a micro-batch in
memory outside its heap at once, so rows are packed where they are made and stay so until they are due.

Rows wait, hour by hour, until the watermark has passed them and are then worked off in order of time; a batch reads
the hours that are due and no others, one at a time. A slice holds its tags, one hour of rows and a bounded number of
rows on their way into the state or out of it, however many a batch brings. A row that arrives behind the watermark comes out as a row of kind ``late`` and
moves nothing: what the stream did is what a batch over the log without the late rows does. The watermark is that of the
source that is ahead (``AHEAD``), so a source that falls silent holds nothing back.

Some minutes before each cutoff a slice says which of its awake tags still miss inputs, and which. The moment stands in the
order of time like a row does, and a timer brings it up when no row does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from sys import intern
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import tagloom
from tagloom.functions import calendar as cal
from tagloom.operators.routing import counts, tag_messages
from tagloom.schemas import DAILY, KEY, RECEIVING, RUNNING, START, WAITING
from tagloom.streaming import packed
from tagloom.streaming.machine import Event, Tag, advance
from tagloom.streaming.packed import NULL, Coded, Waiting
from tagloom.streaming.readiness import DELAY, dated, report_times, timed

SLICES = 64
MINUTE = 60_000_000
AHEAD = ("spark.sql.streaming.multipleWatermarkPolicy", "max")
CHANGE, MESSAGE, REPORT = 0, 1, 2  # order of rows of one moment
LEAD_MINUTES = 2  # from the report of unfinished tags to the cutoff
TAGS_OF_SLICE = 30_000  # a slice holds its tags, some 3 kB each
PARTS = 64  # groups of the tags of a slice that are read and written together
HOLD = 500_000  # rows that a slice gathers before they go into the state
SINGLE = 8  # groups of tags that a batch reads one by one, before it reads all of its slice
OUT = 20_000  # rows of one frame that comes out
ASLEEP_AFTER = 64 * cal.DAY_US  # without a row no tag is awake that long: a monthly cycle has 31 days

TAGS = """tag_id string, state string, update_frequency string, need array<string>, daily array<string>, monthly array<string>,
    day string, month string, run_month string, failures int, run_day string, held array<string>"""
FIELDS = [field.split()[0] for field in TAGS.split(",")]
ACTIONS = """kind string, tag_id string, ts timestamp, event_id long, seq int, cycle string, update_frequency string,
    from_state string, to_state string, reason string, body string"""
#: a row of the input: its place in time, the attempt's times as seconds from there, the key or tag, and all else as JSON
NUMBERS, WHO, FORM = ["us", "sort", "event_id", "began", "ended"], "who", "form"
MOMENT = 3  # the order of waiting rows: time, then sort, then event


@lru_cache(1 << 16)
def _freq_and_table(key: str) -> tuple[str, str]:
    read = json.loads(key)
    return read["freq"], read["dbt"]


@lru_cache(1 << 16)
def _key_of(message: str) -> str:
    """The key of a held message."""
    return json.loads(message)["key"]


class Entry:
    """A registered tag: what it needs, the machine's state, and the messages it holds."""

    __slots__ = ("update_frequency", "need", "tag", "held", "n_daily", "n_monthly", "settled")

    def __init__(self, update_frequency: str = "", need: list[str] = (), tag: Tag | None = None, held: list[str] = ()):
        self.update_frequency, self.tag, self.held = update_frequency, tag or Tag(), list(held)
        self.require(need)

    def require(self, need: list[str]) -> None:
        self.need = list(need)
        self.n_daily = sum(_freq_and_table(k)[0] == DAILY for k in self.need)
        self.n_monthly = len(self.need) - self.n_daily
        self.settled = False

    def settle(self) -> None:
        """Outside a run only flags of needed keys are held, and only messages of flags that are held."""
        if self.tag.state != RUNNING:
            needed = set(self.need)
            self.tag.daily &= needed
            self.tag.monthly &= needed
            if self.held:
                flags = self.tag.daily | self.tag.monthly
                self.held = [m for m in self.held if _key_of(m) in flags]
            self.settled = True

    def missing_at(self, day: str, month: str) -> list[str]:
        """The tables that a tag still waits for in these cycles; none if it is asleep, or running since this day. Cutoffs that
        no row has brought to the machine yet count as past."""
        tag = self.tag
        if tag.state == WAITING or (tag.day >= day and tag.state == RUNNING):
            return []
        daily = tag.daily if tag.day >= day else set()
        monthly = tag.monthly if tag.day >= day or tag.month == month else set()
        if tag.day < day and not monthly:
            return []
        return sorted({_freq_and_table(k)[1] for k in set(self.need) - daily - monthly})

    def row(self) -> tuple:
        t = self.tag
        return (t.state, self.update_frequency, self.need, sorted(t.daily), sorted(t.monthly), t.day, t.month, t.run_month,
                t.failures, t.run_day, self.held)

    @staticmethod
    def of(row: tuple) -> Entry:
        state, update_frequency, need, daily, monthly, day, month, run_month, failures, run_day, held = row
        tag = Tag(state, set(daily or ()), set(monthly or ()), day, month, run_month, failures, run_day)
        return Entry(update_frequency, map(intern, need or ()), tag, held or ())


def _part(tag_id: str | None) -> int:
    return crc32((tag_id or "").encode()) % PARTS


class Registry:
    """The tags of a slice, as far as a batch needs them: those of a part are read and written together."""

    def __init__(self, state):
        self.state, self.tags, self.parts, self.moved, self.whole, self.subscribers = state, {}, set(), set(), False, None

    def _read(self, rows: list[str]) -> None:
        for tag in map(json.loads, rows):
            self.tags[tag["tag_id"]] = Entry.of([tag[name] for name in FIELDS[1:]])

    def read_all(self) -> dict[str, Entry]:
        if not self.whole:
            for (part,), (rows,) in self.state.iterator():
                if part not in self.parts:
                    self._read(rows)
            self.whole = True
        return self.tags

    def get(self, tag_id: str) -> Entry | None:
        """The tag, which may be changed."""
        part = _part(tag_id)
        self.moved.add(part)
        if not self.whole and part not in self.parts:
            if len(self.parts) >= SINGLE:
                self.read_all()
            else:
                self.parts.add(part)
                if self.state.containsKey((part,)):
                    self._read(self.state.getValue((part,))[0])
        return self.tags.get(tag_id)

    def subscribed(self, key: str) -> list[str]:
        if self.subscribers is None:
            self.subscribers = {}
            for tag_id, found in self.read_all().items():
                for k in found.need:
                    self.subscribers.setdefault(k, []).append(tag_id)
        return self.subscribers.get(key, [])

    def put(self, tag_id: str, entry: Entry | None) -> None:
        """A tag's new definition; without one it leaves."""
        self.moved.add(_part(tag_id))
        self.tags.pop(tag_id, None)
        if entry is not None:
            self.tags[tag_id] = entry
        self.subscribers = None

    def save(self) -> None:
        rows: dict[int, list[str]] = {part: [] for part in self.moved}
        for tag_id, found in self.tags.items():
            if (part := _part(tag_id)) in rows:
                rows[part].append(json.dumps(dict(zip(FIELDS, (tag_id, *found.row())))))
        for part, some in rows.items():
            if some:
                self.state.updateValue((part,), (some,))
            elif self.state.containsKey((part,)):
                self.state.removeKey((part,))


def _known(fields: dict) -> dict:
    return {name: value for name, value in fields.items() if value is not None}


def body_of(us: int, sort: int, began: int, ended: int, who: str, form: dict) -> dict:
    """An input row with all that it says."""
    began, ended = (None if n == NULL else n + us // 1_000_000 for n in (began, ended))
    if sort == CHANGE:
        return {"tag_id": who, **form}
    dates = {n: form[n] for n in ("day", "month", "target_month") if n in form}
    if sort == REPORT:
        return _known({"tag_id": who, "status": form.get("status"), "start_time": began, "finish_time": ended, **dates, "run_day": form.get("run_day")})
    key = _key_fields(who)
    message = _known({"kafkaTopic": form.get("topic"), "update_frequency": key["freq"], "value": key["dbt"], "partition_fields": key.get("part"),
                      "partition_values": form.get("pvalue"), "finish_time": ended})
    return {"key": who, "freq": key["freq"], "counts": form["counts"], "message": message, **dates}


@lru_cache(1 << 16)
def _key_fields(key: str) -> dict:
    return json.loads(key)


def held_text(body: dict) -> str:
    return json.dumps({"key": body["key"], "message": body["message"]}, sort_keys=True)


def moved(entry: Entry, body: dict) -> list[tuple]:
    """What a message or report does to a tag: (kind, step, body) rows. The entry changes. A message keeps the text as which it
    is held, which all its tags share."""
    report, tag = "status" in body, entry.tag
    before = tag.state
    if not report and body["day"] <= tag.day and (before == RUNNING or before == RECEIVING and entry.settled and not body["counts"]):
        return []  # most messages
    held = list(entry.held) if report else ()
    event = Event(
        body.get("status", ""), entry.update_frequency, "" if report else body["freq"], -1 if report else body["key"],
        not report and body["counts"], entry.n_daily, entry.n_monthly, body["day"], body["month"], body["target_month"],
        body.get("run_day", ""))
    steps = advance(tag, event, instant=False)
    out = [("transition", step, None) for step in steps]
    if report:
        if body["status"] == START and tag.state == RUNNING and tag.run_day == body["run_day"]:
            out.append(("start", None, {"start_time": body["start_time"], "need": [json.loads(k) for k in entry.need]}))
        for step in steps:
            if step.reason in ("finished", "gave_up"):
                out.append(("finish", None, {
                    "start_time": body["start_time"], "finish_time": body["finish_time"], "is_success": step.reason == "finished",
                    "received": [json.loads(m)["message"] for m in held]}))
    elif event.counts and (before != RUNNING or any(s.reason == "cutoff" for s in steps)):
        if body["key"] in (tag.daily if body["freq"] == DAILY else tag.monthly):
            if "held" not in body:
                body["held"] = held_text(body)
            text = body["held"]
            if any(s.reason == "cutoff" for s in steps):  # what the cutoff has wiped goes first
                flags = (tag.daily | tag.monthly) - {body["key"]}
                entry.held = [m for m in entry.held if _key_of(m) in flags]
            if text not in entry.held:  # equal messages are one
                entry.held.append(text)
    if steps or not entry.settled or not report and body["key"] not in entry.need:
        entry.settle()
    return out


def _rows(block: list[packed.Column]) -> Iterator[tuple]:
    """(us, sort, event_id, began, ended, who, form) of a block."""
    *numbers, who, forms = block
    read = [json.loads(form) for (form,) in forms.values]
    return zip(*[c.tolist() for c in numbers], who.column(), Coded(forms.codes, read).column())


class LiveTags(StatefulProcessor):
    """The tags of one slice. ``teller`` is the slice that speaks where all of them see the same."""

    def __init__(self, schedule: cal.Schedule = cal.DEFAULT, lead_minutes: int = LEAD_MINUTES, teller: int = 0):
        self.schedule, self.lead, self.teller = schedule, lead_minutes * MINUTE, teller

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tags = handle.getMapState("tags", "part int", "rows array<string>")
        self.waiting = handle.getMapState("waiting", "hour long, part int", "rows binary")
        self.reported = handle.getValueState("reported", "us long")  # up to when reports have been made

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows have the tags of a part each."""
        for part, rows in zip(initialState["part"].tolist(), initialState["tags"]):
            registry = Registry(self.tags)
            for row in map(json.loads, rows):
                b = json.loads(row["body"])
                tag = Tag(b.get("state", WAITING), set(b.get("daily", ())), set(b.get("monthly", ())), b.get("day", ""),
                          b.get("month", ""), b.get("run_month", ""), b.get("failures", 0), b.get("run_day", ""))
                registry.put(row["tag_id"], Entry(b["update_frequency"], b["need"], tag, b.get("held", ())))
            registry.save()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held, n, latest, waiting = [], 0, None, Waiting(self.waiting, MOMENT)
        for block in (packed.load(data) for chunk in rows for data in chunk["rows"]):
            late = block[0] <= watermark
            if late.any():
                yield from self._out(self._late(packed.take(block, late), watermark, key[0] == self.teller))
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
            held = []
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        yield from self._due(watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(timerValues.getCurrentWatermarkInMs() * 1000)

    def _late(self, block: list[packed.Column], watermark: int, tells: bool) -> list[tuple]:
        """Rows behind the watermark: all slices see a message late, one says so."""
        out = []
        for us, sort, event_id, began, ended, who, form in _rows(block):
            if sort != MESSAGE or tells:
                row = json.dumps(body_of(us, sort, began, ended, who, form), separators=(",", ":"), ensure_ascii=False)
                out.append(("late", None if sort == MESSAGE else who, us, event_id, 0, None, None, None, None,
                            ("change", "message", "report")[sort], json.dumps({"watermark": watermark, "row": row})))
        return out

    def _taken(self, watermark: int) -> Iterator[tuple]:
        """Rows that are due, in order of time; of one moment, sort and event they come in the order of what they say."""
        for block in Waiting(self.waiting, MOMENT).taken(watermark):
            moments = np.stack(block[:MOMENT])
            if (moments[:, 1:] == moments[:, :-1]).all(axis=0).any():
                rows = list(zip(*[c.column() if isinstance(c, Coded) else c.tolist() for c in block]))
                order = sorted(range(len(rows)), key=lambda i: (*rows[i][:MOMENT], str(rows[i][MOMENT + 2]), *rows[i][MOMENT + 3], *rows[i][MOMENT:MOMENT + 2]))
                block = packed.take(block, np.array(order))
            yield from _rows(block)

    def _due(self, watermark: int) -> Iterator[pd.DataFrame]:
        out, registry = [], Registry(self.tags)
        clock = began = self.reported.get()[0] if self.reported.exists() else None
        for us, sort, event_id, start, end, who, form in self._taken(watermark):
            clock = us - 1 if clock is None else clock
            for some in self._unfinished(clock, us - 1, registry):
                yield from self._out(out + some)
                out = []
            clock = max(clock, us - 1)
            if sort == CHANGE:
                out.append(self._change(us, event_id, body_of(us, sort, start, end, who, form), registry))
                continue
            ids = registry.subscribed(who) if sort == MESSAGE else [who]
            body = body_of(us, sort, start, end, who, form) if ids else None
            for tag_id in ids:
                found = registry.get(tag_id)
                if found is None:
                    continue  # a report of a tag that is not registered
                cycle = body["day"] if found.n_daily or sort == REPORT else body["month"]
                for seq, (kind, step, said) in enumerate(moved(found, body)):
                    out.append((kind, tag_id, us, event_id, seq, cycle, found.update_frequency, *(step or (None, None, None)),
                                None if said is None else json.dumps(said)))
            if len(out) >= OUT:
                yield from self._out(out)
                out = []
        if clock is not None:
            for some in self._unfinished(clock, watermark, registry):
                yield from self._out(out + some)
                out = []
            clock = max(clock, watermark)
            if clock != began:
                self.reported.update((clock,))
                self.handle.registerTimer(self._next_report(clock) // 1000)
        registry.save()
        yield from self._out(out)

    def _next_report(self, us: int) -> int:
        """The first moment of a report after ``us``."""
        offset = cal.cutoff_us(self.schedule) - self.lead
        return ((us - offset) // cal.DAY_US + 1) * cal.DAY_US + offset

    def _unfinished(self, after: int, until: int, registry: Registry) -> Iterator[list[tuple]]:
        """Reports of the moments behind ``after`` up to ``until``. Between them lies no row, so the tags stand still."""
        moment = self._next_report(after)
        until = min(until, after + ASLEEP_AFTER)
        while moment <= until:
            out = []
            day, month = cal.cycles_at(moment, self.schedule)
            report_day = (moment - cal.cutoff_us(self.schedule) + self.lead) // cal.DAY_US
            for tag_id, found in registry.read_all().items():
                missing = found.missing_at(day, month)
                if missing:
                    out.append(("unfinished", tag_id, moment, report_day, 0, day, found.update_frequency, None, None, None,
                                json.dumps(missing)))
            yield out
            moment += cal.DAY_US

    def _change(self, us: int, event_id: int, body: dict, registry: Registry) -> tuple:
        """A tag's new definition: flags of keys it still needs stay, and a run under way ends as it began."""
        tag_id, need = body["tag_id"], sorted(set(body["need"]))
        found = registry.get(tag_id)
        reason = "removed" if not need else "changed" if found else "added"
        before = found.tag.state if found else WAITING
        if need:
            found = found or Entry()
            found.update_frequency = body["update_frequency"]
            found.require(need)
            found.settle()
        registry.put(tag_id, found if need else None)
        return ("change", tag_id, us, event_id, 0, None, body["update_frequency"], before, before if need else WAITING, reason, None)

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(rows), OUT):
            frame = pd.DataFrame(rows[at:at + OUT], columns=["kind", "tag_id", "ts", "event_id", "seq", "cycle", "update_frequency",
                                                             "from_state", "to_state", "reason", "body"])
            frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
            yield frame

    def close(self) -> None:
        pass


def key_text(key: Column | None = None) -> Column:
    """A message key as one text; an absent partition is left out of it."""
    return F.to_json(F.struct(*[(F.col(n) if key is None else key[n]).alias(n) for n in KEY]))


def _input(rows: DataFrame, sort: int, tag_id: Column, event_id: Column, who: Column, form: Column,
           began: Column | None = None, ended: Column | None = None) -> DataFrame:
    """Input rows of one sort; the times of attempts are counted from the row's own, so that most are small."""
    none, second = F.lit(None).cast("long"), F.unix_seconds("ts")
    return rows.select(
        tag_id.alias("tag_id"), F.unix_micros("ts").alias("us"), F.lit(sort).alias("sort"), event_id.alias("event_id"),
        (none if began is None else began - second).alias("began"), (none if ended is None else ended - second).alias("ended"),
        who.alias(WHO), form.alias(FORM))


def message_input(log: DataFrame, frequencies: DataFrame, schedule: cal.Schedule = cal.DEFAULT, delay: str = DELAY) -> DataFrame:
    """The messages of the log, as they go to all slices. Those of unknown tables only move the watermark on."""
    rows = dated(tag_messages(timed(log, delay), frequencies, schedule), schedule).withColumn("counts", counts(schedule))
    form = F.to_json(F.struct("counts", "topic", "pvalue", "day", "month", "target_month"))
    return _input(rows, MESSAGE, F.lit(None).cast("string"), F.col("event_id"), key_text(), form, ended=F.col("finish_time"))


def report_input(reports: DataFrame, schedule: cal.Schedule = cal.DEFAULT, delay: str = DELAY) -> DataFrame:
    """Run reports (tag_id, seq, status, start_time, finish_time), each at the moment its attempt ended."""
    rows = dated(report_times(reports, delay), schedule).withColumn(
        "run_day", cal.day_text(cal.cycle_day(F.timestamp_seconds("start_time"), schedule)))
    form = F.to_json(F.struct("status", "day", "month", "target_month", "run_day"))
    tag_id = F.col("tag_id")
    return _input(rows, REPORT, tag_id, F.col("seq"), tag_id, form, F.col("start_time"), F.col("finish_time"))


def change_input(changes: DataFrame, delay: str = DELAY) -> DataFrame:
    """Changed definitions (tag_id, change_id, ts, update_frequency, need): all keys that the tag needs from then on. A tag
    that needs nothing leaves."""
    form = F.to_json(F.struct("update_frequency", F.transform("need", key_text).alias("need")))
    tag_id = F.col("tag_id")
    return _input(timed(changes, delay), CHANGE, tag_id, F.col("change_id"), tag_id, form)


def slice_of(tag_id: str, slices: int) -> Column:
    return F.pmod(F.xxhash64(tag_id), F.lit(slices)).cast("int")


def slices_for(tags: int, least: int = SLICES) -> int:
    """Slices for so many tags; a checkpoint keeps them."""
    return max(least, -(-tags // TAGS_OF_SLICE))


def registry_state(required: DataFrame) -> DataFrame:
    """(tag_id, body) of a registry at rest: ``required`` has tag_id, update_frequency and need."""
    return required.select("tag_id", F.to_json(F.struct(
        "update_frequency", F.array_sort(F.transform("need", key_text)).alias("need"))).alias("body"))


def revived_state(required: DataFrame, flags: DataFrame, remembered: DataFrame, moment: Column,
                  schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """(tag_id, body) of a registry that goes on after a loss of its checkpoint.

    ``flags`` are those of ``stale_reset`` (tag_id, key, revived); ``remembered`` has the month that a monthly tag ran for
    last (tag_id, run_month). A tag is awake where a flag has survived. Lost are open runs, whose reports then count for
    nothing, and the messages behind the flags.
    """
    def held(freq: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("revived") & (F.col("freq") == freq), key_text())))

    kept = flags.groupBy("tag_id").agg(held(DAILY).alias("daily"), held("M").alias("monthly"))  # the keys of one tag's SQL
    awake = F.size("daily") + F.size("monthly") > 0
    rows = required.select("tag_id", "update_frequency", "need").join(kept, "tag_id", "left").join(remembered, "tag_id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({"daily": F.coalesce("daily", none), "monthly": F.coalesce("monthly", none)}).select(
        "tag_id", F.to_json(F.struct(
            "update_frequency", F.array_sort(F.transform("need", key_text)).alias("need"), "daily", "monthly",
            F.when(awake, RECEIVING).otherwise(WAITING).alias("state"), cal.day_text(cal.cycle_day(moment, schedule)).alias("day"),
            cal.cycle_month(moment, schedule).alias("month"), F.coalesce("run_month", F.lit("")).alias("run_month"))).alias("body"))


def actions(inputs: DataFrame, initial: DataFrame, slices: int = SLICES, schedule: cal.Schedule = cal.DEFAULT,
            lead_minutes: int = LEAD_MINUTES) -> DataFrame:
    """What the tags do. ``inputs`` is the union of message, report and change rows; ``initial`` the state at the start.

    The moment goes in as a plain number, as Spark would drop rows of a marked column behind the watermark unseen.
    """
    numbers = packed.spread(slices)  # of the slices, so that each has a partition
    key = F.array(*map(F.lit, numbers))
    rows = inputs.withColumn("slice", F.when(F.col("sort") != MESSAGE, slice_of("tag_id", slices))).select("slice", *NUMBERS, WHO, FORM)
    rows = rows.mapInArrow(packed.packer(NUMBERS, WHO, [FORM]), packed.PACKED).select(
        F.explode(F.when(F.col("slice") == packed.EVERY, key).otherwise(F.array(F.get(key, F.col("slice"))))).alias("slice"), "rows")
    part = F.pmod(F.crc32(F.coalesce("tag_id", F.lit("")).cast("binary")), F.lit(PARTS)).cast("int")  # as ``_part``
    state = initial.select(
        F.get(key, slice_of("tag_id", slices)).alias("slice"), part.alias("part"), F.to_json(F.struct("tag_id", "body")).alias("row")).groupBy(
        "slice", "part").agg(F.collect_list("row").alias("tags")).groupBy("slice")
    cloudpickle.register_pickle_by_value(tagloom)  # Spark starts the processor on the driver, without the files sent to the workers
    try:
        return rows.groupBy("slice").transformWithStateInPandas(
            statefulProcessor=LiveTags(schedule, lead_minutes, numbers[0]), outputStructType=ACTIONS, outputMode="Append", timeMode="EventTime",
            initialState=state)
    finally:
        cloudpickle.unregister_pickle_by_value(tagloom)


def tags_now(spark, checkpoint: str) -> DataFrame:
    """The tags of a running stream as its checkpoint has them: (tag_id, state, update_frequency, need, daily, monthly, ...)."""
    stored = spark.read.format("statestore").option("stateVarName", "tags").load(checkpoint)
    return stored.select(F.explode("user_map_value.rows").alias("row")).select(F.from_json("row", TAGS).alias("tag")).select("tag.*")


def active_now(spark, checkpoint: str) -> DataFrame:
    """Ids of the tags that are awake."""
    return tags_now(spark, checkpoint).filter(F.col("state") != WAITING).select("tag_id")
