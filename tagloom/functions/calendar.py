"""Calendar rules as column expressions.

Every function takes the as-of day as a column, so a job can be replayed for any day; nothing here asks
the clock.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_TEXT = "^[0-9]{4}(0[1-9]|1[0-2])$"


@dataclass(frozen=True)
class Schedule:
    """How far inputs lag behind the as-of day, and when the day's flags are wiped."""

    daily: int = -2
    monthly: int = -1
    cutoff: str = "00:00:00"

    @property
    def reset_day(self) -> int:
        return abs(self.daily)

    @property
    def cutoff_interval(self) -> Column:
        hours, minutes, seconds = (F.lit(int(part)) for part in self.cutoff.split(":"))
        return F.make_dt_interval(F.lit(0), hours, minutes, seconds)


DEFAULT = Schedule()


def as_of(ts: Column, fixed: str | None = None) -> Column:
    """The as-of day of a row: the fixed day when the job names one, else its arrival day."""
    return F.lit(fixed).cast("date") if fixed else F.to_date(ts)


def day_text(day: Column) -> Column:
    """``yyyy-MM-dd``; a cast costs a fraction of the pattern formatter."""
    return day.cast("string")


def month_text(day: Column) -> Column:
    """``yyyyMM``, from the day's text for the same reason."""
    return F.replace(F.substring(day.cast("string"), 1, 7), F.lit("-"), F.lit(""))


def day_of_month(day: Column, number: Column) -> Column:
    """The given day number within the month of ``day``; a number past the end rolls into the next month."""
    return F.date_add(F.trunc(day, "MM"), number - F.lit(1))


def daily_date(day: Column, schedule: Schedule = DEFAULT) -> Column:
    return F.date_add(day, schedule.daily)


def last_month_first(day: Column, schedule: Schedule = DEFAULT) -> Column:
    """First day of the month that monthly inputs must carry on the as-of day."""
    shifted = F.date_add(day, schedule.daily)
    if schedule.reset_day < 10:
        shifted = F.when(F.dayofmonth(day) == schedule.reset_day, day).otherwise(shifted)
    return F.trunc(F.add_months(shifted, schedule.monthly), "MM")


def last_month(day: Column, schedule: Schedule = DEFAULT) -> Column:
    return month_text(last_month_first(day, schedule))


def is_month_text(value: Column) -> Column:
    return F.coalesce(value.rlike(MONTH_TEXT), F.lit(False))


def _month_first(value: Column) -> Column:
    """First day of a valid month text."""
    return F.make_date(F.substring(value, 1, 4).try_cast("int"), F.substring(value, 5, 2).try_cast("int"), F.lit(1))


def month_to_date(value: Column, day: Column, schedule: Schedule = DEFAULT) -> Column:
    """Day a monthly partition value stands for on the as-of day; null for a month still to come."""
    present = month_text(daily_date(day, schedule))
    return (
        F.when(~is_month_text(value), F.lit(None).cast("date"))
        .when(value == present, daily_date(day, schedule))
        .when(value < present, F.last_day(_month_first(value)))
    )


def window_start(freq: Column, day: Column, started: Column, schedule: Schedule = DEFAULT) -> Column:
    shift = started + F.lit(1)
    return F.when(
        F.upper(freq) == "M", F.add_months(last_month_first(day, schedule), shift)
    ).otherwise(F.date_add(daily_date(day, schedule), shift))


def window_end(freq: Column, start: Column, traced: Column) -> Column:
    shift = traced - F.lit(1)
    return F.when(F.upper(freq) == "M", F.last_day(F.add_months(start, shift))).otherwise(F.date_add(start, shift))


def is_reset_day(day: Column, schedule: Schedule = DEFAULT) -> Column:
    return F.dayofmonth(day) == schedule.reset_day


def cycle_day(ts: Column, schedule: Schedule = DEFAULT) -> Column:
    """Day whose cutoff opened the cycle a moment falls in."""
    return F.to_date(ts if schedule.cutoff == "00:00:00" else ts - schedule.cutoff_interval)


def cycle_close(ts: Column, schedule: Schedule = DEFAULT) -> Column:
    """Day on whose cutoff the cycle of a moment ends."""
    return F.date_add(cycle_day(ts, schedule), 1)


def cycle_month(ts: Column, schedule: Schedule = DEFAULT) -> Column:
    """Monthly cycle of a moment, named by the month its inputs carry; it ends at the reset day's cutoff."""
    return last_month(cycle_day(ts, schedule), schedule)


def cycle(freq: Column, ts: Column, schedule: Schedule = DEFAULT) -> Column:
    """Name of the cycle a flag of this frequency lives in."""
    return F.when(freq == "D", day_text(cycle_day(ts, schedule))).otherwise(cycle_month(ts, schedule))


# ---- the same rules for one moment at a time, for state that timers wake ----

DAY_US = 86_400_000_000


def cutoff_us(schedule: Schedule = DEFAULT) -> int:
    """The cutoff as microseconds of the day."""
    hours, minutes, seconds = map(int, schedule.cutoff.split(":"))
    return (hours * 3600 + minutes * 60 + seconds) * 1_000_000


def cycles_at(us: int, schedule: Schedule = DEFAULT) -> tuple[str, str]:
    """(``cycle_day``, ``cycle_month``) of a moment in microseconds, as texts."""
    day = datetime.fromtimestamp((us - cutoff_us(schedule)) // DAY_US * 86_400, timezone.utc)
    kept = schedule.reset_day < 10 and day.day == schedule.reset_day
    shifted = day if kept else day + timedelta(days=schedule.daily)
    months = shifted.year * 12 + shifted.month - 1 + schedule.monthly
    return day.date().isoformat(), f"{months // 12:04d}{months % 12 + 1:02d}"
