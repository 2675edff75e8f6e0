"""The states of one tag and how a message or a run report moves it.

A small pure function, applied per key by the streaming operator. Dates are worked out in Spark and come
with the row; nothing here asks the clock. Rows come in order of time. Cutoffs need no timer: a flag set is wiped,
and a run without a report freed, when the first row of a later cycle comes, before that row is looked at, and
nobody can see the tag in between.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from tagloom.schemas import (
    ATTEMPTS, DAILY, FINISH, MONTHLY, NON_FINISH, RECEIVING, RUNNING, VERIFYING, WAITING,
)


class Step(NamedTuple):
    from_state: str
    to_state: str
    reason: str


@dataclass(slots=True)
class Tag:
    state: str = WAITING
    daily: set[int] = field(default_factory=set)
    monthly: set[int] = field(default_factory=set)
    day: str = ""
    month: str = ""
    run_month: str = ""
    failures: int = 0
    run_day: str = ""  # of the open run: the daily cycle it was launched in


class Event(NamedTuple):
    """One row for a tag: a message (``status`` empty) or a run report."""

    status: str
    update_frequency: str
    freq: str
    key_no: int
    counts: bool
    n_daily: int
    n_monthly: int
    day: str
    month: str
    target_month: str
    run_day: str  # of a report: the daily cycle in which its run was launched


def _move(tag: Tag, to_state: str, reason: str) -> Step:
    step = Step(tag.state, to_state, reason)
    tag.state = to_state
    return step


def _verify(tag: Tag) -> Step:
    """Stop when no monthly flag is held, else go on collecting."""
    if tag.monthly:
        return _move(tag, RECEIVING, "monthly_held")
    return _move(tag, WAITING, "stopped")


def _finish(tag: Tag, event: Event) -> list[Step]:
    tag.failures = 0
    tag.daily = set()
    if event.update_frequency == MONTHLY:
        tag.run_month = event.target_month
        tag.monthly = set()
    elif not (event.n_daily and event.n_monthly):
        tag.monthly = set()
    return [_move(tag, VERIFYING, "finished"), _verify(tag)]


def _cutoff(tag: Tag, event: Event) -> list[Step]:
    """Wipe what the cutoffs since the last row have ended."""
    if event.day <= tag.day:
        return []
    began = not tag.day
    tag.day, tag.daily = event.day, set()
    if event.month != tag.month:
        tag.month, tag.monthly = event.month, set()
    if began or tag.state not in (RECEIVING, RUNNING):
        return []
    tag.failures = 0
    return [_move(tag, VERIFYING, "cutoff"), _verify(tag)]


def _report(tag: Tag, event: Event) -> list[Step]:
    if event.status not in (FINISH, NON_FINISH):
        return []
    if tag.state != RUNNING or tag.run_day != event.run_day:
        return [_move(tag, tag.state, "other_run")]  # of a run that was freed, or never launched here
    if event.status == FINISH:
        return _finish(tag, event)
    tag.failures += 1
    if tag.failures < ATTEMPTS:
        return [_move(tag, RUNNING, "retry")]
    tag.failures, tag.daily = 0, set()
    return [_move(tag, RECEIVING, "gave_up")]


def advance(tag: Tag, event: Event, instant: bool) -> list[Step]:
    """Apply one row; with ``instant`` every launched run succeeds at once, else reports decide."""
    steps = _cutoff(tag, event)
    if event.status:
        return steps + _report(tag, event)
    if tag.state == RUNNING:
        return steps
    if tag.state == WAITING:
        if event.update_frequency == MONTHLY and tag.run_month == event.target_month:
            return steps
        steps.append(_move(tag, RECEIVING, "first_message"))
    if not event.counts:
        return steps
    (tag.daily if event.freq == DAILY else tag.monthly).add(event.key_no)
    if len(tag.daily) == event.n_daily and len(tag.monthly) == event.n_monthly:
        steps.append(_move(tag, RUNNING, "ready"))
        tag.run_day = event.day
        if instant:
            steps += _finish(tag, event)
    return steps
