"""The main path: which tags became ready, on which day, with which SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import calendar as cal
from tagloom.operators import dependencies as deps
from tagloom.operators import mapping as mp
from tagloom.operators import readiness as rd
from tagloom.operators import routing as rt
from tagloom.operators.runs import composed


def registered(dictionary: DataFrame) -> DataFrame:
    """The definition each tag is registered with: of several rows for one id the first."""
    return deps.first_per_tag(dictionary.select("row_seq", "tag_id", "update_frequency", "sql", "started", "traced"))


def ready_cycles(mapping: DataFrame, dictionary: DataFrame, raw: DataFrame,
                 schedule: cal.Schedule = cal.DEFAULT, guard: bool = True) -> DataFrame:
    """(tag_id, update_frequency, cycle, ready_ts, target_month) for every first readiness."""
    required = deps.requirements(deps.resolve(registered(dictionary), mp.view_map(mapping)))
    messages = rt.tag_messages(raw, mp.table_frequency(mapping), schedule)
    arrivals = rd.first_arrivals(messages, schedule)
    ready = rd.ready_needs(arrivals, deps.need_sets(required), schedule)
    return rd.ready_tags(ready, required, schedule, guard)


def tag_status_flow(mapping: DataFrame, dictionary: DataFrame, raw: DataFrame,
                    schedule: cal.Schedule = cal.DEFAULT) -> DataFrame:
    """Ready tags with their window and composed SQL; the as-of day is the day they became ready."""
    ready = ready_cycles(mapping, dictionary, raw, schedule).withColumn("as_of", F.to_date("ready_ts"))
    definition = registered(dictionary).select("tag_id", "sql", "started", "traced")
    return composed(ready.join(definition, "tag_id"), F.col("as_of"), schedule)
