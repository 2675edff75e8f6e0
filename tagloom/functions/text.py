"""Expressions over tag SQL and view names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.schemas import END_MARK, START_MARK, VIEW_REFERENCE


def table_refs(sql: Column) -> Column:
    """All source views a SQL text mentions, in order, repeats included."""
    return F.regexp_extract_all(sql, F.lit(VIEW_REFERENCE), F.lit(2))


def view_name(qualified: Column) -> Column:
    """``schema.view`` to ``view``; null when there is no dot."""
    return F.when(F.instr(qualified, ".") > 0, F.nullif(F.split_part(qualified, F.lit("."), F.lit(2)), F.lit("")))


def needs_window(sql: Column) -> Column:
    return F.contains(sql, F.lit("$"))


def compose_status(sql: Column, started: Column, traced: Column) -> Column:
    return (
        F.when(~needs_window(sql), "plain")
        .when(started.isNull() | traced.isNull(), "error")
        .otherwise("dated")
    )


def fill_window(sql: Column, start: Column, end: Column) -> Column:
    """SQL with the window filled in; text without a marker is returned as it is."""
    filled = F.replace(F.replace(sql, F.lit(START_MARK), start), F.lit(END_MARK), end)
    return F.when(needs_window(sql), filled).otherwise(sql)
