"""The view-to-table mapping: which table message, at which frequency, a view depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import view_name
from tagloom.schemas import DAILY, INDICATOR_ON, MONTH_PARTITION, MONTHLY


def split_views(mapping: DataFrame) -> DataFrame:
    """One row per view named in ``view_id``; the view is null when it has no schema part."""
    return mapping.withColumn("view", F.explode(F.split("view_id", "/"))).withColumn("view", view_name(F.col("view")))


def enabled(mapping: DataFrame) -> DataFrame:
    return mapping.filter(F.col("disabled_ind") == "")


def classify(mapping: DataFrame) -> DataFrame:
    """Frequency and partition field of each mapping row; rows of no known class are dropped.

    Reference tables count as daily. A table loaded per day inside a month partition is daily too.
    """
    ref, month, day = (F.coalesce(F.col(c) == INDICATOR_ON, F.lit(False)) for c in ("ref_ind", "month_ind", "day_ind"))
    partition = F.nullif(F.col("partition_id"), F.lit(""))
    return mapping.select(
        "*",
        F.when(ref | day, DAILY).when(month, MONTHLY).alias("freq"),
        F.concat("db_id", F.lit("."), "table_id").alias("dbt"),
        F.when(~ref & month & day, MONTH_PARTITION).otherwise(partition).alias("part"),
    ).filter(F.col("freq").isNotNull())


def entries(mapping: DataFrame) -> DataFrame:
    """Enabled, classified, one row per view."""
    return split_views(classify(enabled(mapping))).select("row_seq", "view", "freq", "dbt", "part")


def view_map(mapping: DataFrame) -> DataFrame:
    """view -> message key; of several rows for a view the last one counts.

    ``max_by`` combines on the map side, so a view listed very often costs no large group.
    """
    last = F.max_by(F.struct("freq", "dbt", "part"), "row_seq").alias("last")
    return (
        entries(mapping).filter(F.col("view").isNotNull()).groupBy("view").agg(last).select("view", "last.*")
    )


def table_frequency(mapping: DataFrame) -> DataFrame:
    """``db.table`` -> frequency; of several rows for a table the last one counts."""
    rows = classify(enabled(mapping)).filter(F.col("view_id").isNotNull())
    return rows.groupBy("dbt").agg(F.max_by("freq", "row_seq").alias("freq"))


def frequency_conflicts(mapping: DataFrame) -> DataFrame:
    """Tables listed under two frequencies: what needs the hidden one can never be satisfied."""
    rows = classify(enabled(mapping)).filter(F.col("view_id").isNotNull())
    return (
        rows.groupBy("dbt")
        .agg(
            F.max_by("freq", "row_seq").alias("used_freq"),
            F.sort_array(F.collect_set("freq")).alias("freqs"),  # two values at most
        )
        .filter(F.size("freqs") > 1)
        .select("dbt", "used_freq", F.array_join("freqs", ",").alias("freqs"))
    )
