"""The tag dictionary as a table: reads, search, and batches of writes.

Each write takes the present table and a batch and gives the next state of the table; publish it with
``sources.tables.save_version``. The history dictionary has the same operators over its own table.
``row_seq`` is the store order of the rows: ids are not unique, and a replace touches only the first row of
an id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.codecs import is_complete, stored_is_readable
from tagloom.schemas import DICTIONARY, DICTIONARY_FIELDS, SEARCH_FIELDS, SYSTEM_NAME

STORED = ["row_seq", *DICTIONARY_FIELDS]


def scan(stored: DataFrame) -> DataFrame:
    """All readable rows, absent arrays as empty ones. Nothing else is filtered: disabled tags and those of
    other systems are listed too."""
    return stored.filter(stored_is_readable()).withColumns({
        name: F.coalesce(F.col(name), F.array().cast(DICTIONARY[name].dataType)) for name in ("tag_type", "tickets")
    })


def unreadable(stored: DataFrame) -> DataFrame:
    return stored.filter(~stored_is_readable())


def get(stored: DataFrame, tag_id: str) -> DataFrame:
    """The row of one tag; the first one in store order if the id was inserted twice, and none if that one
    cannot be read."""
    return scan(stored.filter(F.col("tag_id") == tag_id).orderBy("row_seq").limit(1))


def get_one(stored: DataFrame, tag_id: str):
    """As ``get``, but an unknown id is an error."""
    row = get(stored, tag_id).first()
    if row is None:
        raise LookupError(f"tag {tag_id} does not exist")
    return row


def get_many(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """The row of each given id as ``get`` gives it, with ``found`` false where there is none."""
    first = stored.groupBy("tag_id").agg(F.min("row_seq").alias("row_seq"))
    wanted = ids.select("tag_id").distinct().join(first, "tag_id", "left")
    rows = scan(stored).drop("tag_id")
    met = wanted.join(rows.withColumn("found", F.lit(True)), "row_seq", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return met.withColumn("row_seq", F.when(F.col("found"), F.col("row_seq")))


def _equals(name: str, value) -> Column:
    if name == "tag_type":
        wanted = F.array(*[
            F.struct(F.lit(a).alias("type_L1"), F.lit(b).alias("type_L2")) for a, b in value
        ])
        return F.col(name) == wanted
    return F.col(name) == F.lit(value)


def search(stored: DataFrame, **example) -> DataFrame:
    """Query by example: equality on every field given; no field matches every row.

    ``tag_type`` is a list of (L1, L2) pairs and matches the whole list.
    """
    unknown = set(example) - set(SEARCH_FIELDS)
    if unknown:
        raise ValueError(f"not searchable: {sorted(unknown)}")
    given = [_equals(name, value) for name, value in example.items() if value is not None]
    rows = scan(stored)
    return rows.filter(reduce(lambda a, b: a & b, given)) if given else rows


def of_system(rows: DataFrame) -> DataFrame:
    """Rows of our own system, whatever the case of its name; only these are registered."""
    return rows.filter(F.upper(F.coalesce("system_name", F.lit("none"))) == SYSTEM_NAME)


def complete(payloads: DataFrame) -> DataFrame:
    """Write payloads that make a whole dictionary row."""
    return payloads.filter(is_complete())


def incomplete(payloads: DataFrame) -> DataFrame:
    return payloads.filter(~is_complete())


def insert(stored: DataFrame, payloads: DataFrame) -> DataFrame:
    """Append payloads; ids are not checked, and the system is looked at only afterwards."""
    return stored.select(*STORED).unionByName(payloads.select(*STORED))


def _winners(changes: DataFrame) -> DataFrame:
    """Last change per target id."""
    payload = F.struct(*DICTIONARY_FIELDS)
    return changes.groupBy("target_id").agg(F.max_by(payload, "row_seq").alias("payload"))


def replace(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Put the payload in place of the first row of its target id, whole: fields it lacks are gone.

    An id that is not there changes nothing. One join on the row number; untouched rows pass through.
    """
    first = stored.groupBy("tag_id").agg(F.min("row_seq").alias("row_seq"))
    hits = first.join(_winners(changes).withColumnRenamed("target_id", "tag_id"), "tag_id").select("row_seq", "payload")
    old = F.struct(*DICTIONARY_FIELDS)
    return (
        stored.join(hits, "row_seq", "left")
        .select("row_seq", F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(old).alias("row"))
        .select("row_seq", "row.*")
    )


def upsert(stored: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``replace``, and payloads whose id is not there are appended. Gives (new table, changed rows)."""
    last = changes.groupBy("target_id").agg(
        F.max("row_seq").alias("change_seq"), F.max_by(F.struct(*DICTIONARY_FIELDS), "row_seq").alias("payload"))
    first = stored.groupBy("tag_id").agg(F.min("row_seq").alias("first_seq"))
    placed = last.join(first.withColumnRenamed("tag_id", "target_id"), "target_id", "left").select(
        F.coalesce("first_seq", "change_seq").alias("row_seq"), "payload")
    changed = placed.select("row_seq", "payload.*")
    kept = stored.select(*STORED).join(placed.select("row_seq"), "row_seq", "left_anti")
    return kept.unionByName(changed), changed


def remove(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop all rows of the given ids."""
    return stored.join(ids.select("tag_id"), "tag_id", "left_anti").select(*STORED)


def missing_ids(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids a remove or get would refuse because they do not exist."""
    return ids.select("tag_id").distinct().join(stored, "tag_id", "left_anti")
