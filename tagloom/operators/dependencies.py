"""What each tag needs: references in its SQL, the dependency table, and the registry kept over it.

The registry is one long table, one row per (tag, message key). Read by tag it is the forward index, read
by key the reverse index; no second copy is kept, and a key nobody needs any more is simply not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import table_refs
from tagloom.operators.keys import key_join
from tagloom.schemas import DAILY, KEY, MONTHLY

DEPENDENCY = ["tag_id", "update_frequency", *KEY]


def references(dictionary: DataFrame) -> DataFrame:
    """(tag_id, update_frequency, view), each view once per tag; the frequency is upper-cased."""
    return dictionary.select(
        "tag_id",
        F.upper("update_frequency").alias("update_frequency"),
        F.explode(F.array_distinct(table_refs(F.col("sql")))).alias("view"),
    )


def resolve(dictionary: DataFrame, views: DataFrame) -> DataFrame:
    """The dependency table: distinct message keys per tag. Names match with their case."""
    return references(dictionary).join(views, "view").select(*DEPENDENCY).distinct()


def unresolved(dictionary: DataFrame, views: DataFrame) -> DataFrame:
    """References to unknown views; such a tag runs with fewer inputs."""
    return references(dictionary).join(views, "view", "left_anti").select("tag_id", "view")


def requirements(dependencies: DataFrame) -> DataFrame:
    """One row per tag with its sorted set of message keys and a fingerprint of that set.

    A set is no longer than the tag's own SQL text. Tags with equal sets share their readiness history,
    so readiness is worked out per ``need_id`` and handed to the tags at the end.
    """
    return (
        dependencies.groupBy("tag_id", "update_frequency")
        .agg(F.sort_array(F.collect_set(F.struct(*KEY))).alias("need"))
        .withColumn("need_id", F.md5(F.to_json("need")))
    )


def need_sets(required: DataFrame) -> DataFrame:
    """Distinct requirement sets as (need_id, key, key_no, n_daily, n_monthly), one row per key of a set."""
    def side(frequency: str):
        return F.size(F.filter("need", lambda key: key["freq"] == frequency))

    return (
        required.groupBy("need_id").agg(F.first("need").alias("need"))  # equal for equal need_id
        .select("need_id", side(DAILY).alias("n_daily"), side(MONTHLY).alias("n_monthly"),
                F.posexplode("need").alias("key_no", "key"))
        .select("need_id", "key.*", "key_no", "n_daily", "n_monthly")
    )


def without_requirement(dictionary: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Tags that need nothing: they are refused and never run."""
    return dictionary.join(dependencies, "tag_id", "left_anti")


def forward_index(dependencies: DataFrame) -> DataFrame:
    """tag -> its message keys."""
    return requirements(dependencies).select("tag_id", "update_frequency", "need")


def reverse_index(dependencies: DataFrame) -> DataFrame:
    """message key -> its tags, as one row per pair.

    A table may be needed by a third of all tags, so its tags are kept as rows and never gathered into
    one array.
    """
    return dependencies.select(*KEY, "tag_id").distinct()


def subscriber_counts(dependencies: DataFrame) -> DataFrame:
    """Number of tags per message key."""
    return dependencies.groupBy(*KEY).agg(F.countDistinct("tag_id").alias("n_tags"))


def counts(dictionary: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Number of registered tags and of distinct message keys, one row."""
    tags = dictionary.select("tag_id").distinct().agg(F.count(F.lit(1)).alias("n_tags"))
    keys = dependencies.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("n_tables"))
    return tags.select("n_tags", keys.scalar().alias("n_tables"))


def lookup_tags(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """Which of the given tag ids are registered."""
    return ids.select("tag_id").distinct().join(registry, "tag_id", "left_semi")


def lookup_messages(dependencies: DataFrame, messages: DataFrame) -> DataFrame:
    """Which of the given message keys some tag needs."""
    return key_join(messages.select(*KEY).distinct(), dependencies.select(*KEY), "left_semi")


def register(dictionary: DataFrame) -> DataFrame:
    """Registry rows of a load: one per tag id, the first by ``row_seq`` where an id comes twice."""
    first = F.min_by(F.upper("update_frequency"), "row_seq").alias("update_frequency")
    return dictionary.groupBy("tag_id").agg(first)


def add(dependencies: DataFrame, registered: DataFrame, batch: DataFrame, views: DataFrame) -> DataFrame:
    """Register the tags of a batch that are not registered yet; a second load of an id changes nothing."""
    fresh = first_per_tag(batch).join(registered.select("tag_id"), "tag_id", "left_anti")
    return dependencies.select(*DEPENDENCY).unionByName(resolve(fresh, views))


def update(dependencies: DataFrame, registered: DataFrame, batch: DataFrame, views: DataFrame) -> DataFrame:
    """Replace the keys and frequency of registered tags by those of their new definition."""
    known = last_per_tag(batch).join(registered.select("tag_id"), "tag_id", "left_semi")
    kept = dependencies.join(known.select("tag_id"), "tag_id", "left_anti")
    return kept.select(*DEPENDENCY).unionByName(resolve(known, views))


def remove(dependencies: DataFrame, ids: DataFrame) -> DataFrame:
    return dependencies.join(ids.select("tag_id"), "tag_id", "left_anti")


def stop(status: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark tags inactive; they stay registered."""
    stopped = ids.select("tag_id").distinct().withColumn("_stopped", F.lit(True))
    state = F.when(F.col("_stopped"), "inactive").otherwise(F.col("status"))
    return status.join(stopped, "tag_id", "left").withColumn("status", state).drop("_stopped")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, kept and removed keys between two states of the dependency table, per tag.

    One aggregation over both states, in place of three set operations.
    """
    tagged = (
        before.select("tag_id", *KEY, F.lit(1).alias("old"), F.lit(0).alias("new"))
        .unionByName(after.select("tag_id", *KEY, F.lit(0).alias("old"), F.lit(1).alias("new")))
    )
    change = (
        F.when(F.max("old") == 0, "added").when(F.max("new") == 0, "removed").otherwise("kept").alias("change")
    )
    return tagged.groupBy("tag_id", *KEY).agg(change)


def _one_per_tag(batch: DataFrame, pick) -> DataFrame:
    """The id stays the grouping column, so that what follows per tag needs no other exchange."""
    rest = [c for c in batch.columns if c != "tag_id"]
    row = pick(F.struct(*rest), "row_seq").alias("row")
    return batch.groupBy("tag_id").agg(row).select(*["tag_id" if c == "tag_id" else f"row.{c}" for c in batch.columns])


def first_per_tag(batch: DataFrame) -> DataFrame:
    """Of several definitions of one tag the first by ``row_seq``."""
    return _one_per_tag(batch, F.min_by)


def last_per_tag(batch: DataFrame) -> DataFrame:
    """Of several definitions of one tag the last by ``row_seq``."""
    return _one_per_tag(batch, F.max_by)
