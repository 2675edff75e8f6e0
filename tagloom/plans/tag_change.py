"""What a batch of tag changes does: check the payloads, write the dictionary, and register our own system's tags."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tagloom.operators import dependencies as deps
from tagloom.operators import dictionary as tags


def tag_change_flow(stored: DataFrame, dependencies: DataFrame, changes: DataFrame, views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary, dependency table) after a change feed.

    Incomplete payloads are left out. All others are written, whatever their system; only those of our own
    system reach the registry, where the last definition of a tag takes the place of the present one. A tag
    whose new definition belongs to another system keeps the one it is registered with.
    """
    whole = tags.complete(changes)
    table, _ = tags.upsert(stored, whole)
    ours = deps.last_per_tag(tags.of_system(whole))
    kept = dependencies.join(ours.select("tag_id"), "tag_id", "left_anti")
    return table, kept.select(*deps.DEPENDENCY).unionByName(deps.resolve(ours, views))
