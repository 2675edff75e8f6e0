"""Exact duplicates by a heavy-hitter split.

Texts are equal when they are identical after deleting white space; their SHA-256 stands for them. Copies of
one text may be a third of all rows, so the digests are split: Misra-Gries summaries find every digest that
can hold more than 1/(k+1) of the rows, the exact winners of those (k at most) are broadcast and settle their
rows where they lie, and only the other digests, each of them rare by proof, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.texts import SPACE, whole
from tagloom.llm.workers import task
from tagloom.session import stable

COUNTERS = 1024  # k; the broadcast holds that many digests at most, some 100 KB


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, as 64 hex digits; a null text counts as empty."""
    return F.sha2(F.regexp_replace(whole(text), f"{SPACE}+", "").cast("binary"), 256)


def shrink(counts: dict[bytes, int], k: int) -> dict[bytes, int]:
    """A Misra-Gries summary of k counters at most: each loses as much as the (k+1)th largest has."""
    if len(counts) <= k:
        return counts
    floor = sorted(counts.values(), reverse=True)[k]
    return {key: n - floor for key, n in counts.items() if n > floor}


def _summarise(k: int):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for item in pc.value_counts(batch.column(0)):
                key = item["values"].as_py()
                held[key] = held.get(key, 0) + item["counts"].as_py()
            held = shrink(held, k)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

    return run


def frequent(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Candidates for digests with more than 1/(k+1) of the rows, k at most; none of those is missing.

    The summaries of the tasks are summed per digest and shrunk once more by the same rule, which keeps the
    error below 1/(k+1) of all rows whatever the number of summaries.
    """
    merged = (
        digests.select("digest").mapInArrow(_summarise(k), "digest binary, n long")
        .groupBy("digest").agg(F.sum("n").alias("n"))
    )
    top = stable(merged.orderBy(F.desc("n"), "digest").limit(k + 1), "frequent")
    floor = top.agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).first()
    return top.filter(F.col("n") > (floor["least"] if floor["rows"] > k else 0)).select("digest")


def winners(rows: DataFrame) -> DataFrame:
    """Per digest its size and the row that stays: most code points, then the smallest key, a null key last."""
    best = F.min(F.struct(-F.col("n_points"), F.col("key").isNull(), F.col("key"))).alias("best")
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best).select(
        "digest", "group_size", F.col("best.key").alias("keep_key"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: key, digest, n_points, group_size, keep_key, kept.

    Null and empty texts are equal to each other and to texts of white space alone. Rows that repeat a key
    are rows of their own; those that carry the winner's key and text are all ``kept``. An empty table gives
    none. Other columns are not read.
    """
    digests = stable(docs.select(
        F.col(key).alias("key"), F.unhex(digest(F.col(text))).alias("digest"),
        F.length(whole(F.col(text))).alias("n_points")), "digests")
    candidates = frequent(digests, k)
    # exact counts of the candidates (partial sums, k rows per task); only the truly frequent are broadcast
    least = digests.count() // (k + 1)
    heavy = stable(
        winners(digests.join(F.broadcast(candidates), "digest", "left_semi")).filter(F.col("group_size") > least), "heavy")
    settled = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    light = rest.join(winners(rest), "digest")
    return settled.unionByName(light).withColumn("kept", F.col("key").eqNullSafe(F.col("keep_key")))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat a key and a text one stays."""
    groups = exact_groups(docs, key, text, k).filter("kept")
    kept = groups.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"))
    columns = docs.columns
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(key).alias("key"),
                        F.unhex(digest(F.col(text))).alias("own"))
    met = named.join(kept.withColumnRenamed("key", "kept_key"),
                     F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("own") == F.col("digest")))
    # the longer text is looked up in the row, so that both ways read one and the same exchange
    repeated = met.filter("n > 1").groupBy("key", "own").agg(
        F.max_by("row", F.length(whole(F.col("row").getField(text)))).alias("row"))
    return met.filter("n = 1").select("row").unionByName(repeated.select("row")).select(
        *[F.col("row").getField(c).alias(c) for c in columns])
