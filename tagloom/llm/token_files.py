"""Token ids in files: whole documents in ascending key order, in Simple-8b blocks.

A file of the set is a Parquet file of blocks, one row each, so Spark commits files only as wholes, reads them
from any store and prunes what a reader does not ask for. A block holds whole documents of about ``BLOCK`` ids.
Shards are ranges of the key: ids before a shard come from the shards' totals, not from a sort in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.simple8b import Block, decode, encode
from tagloom.llm.texts import whole
from tagloom.llm.tokens import encoder
from tagloom.llm.workers import task
from tagloom.session import fresh_dir

END = 2
BLOCK = 1 << 16  # ids after which a block is closed; a document is never cut

BLOCKS = ("shard int, block int, before long, n_ids long, keys array<{key}>, counts array<long>, "
          "words binary, wide binary, offsets binary, wide_before binary")


def ranges(docs: DataFrame, key: str) -> list:
    """Upper ends of the shards but the last: ranges of the key of about equal size, as many as shuffle partitions,
    from the key column alone."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(key).alias("key")).filter(F.col(key).isNotNull()).repartitionByRange(shards, "key")
    ends = ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("end"))  # one row per shard
    return sorted(r["end"] for r in ends.collect())[:-1]


def _encoded(path: str, end: int | None, ends: list):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([] if end is None else [end], np.uint32)
        for batch in batches:
            ids = [np.concatenate([i, tail]) for i in encoder(path).batch(batch.column(1))]
            raw = [i.astype("<u2" if not len(i) or i.max() < 1 << 16 else "<u4").tobytes() for i in ids]
            shards = [0 if k is None else bisect_left(ends, k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(raw, pa.binary())],
                ["shard", "key", "n", "ids"])

    return run


def _ids(n: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def _blocked(size: int):
    def close(shard: int, number: int, before: int, keys: list, ids: list[np.ndarray], key: pa.DataType):
        block = encode(np.concatenate(ids))
        parts = [block.words.astype("<u8"), block.wide.astype("<u4"), block.offsets.astype("<u4"), block.wide_before.astype("<u4")]
        return pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()),
            pa.array([block.n], pa.int64()), pa.array([keys], pa.list_(key)),
            pa.array([[len(i) for i in ids]], pa.list_(pa.int64())), *[pa.array([p.tobytes()], pa.binary()) for p in parts],
        ], ["shard", "block", "before", "n_ids", "keys", "counts", "words", "wide", "offsets", "wide_before"])

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before, held = -1, 0, 0, 0
        keys, ids = [], []
        for batch in batches:
            kind = batch.schema.field(1).type
            for own, key, n, raw in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if own != shard:
                    if keys:
                        yield close(shard, number, before, keys, ids, kind)
                    shard, number, before, held, keys, ids = own, 0, 0, 0, [], []
                keys.append(key)
                ids.append(_ids(n, raw))
                held += n
                if held >= size:
                    yield close(shard, number, before, keys, ids, kind)
                    number, before, held, keys, ids = number + 1, before + held, 0, [], []
        if keys:
            yield close(shard, number, before, keys, ids, kind)

    return run


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int | None = END,
          block: int = BLOCK) -> None:
    """Encode the texts of ``docs`` and write their ids to ``path`` in ascending key order, null keys first.

    A null text counts as empty; each document is closed by the end id. Rows that repeat a key stand beside
    each other, the shorter ones first. Other columns are not read. An empty table writes no block.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    # the shards are cut from the keys alone, so texts are encoded once and only ids are shuffled
    ends = ranges(docs, key)
    encoded = rows.mapInArrow(_encoded(tokenizer, end, ends), f"shard int, key {kind}, n long, ids binary")
    ordered = encoded.repartitionById(len(ends) + 1, "shard").sortWithinPartitions("shard", "key", "n", "ids")
    ordered.mapInArrow(_blocked(block), BLOCKS.format(key=kind)).write.parquet(path)


def as_block(row: dict) -> Block:
    """A block from the values of its row."""
    return Block(row["n_ids"], np.frombuffer(row["words"], "<u8"), np.frombuffer(row["wide"], "<u4"),
                 np.frombuffer(row["offsets"], "<u4"), np.frombuffer(row["wide_before"], "<u4"))


def _documents(with_ids: bool):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("keys").type.value_type
            for row in batch.to_pylist():
                ids = decode(as_block(row)).astype("<u4")
                ends = np.cumsum(row["counts"])
                starts = ends - row["counts"]
                parts = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array([row["shard"]] * len(parts), pa.int32()), pa.array(row["keys"], kind),
                           pa.array(starts + row["before"]), pa.array(row["counts"], pa.int64()),
                           pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["shard", "key", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    return run


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a written set: key, start, n_tokens, ids_crc32, and the ids if asked for.

    Blocks are decoded where they are read. The ids before a shard are summed from the shards' totals, one small
    row per file, and meet the decoded rows.
    """
    rows = spark.read.parquet(path)
    kind = rows.schema["keys"].dataType.elementType.simpleString()
    totals = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    found = rows.mapInArrow(
        _documents(with_ids), f"shard int, key {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return found.join(starts, "shard").withColumn("start", F.col("start") + F.col("shard_start")).drop("shard", "shard_start")


def written(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int | None = END) -> DataFrame:
    """Write ``docs`` to a new folder under the shared one and read it back."""
    path = fresh_dir(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, key, text, end)
    return read(docs.sparkSession, path)
