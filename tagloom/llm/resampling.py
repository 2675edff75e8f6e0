"""Importance resampling towards a target distribution of hashed word n-grams.

A document's weight is the sum of its features' gains: by how much the bucket of a feature is commoner in the
target's texts than in the source's. Gumbel noise that a hash of the key gives turns the highest scores into a
sample without replacement.

Texts become features by Arrow kernels: lower-casing, splitting and flattening give the words of a batch, dictionary
encoding their numbers. Numbers shifted by one place form pairs, which are dictionary encoded in turn, and the
pairs with the next number the triples. So each distinct n-gram of a batch is hashed once, from the checksums of its
parts, and what every place has is taken by number and summed per text as a segment.

The counts are 10,000 sums of all texts. Texts are read twice, as buckets of all places would be larger than the texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.texts import NOT_WORD, whole
from tagloom.llm.workers import task
from tagloom.session import stable

BUCKETS = 10_000
LENGTH = 3  # words of a feature at most
LEAST_WORDS = 20  # of a document that may be drawn
PERCENT = 5  # of those that are drawn
SEED = 42
SLICE = 2 << 20  # bytes of text whose features are held at once, or one text
NEAR = 64  # bytes up to which checksums are appended by table

CRC = 0xEDB88320  # fixed value: the reflected polynomial of CRC-32


@cache
def _steps() -> np.ndarray:
    """Tables [n, byte place, byte]: what each byte of a checksum becomes when n bytes follow, for n up to ``NEAR``."""
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = np.where(low & 1, (low >> np.uint32(1)) ^ np.uint32(CRC), low >> np.uint32(1))
    out = np.zeros((NEAR + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(1, NEAR + 1):
        out[n] = low[out[n - 1] & 0xFF] ^ (out[n - 1] >> np.uint32(8))
    return out


def appended(head: np.ndarray, tail: np.ndarray, at: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Checksums of texts with checksum ``head`` followed by ``raw[at]``, whose own checksum is ``tail[at]``.

    CRC-32 is linear: the head's moves on by as many bytes as follow, which tables of its four bytes give.
    """
    n = np.array([len(r) for r in raw], np.int64)[at]
    steps, short = _steps(), np.minimum(n, NEAR)
    out = tail[at]
    for place in range(4):
        out = out ^ steps[short, place, (head >> np.uint32(8 * place)) & np.uint32(0xFF)]
    for i in np.flatnonzero(n > NEAR).tolist():
        out[i] = zlib.crc32(raw[at[i]], int(head[i]))
    return out


class Features:
    """The features of some texts: per n-gram length the bucket of each place and the text it lies in."""

    def __init__(self, texts: pa.Array, buckets: int = BUCKETS, length: int = LENGTH):
        parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=f"{NOT_WORD}+")
        words, row = pc.list_flatten(parts), pc.list_parent_indices(parts)
        real = pc.greater(pc.binary_length(words), 0)
        coded = words.filter(real).dictionary_encode()
        self.rows = len(texts)
        row = row.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = [w.encode() for w in coded.dictionary.to_pylist()]
        self.n_words = np.bincount(row, minlength=self.rows)
        crc = np.array([zlib.crc32(w) for w in known], np.uint32)
        spaced = [b" " + w for w in known]
        tail = np.array([zlib.crc32(w) for w in spaced], np.uint32)
        self.places: list[tuple[np.ndarray, np.ndarray]] = []
        gram = word
        for n in range(1, length + 1):
            if n > 1:
                whole_grams = row[:max(0, len(row) - n + 1)] == row[n - 1:]
                pair = gram[:len(whole_grams)][whole_grams[:len(gram)]] * len(known) + word[n - 1:][whole_grams]
                encoded = pa.array(pair).dictionary_encode()
                pairs = encoded.dictionary.to_numpy(zero_copy_only=False).astype(np.int64)
                crc = appended(crc[pairs // max(1, len(known))], tail, pairs % max(1, len(known)), spaced)
                found = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                gram = np.zeros(len(whole_grams), np.int64)  # places whose gram would leave the text stay unused
                gram[whole_grams] = found
                here = row[:len(whole_grams)][whole_grams]
            else:
                found, here = gram, row
            self.places.append(((crc % np.uint32(buckets)).astype(np.int64)[found], here))

    def counts(self, buckets: int) -> np.ndarray:
        return sum(np.bincount(b, minlength=buckets) for b, _ in self.places)

    def n_features(self) -> np.ndarray:
        return sum(np.bincount(row, minlength=self.rows) for _, row in self.places)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """The gains of every text's places, summed as segments; the places come text by text."""
        total = np.zeros(self.rows, np.int64)
        for bucket, row in self.places:
            running = np.concatenate([[0], np.cumsum(gains[bucket])])
            ends = np.searchsorted(row, np.arange(self.rows + 1))
            total += running[ends[1:]] - running[ends[:-1]]
        return total


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about ``size`` bytes."""
    before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(before, before[start] + size, "right")) - 1)
        yield start, end - start
        start = end


def _counted(buckets: int, length: int):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for start, n in slices(batch.column(0)):
                total += Features(batch.column(0).slice(start, n), buckets, length).counts(buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, length: int = LENGTH) -> np.ndarray:
    """Features per bucket over all texts; a task hands on one row per bucket."""
    found = docs.select(whole(F.col(text)).alias("text")).mapInArrow(_counted(buckets, length), "bucket int, n long").groupBy(
        "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the logarithm of the ratio of its smoothed shares, rounded down."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = (target + 1.0) * (all_source + n) / ((source + 1.0) * (all_target + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def _weighed(gain: np.ndarray, length: int):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(1)):
                found = Features(batch.column(1).slice(start, n), len(gain), length)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), *[pa.array(x.astype(np.int64)) for x in (
                        found.n_words, found.n_features(), found.sums(gain))]],
                    ["key", "n_words", "n_features", "weight"])

    return run


@task
def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = 0
    for batch in batches:
        place = pa.array(np.arange(seen, seen + batch.num_rows, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, place], [*batch.schema.names, "place"])
        seen += batch.num_rows


def ranked(rows: DataFrame) -> DataFrame:
    """``rank``, from 1, by falling score and then rising key: ranges of the order are sorted one by one, and the rows
    before a range come from the ranges' sizes."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ordered = rows.repartitionByRange(F.desc("score"), "key").sortWithinPartitions(F.desc("score"), "key")
    placed = stable(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(
        _numbered, f"{fields}, part int, place long"), "ranges")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per shuffle partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop(
        "part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
             length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_features, weight, score, rank (null for rows that are not drawn).

    Null and empty texts have no features and weigh nothing. Rows that repeat a key are rows of their own, with the
    same noise; those that tie in score and key are ranked in any order. A null key takes part, first among ties,
    and its noise is that of the empty text. Empty tables give no rows, or gains of an empty target. Other columns
    are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    gain = gains(bucket_counts(docs, text, buckets, length), bucket_counts(target, target_text, buckets, length))
    rows = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    weighed = rows.mapInArrow(_weighed(gain, length), f"key {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000.0 * F.log(-F.log(uniform)))
    scored = stable(weighed.withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked(scored.filter(able)).withColumn("rank", rank).unionByName(
        scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """(key, rank) of the documents that are drawn."""
    return resample(docs, target, key, **settings).filter(F.col("rank").isNotNull()).select("key", "rank")
