"""Quality by compression: which of two zstandard dictionaries makes a text shorter.

One dictionary is built from text labelled good, one from text labelled bad. A text is cut into blocks of
``BLOCK`` bytes, all of them, so that a dictionary matters as much for a long text as for a short one; each
block is compressed with either dictionary. The normalised difference of the two sums, (bad - good) /
(bad + good), becomes a score by a logistic calibration, which also knows how far the text could be compressed
at all (a repeated line says little about the difference) and how long it is.

The dictionaries are fitted on a bounded sample: ``SAMPLE`` blocks per class, chosen by a hash. The
calibration is fitted on a histogram of bounded size over every other labelled row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.texts import whole
from tagloom.llm.workers import task
from tagloom.session import stable

BLOCK = 1024  # bytes
SAMPLE = 6000  # blocks per class, 6 MB each, from as many rows
DICTIONARY = 256 << 10  # bytes
LEVEL = 3
BINS = (400, 50, 9)  # of difference, ratio and length, in the histogram that is calibrated on
RIDGE = 0.1


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def terms(measured: np.ndarray) -> np.ndarray:
    """What the calibration is linear in, from rows of (difference, ratio, length)."""
    d, r, n = measured.T
    return np.column_stack([d, r, d * d, r * r, d * r, n, d * n])


def blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


@cache
def _compressors(good: bytes, bad: bytes):
    made = []
    for content in (good, bad):
        data = zstandard.ZstdCompressionDict(content)
        data.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(
            level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def measure(text: bytes, good: bytes, bad: bytes) -> tuple[float, float, float]:
    """(difference, ratio, length): the difference is between -1 and 1, above 0 when the good dictionary is the
    better one; the ratio is compressed to plain size, 1 at most; the length is its logarithm, 8 at most. An empty text has
    (0, 1, 0)."""
    parts = blocks(text)
    if not parts:
        return 0.0, 1.0, 0.0
    with_good, with_bad = (sum(len(c.compress(p)) for p in parts) for c in _compressors(good, bad))
    return ((with_bad - with_good) / (with_bad + with_good), min(1.0, (with_good + with_bad) / 2 / len(text)),
            min(8.0, float(np.log(len(text)))))


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def logistic(x: np.ndarray, good: np.ndarray, rows: np.ndarray, turns: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression on cells with ``good`` of ``rows`` rows: Newton's method, with
    steps halved until they help."""
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((rows * np.logaddexp(0, z) - good * z).sum() + RIDGE / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (rows * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (good - rows * p) - RIDGE * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
    return w


def _measured(good: bytes, bad: bytes):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(t, good, bad) for t in batch.column(2).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(found[:, i]) for i in range(3)]],
                ["key", "learn", "difference", "ratio", "length"])

    return run


def measured(docs: DataFrame, good: bytes, bad: bytes, key: str = "doc_id", text: str = "text",
             learn: Column | None = None) -> DataFrame:
    """(key, learn, difference, ratio, length) of every row; a null text counts as empty."""
    kind = docs.schema[key].dataType.simpleString()
    flag = F.lit(False) if learn is None else F.coalesce(learn, F.lit(False))
    return docs.select(F.col(key).alias("key"), flag.alias("learn"), whole(F.col(text)).cast("binary").alias("text")).mapInArrow(
        _measured(good, bad), f"key {kind}, learn boolean, difference double, ratio double, length double")


def _marked(labels: DataFrame, keys: DataFrame, key: str, label: str, sample: int) -> DataFrame:
    """(key, good, place, seen): labelled rows of ``keys``, the rows to learn from; those seen, some ``sample`` of each class by a hash, go into the
    dictionaries, all others calibrate."""
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("good"))
    known = stable(known.join(keys, "key", "left_semi"), "known")
    sizes = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit("quality sample"), F.col("key")), F.lit(1 << 30))
    share = F.lit(0)
    for good, n in sizes.items():
        share = F.when(F.col("good") == good, F.lit(int(min(0.5, sample / n) * (1 << 30)))).otherwise(share)
    return known.withColumn("place", place).withColumn("seen", place < share)


def _dictionaries(docs: DataFrame, marked: DataFrame, learn: Column, key: str, text: str, sample: int) -> list[bytes]:
    seen = F.broadcast(marked.filter("seen").select(F.col("key").alias("_key"), "good", "place"))  # by its share some 2 * sample rows
    rows = docs.filter(learn & F.col(text).isNotNull()).select(F.col(key).alias("_own"), F.col(text).alias("_text")).join(
        seen, F.col("_own") == F.col("_key"))
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length("_text"), F.lit(1)) - 1) / BLOCK))
    pieces = F.transform(starts, lambda i: F.substring(F.col("_text").cast("binary"), (i * BLOCK + 1).cast("int"), F.lit(BLOCK)))
    cut = rows.select("good", "place", F.posexplode(pieces).alias("i", "piece"))
    order = F.xxhash64("place", "i")
    out = []
    for good in (1, 0):
        # the sample is the feature here: as many blocks as the parameter says, least hash first
        chosen = cut.filter(F.col("good") == good).select(order.alias("o"), "piece").orderBy("o", "piece").limit(sample)
        out.append(dictionary([bytes(r["piece"]) for r in chosen.collect()]))
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
        label: str = "quality", sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    """A model from the labelled rows where ``learn`` holds, and the written measures of all rows of ``docs``.

    ``labels`` has the key and a label 0 or 1. Every text is compressed once: the measures, a few numbers per row, are
    what meets the labels and what is scored, so no text is shuffled.
    """
    marked = _marked(labels, docs.filter(learn).select(F.col(key).alias("key")), key, label, sample)
    good, bad = _dictionaries(docs, marked, learn, key, text, sample)
    rows = stable(measured(docs, good, bad, key, text, learn), "measured")
    rest = rows.filter("learn").join(marked.filter("NOT seen").select(F.col("key"), "good"), "key")
    cells = [F.round((F.col("difference") + 1) / 2 * BINS[0]), F.round(F.col("ratio") * BINS[1]), F.round(F.col("length") / 8 * BINS[2])]
    histogram = rest.groupBy(*[c.alias(f"c{i}") for i, c in enumerate(cells)], "good").agg(
        F.avg("difference").alias("d"), F.avg("ratio").alias("r"), F.avg("length").alias("l"), F.count(F.lit(1)).alias("n"),
    ).collect()  # a row per cell and label
    if not histogram:
        return Model(good, bad, (0.0,) * 7, (1.0,) * 7, (0.0,) * 8), rows
    x = terms(np.array([(c["d"], c["r"], c["l"]) for c in histogram]))
    n = np.array([c["n"] for c in histogram], float)
    mean = (x * n[:, None]).sum(axis=0) / n.sum()
    scale = np.sqrt(((x - mean) ** 2 * n[:, None]).sum(axis=0) / n.sum()) + 1e-9
    labelled = np.array([c["good"] for c in histogram]) * n
    weights = logistic(np.column_stack([np.ones(len(x)), (x - mean) / scale]), labelled, n)
    return Model(good, bad, tuple(mean.tolist()), tuple(scale.tolist()), tuple(weights.tolist())), rows


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(key, score, difference) from measured rows."""
    d, r, n = F.col("difference"), F.col("ratio"), F.col("length")
    sum_ = F.lit(model.weights[0])
    for term, mean, scale, weight in zip((d, r, d * d, r * r, d * r, n, d * n), model.mean, model.scale, model.weights[1:]):
        sum_ = sum_ + (term - mean) / scale * weight
    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum_))
    return rows.select("key", (1 / (1 + F.exp(-bounded))).alias("score"), "difference")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, score (how likely its text is labelled good), difference.

    Null and empty texts have difference 0 and the score that goes with it. Rows that repeat a key are scored each.
    Without labels every text gets the score 0.5. Other columns are not read.
    """
    return scored(measured(docs, model.good, model.bad, key, text), model)
