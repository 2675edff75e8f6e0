"""Vector compression by product quantisation in whole numbers, over dictionaries of the values of each dimension.

Components become whole numbers, and blocks of vectors are written once with one dictionary per dimension: the
distinct values, and for each vector the number of its value. A round tabulates, per dimension, the squared
differences of every distinct value to all entries of the codebook; the distances of a block's parts are then
gathers from these tables and their sums. A task hands on sums per entry and dimension, so a round moves
``parts * entries`` rows of a part's width per task, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.workers import task
from tagloom.session import stable

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 4096  # vectors of a dictionary; below 65,537, so that a number of a value has 16 bits
LIMIT = 1 << 27  # whole numbers beyond it are cut to it: their squares would leave 64 bits
HEAVY = 1024  # labels with more than 1/HEAVY of the rows are settled where they lie

BLOCKS = "keys array<{key}>, labels array<{label}>, values array<array<int>>, codes array<binary>"


@dataclass
class Codebooks:
    """``entries[part, number]`` is an entry's components."""

    entries: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def kept(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, whole) of the rows whose vector is whole: its components as whole numbers."""
    parts = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(
        parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    limit = float(LIMIT)
    scaled = F.transform(parts, lambda x: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), x * SCALE))).cast("int"))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(
        F.col(key).alias("key"), F.col(label).alias("label"), scaled.alias("whole"))


def _block(keys: list, labels: list, rows: list[np.ndarray], key: pa.DataType, label: pa.DataType) -> pa.RecordBatch:
    matrix = np.concatenate(rows)
    values, codes = [], []
    for column in matrix.T:
        distinct, number = np.unique(column, return_inverse=True)
        values.append(distinct.tolist())
        codes.append(number.astype("<u2").tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(key)), pa.array([pa.concat_arrays(labels).to_pylist()], pa.list_(label)),
         pa.array([values], pa.list_(pa.list_(pa.int32()))), pa.array([codes], pa.list_(pa.binary()))],
        ["keys", "labels", "values", "codes"])


def _blocked(width: int, size: int):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, rows, held, kinds = [], [], [], 0, None
        for batch in batches:
            kinds = batch.schema.field(0).type, batch.schema.field(1).type
            for start in range(0, batch.num_rows, size):  # a batch is cut where a block would get too large
                part = batch.slice(start, size)
                if held and held + part.num_rows > size:
                    yield _block(keys, labels, rows, *kinds)
                    keys, labels, rows, held = [], [], [], 0
                keys.append(part.column(0))
                labels.append(part.column(1))
                rows.append(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width))
                held += part.num_rows
        if held:
            yield _block(keys, labels, rows, *kinds)

    return run


def blocks(whole: DataFrame, width: int, size: int = BLOCK) -> DataFrame:
    """The written blocks of the vectors with ``width`` components."""
    kinds = {c: whole.schema[c].dataType.simpleString() for c in ("key", "label")}
    return stable(whole.mapInArrow(_blocked(width, size), BLOCKS.format(**kinds)), "blocks")


def distances(values: list, codes: list[bytes], entries: np.ndarray) -> np.ndarray:
    """Squared distances [part, vector, entry] of a block's parts to all entries."""
    parts, n_entries, width = entries.shape
    n = len(codes[0]) // 2
    out = np.zeros((parts, n, n_entries), np.int64)
    for d in range(parts * width):
        table = np.asarray(values[d], np.int64)[:, None] - entries[d // width, :, d % width][None, :]
        out[d // width] += np.take(table * table, np.frombuffer(codes[d], "<u2"), axis=0)
    return out


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in ("values", "codes"))


def _summed(entries: np.ndarray):
    parts, n_entries, width = entries.shape

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, times = np.zeros(entries.shape, np.int64), np.zeros((parts, n_entries), np.int64)
        for values, codes in _block_rows(batches):
            nearest = distances(values, codes, entries).argmin(axis=2)
            for part in range(parts):
                times[part] += np.bincount(nearest[part], minlength=n_entries)
                for j in range(width):
                    d = part * width + j
                    component = np.asarray(values[d], np.int64)[np.frombuffer(codes[d], "<u2")]
                    # sums of a block stay below 2^40 and so are whole in doubles
                    sums[part, :, j] += np.bincount(nearest[part], weights=component, minlength=n_entries).astype(np.int64)
        part, entry = np.divmod(np.arange(parts * n_entries), n_entries)
        used = np.flatnonzero(times.reshape(-1))
        yield pa.RecordBatch.from_arrays([
            pa.array(part[used].astype(np.int32)), pa.array(entry[used].astype(np.int32)), pa.array(times.reshape(-1)[used]),
            pa.array(sums.reshape(-1, width)[used].tolist(), pa.list_(pa.int64())),
        ], ["part", "entry", "n", "sums"])

    return run


def started(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the smallest keys, null keys last; ties go by the components."""
    order = F.col("key").asc_nulls_last(), "whole"
    first = whole.orderBy(*order).first()
    if not first:
        return None
    width = len(first["whole"])
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    rows = [r["whole"] for r in whole.filter(F.size("whole") == width).orderBy(*order).limit(entries).collect()]
    return Codebooks(np.array(rows, np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy())


def improved(cut: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the mean of the parts that are nearest to it, rounded down."""
    entries = books.entries.copy()
    # one row per entry of every task; elements of the sums are added one by one
    found = cut.select("values", "codes").mapInArrow(_summed(entries), "part int, entry int, n long, sums array<long>")
    merged = found.select("part", "entry", "n", F.posexplode("sums").alias("j", "s")).groupBy("part", "entry", "j").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    for r in merged:
        entries[r["part"], r["entry"], r["j"]] = r["s"] // r["n"]
    return Codebooks(entries)


def fit(cut: DataFrame, start: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    for _ in range(rounds):
        start = improved(cut, start)
    return start


def _coded(entries: np.ndarray):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, labels = (batch.column(c)[i].values for c in ("keys", "labels"))
                far = distances(batch.column("values")[i].as_py(), batch.column("codes")[i].as_py(), entries)
                nearest = far.argmin(axis=2)
                error = np.take_along_axis(far, nearest[:, :, None], axis=2)[:, :, 0].sum(axis=0)
                text = [row.tobytes().hex() for row in np.ascontiguousarray(nearest.T.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([keys, labels, pa.array(text, pa.string()), pa.array(error)],
                                                 ["key", "label", "code", "error"])

    return run


def coded(cut: DataFrame, books: Codebooks) -> DataFrame:
    """(key, label, code, error): two hex digits per part, and the squared distance of the vector to its entries."""
    kinds = {c[:-1]: cut.schema[c].dataType.elementType.simpleString() for c in ("keys", "labels")}
    return cut.mapInArrow(_coded(books.entries), "key {key}, label {label}, code string, error long".format(**kinds))


def decoded(code: str, books: Codebooks) -> list[float]:
    """The vector that a code stands for."""
    return [x / SCALE for part, number in enumerate(bytes.fromhex(code)) for x in books.entries[part, number].tolist()]


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds the sum of ``error`` over equal labels, nulls together. Labels with many rows, ``HEAVY`` at most, are settled
    where their rows lie; the others are rare by proof and shuffle."""
    rows = stable(rows, "coded")
    sums = stable(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    many = (sums.agg(F.sum("n")).first()[0] or 0) // HEAVY
    heavy = F.broadcast(sums.filter(F.col("n") > many).select(F.col("label").alias("l"), "label_error"))
    same = F.col("label").eqNullSafe(F.col("l"))
    light = sums.filter(F.col("n") <= many).select(F.col("label").alias("l"), "label_error")
    return rows.join(heavy, same).drop("l").unionByName(
        rows.join(heavy.select("l"), same, "left_anti").join(light, same).drop("l"))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """((key, label, code, error, label_error) of every sound vector, codebooks).

    Rows whose vector is null, empty, or holds a null or non-finite component are dropped, and so are vectors of another
    length than that of the smallest key: the codebooks have no entry for them. Fewer vectors than entries start
    smaller codebooks. Rows that repeat a key are coded each. An empty table gives no rows and no codebooks. Components beyond
    ``LIMIT / SCALE`` are cut to it. Other columns are not read.
    """
    whole = kept(vectors, key, vector, label)
    start = started(whole, parts, entries)
    if start is None:
        return whole.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                            F.lit(0).cast("long").alias("label_error")).filter("1 = 0"), None
    width = start.entries.shape[0] * start.entries.shape[2]
    cut = blocks(whole.filter(F.size("whole") == width), width)
    books = fit(cut, start, rounds)
    return with_label_error(coded(cut, books)), books
