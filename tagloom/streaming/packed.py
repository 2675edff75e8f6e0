"""Columns of many rows as one binary value: rows on their way to keyed state, and rows that wait in it.

A micro-batch holds the rows of a key at once, and each row handed to Python and each call of the state takes its time. So rows
are put together where they are made, by slice, and wait by the hour: numbers by their differences, other columns as
places in a list of their distinct values.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

HOUR = 3_600_000_000  # of rows that wait
PACK = 100_000  # rows that a task gathers before it deals them out
PIECE = 10_000  # rows of one value at most
NULL = int(np.iinfo(np.int64).min)  # a number that is not there
EVERY = -1  # slice of rows that go to all of them


class Coded(NamedTuple):
    """A column as places in a list of its values."""

    codes: np.ndarray
    values: list

    def column(self) -> list:
        return [self.values[i] for i in self.codes.tolist()]


Column = np.ndarray | Coded


def joint(columns: list[Coded]) -> Coded:
    """The combinations of values that occur, as tuples."""
    key, size = np.zeros(len(columns[0].codes), np.int64), 1
    for codes, values in columns:
        if size * len(values) >= 1 << 62:
            kept, key = np.unique(key, return_inverse=True)
            size = len(kept)
        key, size = key * len(values) + codes, size * len(values)
    _, at, place = np.unique(key, return_index=True, return_inverse=True)
    return Coded(place, list(zip(*[Coded(codes[at], values).column() for codes, values in columns])))


def take(rows: list[Column], at: np.ndarray | slice) -> list[Column]:
    return [Coded(c.codes[at], c.values) if isinstance(c, Coded) else c[at] for c in rows]


def merged(blocks: list[list[Column]]) -> list[Column]:
    """The rows of several blocks as one, in this order."""
    if len(blocks) == 1:
        return blocks[0]
    out: list[Column] = []
    for same in zip(*blocks):
        if isinstance(same[0], Coded):
            places: dict = {}
            codes = [np.array([places.setdefault(v, len(places)) for v in c.values], np.int64)[c.codes] for c in same]
            out.append(Coded(np.concatenate(codes), list(places)))
        else:
            out.append(np.concatenate(same))
    return out


def _bytes(numbers: np.ndarray) -> bytes:
    """First bytes first: those that differ little stand together."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def dump(rows: list[Column]) -> bytes:
    out = []
    for c in rows:
        if isinstance(c, Coded):
            used, codes = np.unique(c.codes, return_inverse=True)
            codes = codes.astype(np.min_scalar_type(len(used)))
            out.append((codes.dtype.str, _bytes(codes), [c.values[i] for i in used.tolist()]))
        else:
            step = np.diff(c, prepend=np.int64(0))
            out.append((None, _bytes((step << 1) ^ (step >> 63)), None))
    raw = pickle.dumps(out, pickle.HIGHEST_PROTOCOL)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def load(data: bytes) -> list[Column]:
    rows: list[Column] = []
    for kind, numbers, values in pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)):
        if kind is not None:
            rows.append(Coded(_numbers(numbers, kind), values))
        else:
            step = _numbers(numbers, "<u8")
            rows.append(np.cumsum(((step >> np.uint64(1)) ^ (np.uint64(0) - (step & np.uint64(1)))).view(np.int64)))
    return rows


def runs(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(number, begin, end) of neighbours that are equal."""
    ends = [*(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
    for begin, end in zip([0, *ends], ends):
        yield int(numbers[begin]), begin, end


def _coded(column: pa.ChunkedArray) -> Coded:
    found = pc.dictionary_encode(pa.concat_arrays(column.chunks), null_encoding="encode")
    return Coded(found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist())


def in_order(column: Coded) -> Coded:
    """With its values in order, so that those that are alike stand together."""
    order = sorted(range(len(column.values)), key=lambda i: (column.values[i] is not None, column.values[i] or ""))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Coded(place[column.codes], [column.values[i] for i in order])


def packer(numbers: list[str], who: str, form: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows (slice, ...) become (slice, rows). A block has the ``numbers``, the first of them the moment,
    the text ``who``, and the other columns as one of tuples. Rows without a moment have no place and go."""
    def dealt(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.filter(pc.is_valid(table[numbers[0]]))
        if not table.num_rows:
            return
        columns = [pc.fill_null(table[n].cast(pa.int64()), NULL).to_numpy() for n in numbers]
        block = [*columns, in_order(_coded(table[who])), joint([_coded(table[n]) for n in form])]
        slices = pc.fill_null(table["slice"], EVERY).to_numpy()
        order = np.lexsort((*columns[::-1], slices))
        slices = slices[order]
        for number, begin, end in runs(slices):
            for at in range(begin, end, PIECE):
                data = dump(take(block, order[at:min(end, at + PIECE)]))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([data], pa.binary())], ["slice", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK:
                yield from dealt(held)
                held, n = [], 0
        if held:
            yield from dealt(held)

    return run


PACKED = "slice int, rows binary"


class Waiting:
    """Blocks of rows in a map state (hour, part) -> rows. The first ``keys`` columns give the order. One object serves one call
    of the processor."""

    def __init__(self, state, keys: int):
        self.state, self.keys, self.parts = state, keys, {}

    def _ordered(self, rows: list[Column]) -> list[Column]:
        return take(rows, np.lexsort(rows[:self.keys][::-1]))

    def put(self, blocks: list[list[Column]]) -> None:
        """Rows go into the state as further parts of their hours; ``parts`` are the numbers of those that come next."""
        rows = self._ordered(merged(blocks))
        rows = [in_order(c) if isinstance(c, Coded) and isinstance(c.values[0], str | None) else c for c in rows]
        for hour, begin, end in runs(rows[0] // HOUR):
            part = self.parts.get(hour, 0)
            while hour not in self.parts and self.state.containsKey((hour, part)):
                part += 1
            self.state.updateValue((hour, part), (dump(take(rows, slice(begin, end))),))
            self.parts[hour] = part + 1

    def taken(self, watermark: int) -> Iterator[list[Column]]:
        """Rows that are due, in their order; an hour is read when the one before it is done."""
        last = watermark // HOUR
        if last <= 0:
            return
        keys = sorted(k for k in map(tuple, self.state.keys()) if k[0] <= last)
        for hour, same in groupby(keys, key=lambda k: k[0]):
            blocks = []
            for key in same:
                blocks.append(load(self.state.getValue(key)[0]))
                self.state.removeKey(key)
            rows = self._ordered(merged(blocks))
            due = int(np.searchsorted(rows[0], watermark, "right"))
            if due < len(rows[0]):
                self.state.updateValue((hour, 0), (dump(take(rows, slice(due, None))),))
                rows = take(rows, slice(0, due))
            if due:
                yield rows


def spread(slices: int) -> list[int]:
    """For each slice a number that Spark's hash puts into a partition of its own, when there are as many partitions."""
    found: dict[int, int] = {}
    number = 0
    while len(found) < slices:
        found.setdefault(_murmur3(number) % slices, number)
        number += 1
    return sorted(found.values())


def _murmur3(number: int, seed: int = 42) -> int:
    """Spark's hash of an int."""
    mask = 0xFFFFFFFF
    k = number * 0xCC9E2D51 & mask
    k = ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
    h = seed ^ k
    h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= 4
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * times & mask
    return h - (1 << 32) if h >> 31 else h
