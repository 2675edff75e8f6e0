"""Packing token sequences: a configuration linear program over the length histogram.

Documents are tokenised and cut into pieces of ``CAPACITY`` tokens at most. What is to be packed then is only a
histogram of 1024 lengths, whatever the corpus. Over it the configuration program (one variable per way to
fill a sequence) is solved by multiplicative weights: each round prices all configurations at once by a
knapsack dynamic program under the present weights, buys the best one, and lowers the weights of the lengths
that it covers. Every round's weights bound the program from below, and what is bought, scaled to cover all, from
above; rounds end when both meet, or after ``ROUNDS``. The bought fractions are rounded down, and what is left is filled by largest fit,
again over the histogram. Where the rounds find no cover in time, or a worse one, the plan is largest fit's. The plan is a list of (configuration, times); a piece finds its place from its length and
its rank among the pieces of that length, which comes from counts per chunk and no sort of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.texts import whole
from tagloom.llm.tokens import encoder
from tagloom.llm.workers import task
from tagloom.session import stable

CAPACITY = 1024
END = 2  # closes every document
ROUNDS = 600  # of multiplicative weights at most, hence configurations before rounding
GROWTH = 1.1  # a long piece is worth more than its share: it is harder to place later
EPSILON = 0.1  # of the multiplicative weights: a length that is covered once is worth so much less
GAP = 0.002  # between the program's bounds that ends the rounds

PIECES = "key {key}, piece int, start long, length int, ids_crc32 long, chunk int, rank long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole capacities, the first piece takes the rest."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def _pieces(path: str, capacity: int, end: int | None):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tail = np.array([] if end is None else [end], np.uint32)
        for batch in batches:
            row, places, crc = [], [], []
            for i, ids in enumerate(encoder(path).batch(batch.column(1))):
                raw = np.concatenate([ids, tail]).astype("<u4")
                cut = cuts(len(raw), capacity)
                row += [i] * len(cut)
                places += cut
                crc += [zlib.crc32(raw[start:start + length]) for start, length in cut]
            row, (start, length) = np.array(row, np.int64), np.array(places, np.int64).reshape(-1, 2).T
            # the rank among the pieces of one length: those of the task before, and the earlier ones of the batch
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length))
            rank += seen[length] - first
            seen += np.bincount(length, minlength=capacity + 1)
            piece = np.arange(len(row)) - np.searchsorted(row, row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(row), chunk, np.int32)), pa.array(rank)],
                ["key", "piece", "start", "length", "ids_crc32", "chunk", "rank"])

    return run


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end: int | None = END) -> DataFrame:
    """The written table of pieces, each with its rank among the pieces of its length in its chunk.

    Chunk and rank are columns of the written table, so a later reader sees those of the attempt that counted.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    return stable(rows.mapInArrow(_pieces(tokenizer, capacity, end), PIECES.format(key=kind)), "pieces")


def price(weights: np.ndarray, lengths: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack: how many of each length fill ``capacity`` with the most weight."""
    return _knapsack(weights, lengths, limits, capacity)[0]


def _knapsack(weights: np.ndarray, lengths: np.ndarray, limits: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The filling, and the most weight that one without limits has.

    ``best[c]`` is the most weight in capacity c, each length usable at will; copies above a limit are dropped
    on the way back, and the room goes to the next choice.
    """
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        usable = np.searchsorted(lengths, c, "right")
        best[c], choice[c] = best[c - 1], -1
        if usable:
            gain = best[c - lengths[:usable]] + weights[:usable]
            top = int(gain.argmax())
            if gain[top] > best[c]:
                best[c], choice[c] = gain[top], top
    taken = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0 or taken[choice[c]] >= limits[choice[c]]:
            c -= 1
            continue
        taken[choice[c]] += 1
        c -= lengths[choice[c]]
    return taken, float(best[capacity])


def covering(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> tuple[list[tuple[np.ndarray, float]], float]:
    """(configuration, times) that cover all pieces, and a lower bound of the program's value.

    A round buys the best configuration as often as covers one of its lengths once, and multiplies the weight of
    each length by exp(-EPSILON * what it covers of it). Weights divided by the most that a configuration holds
    of them are a dual solution. What was bought while the weights were still far off is left out again: after
    a cover is whole the count starts anew, each time over twice the rounds at least, and the best cover stays. None
    is found when the lengths are too many for the rounds.
    """
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    log = np.log(lengths / capacity) * GROWTH
    bound = float((need * lengths).sum()) / capacity
    best, found, covered, least, anew = [], {}, np.zeros(len(lengths)), np.inf, 4
    for turn in range(1, rounds + 1):
        weights = np.exp(log - log.max())
        taken, most = _knapsack(weights, lengths, counts[lengths], capacity)
        bound = max(bound, float(need @ weights) / most)
        used = taken > 0
        times = float((need[used] / taken[used]).min())
        covered += taken * times / need
        log -= EPSILON * taken * times / need
        found.setdefault(taken.tobytes(), [taken, 0.0])[1] += times
        if covered.min() > 0:
            value = sum(x for _, x in found.values()) / covered.min()
            if value < least:
                least, best = value, [(t, x / covered.min()) for t, x in found.values()]
            if least <= bound * (1 + gap):
                break
            if turn >= anew:
                found, covered, anew = {}, np.zeros(len(lengths)), 2 * turn
    return best, bound


def fill(left: np.ndarray, lengths: np.ndarray, capacity: int) -> Iterator[tuple[np.ndarray, int]]:
    """Pack what is left: the largest length first, then always the largest that fits; one configuration as often
    as the counts allow. Each turn uses up a length, so the turns are bounded by the number of lengths."""
    left = left.copy()
    while left.any():
        taken = np.zeros(len(lengths), np.int64)
        room = capacity
        for i in range(len(lengths) - 1, -1, -1):
            n = min(int(left[i]), room // int(lengths[i]))
            taken[i] = n
            room -= n * int(lengths[i])
        times = int((left[taken > 0] // taken[taken > 0]).min())
        left -= taken * times
        yield taken, times


def rounded(bought: list[tuple[np.ndarray, float]], left: np.ndarray, lengths: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole times of the bought configurations, as the counts allow, and largest fit for the rest."""
    left, out = left.copy(), []
    for taken, times in sorted(bought, key=lambda x: -x[1]):
        used = taken > 0
        whole_times = min(int(times + 1e-9), int((left[used] // taken[used]).min()))
        if whole_times:
            left -= taken * whole_times
            out.append((taken, whole_times))
    return out + list(fill(left, lengths, capacity))


def plan(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(lengths, copies, times): configurations that hold every piece of the histogram exactly once."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    left = counts[lengths].astype(np.int64)

    def sequences_of(out: list[tuple[np.ndarray, int]]) -> int:
        return sum(times for _, times in out)

    # the program's plan unless largest fit alone needs fewer sequences
    out = min(rounded(covering(counts, capacity, rounds)[0], left, lengths, capacity), rounded([], left, lengths, capacity),
              key=sequences_of)
    return [(lengths[t > 0], t[t > 0], n) for t, n in out]


def slots(configurations: list[tuple[np.ndarray, np.ndarray, int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, copies, first sequence, first offset): where its pieces go, by rank."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, copies, times in configurations:
        offset = 0
        for length, n in zip(lengths[::-1].tolist(), copies[::-1].tolist()):
            rank = taken.get(length, 0)
            rows.setdefault(length, []).append((rank, n, sequence, offset))
            taken[length] = rank + n * times
            offset += length * n
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def _placed(where: dict[int, np.ndarray]):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length).tolist():
                at = np.flatnonzero(length == one)
                row = where[one][np.searchsorted(where[one][:, 0], rank[at], "right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + inside // row[:, 1]
                offset[at] = row[:, 3] + inside % row[:, 1] * one
            kept = [names.index(n) for n in ("key", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(sequence), pa.array(offset)],
                [names[i] for i in kept] + ["sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end: int | None = END, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is one piece of its end token. Rows that repeat a key are packed each. An
    empty table gives no rows. Other columns are not read.
    """
    cut = pieces(docs, tokenizer, key, text, capacity, end)
    per_chunk = stable(cut.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        histogram[row["length"]] = row["n"]
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cut.join(offsets, ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    kind = docs.schema[key].dataType.simpleString()
    return ranked.select("key", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placed(slots(plan(histogram, capacity, rounds))),
        f"key {kind}, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Per sequence how many pieces and tokens it holds."""
    return packed.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").cast("long").alias("tokens"))


def fill_rate(packed: DataFrame, capacity: int = CAPACITY) -> Column:
    return F.sum("length") / (F.countDistinct("sequence_id") * capacity)
