"""Near duplicates by SimHash: fingerprints, bit-sliced comparison inside buckets, components.

Two fingerprints of 64 bits that differ in two bits at most agree on two of four 16-bit quarters, so each
distinct fingerprint goes to six buckets of one pair of quarters. Copies of one fingerprint are one row there.
A bucket with more than ``BUCKET`` fingerprints is not compared as it is: its two other quarters are cut in
four and the same argument is used again, which leaves buckets of one 48-bit value, 65,536 fingerprints at
most by construction. Inside a bucket the bits stand in vertical planes, 64 distances to a machine word; a
carry-save counter adds three planes at a time, and words whose distances are all over the radius are
abandoned. A bucket gives links that span its linked fingerprints, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.components import components
from tagloom.llm.near_copies import copy_classes
from tagloom.llm.texts import whole
from tagloom.llm.workers import task
from tagloom.session import discard, stable, written_tables

RADIUS = 2
WORDS = 3  # words of a shingle
BUCKET = 512  # fingerprints of a bucket that are compared without refining it
WIDE = 32  # groups up to this size are compared row by row shifts, larger ones query by query
HOLD = 1 << 16  # rows a task gathers before it compares
STEP = 15  # planes between two looks at which words are still open


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash over word shingles, repeats included; zero for a text without words."""
    parts = text.lower().split()  # bytes: A-Z only, and exactly the white space of the contract
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*[parts[i:] for i in range(words)]))
    votes, n = np.zeros(64, np.int64), 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start:start + (1 << 16)].astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


@task
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["key", "print"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print) of every row; the fingerprint is a long with the same 64 bits. Null counts as empty."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), whole(F.col(text)).cast("binary").alias("text")).mapInArrow(
        _fingerprints, f"key {kind}, print long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit values: row p has bit p of all of them, 64 values to a word."""
    pad = -len(values) % 64
    padded = np.concatenate([values, np.zeros(pad, np.uint64)]) if pad else values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(difference: Callable[[int, np.ndarray], np.ndarray], n_words: int, n_planes: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(word, mask): the words with a lane of ``RADIUS`` differing bits at most, and those lanes.

    ``difference(p, words)`` gives plane p of the compared values' difference for the open words.
    """
    open_ = np.arange(n_words)
    ones, twos, over = (np.zeros(n_words, np.uint64) for _ in range(3))
    for p in range(0, n_planes, 3):
        a = difference(p, open_)
        b = difference(p + 1, open_) if p + 1 < n_planes else np.zeros_like(a)
        c = difference(p + 2, open_) if p + 2 < n_planes else np.zeros_like(a)
        part = a ^ b
        one, two = part ^ c, (a & b) | (part & c)  # the three planes as a number of two bits
        carry = ones & one
        over |= (twos & two) | (twos & carry) | (two & carry)
        ones ^= one
        twos ^= two ^ carry
        over |= ones & twos  # three or more
        if (p + 3) % STEP == 0:
            still = ~over != 0
            if not still.all():
                open_, ones, twos, over = open_[still], ones[still], twos[still], over[still]
                if not len(open_):
                    break
    return open_, ~over


def _lanes(words: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position in ``words`` and lane of every set bit."""
    bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def _spread(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the label trees of linked rows; a label is a row number and points to a smaller one or itself."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def spanning(buckets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span all near values of equal buckets; rows are sorted by bucket."""
    n = len(values)
    labels = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    sizes = np.diff(np.append(starts, n))
    ends = np.repeat(starts + sizes, sizes)
    rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= WIDE), sizes))
    shift = 1
    while len(rows := rows[rows + shift < ends[rows]]):
        sliced = planes(values[rows] ^ values[rows + shift])
        words, masks = near(lambda p, w: sliced[p, w], sliced.shape[1])
        at, lane = _lanes(words, masks)
        row = words[at] * 64 + lane
        row = rows[row[row < len(rows)]]
        labels = _spread(labels, row, row + shift)
        shift += 1
    for start, size in zip(starts[sizes > WIDE], sizes[sizes > WIDE]):
        labels = _spread_large(labels, values, start, size)
    linked = np.flatnonzero(labels != np.arange(n))
    return values[linked], values[labels[linked]]


def _spread_large(labels: np.ndarray, values: np.ndarray, start: int, size: int) -> np.ndarray:
    own = values[start:start + size]
    sliced = planes(own)
    width = sliced.shape[1]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    block = max(1, (1 << 16) // width)
    for first in range(0, size, block):
        asked = own[first:first + block]
        # 0 or all ones per plane and query: XOR with it compares the query with 64 values at once
        masks = np.where((asked[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), full, np.uint64(0))
        low = first // 64  # earlier words met these rows as queries already
        rest = width - low
        words, hits = near(lambda p, w: sliced[p, low + w % rest] ^ masks[p, w // rest], len(asked) * rest)
        at, lane = _lanes(words, hits)
        query, other = first + words[at] // rest, (low + words[at] % rest) * 64 + lane
        keep = (other < size) & (other > query)
        labels = _spread(labels, start + query[keep], start + other[keep])
    return labels


@task
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; whole buckets are compared, the last one waits for its rest."""
    held: list[np.ndarray] = []

    def compare(rows: np.ndarray) -> pa.RecordBatch:
        a, b = spanning(rows[0], rows[1].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        if sum(h.shape[1] for h in held) >= HOLD:
            rows = np.concatenate(held, axis=1)
            cut = np.searchsorted(rows[0], rows[0, -1])  # the first row of the last bucket
            if cut:
                yield compare(rows[:, :cut])
            held = [rows[:, cut:]]
    if held:
        yield compare(np.concatenate(held, axis=1))


def _bits(value: Column, first: int, n: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _buckets(prints: DataFrame) -> DataFrame:
    """(band, part, print): the six pairs of quarters, with their values."""
    def part(pair):
        value = _bits(F.col("print"), 16 * pair[0], 16) + F.shiftleft(_bits(F.col("print"), 16 * pair[1], 16), 16)
        return F.struct(F.lit(i[pair]).cast("long").alias("band"), value.alias("part"))

    pairs = list(combinations(range(4), 2))
    i = {pair: n for n, pair in enumerate(pairs)}
    return prints.select("print", F.inline(F.array(*[part(p) for p in pairs])))


def _refined(full: DataFrame) -> DataFrame:
    """Buckets that are too full, cut by 16 of the 32 bits they do not share: again six pairs of quarters."""
    pairs = list(combinations(range(4), 2))
    rest = F.lit(None).cast("long")
    for n, pair in enumerate(pairs):
        low, high = [q for q in range(4) if q not in pair]
        other = _bits(F.col("print"), 16 * low, 16) + F.shiftleft(_bits(F.col("print"), 16 * high, 16), 16)
        rest = F.when(F.col("band") == n, other).otherwise(rest)
    finer = full.withColumn("rest", rest)
    parts = [
        F.struct((F.col("band") * 8 + 8 + n).alias("band"),
                 (F.col("part") + F.shiftleft(_bits(F.col("rest"), 8 * a, 8) + F.shiftleft(_bits(F.col("rest"), 8 * b, 8), 8), 32)).alias("part"))
        for n, (a, b) in enumerate(pairs)
    ]
    return finer.select("print", F.inline(F.array(*parts)))


def print_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that span every set of distinct fingerprints connected by steps of ``RADIUS`` bits."""
    banded = stable(_buckets(prints.select("print").distinct()), "bands")
    sizes = banded.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stable(banded.join(sizes, ["band", "part"]), "buckets")
    fine = shared.filter(F.col("n") <= bucket).select("band", "part", "print").unionByName(
        _refined(shared.filter(F.col("n") > bucket)))
    # 48 bits of value and 6 of band in one long, so that a bucket is one key
    keyed = fine.select(F.shiftleft("band", 48).bitwiseOR(F.col("part")).alias("bucket"), "print")
    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links, "a long, b long").distinct()


def print_pairs(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of nodes that span the nodes of each fingerprint and the fingerprints that ``print_links`` links; ``prints``
    has (node, print), a row per node."""
    leads = prints.groupBy("print").agg(F.min("node").alias("lead"))
    same = prints.join(leads, "print").filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    mark = written_tables()
    links = print_links(leads, bucket)
    ends = [leads.select(F.col("print").alias(p), F.col("lead").alias(n)) for p, n in (("x", "a"), ("y", "b"))]
    far = stable(links.select(F.col("a").alias("x"), F.col("b").alias("y")).join(ends[0], "x").join(ends[1], "y").select("a", "b"), "linked")
    discard(prints.sparkSession, mark, keep=1)
    return same.unionByName(far)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(key, print, component) of every row; the component is the smallest key that steps of two bits reach.

    Rows that repeat a key stay rows of their own. Null and empty texts share the fingerprint zero. A null key
    names a component only where there is no other. An empty table gives none; other columns are not read.
    """
    prints = stable(fingerprints(docs, key, text), "prints")
    distinct = stable(prints.groupBy("print").agg(F.min("key").alias("least")), "distinct")
    roots = stable(components(print_links(distinct, bucket)), "roots")
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    whole_class = stable(rooted.join(named, "root").select("print", "component"), "classes")
    return prints.join(whole_class, "print").select("key", "print", "component")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component of near copies the row with the smallest key (null last, then by digest of the text), all columns kept.

    Rows are told apart by key and text: different texts of one key, or without one, are judged each, and of rows
    that repeat both one stays. Near copies share 4/5 of their shingles of five words or more. Fingerprints of these shingles
    that differ in ``RADIUS`` bits at most name the first candidates; an exact check follows, and finds the pairs that lie
    further apart by their prefixes.
    """
    first = F.min(F.struct(F.col("key").isNull(), "key", "digest")).alias("first")
    kept = copy_classes(docs, key, text, known=print_pairs).groupBy("root").agg(first, F.count(F.lit(1)).alias("n")).select(
        F.col("first.key").alias("kept_key"), F.col("first.digest").alias("kept_digest"), "n")
    columns = docs.columns
    met = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(key).alias("own"),
                      F.md5(whole(F.col(text)).cast("binary")).alias("digest")).join(
        kept, F.col("own").eqNullSafe(F.col("kept_key")) & (F.col("digest") == F.col("kept_digest")))
    repeated = met.filter("n > 1").groupBy("own", "digest").agg(
        F.max_by("row", F.length(whole(F.col("row").getField(text)))).alias("row"))
    return met.filter("n = 1").select("row").unionByName(repeated.select("row")).select(
        *[F.col("row").getField(c).alias(c) for c in columns])
