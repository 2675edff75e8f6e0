"""Benchmark decontamination over a positional inverted index of the training text.

The index is cut by documents: each segment holds the postings (term, sorted positions) of a run of whole
documents of about ``SEGMENT`` words, and is one row of a written table. A lookup takes the terms of a window
from the rarest on, by counts over the whole index, and intersects their lists moved back by the term's place
in the window. Nothing of a document ever leaves its segment, so neither a common passage nor a common word
gathers rows in one task, and a list is never longer than its segment. Only the benchmark's terms are posted
unless ``build_index`` is called without a vocabulary.

The benchmark goes to the tasks in blocks of items of a bounded size; a larger benchmark is looked up block
by block in the same index, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.texts import NOT_WORD, LOWER, UPPER, whole, word_list
from tagloom.llm.workers import task
from tagloom.session import stable

WINDOW = 10
SEGMENT = 100_000  # words after which a segment is closed; a document is never cut
GAP = 64  # places between two documents of a segment, more than a window and its slack
BLOCK_BYTES = 32 << 20  # benchmark text that goes to the tasks at a time

INDEX = "segment long, keys array<{key}>, starts array<int>, n_words array<int>, terms array<binary>, offsets array<int>, positions array<int>"
HITS = "segment long, place int, key {key}, n_words long, spans array<struct<first:int,last:int>>, items array<{item}>"
MATCHES = "key {key}, item {item}, kind string, first int, last int"


@dataclass
class Windows:
    """Distinct windows of a benchmark block: their words and the items they come from."""

    words: list[tuple[bytes, ...]]
    items: list[list]

    @property
    def vocabulary(self) -> set[bytes]:
        return {w for window in self.words for w in window}


def windows(items: list[tuple], length: int = WINDOW) -> Windows:
    """Runs of ``length`` words of every item; a shorter item that has words is one window."""
    found: dict[tuple[bytes, ...], dict] = {}
    for item, text in items:
        words = word_list((text or "").encode())
        for i in range(max(1, len(words) - length + 1) if words else 0):
            found.setdefault(tuple(words[i:i + length]), {})[item] = None
    return Windows(list(found), [list(v) for v in found.values()])


def blocks(benchmark: DataFrame, item: str, text: str, size: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark's items in lists of ``size`` bytes of text at most, or of one item."""
    held, n = [], 0
    for row in benchmark.select(item, text).toLocalIterator():
        more = len((row[1] or "").encode())
        if held and n + more > size:
            yield held
            held, n = [], 0
        held.append((row[0], row[1]))
        n += more
    if held:
        yield held


def _posted(vocabulary: dict[bytes, int] | None, segment_words: int, key: pa.DataType):
    def close(number: int, keys: list, counts: list[int], places: list[np.ndarray], terms: list[np.ndarray], names):
        n_words = np.array(counts, np.int64)
        # documents stand apart by a gap, so that no window and no near match reaches into the next one
        starts = np.cumsum(n_words + GAP) - n_words - GAP
        at = np.concatenate([p + s for p, s in zip(places, starts)]) if places else np.zeros(0, np.int64)
        term = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        at, term = at[order], term[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, int)
        return pa.RecordBatch.from_arrays([
            pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()),
            pa.array([keys], pa.list_(key)),
            pa.array([starts.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([n_words.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([[names[t] for t in term[first].tolist()]], pa.list_(pa.binary())),
            pa.array([np.append(first, len(term)).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
        ], ["segment", "keys", "starts", "n_words", "terms", "offsets", "positions"])

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = 0, 0
        keys, counts, places, terms = [], [], [], []
        known = {} if vocabulary is None else vocabulary
        names = None if vocabulary is None else list(vocabulary)
        for batch in batches:
            for key_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = word_list(text.as_py())
                if vocabulary is None:
                    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                    here = np.arange(len(words))
                else:
                    ids = np.array([known.get(w, -1) for w in words], np.int64)
                    here = np.flatnonzero(ids >= 0)
                    ids = ids[here]
                keys.append(key_)
                counts.append(len(words))
                places.append(here)
                terms.append(ids)
                total += len(words) + GAP
                if total >= segment_words:
                    yield close(number, keys, counts, places, terms, names or list(known))
                    number, total = number + 1, 0
                    keys, counts, places, terms = [], [], [], []
                    if vocabulary is None:
                        known = {}
        if keys:
            yield close(number, keys, counts, places, terms, names or list(known))

    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: set[bytes] | None = None,
                segment_words: int = SEGMENT) -> DataFrame:
    """The written index: one row per segment, whole documents each. Null texts have no words."""
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    numbers = None if vocabulary is None else {w: i for i, w in enumerate(sorted(vocabulary))}
    rows = docs.select(F.col(key).alias("key"), whole(F.col(text)).cast("binary").alias("text"))
    return stable(rows.mapInArrow(_posted(numbers, segment_words, to_arrow_type(kind)),
                                  INDEX.format(key=kind.simpleString())), "index")


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): occurrences of every posted term over the whole index."""
    per = F.transform(F.sequence(F.lit(1), F.size("terms")), lambda i: F.struct(
        F.element_at("terms", i).alias("term"), (F.element_at("offsets", i + 1) - F.element_at("offsets", i)).alias("n")))
    return index.filter(F.size("terms") > 0).select(F.inline(per)).groupBy("term").agg(F.sum("n").alias("n"))


def _starts(window: tuple[bytes, ...], order: list[int], post, slack: int) -> np.ndarray:
    """Places where the window begins: every word within ``slack`` of where it belongs."""
    found = None
    for place in order:
        at = post.get(window[place])
        if at is None:
            return np.zeros(0, np.int64)
        at = at - place
        if found is None:
            found = at
        elif not slack:
            near = np.searchsorted(at, found)
            found = found[(near < len(at)) & (at[np.minimum(near, len(at) - 1)] == found)]
        else:
            near = np.searchsorted(at, found - slack)
            found = found[(near < len(at)) & (at[np.minimum(near, len(at) - 1)] <= found + slack)]
        if not len(found):
            return found
    return found


def _segments(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            ends = row["offsets"].values.to_numpy()
            at = row["positions"].values.to_numpy().astype(np.int64)
            post = {t: at[ends[j]:ends[j + 1]] for j, t in enumerate(row["terms"].as_py())}
            yield (row["segment"].as_py(), row["keys"].as_py(), row["starts"].values.to_numpy().astype(np.int64),
                   row["n_words"].values.to_numpy().astype(np.int64), post)


def _searched(asked: Windows, orders: list[list[int]], key: pa.DataType, item: pa.DataType):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, keys, starts, n_words, post in _segments(batches):
            span = int(starts[-1] + n_words[-1]) + 1
            edge = np.zeros(span + 1, np.int32)
            found: dict[int, dict] = {}
            for window, items, order in zip(asked.words, asked.items, orders):
                at = _starts(window, order, post, 0)
                if len(at):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + len(window), -1)
                    for doc in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
                        found.setdefault(doc, {}).update(dict.fromkeys(items))
            hit = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
            first, last = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
            doc = np.searchsorted(starts, first, "right") - 1
            spans: dict[int, list] = {}
            for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist()):
                spans.setdefault(d, []).append({"first": a - int(starts[d]), "last": b - int(starts[d])})
            n = len(keys)
            yield pa.RecordBatch.from_arrays([
                pa.array([segment] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(keys, key),
                pa.array(n_words, pa.int64()),
                pa.array([spans.get(d, []) for d in range(n)],
                         pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                pa.array([list(found.get(d, ())) for d in range(n)], pa.list_(item)),
            ], ["segment", "place", "key", "n_words", "spans", "items"])

    return run


def _near(asked: Windows, orders: list[list[int]], slack: int, key: pa.DataType, item: pa.DataType):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, starts, _, post in _segments(batches):
            out: list[tuple] = []
            for window, items, order in zip(asked.words, asked.items, orders):
                exact = _starts(window, order, post, 0)
                loose = np.setdiff1d(_starts(window, order, post, slack), exact) if slack else exact[:0]
                for kind, at in (("phrase", exact), ("proximity", loose)):
                    doc = np.searchsorted(starts, at + order[0], "right") - 1  # a word that surely is in it
                    for d, a in zip(doc.tolist(), (at - starts[doc]).tolist()):
                        out += [(keys[d], one, kind, max(0, a), a + len(window)) for one in items]
            types = [key, item, pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["key", "item", "kind", "first", "last"])

    return run


def _asked(index: DataFrame, items: list[tuple], length: int) -> tuple[Windows, list[list[int]]]:
    """The block's windows, and for each the order of its words from the rarest on."""
    found = windows(items, length)
    terms = index.sparkSession.createDataFrame([(bytearray(w),) for w in found.vocabulary], "term binary")
    counts = {bytes(r["term"]): r["n"] for r in term_counts(index).join(terms, "term", "left_semi").collect()}
    return found, [sorted(range(len(w)), key=lambda i: counts.get(w[i], 0)) for w in found.words]


def _vocabulary(benchmark: DataFrame, text: str) -> set[bytes] | None:
    """The words of a benchmark of one block; none for a larger one, whose index then posts every word."""
    size = benchmark.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    if size > BLOCK_BYTES:
        return None
    lowered = F.translate(whole(F.col(text)), UPPER, LOWER)
    words = benchmark.select(F.explode(F.split(lowered, f"{NOT_WORD}+")).alias("w")).filter("w <> ''").distinct()
    return {r["w"].encode() for r in words.toLocalIterator()}


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", length: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: key, n_words, spans (word ranges inside an occurrence, end exclusive), items.

    Null and empty texts have no words and are never hit. Rows that repeat a key are rows of their own; items
    that repeat count once. Without items, or with items without words, nothing is hit.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    index = build_index(docs, key, text, _vocabulary(benchmark, item_text))
    key_type, item_type = docs.schema[key].dataType, benchmark.schema[item].dataType
    schema = HITS.format(key=key_type.simpleString(), item=item_type.simpleString())
    parts = []
    for block in blocks(benchmark, item, item_text):
        asked, orders = _asked(index, block, length)
        parts.append(index.mapInArrow(_searched(asked, orders, to_arrow_type(key_type), to_arrow_type(item_type)), schema))
    if not parts:
        parts = [index.mapInArrow(_searched(Windows([], []), [], to_arrow_type(key_type), to_arrow_type(item_type)), schema)]
    if len(parts) == 1:
        return parts[0].select("key", "n_words", "spans", "items")
    every = reduce(DataFrame.unionByName, parts).groupBy("segment", "place").agg(
        F.first("key").alias("key"), F.first("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # one entry per block and document
    return every.select("key", "n_words", merged("spans").alias("spans"), "items")


def merged(spans: str) -> Column:
    """Sorted word ranges without overlap."""
    def add(held: Column, s: Column) -> Column:
        last = F.element_at(held, -1)
        joined = F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.struct(
            last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))))
        return F.when((F.size(held) > 0) & (s["first"] <= F.try_element_at(held, F.lit(-1))["last"]), joined).otherwise(
            F.concat(held, F.array(s)))

    return F.aggregate(spans, F.slice(F.col(spans), 1, 0), add)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
            item_text: str = "text", length: int = WINDOW, slack: int = 2) -> DataFrame:
    """(key, item, kind, first, last): every occurrence of every window, exact (``phrase``) or with each word
    within ``slack`` places of where it belongs (``proximity``); ``last`` is exclusive."""
    from pyspark.sql.pandas.types import to_arrow_type

    if slack + length >= GAP:
        raise ValueError(f"window and slack must stay below {GAP} words")
    index = build_index(docs, key, text, _vocabulary(benchmark, item_text))
    key_type, item_type = docs.schema[key].dataType, benchmark.schema[item].dataType
    schema = MATCHES.format(key=key_type.simpleString(), item=item_type.simpleString())
    parts = [docs.sparkSession.createDataFrame([], schema)]
    for block in blocks(benchmark, item, item_text):
        asked, orders = _asked(index, block, length)
        parts.append(index.mapInArrow(
            _near(asked, orders, slack, to_arrow_type(key_type), to_arrow_type(item_type)), schema))
    return reduce(DataFrame.unionByName, parts)


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, all columns kept.

    Rows are told apart by their texts, so of rows that share a key, or have none, each is judged on its own.
    """
    def digest(column: Column) -> Column:
        return F.md5(whole(column).cast("binary"))

    texts = docs.select(digest(F.col(text)).alias("digest"), F.col(text).alias("text"))
    hit = contamination(texts, benchmark, "digest", "text").filter(F.size("spans") > 0)
    found = hit.select(F.col("key").alias("hit_digest")).distinct()
    return docs.join(found, digest(docs[text]) == found["hit_digest"], "left_anti")
