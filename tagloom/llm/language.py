"""Language identification by nearest centroids.

A text is the vector of its letter n-grams (one to three code points of the lower-cased whole text), hashed to
``DIMENSIONS``, weighted by log term frequency and inverse document frequency, and normalised. Every language
has several centroids from spherical k-means, so a language may have several styles. The nearest centroid by
cosine names the language; a text that is further from it than any text of its length was in training is
rejected.

Every labelled language is learned. The model is fitted on a bounded sample: ``SAMPLE`` texts per language, fewer
texts and centroids each when there are more than ``FULL`` languages, chosen by a hash of the key, whole texts each;
their vectors are made by the tasks. All else covers every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.workers import task

DIMENSIONS = 4096
SAMPLE = 800  # texts per language
CLUSTERS = 4  # centroids per language
FULL = 64  # languages that get SAMPLE and CLUSTERS; more share the texts and centroids of so many
FEWEST = 20  # texts per language, however many share
PASSES = 10
MARGIN = 0.12  # of cosine, below the lowest seen in training
BIN_ROWS = 20  # texts of a length that make its lowest cosine a bound
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def counts(text: str) -> np.ndarray:
    """Hashed counts of the text's n-grams; runs of anything but letters count as one border."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.zeros(len(codes), bool)
    ascii_ = codes < 128
    letters[ascii_] = (codes[ascii_] >= 97) & (codes[ascii_] <= 122)
    other = np.flatnonzero(~ascii_)
    if len(other):
        distinct, back = np.unique(codes[other], return_inverse=True)
        letters[other] = np.array([chr(c).isalpha() for c in distinct.tolist()])[back]
    marked = np.where(letters, codes, np.uint32(1))
    border = ~letters
    kept = ~(border & np.concatenate([[True], border[:-1]])) if len(marked) else border
    a = np.concatenate([np.array([1], np.uint32), marked[kept], np.array([1], np.uint32)])
    one = a * MIX[0]
    two = (one[:-1] ^ (one[:-1] >> 15)) * MIX[1] + a[1:]
    two = two * MIX[0]
    three = (two[:-1] ^ (two[:-1] >> 15)) * MIX[2] + a[2:]
    three = three * MIX[0]
    bits = 32 - (DIMENSIONS.bit_length() - 1)
    grams = np.concatenate([one >> bits, two >> bits, three >> bits])
    return np.bincount(grams, minlength=DIMENSIONS).astype(np.float32)


def length_bin(n_grams: float) -> int:
    return int(np.log2(n_grams + 1))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # per centroid and length bin: the lowest cosine that is not rejected

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        v = np.log1p(raw) * self.idf
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        has = [t is not None and LETTER.search(t) is not None for t in texts]
        out = [(UNKNOWN, 0.0, not h) for h in has]
        at = [i for i, h in enumerate(has) if h]
        if not at or not self.languages:
            return out
        raw = np.stack([counts(texts[i]) for i in at])
        cosine = self.vectors(raw) @ self.centroids.T
        best = cosine.argmax(axis=1)
        for i, c, row, n in zip(at, best.tolist(), cosine, raw.sum(axis=1)):
            score = float(min(1.0, max(0.0, row[c])))
            out[i] = (self.languages[c], score, score < self.floors[c, min(length_bin(n), self.floors.shape[1] - 1)])
        return out


def k_means(v: np.ndarray, k: int, passes: int = PASSES, seed: int = 7) -> np.ndarray:
    """Spherical k-means; the seeds are spread by taking rows far from those taken."""
    rng = np.random.default_rng(seed)
    centres = [v[rng.integers(len(v))]]
    while len(centres) < min(k, len(v)):
        centres.append(v[int((np.stack(centres) @ v.T).max(axis=0).argmin())])
    c = np.stack(centres)
    for _ in range(passes):
        own = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                mean = v[own == j].mean(axis=0)
                c[j] = mean / max(1e-9, np.linalg.norm(mean))
    return c


def apart(v: np.ndarray) -> np.ndarray:
    """The cosine of each row to the mean of the others: few rows are near the centroids that they make."""
    rest = v.sum(axis=0) - v
    norm = np.linalg.norm(rest, axis=1)
    return (v * rest).sum(axis=1) / np.where(norm > 0, norm, 1)


def bounds(best: np.ndarray, bins: np.ndarray, n_bins: int = 40) -> np.ndarray:
    """Per length bin the lowest cosine that is not rejected, from the cosines of a language's sampled texts.

    A bin of ``BIN_ROWS`` texts has its own. Longer texts have the one of the next shorter such bin, as cosines
    grow with length; shorter texts have the one of the shortest such bin, less by the root of two for each halving
    of the length, and never more than a text of the bin has. Without such a bin all texts make one.
    """
    floors = np.zeros(n_bins)
    filled = [b for b in range(n_bins) if (bins == b).sum() >= BIN_ROWS]
    own = {b: max(0.0, float(best[bins == b].min()) - MARGIN) for b in filled}
    if not filled:
        filled = [int(bins.min())]
        own = {filled[0]: max(0.0, float(best.min()) - MARGIN)}
    for b in range(n_bins):
        if b < filled[0]:
            seen = bins == b
            floors[b] = own[filled[0]] * 0.5 ** ((filled[0] - b) / 2)
            if seen.any():
                floors[b] = min(floors[b], max(0.0, float(best[seen].min()) - MARGIN))
        else:
            floors[b] = own.get(b, floors[b - 1])
    return floors


@task
def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [counts(t) for t in batch.column(2).to_pylist()]
        used = [np.flatnonzero(r) for r in raw]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([u.astype("<u2").tobytes() for u in used], pa.binary()),
            pa.array([r[u].astype("<f4").tobytes() for r, u in zip(raw, used)], pa.binary()),
        ], ["lang", "h", "grams", "n"])


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
        sample: int = SAMPLE) -> Model:
    """A model from the rows where ``learn`` holds and language and text are not null.

    Two passes: one counts the languages (text is not read), one makes the vectors of the sampled rows, a
    share per language that gives ``sample`` rows, of which no more than that are used.
    """
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros((0, 40)))
    place = F.pmod(F.xxhash64(F.lit("language sample"), F.col(key)), F.lit(1 << 30))
    sample = min(sample, max(FEWEST, sample * FULL // len(sizes)))
    clusters = max(1, min(CLUSTERS, CLUSTERS * FULL // len(sizes)))
    shares = docs.sparkSession.createDataFrame(
        [(r["lang"], int(min(1.0, 1.3 * sample / r["n"]) * (1 << 30))) for r in sizes], "lang string, share long")
    chosen = rows.select(F.col(lang).alias("lang"), place.alias("h"), F.col(text).alias("text")).join(
        F.broadcast(shares), "lang").filter("h < share").select("lang", "h", "text")
    got = chosen.mapInArrow(_sparse, "lang string, h long, grams binary, n binary").collect()
    by: dict[str, list] = {}
    for row in sorted(got, key=lambda r: (r["lang"], r["h"], r["grams"])):
        if len(by.setdefault(row["lang"], [])) < sample:
            by[row["lang"]].append(row)
    n_texts = sum(map(len, by.values()))
    df = np.zeros(DIMENSIONS)
    for r in (r for rows_ in by.values() for r in rows_):
        df[np.frombuffer(r["grams"], "<u2")] += 1
    idf = np.log((1 + n_texts) / (1 + df)).astype(np.float32) + 0.1
    model = Model([], np.zeros((0, DIMENSIONS), np.float32), idf, np.zeros((0, 40)))
    for name, rows_ in sorted(by.items()):  # one language at a time is dense
        raw = np.zeros((len(rows_), DIMENSIONS), np.float32)
        for i, r in enumerate(rows_):
            raw[i, np.frombuffer(r["grams"], "<u2")] = np.frombuffer(r["n"], "<f4")
        v = model.vectors(raw)
        centres = k_means(v, clusters)
        bins = np.array([length_bin(n) for n in raw.sum(axis=1)])
        floors = np.repeat(bounds((v @ centres.T).max(axis=1) if len(v) >= BIN_ROWS else apart(v), bins)[None], len(centres), axis=0)
        model.languages += [name] * len(centres)
        model.centroids = np.concatenate([model.centroids, centres])
        model.floors = np.concatenate([model.floors, floors])
    return model


def _predicted(model: Model):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column(batch.schema.names.index("_text")).to_pylist())
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept]
                + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                   pa.array([f[2] for f in found], pa.bool_())],
                [batch.schema.names[i] for i in kept] + ["lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score (cosine to the nearest centroid), rejected.

    Null texts and texts without a letter are ``und`` and rejected, with score 0. A model that has learned no
    language calls every text ``und`` and rejects no other. Other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("_text")).mapInArrow(
        _predicted(model), f"key {kind}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns kept, in one pass."""
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    inner = docs.select(row.alias("row"), F.col(text).alias("_text"))
    flagged = inner.mapInArrow(
        _predicted(model), f"row {inner.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return flagged.filter(~F.col("rejected")).select(
        *[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(columns)])
