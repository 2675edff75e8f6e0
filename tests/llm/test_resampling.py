import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import resampling
from tagloom.llm.texts import LOWER, UPPER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def features(text):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5, least=20, buckets=10_000):
    """(key, n_words, n_features, weight, score, rank) of every document, one by one."""
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, text in docs for f in features(text))
    t = Counter(bucket(f) for text in target for f in features(text))
    big_s, big_t = s.total(), t.total()
    rows = []
    for key, text in docs:
        own = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, own))
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(words(text)), len(own), weight,
                     weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(able[:len(able) * percent // 100])}
    return [(*r, rank.get(id(r))) for r in rows]


def got(frame):
    return [tuple(r) for r in frame.select("key", "n_words", "n_features", "weight", "score", "rank").collect()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .é漢\n\x00z", max_size=60), max_size=6), st.integers(1, 4))
def test_features_are_those_of_plain_words(texts, length):
    found = resampling.Features(pa.array(texts, pa.string()), 997, length)
    for row, text in enumerate(texts):
        w = words(text)
        own = [" ".join(w[i:i + n]) for n in range(1, length + 1) for i in range(len(w) - n + 1)]
        buckets = np.concatenate([b[r == row] for b, r in found.places]) if found.places else []
        assert sorted(buckets.tolist()) == sorted(zlib.crc32(f.encode()) % 997 for f in own)
        assert found.n_words[row] == len(w) and found.n_features()[row] == len(own)


def test_checksums_of_long_words():
    raw = [b" " + b"x" * n for n in (0, 1, 62, 63, 64, 65, 500)]
    heads = [b"", b"head", b"\xff" * 90]
    head = np.array([zlib.crc32(h) for h in heads for _ in raw], np.uint32)
    tail = np.array([zlib.crc32(r) for r in raw], np.uint32)
    at = np.tile(np.arange(len(raw)), len(heads))
    assert resampling.appended(head, tail, at, raw).tolist() == [zlib.crc32(h + r) for h in heads for r in raw]


def test_slices_cover_all_texts():
    texts = pa.array(["a" * 10, "", "b" * 25, "c" * 5, "d" * 5])
    assert list(resampling.slices(texts, 12)) == [(0, 2), (2, 1), (3, 2)]
    assert list(resampling.slices(pa.array([], pa.string()), 12)) == []


def test_draw_is_that_of_a_plain_version(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 90)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(5, docs[5][1])] * 3 + [(2000, None), (2001, "")]
    target = [" ".join(rng.choice(vocabulary[:40], 80)) for _ in range(9)] + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(got(found), key=repr) == sorted(plain(docs, target), key=repr)
    assert resampling.drawn(frame, spark.createDataFrame([(t,) for t in target], "text string")).count() == sum(
        r[5] is not None for r in plain(docs, target))


def test_odd_rows_and_empty_tables(odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(got(resampling.resample(odd, odd, percent=100)), key=repr) == sorted(
        plain(docs, [t for _, t in docs], percent=100), key=repr)
    assert sorted(got(resampling.resample(odd, empty)), key=repr) == sorted(plain(docs, []), key=repr)
    assert got(resampling.resample(empty, odd)) == []


@pytest.mark.parametrize("partitions", [1, 5])
def test_ranks_are_one_sequence(spark, partitions):
    rows = spark.range(2000).selectExpr("id AS key", "id % 17 AS score").repartition(partitions)
    found = [(r["rank"], -r["score"], r["key"]) for r in resampling.ranked(rows).collect()]
    assert [r[0] for r in sorted(found)] == list(range(1, 2001))
    assert sorted(found) == sorted(found, key=lambda r: r[1:])
