import re

import numpy as np
import pytest
import xxhash

from tagloom.llm import simhash
from tagloom.llm.components import components


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    """Smallest index reachable by steps of two bits."""
    label = list(range(len(values)))
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    moved = True
    while moved:
        moved = False
        for i, j in pairs:
            low = min(label[i], label[j])
            moved |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def cloud(rng, centres, copies, bits):
    out = []
    for _ in range(centres):
        c = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(copies):
            v = c
            for b in rng.choice(64, rng.integers(0, bits + 1), replace=False):
                v ^= 1 << int(b)
            out.append(v)
    return out


@pytest.mark.parametrize("text", ["", None, "a", "A b", "a b c", "a b c d", "The the THE the the", "É é\x0bx\x0cy z w"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_print(text)


def test_planes_hold_the_bits():
    values = np.random.default_rng(1).integers(0, 1 << 62, 100, dtype=np.uint64)
    sliced = simhash.planes(values)
    for p in (0, 5, 61):
        assert [int(sliced[p, i // 64] >> np.uint64(i % 64)) & 1 for i in range(100)] == [int(v) >> p & 1 for v in values]


@pytest.mark.parametrize("sizes", [(40, 6, 3), (1, 300, 3), (3, 90, 4)])
def test_spanning_links(sizes):
    rng = np.random.default_rng(sum(sizes))
    values = np.array(sorted(set(cloud(rng, *sizes))), np.uint64)
    a, b = simhash.spanning(np.zeros(len(values), np.int64), values)
    at = {int(v): i for i, v in enumerate(values)}
    label = list(range(len(values)))
    for x, y in zip(a.tolist(), b.tolist()):
        assert (x ^ y).bit_count() <= 64
        label[at[x]] = at[y]
    for i in range(len(label)):
        while label[i] != label[label[i]]:
            label[i] = label[label[i]]
    want = plain_components([int(v) for v in values])
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


@pytest.mark.parametrize("bucket", [3, 512])
def test_links_of_all_prints(spark, bucket):
    """A small bucket bound takes the refined way; both link the same."""
    rng = np.random.default_rng(7)
    values = [v - (1 << 64) if v >= 1 << 63 else v for v in sorted(set(cloud(rng, 30, 12, 3) + cloud(rng, 1, 150, 4)))]
    links = simhash.print_links(spark.createDataFrame([(v,) for v in values], "print long"), bucket)
    roots = {r.node: r.root for r in components(links).collect()}
    got = [roots.get(v, v) for v in values]
    want = plain_components([v % (1 << 64) for v in values])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (2000, 1999), (1999, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1100)} | {1999: 1999, 2000: 1999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, empty):
    got = simhash.near_groups(odd)
    assert sorted(((r.key, r.component) for r in got.collect()), key=repr) == sorted(
        [(1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 3), (6, 6), (6, 6), (7, 7), (8, 8)], key=repr)
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 8]
    assert simhash.near_groups(empty).count() == 0 and simhash.near_dedup(empty).count() == 0
