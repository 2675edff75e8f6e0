import hashlib
import math

import numpy as np
import pytest

from tagloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, key string, error string"


def plain(rows, parts=8, n_entries=16, rounds=6):
    """Code, error and label error per row, and the digest, with loops over vectors and entries."""
    sound = [(k, [math.floor(4096 * float(np.float32(x))) for x in v], label) for k, v, label in rows
             if v and all(x is not None and math.isfinite(x) for x in v)]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not sound:
        return [], None
    width = len(sound[0][1])
    sound = [r for r in sound if len(r[1]) == width]
    w = width // parts
    cut = [[v[p * w:p * w + w] for p in range(parts)] for _, v, _ in sound]
    books = [[list(c[p]) for c in cut[:n_entries]] for p in range(parts)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        held = [[nearest(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, h in zip(cut, held) if h[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    out = []
    for (key, _, label), c in zip(sound, cut):
        best = [nearest(c[p], p) for p in range(parts)]
        out.append((key, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), label))
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    return sorted(((k, c, e, total[label]) for k, c, e, label in out), key=repr), digest


def got(frame):
    return sorted((tuple(r) for r in frame.select("key", "code", "error", "label_error").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "k", "e") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(i, rng.normal(0, 0.3, 16).astype(np.float32).tolist(), None if i % 5 == 0 else i % 3) for i in range(200)]
    out += [(500 + i, out[9][1], 2) for i in range(90)] + [out[4], out[4], (None, out[6][1], None), (-1, out[8][1], 7)]
    out += [(900, None, 1), (901, [], 1), (902, [0.5] * 15 + [None], 1), (903, [float("nan")] * 16, 1),
            (904, [0.5] * 15 + [float("-inf")], 1), (905, [0.1] * 8, 1)]
    return out


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_codes_are_those_of_a_plain_version(spark, rows, block, monkeypatch):
    monkeypatch.setattr(vc.blocks, "__defaults__", (block,))
    found, books = vc.compress(frame(spark, rows).repartition(5))
    want, digest = plain(rows)
    assert got(found) == want and books.digest == digest


def test_labels_with_few_rows_are_joined(spark, rows, monkeypatch):
    monkeypatch.setattr(vc, "HEAVY", 2)
    assert got(vc.compress(frame(spark, rows))[0]) == plain(rows)[0]


def test_few_equal_and_no_vectors(spark, rows):
    for some in (rows[:3], [(i, [0.25] * 16, None) for i in range(20)]):
        found, books = vc.compress(frame(spark, some))
        assert (got(found), books.digest) == plain(some)
    for none in ([], [(1, None, 1)]):
        found, books = vc.compress(frame(spark, none))
        assert got(found) == [] and books is None


def test_huge_components_are_cut(spark):
    found, _ = vc.compress(frame(spark, [(i, [3e38 * (-1) ** i] * 8, 1) for i in range(20)] + [(99, [0.0] * 8, 1)]))
    assert all(0 <= e for _, _, e, _ in got(found)) and len(got(found)) == 21


def test_width_that_does_not_fit(spark):
    with pytest.raises(ValueError):
        vc.compress(frame(spark, [(1, [0.5] * 9, 1)]))


def test_decoded_vector_has_the_stated_error(spark, rows):
    found, books = vc.compress(frame(spark, rows))
    vectors = {r[0]: r[1] for r in rows}
    for r in found.filter("key BETWEEN 0 AND 30").collect():
        near = vc.decoded(r["code"], books)
        exact = [math.floor(4096 * x) for x in vectors[r["key"]]]
        assert sum((a - round(4096 * b)) ** 2 for a, b in zip(exact, near)) == r["error"]
