import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import near_copies, simhash


def plain_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    sets = [plain_sets(t) for _, t in rows]
    label = {key: key for key, _ in rows}
    pairs = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i)
             if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def corpus(seed):
    """Texts with copies of one to many changed words, a passage that half of them quote, and short ones."""
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for _ in range(25):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([6, 12, 40, 90, 150]))]
        base += passage * rnd.randrange(2)
        for _ in range(rnd.randrange(1, 7)):
            own = list(base)
            for _ in range(rnd.randrange(5)):
                at = rnd.randrange(len(own))
                own[at:at + rnd.randrange(2)] = [f"x{rnd.randrange(10**6)}"]
            base = own if rnd.random() < 0.5 else base  # chains as well as stars
            texts.append(" ".join(own))
    texts += ["a b", "A  b", "a b c d", "a b c d e", "", " \n", None] + [" ".join(passage)] * 2
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_one_changed_word_is_a_near_copy(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(20):
        words = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        changed = list(words)
        changed[rnd.randrange(120)] = "other"
        rows += [(2 * i, " ".join(words), "a"), (2 * i + 1, " ".join(changed), "b")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))


@pytest.mark.parametrize("seed,sample", [(1, 20_000), (2, 0), (3, 30)])
def test_groups_are_those_of_all_pairs(spark, seed, sample):
    """Whatever the sample that orders the shingles knows."""
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.key: r.component for r in near_copies.copy_groups(docs, sample=sample).collect()}
    want = plain_groups(rows)
    assert got == want and 20 < len(set(want.values())) < len(rows) - 20


def test_similarity_at_the_border():
    a = np.arange(9, dtype=np.uint64)
    assert near_copies.similar(a, np.append(a[:8], np.uint64(90)))  # 8 of 10
    assert not near_copies.similar(a[:8], np.append(a[:7], np.uint64(90)))  # 7 of 9
    assert not near_copies.similar(a, np.arange(100, 109, dtype=np.uint64))


def test_pipeline_drops_near_copies(spark):
    """The stages up to the near copies on the smallest tables; the last against all pairs of its input."""
    now = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        now = stage(spark, now, "/root/testdata/sf0.001")
    docs = sorted((r.doc_id, r.text) for r in now.collect())
    want = [key for key, own in plain_groups(docs).items() if key == own]
    got = sorted(r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, now, "/root/testdata/sf0.001").collect())
    assert got == want and len(want) < len(docs)


def test_rows_of_one_key_and_of_none_are_told_apart(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    schema = "doc_id long, text string, digest string, root string"

    def kept(*rows):
        return sorted((tuple(r)[:2] for r in simhash.near_dedup(spark.createDataFrame([(*r, "d", "r") for r in rows], schema)).collect()), key=repr)

    assert kept((1, a), (1, b)) == [(1, a), (1, b)]
    assert kept((0, b), (1, a), (1, b)) == [(0, b), (1, a)]
    assert kept((None, a), (None, b), (None, b)) == [(None, a), (None, b)]
    assert kept((1, a), (1, a), (2, a.upper())) == [(1, a)]
    assert kept((3, None), (3, ""), (2, " ")) == [(2, " ")]


def test_texts_of_one_template_make_no_pairs(spark, monkeypatch):
    """81 of 96 shingles in common: not similar, and never all met pair by pair."""
    made = []
    pairs = near_copies._pairs
    monkeypatch.setattr(near_copies, "_pairs", lambda open_: made.append(pairs(open_)) or made[-1])
    frame = [" ".join(f"t{i}" for i in range(85))]
    counts = []
    for n in (100, 200):
        made.clear()
        texts = [(i, frame[0] + " " + " ".join(f"x{i}-{j}" for j in range(15))) for i in range(n)]
        groups = near_copies.copy_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert all(r["key"] == r["component"] for r in groups)
        counts.append(sum(m.count() for m in made))
    assert counts[1] <= 2 * counts[0] + 200


def test_candidates_come_from_fingerprints_first(spark, monkeypatch):
    """Copies a word apart in long texts have near fingerprints; the exact check drops pairs that are only near."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(6):
        text = [f"w{x}" for x in rng.integers(0, 500, 900)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:-1], "other"]))]
    asked, pairs = [], simhash.print_pairs
    monkeypatch.setattr(simhash, "print_pairs", lambda prints: asked.append(pairs(prints)) or asked[-1])
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 12, 2))
    near = {frozenset(p) for p in asked[0].collect()}
    nodes = [near_copies.node(near_copies.shingles(t.encode())) for _, t in rows]
    assert sum(frozenset(nodes[i:i + 2]) in near for i in range(0, 12, 2)) >= 3


def test_parities_and_fingerprints_of_sets():
    rng = np.random.default_rng(9)
    for n in (0, 1, 9, 400):
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        other = np.unique(np.append(own[n // 5:], rng.integers(0, 1 << 63, n // 5).astype(np.uint64)))
        apart = sum(int(a ^ b).bit_count() for a, b in zip(near_copies.parity(own), near_copies.parity(other)))
        assert apart <= len(np.setxor1d(own, other))
        bits = [2 * sum(int(h) >> b & 1 for h in own) > n for b in range(64)]
        assert (near_copies.simhash(own) & (1 << 64) - 1).bit_count() == sum(bits)


def test_shingles_of_the_same_texts_meet_once_and_narrow_ones_are_done(spark, monkeypatch):
    """A passage in common makes pairs once and not for each of its shingles; the next turn reads the wide shingles only."""
    read, made = [], []
    open_, pairs = near_copies._open, near_copies._pairs
    monkeypatch.setattr(near_copies, "LINEAR", 4)
    monkeypatch.setattr(near_copies, "_open", lambda shared, roots: read.append(shared.count()) or open_(shared, roots))
    monkeypatch.setattr(near_copies, "_pairs", lambda rows: made.append(pairs(rows)) or made[-1])
    # groups of four texts that have 71 of 96 shingles in common, of similarity 0.59; one of 40 texts
    texts = []
    for g, n in [(g, 4) for g in range(30)] + [(99, 40)]:
        texts += [" ".join([f"g{g}-{i}" for i in range(75)] + [f"x{g}-{t}-{i}" for i in range(25)]) for t in range(n)]
    # parities that are wrong on purpose: all pairs of one shingle come out
    monkeypatch.setattr(near_copies, "FEW", "true")
    groups = near_copies.copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sample=0).collect()
    assert all(r["key"] == r["component"] for r in groups)
    assert len(read) > 1 and read[1] < read[0] / 2
    rows = sum(m.count() for m in made)
    assert rows <= 3 * (30 * 6 + 40 * 39 // 2)
