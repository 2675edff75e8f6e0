import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm.exact_dedup import exact_dedup, exact_groups, frequent, shrink


def plain(rows):
    """(key, keep_key, size, kept) by the definition."""
    by = defaultdict(list)
    for key, text in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((key, text or ""))
    out = []
    for group in by.values():
        keep = min(group, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(key, keep, len(group), key == keep) for key, _ in group]
    return sorted(out, key=repr)


@settings(deadline=None)
@given(st.lists(st.sampled_from("aaaaabbbcdefgh"), max_size=200), st.integers(1, 6), st.integers(1, 5))
def test_summary_keeps_every_frequent_key(keys, k, parts):
    merged = Counter()
    for i in range(parts):
        held = {}
        for key in keys[i::parts]:
            held[key] = held.get(key, 0) + 1
            held = shrink(held, k)
        merged.update(held)
    merged = shrink(dict(merged), k)
    assert len(merged) <= k
    assert {key for key, n in Counter(keys).items() if n > len(keys) / (k + 1)} <= set(merged)


@pytest.mark.parametrize("k", [2, 1024])
def test_like_the_definition(odd, k):
    got = exact_groups(odd, k=k)
    assert sorted(((r.key, r.keep_key, r.group_size, r.kept) for r in got.collect()), key=repr) == plain(
        [(r.doc_id, r.text) for r in odd.collect()])


def test_digest_is_of_the_text_without_white_space(odd):
    got = {r.key: bytes(r.digest).hex() for r in exact_groups(odd).collect()}
    assert got[2] == hashlib.sha256(b"Alphabetagamma").hexdigest() and got[3] == got[4] == got[5] == hashlib.sha256(b"").hexdigest()


def test_hot_text(spark):
    rows = [(i, f"t{i // 400}" if i < 800 else f"x{i // 2}") for i in range(1200)]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=4)
    assert sorted(((r.key, r.keep_key, r.group_size, r.kept) for r in got.collect()), key=repr) == plain(rows)


def test_candidates_are_bounded(spark, odd):
    digests = exact_groups(odd).select("digest")
    assert frequent(digests, 2).count() <= 2


def test_rows_that_stay_keep_their_columns(odd):
    kept = exact_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7, 8]  # the repeated row 6 once
    assert {r.text for r in kept.filter("doc_id = 2").collect()} == {"Alpha  beta\ngamma"}


def test_empty(empty):
    assert exact_groups(empty).count() == 0 and exact_dedup(empty).count() == 0
