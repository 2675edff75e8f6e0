import re

import pytest

from tagloom.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(text, items):
    w, hit, found = words(text), set(), set()
    for item, other in items:
        v = words(other)
        for i in range(max(1, len(v) - 9) if v else 0):
            window = v[i:i + 10]
            for j in range(len(w) - len(window) + 1):
                if w[j:j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found.add(item)
    return len(w), sorted(hit), sorted(found)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Alpha, beta"), (3, None), (4, ""),
         (5, "word " * 11), (2, "Alpha, beta"), (6, "alpha beta"), (7, "three four five six seven eight nine ten eleven twelve")]
TEXTS = ["zero one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven",
         "ALPHA-BETA alpha gamma beta", "x alpha  beta y alpha beta", "word " * 30, "ten eleven twelve", "",
         "one two three four five six seven eight nine ten eleven twelve one two three"]


def covered(r):
    return sorted({i for s in r.spans for i in range(s.first, s.last)})


@pytest.mark.parametrize("segment,block", [(100_000, 1 << 25), (20, 60)])
def test_like_the_definition(spark, odd, monkeypatch, segment, block):
    """Also with many segments, and with a benchmark of several blocks."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam.blocks, "__defaults__", (block,))
    monkeypatch.setattr(decontam.build_index, "__defaults__", ("doc_id", "text", None, segment))
    docs = spark.createDataFrame(list(enumerate(TEXTS, 100)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contamination(docs, bench)
    rows = sorted(((r.key, r.n_words, covered(r), sorted(r.items)) for r in got.collect()), key=repr)
    assert rows == sorted(((r.doc_id, *plain(r.text, ITEMS)) for r in docs.collect()), key=repr)


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha the beta"), (3, "beta x y z alpha"), (4, "beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "alpha beta")], "item_id long, text string")
    got = sorted((r.key, r.kind, r.first) for r in decontam.matches(docs, bench, slack=1).collect())
    assert got == [(1, "phrase", 0), (2, "proximity", 0)]


def test_index_of_every_word(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string").coalesce(1)
    counts = {bytes(r.term).decode(): r.n for r in decontam.term_counts(decontam.build_index(docs)).collect()}
    assert counts == {"a": 2, "b": 2, "c": 1}


def test_clean_keeps_columns(spark, odd, empty):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    kept = decontam.clean(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 6, 7, 8]
    assert decontam.clean(empty, bench).count() == 0
    assert decontam.clean(odd, bench.filter("1 = 0")).count() == odd.count()


def test_clean_rows_of_one_key_and_of_none_stay(spark):
    item = "a b c d e f g h i j k l"
    rows = [(1, item), (1, "clean text"), (None, item), (None, "other clean"), (2, None)]
    docs = spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, hit_digest string")
    kept = decontam.clean(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == [(1, "clean text"), (2, None), (None, "other clean")]
