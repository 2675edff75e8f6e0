import random

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm import language, quality
from tagloom.llm.texts import held_out

WORDS = {"aa": "the and of hing ther with was not", "bb": "der und die nicht ein schen ung zu", "cc": "le que les des eau tion ment pour"}


def corpus(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        rows.append((i, " ".join(rnd.choice(WORDS[lang].split()) for _ in range(rnd.randint(5, 60))), lang))
    return rows


def test_language(spark, odd, empty):
    docs = spark.createDataFrame(corpus(600), "doc_id long, text string, lang string")
    model = language.fit(docs, ~held_out(F.col("doc_id")))
    got = language.identify(docs, model).join(docs.withColumnRenamed("doc_id", "key"), "key").filter(held_out(F.col("key"))).collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got)
    assert not any(r.rejected for r in got) and all(0 <= r.score <= 1 for r in got)
    strange = spark.createDataFrame([(1, "щука жужжит вьюга " * 20), (2, None), (3, "123 !?"), (4, "")], "doc_id long, text string")
    assert {r.key: (r.lang_pred == "und", r.rejected) for r in language.identify(strange, model).collect()} == {
        1: (False, True), 2: (True, True), 3: (True, True), 4: (True, True)}
    kept = language.accepted(odd, model)
    assert kept.columns == odd.columns and not {3, 4, 5, 8} & {r.doc_id for r in kept.collect()}
    assert language.identify(empty, model).count() == 0 and language.accepted(empty, model).count() == 0


def test_language_without_labels(odd, empty):
    model = language.fit(empty, ~held_out(F.col("doc_id")))
    assert {(r.lang_pred, r.score) for r in language.identify(odd, model).collect()} == {("und", 0.0)}
    assert {r.doc_id for r in language.accepted(odd, model).collect()} == {None, 1, 2, 6, 7}


def test_more_than_64_languages_are_learned(spark):
    rnd = random.Random(2)
    stems = {f"l{i:02}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for i in range(70)}
    rows = [(i, " ".join(rnd.choice(stems[lang]) for _ in range(40)), lang) for i, lang in enumerate(sorted(stems) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, ~held_out(F.col("doc_id")))
    assert set(model.languages) == set(stems) and len(model.centroids) <= language.CLUSTERS * language.FULL
    got = {r.key: r for r in language.identify(docs, model).collect()}
    assert sum(got[key].lang_pred == lang for key, _, lang in rows) > 0.98 * len(rows)
    assert sum(r.rejected for r in got.values()) < 0.02 * len(rows)


def test_few_texts_and_short_texts_have_floors():
    few = language.bounds(np.full(5, 0.6), np.full(5, 8))
    assert np.allclose(few[8:], 0.48) and np.allclose(few[6], 0.24) and (few > 0).all()
    rows = language.bounds(np.array([0.2] + [0.7] * 20), np.array([5] + [8] * 20))
    assert np.isclose(rows[8], 0.58) and np.isclose(rows[5], 0.08) and rows[7] > 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame(corpus(300), "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), sample=20)
    assert sorted(set(model.languages)) == sorted(WORDS) and len(model.centroids) <= 3 * language.CLUSTERS


def test_n_grams_see_letters_only():
    assert (language.counts("Ab, ab") == language.counts("ab ab")).all()
    assert (language.counts("é1é") == language.counts("É É")).all()
    assert language.counts("").sum() >= 0


def test_quality(spark, odd, empty):
    rnd = random.Random(4)
    rows = corpus(800, 9)
    bad = {i for i, *_ in rows if rnd.random() < 0.3}
    texts = [(i, t if i not in bad else "".join(w.upper() + rnd.choice("#$%") * 3 + " | " for w in t.split()), lang) for i, t, lang in rows]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    model, measured = quality.fit(docs, labels, ~held_out(F.col("doc_id")))
    got = quality.scored(measured, model).filter(held_out(F.col("key"))).collect()
    assert {(r.key, r.score) for r in quality.score(docs, model).filter(held_out(F.col("key"))).collect()} == {(r.key, r.score) for r in got}
    assert sum((r.score >= 0.7) == (r.key not in bad) for r in got) > 0.98 * len(got)
    scores = quality.score(odd, model).collect()
    assert len(scores) == 10 and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if r.key in (3, 4)}) == 1
    assert quality.score(empty, model).count() == 0


def test_quality_without_labels(odd):
    none = odd.sparkSession.createDataFrame([], "doc_id long, quality int")
    model, _ = quality.fit(odd, none, ~held_out(F.col("doc_id")))
    assert {r.score for r in quality.score(odd, model).collect()} == {0.5}


def test_whole_text_is_measured():
    good, bad = b"the and of hing " * 200, b"### $$$ %%% ||| " * 200
    front, back = b"the and of hing " * 400, b"### $$$ %%% ||| " * 400
    only, both = quality.measure(front, good, bad), quality.measure(front + back, good, bad)
    assert only[0] > both[0] and abs(both[0]) < only[0]
    assert np.allclose(quality.measure(b"", good, bad), (0, 1, 0))
