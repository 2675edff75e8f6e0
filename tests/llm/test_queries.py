"""The registered queries on the smallest tables: oracle SQL where there is some, plain versions of the pipeline's stages."""

import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_near_copies import plain_groups

from tagloom.llm import language, queries
from tagloom.llm.texts import held_out
from tagloom.llm.tokens import Encoder, public_path

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id bigint", "keep_id bigint", "group_size bigint", "kept boolean", "text_sha256 string"],
    "op2": ["doc_id bigint", "fingerprint string", "component_id bigint"],
    "op3": ["conv_id bigint", "turn bigint", "role string", "reply_to bigint", "thread bigint", "position bigint"],
    "op4": ["doc_id bigint", "piece int", "start bigint", "length bigint", "ids_crc32 bigint", "sequence_id bigint", "offset bigint"],
    "op5": ["doc_id bigint", "n_email bigint", "n_ip bigint", "n_card bigint", "n_phone bigint", "base_sha256 string", "spans string"],
    "op6": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
    "op7": ["doc_id bigint", "start bigint", "n_tokens bigint", "ids_crc32 bigint"],
    "op8": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
    "op9": ["doc_id bigint", "n_words bigint", "n_base bigint", "first_word bigint", "last_word bigint", "base_labels string",
            "labels string", "score double"],
    "op10": ["doc_id bigint", "n_words bigint", "n_hit bigint", "n_items bigint", "items_sha256 string", "contaminated boolean"],
    "op11": ["doc_id bigint", "n_features bigint", "weight bigint", "score bigint", "rank bigint"],
    "op12": ["page_id bigint", "host string", "path string", "rule string", "verdict string"],
    "op13": ["vec_id bigint", "code string", "error bigint", "label_error bigint", "codebooks_sha256 string"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, duck, name):
    frame = queries.QUERIES[name](spark, SMALL)
    found = [f"{c} {t}" for c, t in frame.dtypes]
    assert set(COLUMNS[name.split("_")[0]]) <= set(found)
    rows = frame.collect()
    table = "conversations" if name.startswith("op3") else "documents"
    n = duck.execute(f"select count(*) from {table}").fetchone()[0]
    assert len(rows) >= n if name.startswith("op4") else len(rows) == n
    if name in queries.ORACLE:
        result = duck.execute(queries.ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert sorted(tuple(r[names.index(c)] for c in frame.columns) for r in result.fetchall()) == sorted(map(tuple, rows))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def windows(text):
    w = words(text)
    return {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def held(docs, items):
    lengths = {len(w) for w in items}
    def hit(text):
        w = words(text)
        return any(tuple(w[i:i + n]) in items for n in lengths for i in range(len(w) - n + 1))
    return [d for d in docs if not hit(d[1])]


def distinct(docs):
    best = {}
    for key, text in docs:
        own = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best[own] = min(best.get(own, (key, text)), (key, text), key=lambda d: (-len(d[1] or ""), d[0]))
    return sorted(best.values())


def representatives(docs):
    """Of each group of near copies, five words and a similarity of 0.8, the one with the smallest id."""
    label = plain_groups(docs)
    return [d for d in docs if label[d[0]] == d[0]]


def test_pipeline_stage_by_stage(spark, duck):
    """Every stage against a plain version of it, fed with what the plain version before kept."""
    raw = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(raw, ~held_out(F.col("doc_id")))
    docs = sorted(duck.execute("select doc_id, text from documents").fetchall())
    items = set().union(*[windows(t) for _, t in duck.execute("select item_id, text from benchmark").fetchall()])
    plain = [
        [d for d in docs if not model.predict([d[1]])[0][2]],
    ]
    plain.append(distinct(plain[-1]))
    plain.append(representatives(plain[-1]))
    plain.append(held(plain[-1], items))
    now = raw
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:-1], plain):
        now = stage(spark, now, SMALL)
        assert now.columns == raw.columns
        assert sorted((r.doc_id, r.text) for r in now.collect()) == kept, name
    assert len(plain[-1]) < len(docs)
    packed = corpus_pipeline.run(spark, SMALL).collect()
    encoder = Encoder(public_path("byte_bpe_50k.json"))
    at = {}
    for r in packed:
        at.setdefault(r.doc_id, []).append(r)
    assert sorted(at) == [key for key, _ in plain[-1]]
    total, sequences = 0, {}
    for key, text in plain[-1]:
        ids = np.append(encoder.batch([text or ""])[0], 2).astype("<u4")
        total += len(ids)
        for r in sorted(at[key], key=lambda r: r.piece):
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sum(r.length for r in at[key]) == len(ids)
    for places in sequences.values():
        assert [a for a, _ in sorted(places)] == np.cumsum([0] + [n for _, n in sorted(places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 1024
    assert len(sequences) <= -(-total // 1024) + 2


def test_stages_take_an_empty_table(spark):
    now = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, now, SMALL).count() == 0
