"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.texts import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of its text that stays."""
    from tagloom.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op1_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT text_sha256, count(*) AS group_size,
             arg_min(doc_id, (-length(text), doc_id)) AS keep_id FROM d GROUP BY text_sha256)
SELECT d.doc_id, w.keep_id, w.group_size, d.doc_id = w.keep_id AS kept, d.text_sha256
FROM d JOIN w USING (text_sha256)
"""


@query
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component of near copies."""
    from tagloom.llm.simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside benchmark passages."""
    from tagloom.llm.decontam import contamination, n_hit

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col("key").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE["op10_decontamination"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
occ AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
m AS (SELECT DISTINCT doc_id, i, n, item_id FROM occ JOIN win USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    from tagloom.llm.packing import pack
    from tagloom.llm.tokens import public_path

    return pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json")).select(
        F.col("key").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        "sequence_id", "offset")


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as its ids stand in the written files."""
    from tagloom.llm.token_files import written
    from tagloom.llm.tokens import public_path

    return written(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json")).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licenses that its text names or quotes."""
    from tagloom.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    from tagloom.llm.language import fit, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, ~held_out(F.col("doc_id"))))
    return found.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with how likely its text is of good quality."""
    from tagloom.llm.quality import fit, scored

    model, measured = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return scored(measured, model).select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the personal data in its text."""
    from tagloom.llm.pii import KINDS, find, fit

    docs = table(spark, sf_dir, "documents")

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(docs, fit(docs)).select(
        F.col("key").alias("doc_id"), *map(number, KINDS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"))


@query
def op3_chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in reply order, quotes taken out."""
    from tagloom.llm.quotes import threads

    return threads(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


@query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark's texts, and its rank among those that are drawn."""
    from tagloom.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLE["op11_resampling"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS f
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS n))),
bf AS (SELECT array_to_string(w[i:i + n - 1], ' ') AS f
       FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, (SELECT unnest([1, 2, 3]) AS n))),
tbl AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce(
    range(0, 8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
bytes AS (SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i:
              16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS x
          FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf))),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(x, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k
           FROM bytes, tbl),
dk AS (SELECT doc_id, k FROM df JOIN hashed USING (f)),
sn AS (SELECT k, count(*) AS s FROM dk GROUP BY k),
tn AS (SELECT k, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY k),
al AS (SELECT (SELECT coalesce(sum(s), 0) FROM sn)::DOUBLE AS alls, (SELECT coalesce(sum(t), 0) FROM tn)::DOUBLE AS allt),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (alls + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (allt + 10000))))::BIGINT AS gain
      FROM sn FULL JOIN tn USING (k), al),
wt AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dk JOIN g USING (k) GROUP BY doc_id),
sc AS (SELECT doc_id, len(w) AS n, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
              coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                                 / 4294967296.0::DOUBLE)))::BIGINT AS score
       FROM d LEFT JOIN wt USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM r) THEN rank END AS rank
FROM sc LEFT JOIN r USING (doc_id)
"""


@query
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL with the rule that fits it, and its verdict."""
    from tagloom.llm.url_filter import filtered

    return filtered(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


def _url_rates() -> str:
    """The smoothed rates of all grams, from no context to two characters of it."""
    parts = ["r AS (SELECT gram, 1 / 32.0::DOUBLE AS ra, 1 / 32.0::DOUBLE AS rr FROM cells)"]
    for k in range(3):
        size, least = 32 ** (k + 1), 4 if k else 0
        parts.append(f"""
r{k} AS (SELECT r.gram, CASE WHEN c.a >= {least} THEN (s.a + 5 * ra) / (c.a + 5) ELSE ra END AS ra,
                CASE WHEN c.r >= {least} THEN (s.r + 5 * rr) / (c.r + 5) ELSE rr END AS rr
         FROM {'r' if not k else f'r{k - 1}'} r
         JOIN (SELECT gram % {size} AS x, sum(a) AS a, sum(r) AS r FROM cells GROUP BY 1) s ON s.x = r.gram % {size}
         JOIN (SELECT (gram % {size}) // 32 AS x, sum(a) AS a, sum(r) AS r FROM cells GROUP BY 1) c ON c.x = (r.gram % {size}) // 32)""")
    return ",".join(parts)


ORACLE["op12_url_filter"] = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS (SELECT *, row_number() OVER () AS id, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM u),
x AS MATERIALIZED (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said,
             substr(md5(host || path), 4, 1) IN ('0', '4', '8', 'c') AS held,
             list_transform(list_filter(string_split(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
                                        lambda c: c <> ''),
               lambda c: CASE WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 96 WHEN c BETWEEN '0' AND '9' THEN 27 WHEN c = '.' THEN 28
                       WHEN c = '/' THEN 29 WHEN c = '-' THEN 30 ELSE 31 END) AS c FROM v),
gr AS MATERIALIZED (SELECT id, said, held, c[i] + 32 * CASE WHEN i > 1 THEN c[i - 1] ELSE 0 END + 1024 * CASE WHEN i > 2 THEN c[i - 2] ELSE 0 END AS gram
       FROM (SELECT id, said, held, c, unnest(range(1, len(c) + 1)) AS i FROM x)),
n AS (SELECT gram, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS r FROM gr
      WHERE said IS NOT NULL AND NOT held GROUP BY gram),
cells AS MATERIALIZED (SELECT t.gram, coalesce(a, 0) AS a, coalesce(r, 0) AS r FROM (SELECT unnest(range(0, 32768)) AS gram) t LEFT JOIN n USING (gram)),
{_url_rates()},
m AS (SELECT gram, floor(1000 * ln(ra / rr))::BIGINT AS weight FROM r2),
s AS MATERIALIZED (SELECT x.id, floor(t.w / len(c)::DOUBLE)::BIGINT AS score FROM x
      JOIN (SELECT id, sum(weight) AS w FROM gr JOIN m USING (gram) GROUP BY id) t USING (id)),
h AS (SELECT score, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS r FROM x JOIN s USING (id)
      WHERE said IS NOT NULL AND held GROUP BY score),
e AS (SELECT score, coalesce(sum(a) OVER w, 0) * sum(r) OVER () + (sum(r) OVER () - coalesce(sum(r) OVER w, 0)) * sum(a) OVER () AS errors,
             coalesce(floor((lag(score) OVER (ORDER BY score) + score + 1) / 2.0)::BIGINT, score) AS edge
      FROM h WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
least AS (SELECT arg_min(edge, (errors, score)) AS threshold FROM e)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score < threshold THEN 'block' ELSE 'allow' END) AS verdict, score
FROM x LEFT JOIN s USING (id), least
"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound vector with its code and error, and the digest of the codebooks."""
    from tagloom.llm.vector_codes import compress

    rows, books = compress(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("key").alias("vec_id"), "code", "error", "label_error",
                       F.lit(books.digest if books else None).cast("string").alias("codebooks_sha256"))


def _book_rounds() -> str:
    """Assignment and new codebooks, six times."""
    near = """a{r} AS (SELECT q.id, q.p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
         SELECT q.id, q.p, b.e, list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
         FROM q JOIN b{r} b USING (p)) q GROUP BY q.id, q.p)"""
    mean = """b{n} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (
         SELECT p, e, list(x ORDER BY j) AS v FROM (
           SELECT p, e, j, floor(sum(q.v[j])::DOUBLE / count(*))::BIGINT AS x
           FROM (SELECT q.p, a.e, q.v, unnest(range(1, len(q.v) + 1)) AS j FROM q JOIN a{r} a USING (id, p)) q GROUP BY p, e, j)
         GROUP BY p, e) m USING (p, e))"""
    return ",\n".join(text.format(r=r, n=r + 1) for r in range(6) for text in (near, mean)) + ",\n" + near.format(r=6)


ORACLE["op13_vector_codes"] = f"""
WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id,
                  list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT id, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS v FROM k, (SELECT unnest(range(0, 8)) AS p)),
b0 AS (SELECT p, id - 1 AS e, v FROM q WHERE id <= 16),
{_book_rounds()},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6),
c AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a6 GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN c USING (id), books
"""
