"""Thin queries of the training-data operators: each applies one operator to its whole table and returns a digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, language_id, line_templates, mpeg_audio, packing, pii, simhash, toxicity, url_filter, warc
from keyloom.llm._shared import key_fold, table

URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


PII_KEY = "a key is passed in by whoever runs the operator"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND d.payload_bytes >= 100
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.parse_rule(*r) for r in URL_RULES]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH rules(verdict, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT row_number() OVER () AS rn, page_id,
             CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rn, page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS authority FROM u),
s AS (SELECT rn, page_id,
             translate(authority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(authority) + 1), '^[^?#]*', 0) AS path FROM h),
m AS (SELECT s.rn, r.verdict, r.host || r.path AS rule,
             row_number() OVER (PARTITION BY s.rn ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC) AS k
      FROM s JOIN rules r ON (s.host = r.host OR s.host LIKE '%.' || r.host) AND starts_with(s.path, r.path))
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM s LEFT JOIN m ON m.rn = s.rn AND m.k = 1
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), key_fold(F.col("__id"), 5) != 0)
    out = toxicity.score(docs, net)
    return out.select("doc_id", (key_fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


OP7_SQL = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
dw AS (SELECT row_number() OVER () AS rn, doc_id,
              regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, fold),
bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, fold),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n,
               unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS s
        FROM bw WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT rn, n, unnest(range(1, len(w) - n + 2)) AS i,
                unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
         FROM dw, ns WHERE len(w) >= n),
hit AS (SELECT rn, dwin.n, i, item FROM dwin JOIN win ON win.n = dwin.n AND win.s = dwin.s),
words AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rn),
items AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rn, item FROM hit) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (rn) LEFT JOIN items USING (rn)
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, key_fold(F.col("doc_id"), 4) != 2)
    return out.select("doc_id", (key_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mpeg_audio.round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_url_filter": op3_url_filter,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_line_templates": op6_line_templates,
    "op7_decontaminate": op7_decontaminate,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_mpeg_audio": op10_mpeg_audio,
}
ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op3_url_filter": OP3_SQL,
    "op7_decontaminate": OP7_SQL,
}
