"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightline.llm import bytepairs, html, language, lm, merkle, near_dedup, neighbours, packing, pieces, quality, secrets, urls, variants
from flightline.llm.text import id_remainder, read_table
from flightline.plans.durable import durable

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# Fixed rules of the URL query.
URL_RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)


def packed(docs: DataFrame) -> DataFrame:
    """Digest columns instead of the ids, so that only narrow rows are numbered and moved."""
    cut = packing.token_pieces(docs, BYTE_BPE, public_tokenizers.PATTERN)
    stored = durable(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.assign_windows(stored, keep=["ids_crc32"])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(
        read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
        read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]),
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return neighbours.nearest(vectors, lambda vec_id: vec_id % 50 == 0, k=5)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    scored = lm.score_documents(docs, ~held_out)
    return scored.withColumn("held_out", F.coalesce(id_remainder(F.col("doc_id"), 5) == 1, F.lit(False)))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    both = pieces.decode_documents(pieces.encode_documents(docs, PIECE_BPE), PIECE_BPE)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages", ["page_id", "url"]), URL_RULES)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_text(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    learned = language.train(docs.filter(~held_out))
    asked = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language.identify(asked, learned).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    ids = bytepairs.encode_documents(docs, MULTI_BPE, public_tokenizers.PATTERN).drop("text")
    return bytepairs.decode_documents(ids, MULTI_BPE).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bytepairs.packed_ids(F.col("ids"), MULTI_BPE), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(read_table(spark, sf_dir, "documents", list(merkle.COLUMNS)))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_neighbours": op3_neighbours,
    "op4_lm": op4_lm,
    "op5_pieces": op5_pieces,
    "op6_urls": op6_urls,
    "op7_html": op7_html,
    "op8_secrets": op8_secrets,
    "op9_language": op9_language,
    "op10_near_dedup": op10_near_dedup,
    "op11_bpe": op11_bpe,
    "op12_variants": op12_variants,
    "op13_merkle": op13_merkle,
}

_OP6 = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT p.page_id, p.host, p.path,
       (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r
        WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
       coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r
        WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
        'allow') AS verdict
FROM parts p
"""

_OP3 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.size * c.size) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP10 = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE
    WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
      lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE []::VARCHAR[] END AS shingles
  FROM t),
e AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (
  SELECT a, b FROM p
  UNION
  SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles,
       least(s.doc_id, coalesce(c.least, s.doc_id)) AS component_id,
       s.doc_id <= coalesce(c.least, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.doc_id = c.doc_id
"""

# crc32 of a list of bytes, as 256 table entries and a fold.
_CRC = """
crc(t) AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(
  list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))
"""
_CRC_OF = """
xor(list_reduce(list_prepend(4294967295, {bytes}),
  lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)
"""

_OP12 = (
    "WITH RECURSIVE " + _CRC + """,
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
hashed AS (
  SELECT run, coalesce(""" + _CRC_OF.format(
        bytes="""flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x:
    CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [(192 + (ord(x) >> 6))::BIGINT, (128 + (ord(x) & 63))::BIGINT] END))"""
    ) + """, 1) AS h
  FROM runs JOIN crc ON true WHERE length(run) >= 7),
v AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0
      THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
less AS MATERIALIZED (
  SELECT word, n, gap, substr(word, 1, gap - 1) || substr(word, gap + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS gap FROM v)),
replaced AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n
  FROM less a JOIN less b ON a.gap = b.gap AND a.rest = b.rest AND a.word <> b.word),
shorter AS (SELECT DISTINCT l.word, l.n, v.word AS near, v.n AS near_n FROM less l JOIN v ON v.word = l.rest),
pairs AS MATERIALIZED (
  SELECT word, near, near_n FROM replaced
  UNION ALL SELECT word, near, near_n FROM shorter
  UNION ALL SELECT near, word, n FROM shorter),
best AS (
  SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place,
    count(*) OVER (PARTITION BY word) AS n_near
  FROM pairs),
named AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.near_n >= 10 * v.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 10 * v.n THEN b.near_n END AS form_n
  FROM v LEFT JOIN best b ON b.word = v.word AND b.place = 1),
follow(word, here, step) AS (
  SELECT word, form, 1 FROM named WHERE form IS NOT NULL
  UNION ALL
  SELECT f.word, n.form, f.step + 1 FROM follow f JOIN named n ON n.word = f.here AND n.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, step) AS root FROM follow GROUP BY word)
SELECT n.word, n.n, n.n_near, n.form, n.form_n, coalesce(e.root, n.word) AS root
FROM named n LEFT JOIN ends e ON e.word = n.word
"""
)

_OP13 = (
    "WITH RECURSIVE " + _CRC + """,
named AS (
  SELECT doc_id, source, text, coalesce('=' || source, '') AS k,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-')
    || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
    || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    coalesce(replace(text, chr(10), ''), '') AS bare,
    """ + _CRC_OF.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)") + """ % 2 = 0 AS bad
  FROM documents JOIN crc ON true),
leaves AS MATERIALIZED (
  SELECT doc_id, k, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS d,
    sha256(head || CASE WHEN text IS NULL THEN '-' WHEN bad THEN strlen(bare)::VARCHAR || ':' || bare
                   ELSE strlen(text)::VARCHAR || ':' || text END) AS changed,
    row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n
  FROM named),
nodes(k, lvl, pos, d, n) AS (
  SELECT k, 0, pos, d, n FROM leaves
  UNION ALL
  SELECT k, lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY k, lvl, pos // 3, n),
subroots AS (
  SELECT k, d, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, d, n) AS (
  SELECT 0, pos, d, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3
  FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n),
everything AS MATERIALIZED (
  SELECT k, lvl, pos, d, n FROM nodes UNION ALL SELECT NULL, lvl, pos, d, n FROM tops),
sides AS MATERIALIZED (
  SELECT a.k, a.lvl, a.pos,
    coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM everything a JOIN everything b
    ON a.k IS NOT DISTINCT FROM b.k AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.k, a.lvl, a.pos),
low(doc_id, k, lvl, pos, cur, proof) AS (
  SELECT doc_id, k, 0, pos, changed, '' FROM leaves
  UNION ALL
  SELECT w.doc_id, w.k, w.lvl + 1, w.pos // 3, sha256(s.l || w.cur || s.r), w.proof || s.l || s.r
  FROM low w JOIN sides s ON s.k = w.k AND s.lvl = w.lvl AND s.pos = w.pos),
joined AS (
  SELECT w.doc_id, s.d AS subroot, s.pos, w.cur, w.proof,
    row_number() OVER (PARTITION BY w.doc_id ORDER BY w.lvl DESC) AS last
  FROM low w JOIN subroots s ON s.k = w.k),
high(doc_id, lvl, pos, subroot, cur, proof) AS (
  SELECT doc_id, 0, pos, subroot, cur, proof FROM joined WHERE last = 1
  UNION ALL
  SELECT w.doc_id, w.lvl + 1, w.pos // 3, w.subroot, sha256(s.l || w.cur || s.r), w.proof || s.l || s.r
  FROM high w JOIN sides s ON s.k IS NULL AND s.lvl = w.lvl AND s.pos = w.pos),
ends AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) AS last FROM high)
SELECT l.doc_id, l.d AS leaf, e.subroot, (SELECT d FROM tops WHERE n = 1) AS root, sha256(e.proof) AS proof_sha256,
       e.cur AS folded_root, e.cur = (SELECT d FROM tops WHERE n = 1) AS verified
FROM leaves l JOIN ends e ON e.doc_id = l.doc_id AND e.last = 1
"""
)

ORACLES: dict[str, str] = {
    "op3_neighbours": _OP3,
    "op6_urls": _OP6,
    "op10_near_dedup": _OP10,
    "op12_variants": _OP12,
    "op13_merkle": _OP13,
}
