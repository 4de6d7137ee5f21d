"""The queries of this subpackage over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import (
    credentials, lexical_search, main_text, mixing, neighbours, packing, phrases, pieces, simhash, toxicity, url_index, weak_rules,
)
from orderloom.llm.common import bucket, staged, table

TOXIC = 0.7
PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"

# Fixed values: (host, path, block).
URL_RULES = [("net", "/", True), ("example.net", "/en/", False), ("example.com", "/de/", True), ("org", "/fr/", False)]
# Hosts that are blocked with their subdomains where no rule fits.
BLOCKED_HOSTS = [
    f"{name}.example.{top}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
]


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Model:
    labels = table(spark, folder, "labels").where(bucket("doc_id", 3) != 1)
    return toxicity.fit(table(spark, folder, "documents"), labels)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    model = toxicity_model(spark, folder)
    scored = model.score(table(spark, folder, "documents").select("doc_id", "text"), "text", "score")
    return scored.select(
        "doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"),
    )


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    measured = staged(weak_rules.measure(table(spark, folder, "documents"), keep=("doc_id",)), "rules-measures")
    return weak_rules.judge(measured, weak_rules.fit(measured)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, block boolean")
    hosts = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "host string")
    return url_index.judge(table(spark, folder, "pages"), rules, hosts)


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_decode(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(WORDS), with_ids=False)


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", (bucket("doc_id", 5) == 1).alias("held_out"))
    return mixing.score(docs, "held_out")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.token_counts(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op11_credentials(spark: SparkSession, folder: str) -> DataFrame:
    found = credentials.find(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(credentials.shown("found", len(credentials.SURE)), 256).alias("base_sha256"),
        credentials.shown("found").alias("spans"),
    )


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_simhash, op3_main_text, op4_quality_rules, op5_url_filter, op6_neighbours, op7_pieces, op8_packing,
        op9_mixing, op10_token_counts, op11_credentials, op12_phrases, op13_lexical_search, pipeline,
    )
}

def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Which kind each pattern of the credential search belongs to, in the order of its groups.
_CREDENTIALS = [
    (0, credentials.ASSIGN), (1, credentials.ACCESS), (2, credentials.HEX), (3, credentials.MIXED), (3, credentials.VAGUE),
    (4, credentials.MAIL), (4, credentials.NAMED), (5, credentials.URL), (5, credentials.ADDRESS), (6, credentials.BLANK),
]
_MATCHES = " UNION ALL ".join(
    f"SELECT r, {g} AS g, {kind} AS kind, regexp_split_to_array(t, {_quoted(p)}) AS gaps, regexp_extract_all(t, {_quoted(p)}) AS ms FROM docs"
    for g, (kind, p) in enumerate(_CREDENTIALS)
)

ORACLES: dict[str, str] = {
    # Every weak span is held against every other part of its text; only the texts are as the operator reads them.
    "op11_credentials": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), matches AS ({_MATCHES}
), each AS (
  SELECT r, g, kind, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM matches WHERE len(ms) > 0
), placed AS (
  SELECT r, g, kind, m, sum(length(gap) + length(m)) OVER (PARTITION BY r, g ORDER BY i) AS e FROM each
), parts AS (
  SELECT r, kind, e - length(m) AS s, e FROM placed
  WHERE CASE WHEN g = 0 THEN regexp_full_match(m, {_quoted(credentials.SHORT_ASSIGN.strip("^$"))})
             WHEN g = 3 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]')
                             AND (regexp_matches(m, '[A-Z]') OR regexp_full_match(m, '[0-9a-f]{{16,23}}'))
             ELSE TRUE END
), scoped AS (
  SELECT p.*, (SELECT count(*) FROM parts b WHERE b.r = p.r AND b.kind = 6 AND b.s < p.s) AS scope,
         kind > 2 AND EXISTS (SELECT 1 FROM parts b WHERE b.r = p.r AND b.kind < 3 AND b.s < p.e AND b.e > p.s) AS inside
  FROM parts p WHERE kind < 6
), met AS (
  SELECT w.r, w.kind, w.s, w.e, list(DISTINCT c.kind) AS k
  FROM scoped w JOIN scoped c
    ON c.r = w.r AND c.scope = w.scope AND NOT c.inside AND c.s < w.e + {credentials.REACH} AND c.e > w.s - {credentials.REACH}
  WHERE w.kind > 2 AND NOT w.inside GROUP BY ALL
), linked AS (
  SELECT r, kind, s, e FROM met
  WHERE CASE kind WHEN 3 THEN list_contains(k, 1) OR list_contains(k, 4) AND list_contains(k, 5)
                  WHEN 4 THEN list_has_any(k, [0, 2]) OR list_contains(k, 3) AND list_contains(k, 5)
                  ELSE list_has_any(k, [0, 2, 3]) AND list_has_any(k, [1, 4]) END
), spans AS (
  SELECT DISTINCT r, kind, s, e, list_extract({list(credentials.KINDS)}, kind + 1) || ':' || s::BIGINT || ':' || e::BIGINT AS shown
  FROM (SELECT r, kind, s, e FROM parts WHERE kind < 3 UNION ALL SELECT * FROM linked)
), gathered AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
         count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(shown, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3) AS base,
         string_agg(shown, ',' ORDER BY s, kind, e) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN gathered USING (r)
""",
    "op12_phrases": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i:i + size - 1])) AS p
  FROM words, (VALUES (1), (2), (3)) AS sizes(size)
), counts AS (SELECT lang, size, array_to_string(p, ' ') AS phrase, p, count(*) AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (SELECT * FROM counts WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.p, c.f, k, a.f AS l, b.f AS r, (1000000 * c.f::HUGEINT * c.f) // (a.f::HUGEINT * b.f) AS score
  FROM candidates c, (VALUES (1), (2)) AS ks(k)
  JOIN counts a ON a.lang = c.lang AND a.size = k AND a.phrase = array_to_string(c.p[1:k], ' ')
  JOIN counts b ON b.lang = c.lang AND b.size = c.size - k AND b.phrase = array_to_string(c.p[k + 1:], ' ')
  WHERE k < c.size
), lowest AS (
  SELECT * FROM cuts c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
  SELECT lang, array_to_string(p[i:i + 1], ' ') AS phrase, max(f) AS longer
  FROM candidates, (VALUES (1), (2)) AS places(i) WHERE size = 3 GROUP BY ALL
), ranked AS (
  SELECT lang, phrase, l.f AS a, l, r, score::BIGINT AS score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, l.f DESC, phrase) AS rank
  FROM lowest l LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * l.f
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "op13_lexical_search": """
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), wanted AS (SELECT i, item_id, t, count(*) AS times FROM items GROUP BY ALL
), whole AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs WHERE len(w) > 0
), sizes AS (SELECT d, doc_id, 100 - 75 + (75 * len(w) * n_docs) // n_terms AS m FROM docs, whole
), tfs AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM wanted) GROUP BY ALL
), weights AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY t
), scores AS (
  SELECT i, item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM tfs JOIN weights USING (t) JOIN wanted USING (t) JOIN sizes USING (d) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
""",
    "op5_url_filter": f"""
WITH split AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), rules(h, p, block) AS (VALUES {", ".join(f"('{h}', '{p}', {str(b).lower()})" for h, p, b in URL_RULES)}
), bad(h) AS (VALUES {", ".join(f"('{h}')" for h in BLOCKED_HOSTS)}
), fitting AS (
  SELECT page_id, h || p AS rule, block,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC) AS r
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), listed AS (
  SELECT DISTINCT page_id FROM parts JOIN bad ON host = h OR ends_with(host, '.' || h)
)
SELECT page_id, host, path, rule,
       CASE WHEN CASE WHEN rule IS NULL THEN listed.page_id IS NOT NULL ELSE block END THEN 'block' ELSE 'allow' END AS verdict
FROM parts
LEFT JOIN (SELECT * FROM fitting WHERE r = 1) USING (page_id)
LEFT JOIN listed USING (page_id)
""",
}
