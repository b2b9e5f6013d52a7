"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, counts, html, jaccard, mixing, neardup, pieces, quality, records, sharding, warc, whiten
from .runtime import new_folder


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file; a parameter of the operators, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
MIX_SEED = 20240
CHAT_SCHEMAS = {"ask": {"text": ("string", True), "n_chars": ("integer", True)}, "wait": {"turn": ("integer", True)}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).drop("rejected_by")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"), decoded_name="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.reply_links(chat.logged_backwards(table(spark, sf_dir, "conversations")), chained=True)
    rows = chat.format_chats(linked, CHAT_SCHEMAS, turn="logged")
    return rows.select("conv_id", "turn", "logged", "role", "anchor_turn", "level", "call_turn", "linked", "n_calls", "valid", "json")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), "doc_id", SHARDS)
    folder = new_folder(spark, "shards")
    placed.write.partitionBy("shard").mode("overwrite").parquet(folder)
    moved = spark.read.schema(placed.schema).parquet(folder)
    rows = moved.join(F.broadcast(sharding.shard_totals(moved, "n_chars")), "shard")
    return rows.select("doc_id", "slot", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard_rows", "shard_size")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"), seed=MIX_SEED)


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = records.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model")).drop("text")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_sentencepiece, op3_chat_format, op4_html_text, op5_jaccard_join, op6_warc, op7_shard_placement, op8_source_mix, op9_embedding_neardup, op10_token_records, op11_token_counts, op12_embedding_whitening, op13_filter_audit)}


OP3_SQL = """
WITH RECURSIVE m AS (
  SELECT *, turn - turn % 4 + 3 - turn % 4 AS logged, role IN ('user', 'assistant') AS speaks FROM conversations
), calls AS (
  SELECT conv_id, turn, min(logged) AS call_turn FROM m WHERE speaks AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), place(conv_id, turn, spot, depth) AS (
  SELECT conv_id, turn, call_turn, 0 FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)
  UNION ALL
  SELECT c.conv_id, c.turn, greatest(c.call_turn, p.spot), CASE WHEN p.spot >= c.call_turn THEN p.depth + 1 ELSE 0 END
  FROM place p JOIN calls c ON c.conv_id = p.conv_id AND c.turn = p.turn + 1
), upper AS (
  SELECT p.*, c.call_turn FROM place p JOIN calls c USING (conv_id, turn)
)
SELECT m.conv_id, m.turn, m.logged, m.role, greatest(m.logged, u.spot) AS anchor_turn, CASE WHEN u.spot >= m.logged THEN u.depth + 1 ELSE 0 END AS level, u.call_turn, u.call_turn IS NOT NULL AS linked,
       CASE WHEN speaks THEN 1 ELSE 0 END AS n_calls,
       m.role <> 'user' OR m.text IS NOT NULL AS valid,
       '{' || CASE WHEN m.text IS NULL THEN '' ELSE '"content":' || to_json(m.text) || ',' END || '"role":' || to_json(m.role)
       || CASE WHEN speaks THEN ',"tool_call_id":"' || m.conv_id || ':' || (m.turn - 1) || '","tool_calls":[{"arguments":' || to_json('{'
               || CASE WHEN m.role = 'assistant' THEN '"turn":' || m.turn WHEN m.text IS NULL THEN '' ELSE '"n_chars":' || length(m.text) || ',"text":' || to_json(m.text) END || '}')
               || ',"id":"' || m.conv_id || ':' || m.turn || '","name":"' || CASE WHEN m.role = 'user' THEN 'ask' ELSE 'wait' END || '"}]'
               ELSE '' END || '}' AS json
FROM m LEFT JOIN upper u ON speaks AND u.conv_id = m.conv_id AND u.turn = m.turn - 1
"""

OP7_SQL = f"""
WITH owner AS (
  SELECT from_json('{json.dumps(sharding.fill_table(SHARDS))}', '["INT"]') AS shard_of
), placed AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT) % {sharding.TABLE_SIZE} AS slot FROM documents
), named AS (
  SELECT placed.*, 'shard-' || lpad(shard_of[slot + 1]::VARCHAR, 3, '0') AS shard FROM placed, owner
)
SELECT doc_id, slot, shard, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, count(*) OVER (PARTITION BY shard) AS shard_rows, sum(coalesce(n_chars, 0)) OVER (PARTITION BY shard)::BIGINT AS shard_size FROM named
"""

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS times FROM (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5))
), covered AS (
  SELECT doc_id, count(DISTINCT p + i) AS n_repeat_words FROM win, range(0, 5) r(i) WHERE times > 1 GROUP BY doc_id
), line_sums AS (
  SELECT doc_id, sum((n - 1) * b) AS again, sum(n * b) AS whole FROM (SELECT doc_id, l, count(*) AS n, any_value(strlen(l)) AS b FROM (SELECT doc_id, unnest(lines) AS l FROM w) GROUP BY doc_id, l) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(again, 0) AS again, coalesce(whole, 0) AS whole,
    len(list_filter(list_zip(w[1:-2], w[2:]), lambda x: x[1] = x[2])) AS stutter,
    length(t) - length(regexp_replace(t, '[\x21-\x40\x5b-\x60\x7b-\x7e]', '', 'g')) AS other, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper
  FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN line_sums USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines > 0 AND 10 * again > 3 * whole) OR 10 * stutter > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * other > 6 * word_chars OR 2 * upper > word_chars) AS kept
FROM b
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, len(w) || ' ' || array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(node, seen) AS (
  SELECT a, a FROM e UNION SELECT b, b FROM e
  UNION SELECT r.node, CASE WHEN e.a = r.seen THEN e.b ELSE e.a END FROM reach r JOIN e ON e.a = r.seen OR e.b = r.seen
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(seen) FROM reach WHERE node = w.doc_id), w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""

OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT page_id, p.payload_bytes, p.payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest, payload_bytes)
"""

OP8_SQL = f"""
WITH RECURSIVE per AS (
  SELECT source, CASE WHEN sum(coalesce(n_chars, 0)) > 0 THEN sum(coalesce(n_chars, 0))::DOUBLE ELSE count(*)::DOUBLE END AS size FROM documents GROUP BY source
), rate AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM per) * (SELECT sum(size) FROM per) / size AS rate FROM per
), cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rate
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < 60
), drawn AS (
  SELECT d.*, CAST('0x' || substr(md5('{MIX_SEED}|' || coalesce(doc_id::VARCHAR, '') || '|1'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents d
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND d.u >= cdf.c) AS n FROM drawn d
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INTEGER AS copy FROM counted WHERE n > 0
)
SELECT *, CAST('0x' || substr(md5('{MIX_SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy || '|order'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS mix_order FROM copies
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM w LEFT JOIN l USING (doc_id)
), g AS (
  SELECT part, failed, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o AS filter_order, step::INTEGER AS step, o[step] AS own, substr(o, 1, step - 1) AS earlier FROM orders, range(1, 6) r(step)
), s AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (NOT gone AND hit) AS removed, sum(n) FILTER (gone AND hit) AS redundant,
    sum(n) FILTER (failed = own) AS unique_fails, sum(good) FILTER (NOT gone AND hit) AS good_lost, sum(toxic) FILTER (NOT gone AND hit) AS toxic_lost
  FROM (SELECT *, translate(failed, earlier, '') <> failed AS gone, contains(failed, own) AS hit FROM g, steps) GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_filter_audit": OP13_SQL, "op1_quality_rules": OP1_SQL, "op5_jaccard_join": OP5_SQL, "op6_warc": OP6_SQL, "op3_chat_format": OP3_SQL, "op7_shard_placement": OP7_SQL, "op8_source_mix": OP8_SQL}
