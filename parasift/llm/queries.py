"""Queries over the driver's tables, one for each operator, with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasift.llm import alignment, bpe, collocations, decontaminate, linededup, media, quality, secretscan, sharding, simhash, toolcalls, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


REPLY_SCHEMA = {
    "type": "object",
    "required": ["prompt", "turn"],
    "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    "additionalProperties": False,
}


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = toolcalls.turns_as_calls(table(spark, sf_dir, "conversations"))
    return toolcalls.format_chat(messages, {"reply": REPLY_SCHEMA}).drop("problems")


def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage", F.size("tiles").alias("n_tiles"))


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    placed = sharding.assign_shards(docs, 24, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "lines_total", "lines_dropped", digest.alias("kept_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned_with_counts(table(spark, sf_dir, "documents"), alignment_files(), digest=True)
    return found.select("doc_id", *alignment.COUNTS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def alignment_files() -> tuple[str, str, str, str]:
    ranks, library, model = map(public_tokenizers.path, ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
    return ranks, public_tokenizers.PATTERN, library, model


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secretscan.BASE]))
    counts = (F.size(F.filter("spans", lambda s: s["kind"] == r.kind)).cast("long").alias(f"n_{r.kind}") for r in secretscan.BASE)  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(secretscan.shown(base).cast("binary"), 256).alias("base_sha256"), secretscan.shown(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_counterfactual_toxicity": op2_counterfactual_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_tool_call_linking": op4_tool_call_linking,
    "op5_ftrl_quality": op5_ftrl_quality,
    "op6_greedy_tiling": op6_greedy_tiling,
    "op7_hypergeometric_shards": op7_hypergeometric_shards,
    "op8_media_columns": op8_media_columns,
    "op9_warc": op9_warc,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_collocations": op12_collocations,
    "op13_secret_scan": op13_secret_scan,
}


def _secret_sql() -> str:
    """Matches of each rule and what stands between them, cut by the rule's expression; a match's place is the length
    of all that is before it."""
    kinds = []
    for n, rule in enumerate(secretscan.RULES):
        head, value = (part.replace("\\x20", " ").replace("'", "''") for part in (rule.head, rule.value))
        if rule.any_case:
            head = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", head)
        whole = f"'(?:{head})({value})'"
        kinds.append(f"""
  SELECT doc_id, {n} AS n, '{rule.kind}' AS kind, unnest(m) AS m, unnest(v) AS v, unnest(list_slice(p, 1, len(m))) AS p, generate_subscripts(m, 1) AS i, {rule.least} AS least, {rule.least_value} AS least_value
  FROM (SELECT doc_id, regexp_extract_all(text, {whole}) AS m, regexp_extract_all(text, {whole}, {whole.count("(") - whole.count("(?:")}) AS v, regexp_split_to_array(text, {whole}) AS p FROM d)""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({" UNION ALL ".join(kinds)}
), placed AS (
  SELECT doc_id, n, kind, m, v, least, least_value, (sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a
  FROM f WINDOW w AS (PARTITION BY doc_id, n ORDER BY i)
), kept AS (
  SELECT doc_id, n, kind, a, kind || ':' || a || ':' || (a + length(m)) AS shown FROM placed WHERE length(m) >= least AND length(v) >= least_value
)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secretscan.BASE)},
  sha256(coalesce(string_agg(shown, ',' ORDER BY a, n) FILTER (n < {len(secretscan.BASE)}), '')) AS base_sha256, coalesce(string_agg(shown, ',' ORDER BY a, n), '') AS spans
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""


ORACLE_SQL: dict[str, str] = {
    "op4_tool_call_linking": """
WITH m AS (
  SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind FROM conversations
), users AS (
  SELECT DISTINCT conv_id, turn FROM m WHERE kind = 'call'
), answers AS (
  SELECT DISTINCT conv_id, turn FROM m WHERE kind = 'result'
), chains AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS place FROM users
), depth AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, turn - 2 * place ORDER BY turn) - 1 AS depth FROM chains
)
SELECT m.conv_id, m.turn, m.role, m.kind,
  CASE kind WHEN 'call' THEN m.conv_id || '-' || m.turn WHEN 'result' THEN m.conv_id || '-' || (m.turn - 1) END AS call_id,
  CASE kind WHEN 'call' THEN a.conv_id IS NOT NULL WHEN 'result' THEN d.conv_id IS NOT NULL ELSE false END AS linked,
  CASE kind WHEN 'call' THEN 2 * d.depth WHEN 'result' THEN 2 * d.depth + 1 END AS level,
  m.turn AS place,
  CASE WHEN kind = 'call' THEN coalesce(length(m.text) > 0, false) AND m.turn >= 0 END AS valid,
  CASE kind
    WHEN 'call' THEN '{"arguments":{"prompt":' || to_json(m.text) || ',"turn":' || m.turn || '},"call_id":"' || m.conv_id || '-' || m.turn || '","kind":"call","name":"reply"}'
    WHEN 'result' THEN '{"call_id":"' || m.conv_id || '-' || (m.turn - 1) || '","content":' || to_json(m.text) || ',"kind":"result"}'
    ELSE '{"content":' || to_json(m.text) || ',"kind":"message","role":' || to_json(m.role) || '}' END AS json
FROM m
LEFT JOIN answers a ON kind = 'call' AND a.conv_id = m.conv_id AND a.turn = m.turn + 1
LEFT JOIN depth d ON d.conv_id = m.conv_id AND d.turn = CASE kind WHEN 'call' THEN m.turn WHEN 'result' THEN m.turn - 1 END
""",
    # Base 32 by hand: the digest's hexadecimal digits as bits, five at a time.
    "op9_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), o AS (
  SELECT body, min(page_id) AS owner FROM p GROUP BY body
), b AS (
  SELECT page_id, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', hex[i])]), '') AS bits FROM p
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INTEGER + 8 * bits[5 * i + 2]::INTEGER + 4 * bits[5 * i + 3]::INTEGER + 2 * bits[5 * i + 4]::INTEGER + bits[5 * i + 5]::INTEGER]), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p JOIN o USING (body) JOIN b USING (page_id)
""",
    "op10_line_dedup": """
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), cut AS (
  SELECT doc_id, pos, string_split_regex(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \\t\\v\\f\\r]+') AS words
  FROM raw WHERE regexp_matches(line, '[^ \\t\\v\\f\\r]')
), masked AS (
  SELECT doc_id, pos, words, list_transform(words, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS m FROM cut
), lines AS (
  SELECT doc_id, pos, len(m) AS n, len(list_filter(m, lambda w: w <> '<*>')) AS c, CASE WHEN len(list_filter(m, lambda w: w <> '<*>')) = 0 THEN words ELSE m END AS t FROM masked
), filed AS (
  SELECT doc_id, pos, array_to_string(t, ' ') AS key FROM lines
  UNION ALL
  SELECT doc_id, pos, concat_ws(chr(10), n, i, array_to_string(t[1 : i * n // 5], ' '), array_to_string(t[(i + 1) * n // 5 + 1 : n], ' ')) AS key
  FROM lines, range(5) r(i) WHERE n >= 4 AND (i + 1) * n // 5 > i * n // 5 AND c - ((i + 1) * n // 5 - i * n // 5) >= 3 AND (i * n // 5 >= 3 OR (i + 1) * n // 5 <= n - 2)
), first AS (
  SELECT key, min(doc_id) AS first FROM filed GROUP BY key HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, pos FROM filed JOIN first USING (key) WHERE doc_id > first
), kept AS (
  SELECT doc_id, count(*) AS lines_total, count(g.pos) AS lines_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY r.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM raw r LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.lines_total, 0)::INTEGER AS lines_total, coalesce(k.lines_dropped, 0)::INTEGER AS lines_dropped, sha256(coalesce(k.text, d.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), f AS MATERIALIZED (
  SELECT lang, p, count(*) AS a FROM (SELECT lang, w[i : i + k - 1] AS p FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), range(1, 5) r(k) WHERE i + k - 1 <= len(w)) GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, p, a FROM f WHERE len(p) > 1
), longer AS (
  SELECT lang, part AS p, max(a) AS a FROM (SELECT lang, a, p[i : i + k - 1] AS part FROM c, range(1, 4) s(i), range(2, 4) r(k) WHERE k < len(p) AND i + k - 1 <= len(p)) GROUP BY ALL
), parts AS (
  SELECT lang, p, a, k, p[1:k] AS before, p[k + 1 : len(p)] AS after FROM c, range(1, 4) x(k) WHERE k < len(p)
), cuts AS (
  SELECT t.lang, t.p, t.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * t.a // (l.a + r.a))::BIGINT AS score
  FROM parts t JOIN f l ON l.lang = t.lang AND l.p = t.before JOIN f r ON r.lang = t.lang AND r.p = t.after
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), ranked AS (
  SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN longer g USING (lang, p) WHERE g.a IS NULL OR 100 * g.a < 80 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang) USING (lang) QUALIFY rank <= 2000
""",
    "op13_secret_scan": _secret_sql(),
}
