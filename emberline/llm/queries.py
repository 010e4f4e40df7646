"""One query for each training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import (
    cascade, circulant_minhash, conversations, decontaminate, html_template, jaccard_join, langmix, packing, pii, token_lengths, tool_calls,
    warc, whitening,
)
from emberline.llm.common import lean_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            lean_batches(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: For plain turns only; calls written as JSON in the texts are tested against a brute-force version.
CALLS_SQL = """
WITH keyed AS (
  SELECT conv_id, turn, role, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS r
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE r = 1),
users AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM keyed WHERE role = 'user'),
answers AS (SELECT conv_id, turn, text FROM keyed WHERE role = 'assistant'),
joined AS (
  SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.turn, a.turn - 1) AS asked, u.turn AS turn, a.turn AS result_turn, u.text AS question, a.text AS answer, u.position
  FROM users u FULL JOIN answers a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1),
quoted AS (
  SELECT *, coalesce('"' || replace(replace(replace(replace(replace(question, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"', 'null') AS q,
         coalesce('"' || replace(replace(replace(replace(replace(answer, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"', 'null') AS r
  FROM joined)
SELECT conv_id, 'turn-' || asked AS id, turn, result_turn,
       CASE WHEN turn IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       position::BIGINT AS position,
       CASE WHEN turn IS NULL THEN NULL WHEN question IS NULL THEN 'text:missing' ELSE '' END AS errors,
       CASE WHEN turn IS NOT NULL THEN '{"arguments":{"text":' || q || ',"turn":"' || turn || '"},"id":"turn-' || turn || '","name":"respond","result":' || r || '}' END AS call_json
FROM quoted
"""


@query("op2_tool_call_linking", CALLS_SQL)
def op2_tool_call_linking(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "conversations")
    calls, results = tool_calls.turn_calls(messages)
    calls = calls.unionByName(tool_calls.read_calls(messages))
    results = results.unionByName(tool_calls.read_results(messages))
    schema = spark.sql("SELECT * FROM VALUES ('respond', 'text', 'string', true), ('respond', 'turn', 'integer', true) AS t(tool, field, kind, required)")
    linked = tool_calls.link_calls(calls, results, schema)
    return linked.withColumn("errors", F.array_join("errors", ",")).drop("typed_json")  # the SQL has the texts only


@query("op3_template_extraction")
def op3_template_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_template.extract(table(spark, folder, "pages"))


@query("op4_language_mixture")
def op4_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langmix.fit(docs.filter(~langmix.held_out()))
    found = langmix.identify(docs, model)
    return found.select("doc_id", langmix.held_out().alias("held_out"), "lang_pred", "score", "languages", "shares")


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.scan(table(spark, folder, "documents"))
    counts = [F.coalesce(F.regexp_count("base", F.lit(f"(^|,){kind}:")), F.lit(0)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


WARC_SQL = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM rows WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)
"""


@query("op6_warc_revisits", WARC_SQL)
def op6_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.write_and_read(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, folder, "documents"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_lengths.context_totals(token_lengths.length_histogram(table(spark, folder, "documents")))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


CASCADE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
basic AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered FROM words),
each_word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words),
top AS (SELECT doc_id, max(n) AS top_word FROM (SELECT doc_id, word, count(*) AS n FROM each_word GROUP BY ALL) GROUP BY 1),
windows AS (SELECT * FROM (
  SELECT doc_id, place, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS three
  FROM each_word WINDOW d AS (PARTITION BY doc_id ORDER BY place)) WHERE three IS NOT NULL),
twice AS (SELECT * FROM (SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT place + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY 1),
whole AS (
  SELECT b.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(t.top_word, 0) AS top_word
  FROM basic b LEFT JOIN covered c USING (doc_id) LEFT JOIN top t USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM whole)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_words > 1000000 OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_lettered < 7 * n_words OR 10 * top_word > 3 * n_words) AS kept
FROM judged
"""


@query("op10_quality_cascade", CASCADE_SQL)
def op10_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = cascade.filter_quality(table(spark, folder, "documents"), measures=base)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *base, failed.alias("base_failed"), "kept")


@query("op11_minhash_duplicates")
def op11_minhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return circulant_minhash.deduplicate(table(spark, folder, "documents"))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


#: Best paths row by row: for each grammar state the cheapest (and, among equals, least) edits and the lines they give.
REPAIR_SQL = r"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
checked AS (
  SELECT raw.*, xor(list_reduce(list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, t[xor(a % 256, b) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM raw, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM checked),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) AS pair FROM numbered),
insertions AS (
  SELECT * FROM (VALUES (0, '', 0, 0, []), (1, '', 1, 0, []), (2, '', 2, 0, []), (3, '', 3, 0, []),
    (0, 'I', 2, 2, ['user:']), (1, 'I', 2, 2, ['user:']), (2, 'I', 3, 2, ['assistant:']), (3, 'I', 2, 2, ['user:']),
    (0, 'II', 3, 4, ['user:', 'assistant:']), (1, 'II', 3, 4, ['user:', 'assistant:'])) AS v(s, letters, t, cost, lines)),
steps AS (
  SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS v(s, initial, t)),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s, cost, audit, lines FROM (
    SELECT p.conv_id, r.i, e.t AS s, p.cost + n.cost + e.cost AS cost, p.audit || n.letters || e.letter AS audit,
           p.lines || n.lines || e.line AS lines
    FROM paths p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
    JOIN insertions n ON n.s = p.s,
    LATERAL (
      SELECT n.t AS t, 3 AS cost, 'D' AS letter, []::VARCHAR[] AS line
      UNION ALL
      SELECT k.t, (r.fault = 'truncated')::INT, 'K', [r.role || ':' || r.text] FROM steps k
      WHERE k.s = n.t AND k.initial = substr(r.role, 1, 1) AND r.fault IN ('', 'truncated')
      UNION ALL
      SELECT CASE n.t WHEN 2 THEN 3 ELSE 2 END, 2 + (r.fault = 'truncated')::INT, 'R', [CASE n.t WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text]
      WHERE r.fault IN ('', 'truncated')) e
    QUALIFY row_number() OVER (PARTITION BY p.conv_id, e.t ORDER BY p.cost + n.cost + e.cost, p.audit || n.letters || e.letter) = 1)),
ends AS (
  SELECT p.conv_id, p.cost + n.cost AS cost, p.audit || n.letters AS audit, p.lines || n.lines AS lines
  FROM paths p JOIN insertions n ON n.s = p.s AND n.t IN (0, 3)
  WHERE p.i = coalesce((SELECT max(i) FROM judged j WHERE j.conv_id IS NOT DISTINCT FROM p.conv_id), 0)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + n.cost, p.audit || n.letters) = 1),
totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ends e LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op13_conversation_repair", REPAIR_SQL)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, folder, "conversations")))
