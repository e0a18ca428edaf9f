"""The registered queries of this package: ``opN_<name>`` over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(_TOKENIZER))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import digest

    return digest(_table(spark, sf_dir, "documents"))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import KINDS, pseudonymise

    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = pseudonymise(docs, key="check")
    times = lambda kind: F.size(F.filter("found", lambda k: k == kind)).cast("long")
    counts = [times(kind).alias(f"n_{kind}") for kind in KINDS]
    return made.select("doc_id", *counts, "text")


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.nn_descent import search

    return search(_table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard_join import classes

    return classes(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import digest

    return digest(_table(spark, sf_dir, "documents"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_model import score

    return score(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("score", 6).alias("score"))


_OP7_SQL = """
WITH words AS (
  SELECT rid, doc_id, i, w[i] AS word FROM (
    SELECT row_number() OVER () AS rid, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
      FROM documents) d) u),
pairs AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM words),
total AS (SELECT count(*) AS n FROM words),
one AS (SELECT word, count(*) AS c FROM words GROUP BY word),
followers AS (SELECT before, count(*) AS c FROM pairs WHERE before IS NOT NULL GROUP BY before),
two AS (SELECT before, word, count(*) AS c FROM pairs WHERE before IS NOT NULL GROUP BY before, word),
scored AS (
  SELECT p.doc_id, CASE WHEN two.c >= 2 THEN ln(two.c / followers.c)
    WHEN p.before IS NULL THEN ln(one.c / total.n) ELSE ln(one.c / total.n * 0.4) END AS s
  FROM pairs p JOIN one ON p.word = one.word CROSS JOIN total
  LEFT JOIN two ON p.before = two.before AND p.word = two.word LEFT JOIN followers ON p.before = followers.before)
SELECT d.doc_id, count(s) AS n_words, round(avg(s), 6) AS score
FROM documents d LEFT JOIN scored s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import find

    hits = find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.col("hits.item_id"))
    return hits.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_hits"),
        F.array_sort(items).alias("item_ids"),
        F.array_min("hits.begin").alias("first_begin"),
        F.array_max("hits.end").alias("last_end"),
    )


def op9_label_propagation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), shards=40)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import held_out, learn, score

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = score(docs, learn(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.conversation_repair import repair

    return repair(_table(spark, sf_dir, "conversations"))


# crc32 by its table; then the rows of a conversation from its last to its first, with the best of each grammar state: 1 nothing yet,
# 2 after s, 3 after u, 4 after a.
_OP11_SQL = """
WITH RECURSIVE poly AS (
  SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: xor(c >> 1, 3988292384 * (c & 1)), i::BIGINT)) AS t),
filled AS (
  SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS name, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
dealt AS (
  SELECT f.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM filled f, poly),
damaged AS (
  SELECT name, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM dealt WHERE kind <> 0) d),
placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY turn NULLS FIRST, role, sha256(text)) AS place FROM damaged),
faulty AS (
  SELECT *, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 4 END AS initial,
    CASE WHEN last = '' THEN 'blank' WHEN place > min(place) OVER (PARTITION BY name, role, text) THEN 'duplicate'
      WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM (SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM placed) p),
beside AS (SELECT *, initial * 10 + lead(initial) OVER (PARTITION BY name ORDER BY place) NOT IN (12, 23, 32) AS illegal FROM faulty),
counts AS (
  SELECT name, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (illegal) AS illegal, count(*) AS n FROM beside GROUP BY name),
walk AS (
  SELECT name, n AS place, [{'c': 0, 'a': '', 'r': []::VARCHAR[]}, {'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']},
    {'c': 3, 'a': 'I', 'r': ['assistant:']}, {'c': 0, 'a': '', 'r': []::VARCHAR[]}] AS s FROM counts
  UNION ALL
  SELECT w.name, w.place - 1, list_transform([1, 2, 3, 4], lambda q: list_min([b[q],
      {'c': b[due[q]].c + 3, 'a': 'I' || b[due[q]].a, 'r': list_prepend(said[q], b[due[q]].r)},
      {'c': b[due[due[q]]].c + 6, 'a': 'II' || b[due[due[q]]].a, 'r': list_concat([said[q], said[due[q]]], b[due[due[q]]].r)}]))
  FROM (
    SELECT w.name, w.place, due, said, list_transform([1, 2, 3, 4], lambda q: list_min(list_filter([
        {'c': s[q].c + 4, 'a': 'D' || s[q].a, 'r': s[q].r},
        {'c': CASE WHEN gone OR keeps[q][initial] = 0 THEN NULL ELSE s[keeps[q][initial]].c + extra END,
         'a': 'K' || s[keeps[q][initial]].a, 'r': list_prepend(role || ':' || text, s[keeps[q][initial]].r)},
        {'c': CASE WHEN gone THEN NULL ELSE s[due[q]].c + extra + 3 END,
         'a': 'R' || s[due[q]].a, 'r': list_prepend(said[q] || text, s[due[q]].r)}], lambda o: o.c IS NOT NULL))) AS b
    FROM (
      SELECT w.*, f.role, f.text, f.initial, f.fault IN ('blank', 'duplicate') AS gone, CASE f.fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra,
        [3, 3, 4, 3] AS due, ['user:', 'user:', 'assistant:', 'user:'] AS said, [[2, 3, 0, 0], [0, 3, 0, 0], [0, 0, 4, 0], [0, 3, 0, 0]] AS keeps
      FROM walk w JOIN faulty f ON w.name = f.name AND w.place = f.place) w) w),
best AS (SELECT name, s[1] AS s FROM walk WHERE place = 0)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.c, 0)::BIGINT AS cost, coalesce(s.a, '') AS audit,
  sha256(coalesce(array_to_string(s.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, name FROM filled) k LEFT JOIN counts USING (name) LEFT JOIN best USING (name)
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.source_divergence import divergence

    return divergence(_table(spark, sf_dir, "documents"))


_OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term),
held AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS lang_n, l.v, l.total AS lang_total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY s.lang, s.source) AS total
  FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON s.lang = c.lang AND s.source = c.source AND k.term = c.term),
priced AS (
  SELECT *, 1 + 1000000000 * (n + 5) // (total + 5 * v) AS p, 1 + 1000000000 * (lang_n::HUGEINT + 5) // (lang_total + 5 * v) AS q FROM held),
differ AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN differ d ON a.lang = d.lang AND a.source = d.source AND b.source = d.item),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM priced WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) r
WHERE part = 'pair' OR rank <= 50
"""


def op13_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat_format import digest, format_chats

    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digest(format_chats(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)))


_OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '##(\\*)# ', '##\\\1# ', 'g') AS t,
    regexp_replace(regexp_replace(regexp_replace(role, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '##(\\*)# ', '##\\\1# ', 'g'), ':(\\*) ', ':\\\1 ', 'g') AS r
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(length('### ') + length(r) + length(': ') + length(t) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_pii_pseudonyms": op3_pii_pseudonyms,
        "op4_nn_descent": op4_nn_descent,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_secret_scan": op6_secret_scan,
        "op7_stupid_backoff": op7_stupid_backoff,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_label_propagation_sharding": op9_label_propagation_sharding,
        "op10_toxicity": op10_toxicity,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_source_divergence": op12_source_divergence,
        "op13_chat_round_trip": op13_chat_round_trip,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_stupid_backoff": _OP7_SQL, "op11_conversation_repair": _OP11_SQL, "op12_source_divergence": _OP12_SQL, "op13_chat_round_trip": _OP13_SQL}
