"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import ann, bpe, chat, langid, media, nearjoin, packing, pii, resample, secrets, substrings, trie, urls
from orbweave.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ids=False)


#: Fixed rules: host, path and verdict.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_nearjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the merges of byte_bpe_50k.json as ranks, without its added tokens
    return packing.pack(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, json_path=public_tokenizers.path("byte_bpe_50k.json"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return secrets.find_secrets(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: A conversation whose texts are control strings elsewhere.
MARKED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(MARKED, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.turns(table(spark, sf_dir, "conversations"))))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_urls": op2_urls,
    "op3_ann": op3_ann,
    "op4_pii": op4_pii,
    "op5_nearjoin": op5_nearjoin,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_substrings": op8_substrings,
    "op9_media": op9_media,
    "op10_langid": op10_langid,
    "op11_chat": op11_chat,
    "op12_trie": op12_trie,
    "op13_resample": op13_resample,
}

ORACLE_SQL = {
    "op2_urls": """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged
""",
    "op11_chat": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, len(regexp_extract_all(r, '[<\\[]\\\\*(\\|start\\|>|\\|message\\|>|\\|end\\|>|\\|endoftext\\|>|s>|/s>|INST\\]|/INST\\])'))
    + len(regexp_extract_all(t, '[<\\[]\\\\*(\\|start\\|>|\\|message\\|>|\\|end\\|>|\\|endoftext\\|>|s>|/s>|INST\\]|/INST\\])')) AS escapes
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(t) + escapes + length('<|start|><|message|><|end|>'))::bigint AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op12_trie": """
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, item) AS p, item, chars
  FROM (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS item, length(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT c, c - c % 100 AS b, xor(list_reduce([ord(x) FOR x IN string_split(c::varchar, '')],
    lambda crc, x: list_reduce(range(8), lambda q, i: xor(q >> 1, 3988292384 * (q & 1)), xor(crc, x)), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM own)
), items AS (
  SELECT c, p, item, chars FROM own JOIN convs USING (c) WHERE p > h
  UNION ALL SELECT convs.c, own.p, item, chars FROM convs JOIN own ON own.c = convs.b AND own.p <= h
), begun AS (
  SELECT c, row_number() OVER w AS depth, chars, string_agg(item, '') OVER w AS prefix FROM items WINDOW w AS (PARTITION BY c ORDER BY p)
  UNION ALL SELECT c, 0, 0, '' FROM convs
), ends AS (
  SELECT prefix, string_agg(c::varchar, ',' ORDER BY c) AS ids FROM begun JOIN (SELECT c, max(depth) AS depth FROM begun GROUP BY c) USING (c, depth) GROUP BY prefix
), nodes AS (
  SELECT prefix, any_value(depth) AS depth, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs,
    CASE WHEN any_value(depth) > 0 THEN left(prefix, 64 * any_value(depth - 1)) END AS parent
  FROM begun GROUP BY prefix
), children AS (
  SELECT parent AS prefix, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), known AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix)
), below AS (
  SELECT a.prefix, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars)::bigint AS saved_tokens
  FROM known a JOIN known b ON b.depth >= a.depth AND left(b.prefix, 64 * a.depth) = a.prefix GROUP BY a.prefix
)
SELECT k.conv_id, k.depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM known k JOIN below USING (prefix) LEFT JOIN ends USING (prefix) LEFT JOIN known up ON up.prefix = k.parent
""",
    "op13_resample": """
WITH found AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
  UNION ALL SELECT 'b', NULL, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), spread AS (
  SELECT side, doc_id, unnest(words) AS word FROM found
), coded AS (
  SELECT word, xor(list_reduce([ord(code[2 * i - 1]) * 16 + ord(code[2 * i]) - 816 - 7 * (16 * (code[2 * i - 1] > '9')::int + (code[2 * i] > '9')::int) FOR i IN range(1, length(code) // 2 + 1)],
    lambda crc, x: list_reduce(range(8), lambda q, j: xor(q >> 1, 3988292384 * (q & 1)), xor(crc, x)), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS code FROM (SELECT DISTINCT word FROM spread))
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM spread JOIN coded USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::double * (sum(s) OVER () + 10000)::double) / ((s + 1)::double * (sum(t) OVER () + 10000)::double)))::bigint AS gain FROM counts
), weights AS (
  SELECT doc_id, sum(gain)::bigint AS weight FROM spread JOIN coded USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(len(words), 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::bigint + 0.5::double) / 4294967296::double)))::bigint AS score
  FROM found LEFT JOIN weights USING (doc_id) WHERE side = 'd'
), placed AS (
  SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * count(*) FILTER (n_features >= 20) OVER () // 100 THEN place END AS rank FROM placed
""",
}
