"""Queries of the text operators with their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe_stream, chat_format, conversation_repair, decontaminate, hard_negatives, host_rules, minhash, quality_net, substring_dedup, suffix_dedup, token_files, toxicity, url_filter
from .common import shared_folder

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


@query("op1_toxicity")
def op1(spark, d):
    docs = read(spark, d, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, read(spark, d, "labels")))
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


@query("op2_token_files")
def op2(spark, d):
    folder = shared_folder(spark, "tokens")
    manifest = token_files.write_tokens(read(spark, d, "documents"), folder, public_tokenizers.path(TOKENIZER), end_id=1)
    read_back = token_files.read_documents(spark, manifest)
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_suffix_dedup")
def op3(spark, d):
    return suffix_dedup.remove_repeats(read(spark, d, "documents"), digest=True)


@query("op4_minhash")
def op4(spark, d):
    return minhash.near_duplicates(read(spark, d, "documents"))


WORDS = r"[^\x20\x09-\x0D]+"
_OP5 = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), x -> regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1) GROUP BY 1),
m AS (SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, x -> length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (10 * n_symbols > n_words) AS s, (10 * n_dup_lines > 3 * n_lines) AS l FROM m),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS a, sum(s::INT) AS b, sum(l::INT) AS c FROM f WHERE host IS NOT NULL GROUP BY 1),
p AS (SELECT avg(a / n) AS am, var_samp(a / n) AS av, avg(b / n) AS bm, var_samp(b / n) AS bv, avg(c / n) AS cm, var_samp(c / n) AS cv FROM h),
q AS (SELECT host, n, a, b, c, am, bm, cm, CASE WHEN av > 0 THEN greatest(0, am * (1 - am) / av - 1) ELSE 0 END AS sa,
             CASE WHEN bv > 0 THEN greatest(0, bm * (1 - bm) / bv - 1) ELSE 0 END AS sb, CASE WHEN cv > 0 THEN greatest(0, cm * (1 - cm) / cv - 1) ELSE 0 END AS sc FROM h, p),
v AS (SELECT host FROM q WHERE greatest((a + am * sa) / (n + sa), (b + bm * sb) / (n + sb), (c + cm * sc) / (n + sc)) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM v))) AS kept FROM f
"""


@query("op5_host_rules", _OP5)
def op5(spark, d):
    out = host_rules.judge(read(spark, d, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op6_url_filter")
def op6(spark, d):
    return url_filter.judge(read(spark, d, "pages"), URL_RULES, url_filter.labelled_urls(spark))


@query("op7_decontaminate")
def op7(spark, d):
    return decontaminate.find_leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query("op8_chat_format")
def op8(spark, d):
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    digest = chat_format.read_back(chat_format.format_turns(turns))
    return digest.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_invalid")


@query("op9_bpe_stream")
def op9(spark, d):
    encoded = bpe_stream.encode_documents(read(spark, d, "documents"), public_tokenizers.path(TOKENIZER))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op10_substring_dedup")
def op10(spark, d):
    return substring_dedup.remove_repeats(read(spark, d, "documents"), digest=True)


_OP12 = r"""
WITH RECURSIVE
t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
l AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::BIGINT) % 20 AS lot FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'g' END AS fault FROM o),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM f GROUP BY 1),
b AS (SELECT conv_id, count(*) FILTER (y IS NOT NULL AND x || y NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, x, lead(x) OVER (PARTITION BY conv_id ORDER BY i) AS y FROM f) GROUP BY 1),
z AS (SELECT conv_id, n AS i, [{'c': 0, 'a': '', 'r': []::VARCHAR[]}, {'c': 10, 'a': 'II', 'r': ['user:', 'assistant:']}, {'c': 5, 'a': 'I', 'r': ['assistant:']}, {'c': 0, 'a': '', 'r': []::VARCHAR[]}] AS s FROM n
      UNION ALL
      SELECT conv_id, i - 1, [list_min([m[1], {'c': 5 + m[3].c, 'a': 'I' || m[3].a, 'r': list_prepend('user:', m[3].r)}]), list_min([m[2], {'c': 5 + m[3].c, 'a': 'I' || m[3].a, 'r': list_prepend('user:', m[3].r)}]), m[3], m[4]]
      FROM (SELECT conv_id, i, [e[1], e[2], list_min([e[3], {'c': 5 + e[4].c, 'a': 'I' || e[4].a, 'r': list_prepend('assistant:', e[4].r)}]), list_min([e[4], {'c': 5 + e[3].c, 'a': 'I' || e[3].a, 'r': list_prepend('user:', e[3].r)}])] AS m
        FROM (SELECT z.conv_id, z.i, list_transform([1, 2, 3, 4], lambda q: list_min(list_filter([
            {'c': 2 + s[q].c, 'a': 'D' || s[q].a, 'r': s[q].r},
            CASE WHEN fault IN ('g', 't') THEN {'c': 1 + CASE fault WHEN 't' THEN 5 ELSE 0 END + s[CASE q WHEN 3 THEN 4 ELSE 3 END].c, 'a': 'R' || s[CASE q WHEN 3 THEN 4 ELSE 3 END].a,
                 'r': list_prepend(CASE q WHEN 3 THEN 'assistant:' ELSE 'user:' END || text, s[CASE q WHEN 3 THEN 4 ELSE 3 END].r)} END,
            CASE WHEN fault IN ('g', 't') AND ((q = 1 AND x = 's') OR (q <> 3 AND x = 'u') OR (q = 3 AND x = 'a')) THEN {'c': CASE fault WHEN 't' THEN 5 ELSE 0 END + s[CASE x WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c,
                 'a': 'K' || s[CASE x WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a, 'r': list_prepend(role || ':' || text, s[CASE x WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].r)} END], lambda y: y IS NOT NULL))) AS e
          FROM z JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.i = z.i))),
w AS (SELECT conv_id, s[1] AS s FROM z WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s.c, 0)::BIGINT AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op12_conversation_repair", _OP12)
def op12(spark, d):
    rows = conversation_repair.damaged(read(spark, d, "conversations"))
    return conversation_repair.summarise(conversation_repair.repair(rows.where("NOT dropped"), rows.where("dropped")))


_OP13 = """
WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INT) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) <= 3
"""


@query("op13_hard_negatives", _OP13)
def op13(spark, d):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, d, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


@query("op11_quality_network")
def op11(spark, d):
    docs = read(spark, d, "documents")
    table = quality_net.word_table(docs)
    scored = quality_net.score_documents(docs, table, quality_net.fit(docs, read(spark, d, "labels"), table))
    return scored.select("doc_id", (quality_net.fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")
