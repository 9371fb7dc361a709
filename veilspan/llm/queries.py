"""The operators over whole tables, with fixed results, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.llm.sstable import token_index

    return token_index(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0).drop("shard")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096)


def _classified(scored: DataFrame, fold, score: str, least: float) -> DataFrame:
    return scored.select("doc_id", fold.alias("held_out"), F.col(score).alias("score"), (F.col(score) >= least).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.llm.quality import fit_quality, score_quality
    from veilspan.llm.scoring import learned_fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), modulus=4, held_out=2)
    return _classified(score_quality(docs, model, "s"), ~learned_fold(4, 2), "s", 0.7)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.llm.chat import format_conversations, loss_text, parse_formatted

    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = format_conversations(turns).select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars")
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.llm.vectors import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.llm.decontaminate import find_contamination, hit_words, items_digest

    found, c = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_items = F.size(c["items"]).cast("long")
    return found.select("doc_id", F.col(c["n_words"]).alias("n_words"), hit_words(F.col(c["stretches"])).alias("n_hit"), n_items.alias("n_items"), items_digest(F.col(c["items"])).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.llm.scoring import learned_fold
    from veilspan.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), modulus=5, held_out=0)
    return _classified(score_toxicity(docs, model, "s"), ~learned_fold(5, 0), "s", 0.5)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=0, capacity=2048)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_token_shards, op2_warc, op3_token_counts, op4_quality, op5_chat, op6_minhash, op7_vectors, op8_decontamination, op9_toxicity, op10_packing, pipeline)
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: 40 hex digits are eight groups of five: a group's 20 bits are four base-32 digits.
_BASE32_OF_SHA1 = f"""list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform(range(0, 4), lambda k: substr('{_BASE32}', 1 + CAST(
  (CAST(('0x' || substr(sha1, 1 + 5 * g, 5)) AS BIGINT) >> (15 - 5 * k)) & 31 AS BIGINT), 1)), lambda a, b: a || b)), lambda a, b: a || b)"""

_COMPONENTS = """
reach(a, b) AS (SELECT id, id FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

ORACLE: dict[str, str] = {
    "op2_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha1 FROM pages),
d AS (SELECT html, max(page_id) AS latest FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, {_BASE32_OF_SHA1} AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM p JOIN d ON p.html = d.html""",
    "op5_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, role = 'assistant' AS a, length(regexp_replace(replace(text, '\', '\\'), '</?s>|<(image|audio|document)_\d+>|\[/?INST\]|\[ROLE\]', '#\0', 'g')) AS n,
  length(regexp_replace(replace(role, '\', '\\'), '</?s>|<(image|audio|document)_\d+>|\[/?INST\]|\[ROLE\]', '#\0', 'g')) AS r FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (a), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (a), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN a THEN 7 ELSE r + 19 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id AS id, len(s) AS n FROM s),
node AS (SELECT id FROM n),
x AS (SELECT DISTINCT doc_id AS id, unnest(s) AS sh FROM s),
common AS (SELECT p.id AS a, q.id AS b, count(*) AS k FROM x p JOIN x q ON p.sh = q.sh AND p.id <> q.id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),"""
    + _COMPONENTS
    + "SELECT n.id AS doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id, n.id = component_id AS kept FROM n JOIN comp USING (id)",
    "op7_vectors": """
WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
node AS (SELECT id FROM v),
link AS (SELECT p.id AS a, q.id AS b FROM good p JOIN good q ON p.id <> q.id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.9),"""
    + _COMPONENTS
    + """, k AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN k USING (id)""",
    "op8_decontamination": r"""
WITH dw AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT id AS item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM (SELECT id, w, least(8, len(w)) AS n FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, sizes WHERE len(w) >= n),
hit AS (SELECT DISTINCT p.id, p.i, p.n, item FROM place p JOIN win ON win.n = p.n AND win.win = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
word AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY id),
item AS (SELECT id, count(*) AS n_items, string_agg(CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS items FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id)
SELECT dw.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN word USING (id) LEFT JOIN item USING (id)""",
}
