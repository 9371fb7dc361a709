"""Queries of sources, exports, page regions, review and gold tasks over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import regions as R
from veilspan.operators import gold as G
from veilspan.operators import reconcile as X
from veilspan.operators import refinement as N
from veilspan.operators import review as V
from veilspan.operators import synthetic as S
from veilspan.sources import exports, files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's text could stand for two pages."""
    return _table(spark, sf_dir, "documents").select("doc_id", R.text_quality(F.col("text"), F.lit(2)).alias("verdict"))


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 700).alias("x"), (F.col("o_orderkey") % 900).alias("y"), (F.col("o_orderkey") % 130).alias("c"))
    box = R.box(F.array(F.col("x") + 50, F.col("x")), F.array("y", F.col("y") + 20), F.lit(640), F.lit(800), from_bottom=True)
    rows = rows.select("o_orderkey", box.alias("b"), R.confidence(F.col("c")).alias("c"))
    return rows.select("o_orderkey", *[F.round(f"b.{c}", 9).alias(c) for c in ("x1", "y1", "x2", "y2")], F.round("c", 9).alias("confidence"))


def document_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _table(spark, sf_dir, "documents").select("doc_id", files.fragments(F.col("text"), 500).alias("f"))
    return cut.select("doc_id", F.size("f").cast("long").alias("n"), F.sha2(F.array_join("f", "|"), 256).alias("digest"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of up to 30,000 characters of every text."""
    cut = files.chunks(_table(spark, sf_dir, "documents"))
    return cut.select(F.col("doc_id").cast("long").alias("doc_id"), "start", F.sha2("text", 256).alias("digest"))


def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as Markdown."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(exports.markdown(F.col("text")), 256).alias("digest"))


def escaped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", exports.escape_cell(F.concat(F.lit(" |\n"), F.col("o_orderstatus"), F.lit("  | x "))).alias("cell"))


def document_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address of mail and telephone number in all documents."""
    return N.contacts(_table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "text", "label")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 5 == 0, "accepted").when(F.col("event_id") % 5 == 1, "rejected")
    return V.findings(e.select(F.concat(F.lit("d"), "user_id").alias("document_ref"), F.col("event_id").alias("location"), F.col("event_type").alias("entity_type"), F.lit("[X_1]").alias("placeholder"), (F.col("event_id") % 100 / 100).alias("confidence"), status.alias("status")))


def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a confidence of 50 % and more, the pending ones skipped by one decision."""
    return V.filtered(V.decide(_findings(spark, sf_dir), "skipped", least=80), least=50).select("finding_id", "document_ref", "status")


def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(_findings(spark, sf_dir))


def review_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.by_entity_type(_findings(spark, sf_dir))


def gold_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of all events (every seventh span is void), every third decided."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("start"), (F.col("event_id") + F.when(F.col("event_id") % 7 == 0, 0).otherwise(5)).alias("end"), F.col("event_type").alias("label"), F.lit("prose").alias("layout"))
    tasks, _ = G.import_candidates(e.unionByName(e), e)
    done = tasks.where("start % 3 = 0").select("task_id", F.lit("accepted").alias("decision"))
    return G.annotate(tasks, done).select("task_id", "doc_id", "status")


def gold_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("start"), (F.col("event_id") + F.when(F.col("event_id") % 7 == 0, 0).otherwise(5)).alias("end"), F.col("event_type").alias("label"), F.lit("prose").alias("layout"))
    return G.import_candidates(e.unionByName(e), e.where("event_type <> 'click'"))[1]


def synthetic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid identifiers made from every order's key."""
    i = F.col("o_orderkey")
    nine = F.lpad(i.cast("string"), 9, "0")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", S.with_tax_digit(nine).alias("tax"), S.with_registration_digit(F.concat(F.lit("102"), nine)).alias("registration"), S.with_insurance_digits(nine).alias("insurance"),
        S.digest_number("seed", "CARD", i, 9).alias("digest"), S.split_of_index(i % 200).alias("split"),
    )


def synthetic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label"), (i % 6 == 0).alias("negative"), S.split_of_index(i % 200).alias("split"))
    return G.coverage(rows)


def reconciled_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with every address of the network kind that stands in any of them replaced."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    shape = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(shape), F.lit(0))).alias("original")).distinct()
    named = found.select(F.lit("IP_ADDRESS").alias("label"), "original", F.concat(F.lit("[IP_ADDRESS_"), F.crc32(F.col("original").cast("binary")), F.lit("]")).alias("token"), F.crc32(F.col("original").cast("binary")).alias("number"))
    return X.reconcile(docs, named).select("doc_id", F.sha2("text", 256).alias("digest"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        text_gate, region_boxes, document_fragments, document_chunks, document_markdown, document_contacts, escaped_cells, review_findings, review_summary, review_by_type, gold_tasks, gold_left_out, synthetic_ids,
        synthetic_coverage, reconciled_addresses,
    )
}

_FINDINGS = """f AS (SELECT 'd' || user_id AS document_ref, CAST(event_id AS VARCHAR) AS location, upper(event_type) AS entity_type, event_id % 100 / 100 AS confidence,
CASE event_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM events)"""
_TASKS = """e AS (SELECT DISTINCT user_id AS doc_id, event_id AS start, event_id + CASE WHEN event_id % 7 = 0 THEN 0 ELSE 5 END AS "end", event_type AS label FROM events)"""
_D = "CAST(substr(b, {}, 1) AS INT)"
_TAX = " + ".join(f"{w} * {_D.format(i + 1)}" for i, w in enumerate((2, 4, 10, 3, 5, 9, 4, 6, 8)))
_INSURANCE = " + ".join(f"{9 - i} * {_D.format(i + 1)}" for i in range(9))
_SPLIT = "CASE WHEN o_orderkey % 200 < 140 THEN 'train' WHEN o_orderkey % 200 < 170 THEN 'dev' ELSE 'test' END"
_CLAMP = "round(least(greatest({}, 0.0), 1.0), 9)"

_ITEM = r"(?:[0-9]+(?:\.[0-9]+)*\.?|[а-яёa-z]\)|-|•|\*)\s+"

ORACLE = {
    "document_fragments": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents),
f AS (SELECT doc_id, flatten(list_transform(p, lambda x: list_transform(range(0, CAST(ceil(length(x) / 500) AS BIGINT)), lambda i: x[i * 500 + 1:(i + 1) * 500]))) AS f FROM p)
SELECT doc_id, CAST(len(f) AS BIGINT) AS n, sha256(array_to_string(f, '|')) AS digest FROM f""",
    "document_chunks": """WITH RECURSIVE c(doc_id, t, start, stop) AS (SELECT doc_id, text, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, t, stop, CASE WHEN stop + 30000 >= length(t) THEN length(t) WHEN strpos(reverse(t[stop + 2:stop + 30000]), chr(10)) > 0 THEN stop + 30000 - strpos(reverse(t[stop + 2:stop + 30000]), chr(10))
  WHEN strpos(reverse(t[stop + 2:stop + 30000]), ' ') > 0 THEN stop + 30000 - strpos(reverse(t[stop + 2:stop + 30000]), ' ') ELSE stop + 30000 END FROM c WHERE stop < length(t))
SELECT doc_id, start, sha256(t[start + 1:stop]) AS digest FROM c WHERE stop > start UNION ALL SELECT doc_id, CAST(0 AS BIGINT), sha256('') FROM documents WHERE text = ''""",
    "document_markdown": rf"""WITH b AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\n\s*\n+'), lambda x: regexp_matches(x, '\S')) AS b FROM documents),
l AS (SELECT doc_id, text, list_transform(b, lambda x: struct_pack(x := x, l := list_filter(list_transform(regexp_split_to_array(x, '\r\n|[\n\r]'), lambda y: trim(y)), lambda y: y <> ''))) AS b FROM b),
m AS (SELECT doc_id, text, list_transform(b, lambda x: CASE WHEN contains(x.x, '|') THEN array_to_string(x.l, chr(10)) || chr(10) WHEN regexp_matches(array_to_string(x.l, ' '), '^(?:{exports.TITLES})(?:$|[^\p{{L}}\p{{N}}_])') THEN '## ' || array_to_string(x.l, ' ') || chr(10)
  WHEN regexp_matches(array_to_string(x.l, ' '), '^{_ITEM}') THEN '- ' || array_to_string(x.l, ' ') ELSE array_to_string(x.l, ' ') || chr(10) END) AS m FROM l)
SELECT doc_id, sha256(CASE WHEN text = '' THEN '' ELSE regexp_replace(array_to_string(m, chr(10)), '^\s+|\s+$', '', 'g') || chr(10) END) AS digest FROM m""",
    "document_contacts": f"""WITH k(label, p) AS (VALUES {', '.join("('" + k + "', '" + p + "')" for k, p in N.CONTACTS.items())}),
m AS (SELECT doc_id, label, regexp_extract_all(text, p) AS f, regexp_split_to_array(text, p) AS g FROM documents, k WHERE text IS NOT NULL),
s AS (SELECT doc_id, label, f, g, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0)
SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS INT) AS start,
CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(f[1:i], lambda x: length(x))) AS INT) AS "end", f[i] AS text, label FROM s""",
    "text_gate": r"""WITH a AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s,
list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
b AS (SELECT *, list_filter(l, lambda x: NOT regexp_full_match(x, '(?i)scanned (?:with|by) \S.*')) AS i, length(regexp_replace(s, '[^\p{L}\p{N}]', '', 'g')) AS k FROM a)
SELECT doc_id, CASE WHEN s = '' THEN 'empty' WHEN length(s) < 20 OR k / length(s) < 0.25 THEN 'unreadable' WHEN len(i) = 0 THEN 'watermark'
WHEN length(regexp_replace(array_to_string(i, ' '), '[^\p{L}\p{N}]', '', 'g')) < 40 THEN 'sparse'
WHEN length(regexp_replace(array_to_string(list_distinct(list_transform(i, lambda x: lower(x))), ' '), '[^\p{L}\p{N}]', '', 'g')) < 30 THEN 'repeated' ELSE 'ok' END AS verdict FROM b""",
    "region_boxes": f"""SELECT o_orderkey, {_CLAMP.format('o_orderkey % 700 / 640')} AS x1, {_CLAMP.format('1 - (o_orderkey % 900 + 20) / 800')} AS y1, {_CLAMP.format('(o_orderkey % 700 + 50) / 640')} AS x2,
{_CLAMP.format('1 - o_orderkey % 900 / 800')} AS y2, {_CLAMP.format('CASE WHEN o_orderkey % 130 BETWEEN 2 AND 100 THEN o_orderkey % 130 / 100 ELSE CAST(o_orderkey % 130 AS DOUBLE) END')} AS confidence FROM orders""",
    "escaped_cells": r"SELECT o_orderkey, '\| ' || o_orderstatus || ' \| x' AS cell FROM orders",
    "review_findings": f"""WITH {_FINDINGS} SELECT substr(sha256(document_ref || chr(31) || location || chr(31) || entity_type || chr(31) || '[X_1]'), 1, 20) AS finding_id, document_ref,
CASE WHEN status = 'pending' AND confidence >= 0.8 THEN 'skipped' ELSE status END AS status FROM f WHERE confidence >= 0.5""",
    "review_summary": f"""WITH {_FINDINGS} SELECT s AS status, CAST((SELECT count(*) FROM f WHERE s IN (f.status, 'total')) AS BIGINT) AS n FROM unnest(['pending', 'accepted', 'rejected', 'skipped', 'total']) AS t(s)""",
    "review_by_type": f"WITH {_FINDINGS} SELECT entity_type, count(*) AS n FROM f GROUP BY 1",
    "gold_tasks": f"""WITH {_TASKS} SELECT sha256(doc_id || chr(31) || start || chr(31) || "end" || chr(31) || 'prose' || chr(31) || label) AS task_id, doc_id, CASE WHEN start % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status FROM e WHERE start % 7 <> 0""",
    "gold_left_out": """WITH a AS (SELECT * FROM events UNION ALL SELECT * FROM events), r AS (SELECT CASE WHEN user_id IS NULL THEN 'document' WHEN event_type = 'click' OR event_type IS NULL THEN 'label' WHEN event_id % 7 = 0 THEN 'span' END AS reason, * FROM a)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'duplicate', CAST(count(*) - count(DISTINCT (user_id, event_id, event_type)) AS BIGINT) FROM r WHERE reason IS NULL""",
    "synthetic_ids": f"""SELECT o_orderkey, b || (({_TAX}) % 11 % 10) AS tax, '102' || b || (CAST('102' || b AS BIGINT) % 11 % 10) AS registration,
substr(b, 1, 3) || '-' || substr(b, 4, 3) || '-' || substr(b, 7, 3) || ' ' || lpad(CAST(({_INSURANCE}) % 101 % 100 AS VARCHAR), 2, '0') AS insurance,
CAST(CAST('0x' || substr(sha256('seed:CARD:' || o_orderkey), 1, 16) AS UBIGINT) % 1000000000 AS BIGINT) AS digest, {_SPLIT} AS split FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS b FROM orders)""",
    "synthetic_coverage": f"""SELECT label, count(*) FILTER (NOT neg) AS positive, count(*) FILTER (neg) AS negative, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test
FROM (SELECT o_orderstatus AS label, o_orderkey % 6 = 0 AS neg, {_SPLIT} AS split FROM orders) GROUP BY 1""",
}
