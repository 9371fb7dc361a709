"""Queries of the de-identification engine over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import checksums as C
from veilspan.operators import detection as D
from veilspan.operators import evaluation as E
from veilspan.operators import masking as M
from veilspan.plans.detection_sql import DETECT_SPANS, MASK_DOCUMENTS
from veilspan.sources.staging import staged


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("body"))


def detect_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved spans of all rules in all documents."""
    return D.resolve(D.candidates(_docs(spark, sf_dir))).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text", "label")


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    # the registry and the masking both read the spans: detection runs once
    found = staged(D.resolve(D.candidates(docs)), "spans")
    masked = M.mask(docs, found, M.registry(found))
    return masked.select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), "n_replaced")


def checksum_inn(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat("body", (F.col("o_orderkey") % 10).cast("string"))
    return _ids(spark, sf_dir).select("o_orderkey", C.valid_inn(value).alias("ok"))


def checksum_snils(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat("body", F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"))
    return _ids(spark, sf_dir).select("o_orderkey", C.valid_snils(value).alias("ok"))


def checksum_ogrn(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("102"), "body", (F.col("o_orderkey") % 10).cast("string"))
    return _ids(spark, sf_dir).select("o_orderkey", C.valid_ogrn(value).alias("ok"))


def checksum_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("400000"), "body", (F.col("o_orderkey") % 10).cast("string"))
    return _ids(spark, sf_dir).select("o_orderkey", C.valid_luhn(value).alias("ok"))


def document_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(E.split_of(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("split")).agg(F.count("*").alias("n"))


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("start"), (F.col("event_id") + 5).alias("end"), (F.col("event_id") % 3).cast("string").alias("layout"), F.col("event_type").alias("label"))
    p = e.where("start % 7 <> 0").withColumn("label", F.when(F.col("start") % 7 == 1, "other").otherwise(F.col("label"))).withColumn("end", F.when(F.col("start") % 7 == 2, F.col("end") + 1).otherwise(F.col("end")))
    return e, p


def gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.span_metrics(*_gold(spark, sf_dir))
    return out.select("scope", "name", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def gold_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(*_gold(spark, sf_dir))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 candidates of each label: a review queue's own length."""
    return E.top_per_label(_gold(spark, sf_dir)[0], 200, "doc_id", "start", "end")


def label_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _gold(spark, sf_dir)
    return E.deficits(p, g, 3000)


QUERIES = {f.__name__: f for f in (detect_spans, mask_documents, checksum_inn, checksum_snils, checksum_ogrn, checksum_luhn, document_splits, gold_metrics, gold_confusion, review_queue, label_deficits)}

_D = "CAST(substr(v, {}, 1) AS INT)"


def _sum(weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * {_D.format(i + 1)}" for i, w in enumerate(weights)) + ")"


_IDS = "SELECT o_orderkey, {} AS v FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS body FROM orders)"
_GOLD = """e AS (SELECT user_id AS doc_id, event_id AS start, event_id + 5 AS "end", CAST(event_id % 3 AS VARCHAR) AS layout, event_type AS label FROM events),
p AS (SELECT doc_id, start, CASE WHEN start % 7 = 2 THEN "end" + 1 ELSE "end" END AS "end", layout, CASE WHEN start % 7 = 1 THEN 'other' ELSE label END AS label FROM e WHERE start % 7 <> 0)"""
_LUHN = " + ".join(f"(CASE WHEN {_D.format(i)} * {2 if i % 2 else 1} > 9 THEN {_D.format(i)} * 2 - 9 ELSE {_D.format(i)} * {2 if i % 2 else 1} END)" for i in range(1, 17))

ORACLE = {
    "detect_spans": DETECT_SPANS,
    "mask_documents": MASK_DOCUMENTS,
    "checksum_inn": f"SELECT o_orderkey, {_sum([2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = {_D.format(10)} AS ok FROM ({_IDS.format('body || CAST(o_orderkey % 10 AS VARCHAR)')})",
    "checksum_snils": f"SELECT o_orderkey, {_sum(list(range(9, 0, -1)))} % 101 % 100 = CAST(substr(v, 10, 2) AS INT) AS ok FROM ({_IDS.format('body || lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, chr(48))')})",
    "checksum_ogrn": f"SELECT o_orderkey, CAST(substr(v, 1, 12) AS BIGINT) % 11 % 10 = {_D.format(13)} AS ok FROM ({_IDS.format(chr(39) + '102' + chr(39) + ' || body || CAST(o_orderkey % 10 AS VARCHAR)')})",
    "checksum_luhn": f"SELECT o_orderkey, ({_LUHN}) % 10 = 0 AS ok FROM ({_IDS.format(chr(39) + '400000' + chr(39) + ' || body || CAST(o_orderkey % 10 AS VARCHAR)')})",
    "document_splits": "SELECT CASE WHEN b >= 80 THEN 'test' WHEN b >= 70 THEN 'dev' ELSE 'train' END AS split, count(*) AS n FROM (SELECT CAST(('0x' || substr(sha256(coalesce(text, '')), 1, 8)) AS BIGINT) % 100 AS b FROM documents) GROUP BY 1",
    "gold_metrics": f"""WITH {_GOLD}, g AS (SELECT doc_id, start, "end", layout, label, count(*) AS g FROM e GROUP BY ALL), q AS (SELECT doc_id, start, "end", layout, label, count(*) AS p FROM p GROUP BY ALL),
b AS (SELECT label, layout, least(coalesce(g, 0), coalesce(p, 0)) AS tp, greatest(coalesce(p, 0) - coalesce(g, 0), 0) AS fp, greatest(coalesce(g, 0) - coalesce(p, 0), 0) AS fn FROM g FULL JOIN q USING (doc_id, start, "end", layout, label)),
s AS (SELECT 'micro' AS scope, '' AS name, * EXCLUDE (label, layout) FROM b UNION ALL SELECT 'entity', label, * EXCLUDE (label, layout) FROM b UNION ALL SELECT 'layout', layout, * EXCLUDE (label, layout) FROM b),
t AS (SELECT scope, name, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM s GROUP BY ALL),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re FROM t)
SELECT scope, name, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1 FROM r""",
    "gold_confusion": f"""WITH {_GOLD}, g AS (SELECT doc_id, start, "end", layout, max(label) AS label FROM e GROUP BY ALL) SELECT g.label AS gold_label, p.label AS predicted_label, count(*) AS n FROM g JOIN p USING (doc_id, start, "end", layout) WHERE g.label <> p.label GROUP BY ALL""",
    "review_queue": f"""WITH {_GOLD} SELECT doc_id, start, "end", layout, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id, start, "end") AS r FROM e) WHERE r <= 200""",
    "label_deficits": f"""WITH {_GOLD} SELECT label, coalesce(a, 0) AS available, coalesce(d, 0) AS documents, greatest(3000 - coalesce(a, 0), 0) AS deficit FROM (SELECT DISTINCT label FROM e) LEFT JOIN (SELECT label, count(*) AS a, count(DISTINCT doc_id) AS d FROM p GROUP BY label) USING (label)""",
}
