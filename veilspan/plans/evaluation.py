"""Queries of the evaluation, gold rows, records and certificates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import evaluation as E
from veilspan.operators import gold as G
from veilspan.operators import records as R
from veilspan.plans.queries import _GOLD, _gold


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ("click", "view", "purchase", "signup", "other", "never")], "label string")


def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _gold(spark, sf_dir)
    return E.macro_metrics(E.span_metrics(g, p), _labels(spark)).select("scope", "entities", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _gold(spark, sf_dir)
    return E.safe_rows(E.unmatched(p, g))


def false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _gold(spark, sf_dir)
    return E.unmatched(g, p).select("doc_id", "start", "end", "layout", "label")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _events(spark, sf_dir).select(
        F.concat(F.when(i % 3 == 0, "doc_").otherwise("/home/a/"), F.lpad(F.hex(F.col("user_id")), 8, "0")).alias("doc_id"), i.alias("start"), (i + i % 7).alias("end"), F.col("event_type").alias("label"),
        F.element_at(F.array(*map(F.lit, ("xlsx", "scan", "", "prose", "table"))), (i % 5 + 1).cast("int")).alias("layout"), F.element_at(F.array(*map(F.lit, ("accepted", "rejected", "accepted", "pending", "odd"))), (i % 5 + 1).cast("int")).alias("status"),
        F.when(i % 4 == 0, "unsure").otherwise("confirmed").alias("annotator_status"), (i % 11 != 0).alias("real"), F.when(i % 13 == 0, True).alias("synthetic"), i.alias("line"), F.sha2(i.cast("string"), 256).alias("text_sha256"),
    )


def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gold_coverage(_marked(spark, sf_dir), _labels(spark), 500)


def gold_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage_totals(E.gold_coverage(_marked(spark, sf_dir), _labels(spark), 500))


def gold_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.manifest(_marked(spark, sf_dir), "line")


def label_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.layouts_by_label(_marked(spark, sf_dir))


def gold_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), (F.col("event_id") * 37 % 400).alias("start"), (F.col("event_id") * 37 % 400 + 4 + F.col("event_id") % 30).alias("end"), F.col("event_id").alias("line"))
    return E.overlapping(rows)


def gold_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir).withColumns({
        "schema_version": F.when(F.col("line") % 17 == 0, "v0").otherwise(G.VERSIONS[0]), "task_id": F.when(F.col("line") % 19 != 0, F.col("line")), "source_sha256": F.when(F.col("line") % 23 == 0, "x").otherwise(F.col("text_sha256")),
        "surface_policy": F.lit("hash_only"), "surface_sha256": F.when(F.col("line") % 2 == 0, F.col("text_sha256")), "annotator_id": F.lit("a1"),
    })
    known = F.array(*map(F.lit, ("click", "view", "purchase")))
    return rows.select("line", F.array_join(G.gold_errors(known), ",").alias("errors"))


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("path"), "text")
    n = F.char_length("text")
    spans = docs.where(n >= 40).select("doc_id", F.explode(F.array(F.struct(F.lit(3).alias("start"), F.lit(9).alias("end"), F.lit("A").alias("label")), F.struct(F.lit(20).alias("start"), F.lit(31).alias("end"), F.lit("B").alias("label")))).alias("s"))
    return docs, spans.select("doc_id", "s.*")


def candidate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all documents with two spans each."""
    docs, spans = _spans(spark, sf_dir)
    r = R.annotations(spans, docs)
    joined = F.array_join(F.transform("annotations", lambda a: F.concat_ws(":", a["id"], a["start"].cast("string"), a["label"], a["surface_sha256"], a["surface_length"].cast("string"))), ",")
    return r.select("document_id", "doc_id", "text_length", "text_sha256", joined.alias("annotations"), "masked_text_sha256")


def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the records against their texts: every fifth text is changed, every seventh label unknown."""
    docs, spans = _spans(spark, sf_dir)
    spans = spans.withColumn("label", F.when(F.col("doc_id") % 7 == 0, "Q").otherwise(F.col("label")))
    r = R.annotations(spans, docs).join(docs.select(F.col("doc_id").alias("_id"), "text"), F.col("doc_id") == F.col("_id"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("#"), "text")).otherwise(F.col("text"))
    return r.select("doc_id", F.array_join(R.record_errors(F.array(F.lit("A"), F.lit("B")), text), ",").alias("errors"))


def audit_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A certificate of each user's events."""
    e = _events(spark, sf_dir)
    outputs = e.groupBy(F.concat(F.lit("u"), "user_id").alias("path")).agg(F.sha2(F.max("event_id").cast("string"), 256).alias("input_sha256"), F.count("*").alias("input_bytes"), F.sha2(F.min("event_id").cast("string"), 256).alias("output_sha256"), F.max("event_id").alias("output_bytes"))
    counts = e.groupBy(F.concat(F.lit("u"), "user_id").alias("path"), F.upper("event_type").alias("entity_type")).agg(F.count("*").alias("n"))
    return R.certificates(outputs, counts, "r1", F.lit("2024-01-01T00:00:00Z"))


def review_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces and surroundings of all spans, every third with a wrong hash."""
    docs, spans = _spans(spark, sf_dir)
    surface = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    queue = spans.join(docs, "doc_id").select("doc_id", "start", "end", "label", F.when(F.col("doc_id") % 3 == 0, "no").otherwise(F.sha2(surface, 256)).alias("surface_sha256"))
    return G.review_rows(queue, docs, 10).select("doc_id", "label", "surface", "context")


QUERIES = {
    f.__name__: f
    for f in (macro_scores, false_positives, false_negatives, gold_coverage, gold_totals, gold_manifest, label_layouts, gold_overlaps, gold_row_errors, candidate_records, record_checks, audit_certificates, review_contexts)
}

_LABELS = "l AS (SELECT unnest(['click', 'view', 'purchase', 'signup', 'other', 'never']) AS label)"
_MARKED = """r AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'doc_' ELSE '/home/a/' END || lpad(upper(to_hex(user_id)), 8, '0') AS doc_id, event_id AS start, event_id + event_id % 7 AS "end", event_type AS label,
['table', 'ocr', 'text', 'text', 'table'][event_id % 5 + 1] AS layout, ['accepted', 'rejected', 'accepted', 'pending', 'odd'][event_id % 5 + 1] AS status, event_id AS line, sha256(CAST(event_id AS VARCHAR)) AS h,
event_id % 4 <> 0 AS sure, event_id % 11 <> 0 AS real, event_id % 13 = 0 AS synthetic FROM events)"""
_ACCEPTED = "a AS (SELECT * FROM r WHERE status = 'accepted' AND sure AND real AND NOT synthetic)"
_SAFE = "CASE WHEN regexp_full_match({0}, '(?i)(?:doc|document|file)[_-][a-f0-9]{{8,64}}') THEN {0} ELSE 'docref_' || substr(sha256({0}), 1, 24) END"
_COVERED = f"{_MARKED}, {_ACCEPTED}, {_LABELS}, c AS (SELECT label, (SELECT count(*) FROM a WHERE a.label = l.label) AS confirmed FROM l)"
_D = "d AS (SELECT doc_id, coalesce(text, '') AS t, 'doc_' || substr(sha256('d/' || doc_id || '.txt' || chr(0) || coalesce(text, '')), 1, 12) AS id FROM documents)"
# the longer surface goes first
_MASK = "replace(replace(t[1:3] || '[A]' || t[10:20] || '[B]' || t[32:], t[21:31], '[B]'), t[4:9], '[A]')"

ORACLE = {
    "macro_scores": f"""WITH {_GOLD}, {_LABELS}, g AS (SELECT doc_id, start, "end", layout, label, count(*) AS g FROM e GROUP BY ALL), q AS (SELECT doc_id, start, "end", layout, label, count(*) AS p FROM p GROUP BY ALL),
b AS (SELECT label, CAST(sum(least(coalesce(g, 0), coalesce(p, 0))) AS BIGINT) AS tp, CAST(sum(coalesce(g, 0)) AS BIGINT) AS g, CAST(sum(coalesce(p, 0)) AS BIGINT) AS p FROM g FULL JOIN q USING (doc_id, start, "end", layout, label) GROUP BY 1),
s AS (SELECT label, CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS pr, CASE WHEN g > 0 THEN tp / g ELSE 0.0 END AS re, coalesce(g, 0) + coalesce(p, 0) AS n FROM l LEFT JOIN b USING (label)),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS f1 FROM s), u AS (SELECT 'macro' AS scope, * FROM f UNION ALL SELECT 'supported', * FROM f WHERE n > 0)
SELECT scope, count(*) AS entities, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(f1), 6) AS f1 FROM u GROUP BY 1""",
    "false_positives": f"""WITH {_GOLD} SELECT 'docref_' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 24) AS document_id, start, "end", label, 'text' AS layout FROM p ANTI JOIN e USING (doc_id, start, "end", layout, label)""",
    "false_negatives": f"""WITH {_GOLD} SELECT doc_id, start, "end", layout, label FROM e ANTI JOIN p USING (doc_id, start, "end", layout, label)""",
    "gold_coverage": f"WITH {_COVERED} SELECT label, confirmed, CAST(500 AS BIGINT) AS required, confirmed >= 500 AS complete FROM c",
    "gold_totals": f"WITH {_COVERED} SELECT count(*) AS entities, count(*) FILTER (confirmed >= 500) AS complete_entities, bool_and(confirmed >= 500) AS all_complete, CAST(sum(confirmed) AS BIGINT) AS confirmed FROM c",
    "gold_manifest": f"WITH {_MARKED}, m AS (SELECT doc_id, arg_max(h, line) AS digest FROM r GROUP BY 1), b AS (SELECT *, CAST(('0x' || substr(digest, 1, 8)) AS BIGINT) % 100 AS b FROM m) SELECT doc_id, digest, CASE WHEN b >= 80 THEN 'test' WHEN b >= 70 THEN 'dev' ELSE 'train' END AS split FROM b",
    "label_layouts": f"""WITH {_MARKED} SELECT label, count(*) FILTER (layout = 'text') AS text, count(*) FILTER (layout = 'table') AS "table", count(*) FILTER (layout = 'ocr') AS ocr FROM r GROUP BY 1""",
    "gold_overlaps": """WITH r AS (SELECT user_id AS doc_id, event_id * 37 % 400 AS start, event_id * 37 % 400 + 4 + event_id % 30 AS "end", event_id AS line FROM events),
w AS (SELECT *, max("end") OVER s AS earlier_end, max(("end", -line)) OVER s AS m FROM r WINDOW s AS (PARTITION BY doc_id ORDER BY start, "end", line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, start, "end", line, earlier_end, -m[2] AS earlier_line FROM w WHERE start < earlier_end""",
    "gold_row_errors": f"""WITH {_MARKED} SELECT line, concat_ws(',', CASE WHEN line % 17 = 0 THEN 'schema_version' END, CASE WHEN line % 19 = 0 THEN 'task_id' END, CASE WHEN line % 23 = 0 THEN 'source_sha256' END, CASE WHEN NOT real THEN 'real' END, CASE WHEN line % 7 = 0 THEN 'span' END,
CASE WHEN label NOT IN ('click', 'view', 'purchase') THEN 'label' END, CASE WHEN status = 'accepted' AND line % 2 = 1 THEN 'accepted_surface' END, CASE WHEN status = 'odd' THEN 'status' END, CASE WHEN status = 'accepted' AND NOT sure THEN 'annotator' END) AS errors FROM r""",
    "candidate_records": f"""WITH {_D} SELECT id AS document_id, doc_id, CAST(length(t) AS INT) AS text_length, sha256(t) AS text_sha256,
CASE WHEN length(t) >= 40 THEN id || ':a0001:3:A:' || sha256(t[4:9]) || ':6,' || id || ':a0002:20:B:' || sha256(t[21:31]) || ':11' ELSE '' END AS annotations, sha256(CASE WHEN length(t) >= 40 THEN {_MASK} ELSE t END) AS masked_text_sha256 FROM d""",
    "record_checks": f"""WITH {_D} SELECT doc_id, concat_ws(',', CASE WHEN length(t) >= 40 AND doc_id % 7 = 0 THEN 'label' END, CASE WHEN doc_id % 5 = 0 THEN 'source_length,source_hash' END,
CASE WHEN doc_id % 5 = 0 AND length(t) >= 40 AND (t[3:8] <> t[4:9] OR t[20:30] <> t[21:31]) THEN 'surface_hash' END) AS errors FROM d""",
    "audit_certificates": """WITH c AS (SELECT user_id, upper(event_type) AS k, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n, string_agg('"' || k || '":' || n, ',' ORDER BY k) AS e FROM c GROUP BY 1),
o AS (SELECT user_id, max(event_id) AS hi, min(event_id) AS lo, count(*) AS c FROM events GROUP BY 1)
SELECT 'u' || user_id AS path, '{"schema_version":"privacy-audit-v1","rules_version":"r1","generated_at_utc":"2024-01-01T00:00:00Z","input":{"sha256":"' || sha256(CAST(hi AS VARCHAR)) || '","size_bytes":' || c || '},"output":{"sha256":"' || sha256(CAST(lo AS VARCHAR)) || '","size_bytes":' || hi || '},"counts":{"replacements":' || n || ',"entities_by_type":{' || e || '}}}' AS certificate FROM o JOIN m USING (user_id)""",
    "review_contexts": f"""WITH {_D}, s AS (SELECT doc_id, t, 'A' AS label, 3 AS a, 9 AS b FROM d WHERE length(t) >= 40 UNION ALL SELECT doc_id, t, 'B', 20, 31 FROM d WHERE length(t) >= 40)
SELECT doc_id, label, t[a + 1:b] AS surface, t[greatest(a - 10, 0) + 1:a] || chr(10214) || t[a + 1:b] || chr(10215) || t[b + 1:b + 10] AS context FROM s WHERE doc_id % 3 <> 0""",
}
