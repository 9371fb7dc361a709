"""Queries of redaction, resolving, splicing, the registry and restoring over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import text as X
from veilspan.operators import detection as D
from veilspan.operators import masking as M


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a log line: all redactions in order."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.sanitize_log(F.col("text")), 256).alias("digest"))


def _line(key: F.Column) -> F.Column:
    k, two = key.cast("string"), F.lpad((key % 100).cast("string"), 2, "0")
    nine = F.lpad(k, 9, "0")
    return F.concat(
        F.lit("api_key="), k, F.lit(" Bearer t."), k, F.lit(" паспорт 45 "), two, F.lit(" 1"), F.substring(nine, 5, 5), F.lit("; СНИЛС 112-233-4"), two, F.lit(" "), two, F.lit(", счёт 4070281"), F.lpad(nine, 13, "5"),
        F.lit("; карта 4111 11"), two, F.lit(" 1111 1111, ИНН: 7"), nine, F.lit(", u"), k, F.lit("@mail.example.com 8 (495) 123-45-"), two, F.lit(" C:\\Users\\u"), k, F.lit("\\x /home/u"), k, F.lit("/y /Users/u"), k, F.lit("/z"),
    )


def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line of each order with every kind of value that is redacted."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", X.sanitize_log(_line(F.col("o_orderkey")), 220).alias("line"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping candidates: those of one user's events stand side by side on a line of 400 places."""
    e = _table(spark, sf_dir, "events")
    start = (F.col("event_id") * 37 % 400).cast("int")
    priority = F.element_at(F.array(*map(F.lit, (95, 90, 85, 80))), (F.col("event_id") % 4 + 1).cast("int"))
    confidence = (F.col("event_id") % 7 + 3) / 10
    return e.select(F.col("user_id").alias("doc_id"), start.alias("start"), (start + 4 + (F.col("event_id") % 9).cast("int")).alias("end"), F.lit("x").alias("text"), F.col("event_type").alias("label"), F.concat(F.lit("r"), F.col("event_id") % 4).alias("rule"), priority.alias("priority"), confidence.alias("confidence"))


def resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates merged and resolved."""
    return D.resolve(_candidates(spark, sf_dir)).select("doc_id", "start", "end", "label", "priority", F.round("confidence", 6).alias("confidence"), "sources")


def longest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates chosen by length."""
    return D.longest_first(_candidates(spark, sf_dir)).select("doc_id", "start", "end", "label")


def spliced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with good, overlapping, empty and outlying spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = "array(named_struct('start', 2, 'end', 7, 'token', '[A_1]'), named_struct('start', 5, 'end', 9, 'token', '[B_1]'), named_struct('start', 10, 'end', 10, 'token', '[C_1]'), named_struct('start', 12, 'end', 15, 'token', '[D_1]'), named_struct('start', 3, 'end', 2000000000, 'token', '[E_1]'))"
    return docs.withColumn("spans", F.expr(spans)).select("doc_id", M.spliced(F.col("text"), F.col("spans")).alias("s")).select("doc_id", F.sha2("s.out", 256).alias("digest"), "s.n")


def entity_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all orders by status: customers named in two spellings, insurance numbers with and without marks."""
    o = _table(spark, sf_dir, "orders")
    c = F.lpad((F.col("o_custkey") % 500).cast("string"), 11, "0")
    spelt = F.when(F.col("o_orderkey") % 2 == 0, c).otherwise(F.concat(F.substring(c, 1, 3), F.lit("-"), F.substring(c, 4, 3), F.lit("-"), F.substring(c, 7, 3), F.lit(" "), F.substring(c, 10, 2)))
    name = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "CLIENT  ").otherwise("Client "), F.col("o_custkey").cast("string"))
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit(3).alias("start"), name.alias("text"), F.concat(F.lit("PER"), F.lower("o_orderstatus")).alias("label")), F.struct(F.lit(40).alias("start"), spelt.alias("text"), F.lit("SNILS").alias("label")))).alias("s"))
    return M.registry(rows.select("doc_id", "s.start", (F.col("s.start") + 5).alias("end"), "s.text", "s.label")).select("label", "key", "token", "number", "original")


def restored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A masked line of each order, with unknown and repeated tokens, restored from the customers' names."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    token = F.concat(F.lit("[PER_"), F.col("o_custkey").cast("string"), F.lit("]"))
    line = F.concat(F.lit("to "), token, F.lit(", ["), F.col("o_orderstatus"), F.lit("_0] and "), token, F.lit(" /Any/"))
    names = c.where("c_custkey % 5 <> 0").select(F.concat(F.lit("[PER_"), F.col("c_custkey").cast("string"), F.lit("]")).alias("token"), F.col("c_name").alias("original"))
    return M.restore(o.select(F.col("o_orderkey").alias("doc_id"), line.alias("masked")), names)


def protected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a line taken out for a rewrite, the rewrite's verdict, and the tokens put back."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("Срок [DATE_"), k, F.lit("] не позднее "), k, F.lit(" дней для /ФИО_1/ и {{x}}"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", X.protect_placeholders(text).alias("p"))
    changed = F.when(F.col("o_orderkey") % 4 == 1, F.replace(F.col("p.text"), F.lit(" не "), F.lit(" "))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.col("p.text"), F.lit(" 7"))).when(F.col("o_orderkey") % 4 == 3, F.replace(F.col("p.text"), F.lit("<<PH1>>"), F.lit("<<PH2>>"))).otherwise(F.replace(F.col("p.text"), F.lit("Срок"), F.lit("Время")))
    problem = X.rewrite_problem(changed, F.col("p"), F.lit(1.0))
    return rows.select("o_orderkey", problem.alias("problem"), X.unprotect(changed, F.col("p.tokens")).alias("text"))


def document_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of edited copies."""
    k = F.col("o_orderkey")
    mark = F.element_at(F.array(*map(F.lit, ("", " (2)", "_cleaned_3", " - копия", " v2 final", "_правки", "-ChatGPT_исправленный", " (копия 4)"))), (k % 8 + 1).cast("int"))
    stem = F.concat(F.lit("Договор "), k.cast("string"), mark)
    return _table(spark, sf_dir, "orders").select("o_orderkey", X.document_stem(stem).alias("stem"), X.is_edited_stem(stem).alias("edited"))


def replacement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    sign = F.element_at(F.array(*map(F.lit, ("=>", "->", "=", ":", "#", " : => "))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rule = F.concat(F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.concat(F.lit(" a"), k)), sign, F.lit(" b "))
    return _table(spark, sf_dir, "orders").select("o_orderkey", X.replacement_rule(rule).alias("r")).select("o_orderkey", "r.source", "r.target")


QUERIES = {f.__name__: f for f in (redacted_documents, redacted_lines, resolved_spans, longest_spans, spliced_documents, entity_registry, restored_lines, protected_lines, document_stems, replacement_rules)}

# RE2 has no lookbehind: the character before a path is kept as a group
_CHAIN = [(p.replace("(?U)", "").replace("(?iU)", "(?i)"), m.replace("$1", r"\1")) for p, m in (*X.USER_PATHS, *X.REDACTIONS)]
_CHAIN = [(p.replace(r"(?<!\w)", r"(^|\W)"), r"\1" + m) if r"(?<!\w)" in p else (p, m) for p, m in _CHAIN]


def _redacted(column: str) -> str:
    out = column
    for p, m in _CHAIN:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, p.replace("'", "''"), m)
    return out


_C = """c AS (SELECT user_id AS doc_id, event_id * 37 % 400 AS s, event_id * 37 % 400 + 4 + event_id % 9 AS e, event_type AS label, [95, 90, 85, 80][event_id % 4 + 1] AS p, (event_id % 7 + 3) / 10 AS c, event_id % 4 AS r FROM events)"""
_OVER = "greatest(e.s, {x}.s) < least(e.e, {x}.e)"

ORACLE = {
    "redacted_documents": f"SELECT doc_id, sha256({_redacted('text')}) AS digest FROM documents",
    "redacted_lines": r"""SELECT o_orderkey, CASE WHEN length(l) > 220 THEN substr(l, 1, 217) || '...' ELSE l END AS line FROM (SELECT o_orderkey, 'api_key=[REDACTED] Bearer [REDACTED_TOKEN] паспорт [REDACTED_PASSPORT]; СНИЛС [REDACTED_SNILS], счёт [REDACTED_ACCOUNT]; карта [REDACTED_CARD], ИНН: [REDACTED_INN], [REDACTED_EMAIL] [REDACTED_PHONE] [USER_PATH]\x [USER_PATH]/y [USER_PATH]/z' AS l FROM orders)""",
    "resolved_spans": f"""WITH {_C},
m AS (SELECT doc_id, s, e, arg_max(label, (p, c, -r, label)) AS label, max(p) AS p, CASE WHEN count(*) = 1 THEN max(c) ELSE 1 - product(1 - least(greatest(c, 0.01), 0.99)) END AS c, string_agg(DISTINCT 'r' || r, '+' ORDER BY 'r' || r) AS sources FROM c GROUP BY ALL),
g AS (SELECT doc_id, list({{'p': p, 'c': c, 's': s, 'e': e, 'label': label, 'sources': sources}} ORDER BY -p, -round_even(c, 2), s - e, s, e) AS l FROM m GROUP BY 1),
k AS (SELECT doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda e: {_OVER.format(x='x[1]')} AND CASE WHEN e.s <= x[1].s AND x[1].e <= e.e THEN NOT (x[1].p >= 90 AND e.p < 90)
  WHEN x[1].s <= e.s AND e.e <= x[1].e THEN e.p >= 90 AND x[1].p < 90 ELSE NOT (x[1].p * x[1].c > e.p * e.c) END)) > 0 THEN acc ELSE list_append(list_filter(acc, lambda e: NOT ({_OVER.format(x='x[1]')})), x[1]) END) AS l FROM g),
u AS (SELECT doc_id, unnest(l) AS x FROM k) SELECT doc_id, CAST(x.s AS INT) AS start, CAST(x.e AS INT) AS "end", x.label AS label, x.p AS priority, round(x.c, 6) AS confidence, x.sources AS sources FROM u""",
    "longest_spans": f"""WITH {_C}, g AS (SELECT doc_id, list({{'s': s, 'e': e, 'label': label}} ORDER BY s - e, s, e, label) AS l FROM c GROUP BY 1),
k AS (SELECT doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda e: {_OVER.format(x='x[1]')})) > 0 THEN acc ELSE list_append(acc, x[1]) END) AS l FROM g),
u AS (SELECT doc_id, unnest(l) AS x FROM k) SELECT doc_id, CAST(x.s AS INT) AS start, CAST(x.e AS INT) AS "end", x.label AS label FROM u""",
    "spliced_documents": """SELECT doc_id, sha256(CASE WHEN n < 7 THEN t WHEN n < 15 THEN t[1:2] || '[A_1]' || t[8:] ELSE t[1:2] || '[A_1]' || t[8:12] || '[D_1]' || t[16:] END) AS digest, CAST((n >= 7)::INT + (n >= 15)::INT AS BIGINT) AS n
FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)""",
    "entity_registry": """WITH r AS (SELECT o_orderkey AS d, 3 AS s, 'PER' || lower(o_orderstatus) AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'CLIENT  ' ELSE 'Client ' END || o_custkey AS t, 'client ' || o_custkey AS key FROM orders
UNION ALL SELECT o_orderkey, 40, 'SNILS', CASE WHEN o_orderkey % 2 = 0 THEN c ELSE substr(c, 1, 3) || '-' || substr(c, 4, 3) || '-' || substr(c, 7, 3) || ' ' || substr(c, 10, 2) END, c FROM (SELECT o_orderkey, lpad(CAST(o_custkey % 500 AS VARCHAR), 11, '0') AS c FROM orders)),
f AS (SELECT label, key, min((d, s, t)) AS x FROM r GROUP BY ALL), n AS (SELECT label, key, row_number() OVER (PARTITION BY label ORDER BY x[1], x[2], key) AS number, x[3] AS original FROM f)
SELECT label, key, '[' || label || '_' || number || ']' AS token, number, original FROM n""",
    "restored_lines": """SELECT o_orderkey AS doc_id, 'to ' || t || ', [' || o_orderstatus || '_0] and ' || t || ' /Any/' AS text FROM (SELECT o.*, coalesce(c_name, '[PER_' || o_custkey || ']') AS t FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey)""",
    "protected_lines": """SELECT o_orderkey, [NULL, 'modality', 'numbers', 'sentinels'][o_orderkey % 4 + 1] AS problem, CASE o_orderkey % 4 WHEN 0 THEN 'Время' ELSE 'Срок' END || ' [DATE_' || o_orderkey || CASE o_orderkey % 4 WHEN 1 THEN '] позднее ' ELSE '] не позднее ' END || o_orderkey || ' дней для ' ||
CASE o_orderkey % 4 WHEN 3 THEN '{{x}}' ELSE '/ФИО_1/' END || ' и {{x}}' || CASE o_orderkey % 4 WHEN 2 THEN ' 7' ELSE '' END AS text FROM orders""",
    "document_stems": "SELECT o_orderkey, 'Договор ' || o_orderkey AS stem, o_orderkey % 8 NOT IN (0, 2) AS edited FROM orders",
    "replacement_rules": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 4 OR o_orderkey % 13 = 0 AND NOT (o_orderkey % 6 = 5) THEN NULL WHEN o_orderkey % 6 = 5 THEN CASE WHEN o_orderkey % 13 = 0 THEN ':' ELSE 'a' || o_orderkey || ' :' END ELSE 'a' || o_orderkey END AS source,
CASE WHEN o_orderkey % 6 = 4 OR o_orderkey % 13 = 0 AND NOT (o_orderkey % 6 = 5) THEN NULL ELSE 'b' END AS target FROM orders""",
}
