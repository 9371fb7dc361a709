"""Queries of tables over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.fields import field_label
from veilspan.operators import refinement as R
from veilspan.operators import tables as T


def _cells(spark: SparkSession, sf_dir: str, name: str, doc: str, sheet: str, *cells: tuple[int, int, str]) -> DataFrame:
    """Every row of a table as a sheet with these cells (row, column, SQL of the value)."""
    each = F.expr("array(" + ", ".join(f"named_struct('row', {r}, 'col', {c}, 'value', CAST({v} AS STRING))" for r, c, v in cells) + ")")
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(doc).alias("doc_id"), F.expr(sheet).alias("sheet"), F.explode(each).alias("c"))
    return rows.select("doc_id", "sheet", "c.*")


def form_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the cells of a form for every customer."""
    even = "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END"
    cells = _cells(spark, sf_dir, "customer", "c_custkey", "'form'", (0, 0, "'ФИО:'"), (0, 1, "c_name"), (0, 2, "c_mktsegment"), (1, 0, "'Телефон'"), (1, 1, even), (1, 2, "c_acctbal"), (2, 0, "c_nationkey"))
    return T.table_contexts(cells).select("doc_id", "row", "col", "label", "label_row", "label_col", "value_offset")


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(
        spark, sf_dir, "orders", "o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN 'ОС' ELSE 'Лист1' END",
        (0, 0, "'Дата'"), (0, 1, "'Назначение платежа'"), (0, 2, "CASE WHEN o_orderkey % 3 = 0 THEN 'Номер документа' ELSE 'Контрагент' END"), (0, 3, "'Сумма'"),
        (1, 0, "'x'"), (2, 0, "'08.09.2025'"), (2, 1, "concat('Оплата по счету №', o_custkey, ' от 08.09.2025')"), (2, 2, "concat(' K', o_custkey)"), (2, 3, "o_orderkey"),
    )


def sheet_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of a sheet of payments for every order."""
    return T.sheet_profiles(_register(spark, sf_dir)).groupBy("profile").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def sheet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of those sheets declare, as spans (bank operations have their headers in the
    second row, so that in the first counts as a value)."""
    found = T.targeted_cells(_register(spark, sf_dir)).select("doc_id", "row", "col", F.explode("spans").alias("s"))
    return found.select("doc_id", "row", "col", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.text", "s.label")


def captioned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every part's type as a caption (all but one have none)."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", field_label(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" Номер  договора ("), "p_brand", F.lit(")"))).otherwise(F.col("p_type"))).alias("label"))


def document_websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a website's address stands in a page's address or HTML."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", R.is_website(F.col("url")).alias("in_url"), R.is_website(F.col("html")).alias("in_html"))


QUERIES = {f.__name__: f for f in (form_contexts, sheet_profiles, sheet_values, captioned_parts, document_websites)}

_SITE = r"(?i)(?:(?:https?|ftp)://[^\s<>\[\]]+|www\.[A-Za-zА-Яа-яЁё0-9-]+(?:\.[A-Za-zА-Яа-яЁё0-9-]+)+|[A-Za-zА-Яа-яЁё0-9]\.(?:ru|рф|com|org|net|io|biz|info|pro|edu|gov))"
_NAMED = "(o_orderkey % 5 <> 0)"

ORACLE = {
    "form_contexts": """WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 2 = 0 AND c_mktsegment IS NOT NULL AS even FROM customer),
p AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)) AS t("row", col))
SELECT doc_id, "row", col, CASE WHEN (row, col) = (0, 1) THEN 'ФИО' WHEN (row, col) IN ((1, 1), (2, 0)) OR ((row, col) = (1, 2) AND NOT even) THEN 'Телефон' END AS label,
CASE WHEN (row, col) = (0, 1) THEN 0 WHEN (row, col) IN ((1, 1), (2, 0)) OR ((row, col) = (1, 2) AND NOT even) THEN 1 END AS label_row,
CASE WHEN (row, col) IN ((0, 1), (1, 1), (2, 0)) OR ((row, col) = (1, 2) AND NOT even) THEN 0 END AS label_col,
CASE WHEN (row, col) = (0, 1) THEN 4 WHEN (row, col) IN ((1, 1), (2, 0)) OR ((row, col) = (1, 2) AND NOT even) THEN 8 ELSE 0 END AS value_offset
FROM c, p WHERE even OR (row, col) <> (1, 1)""",
    "sheet_profiles": """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'inventory' WHEN o_orderkey % 3 = 0 THEN 'bank_operations' ELSE 'payment_register' END AS profile, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders GROUP BY 1""",
    "sheet_values": f"""WITH o AS (SELECT o_orderkey AS doc_id, CAST(o_custkey AS VARCHAR) AS k, o_orderkey % 3 = 0 AS bank FROM orders WHERE {_NAMED}), t AS (SELECT *, 'Оплата по счету №' || k || ' от 08.09.2025' AS v FROM o)
SELECT doc_id, 2 AS "row", 0 AS col, 0::BIGINT AS start, 10::BIGINT AS "end", '08.09.2025' AS text, 'DATE' AS label FROM o
UNION ALL SELECT doc_id, 2, 1, 17, 17 + length(k), k, 'DOCUMENT_NUMBER' FROM t
UNION ALL SELECT doc_id, 2, 1, length(v) - 10, length(v), '08.09.2025', 'DATE' FROM t
UNION ALL SELECT doc_id, 0, 2, 0, 15, 'Номер документа', 'DOCUMENT_NUMBER' FROM o WHERE bank
UNION ALL SELECT doc_id, 2, 2, 0, 2 + length(k), 'K' || k, CASE WHEN bank THEN 'DOCUMENT_NUMBER' ELSE 'ORG' END FROM o""",
    "captioned_parts": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_brand IS NOT NULL THEN 'Номер договора' END AS label FROM part",
    "document_websites": f"SELECT page_id, coalesce(regexp_matches(url, '{_SITE}'), false) AS in_url, coalesce(regexp_matches(html, '{_SITE}'), false) AS in_html FROM pages",
}
