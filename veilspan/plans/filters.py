"""Queries of filters, bounds and name linking over sentences made from the orders' keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import pages as P
from veilspan.operators import refinement as R
from veilspan.operators import registries as G

#: Surfaces of our own and the filters that take them.
SURFACES = {
    "Министерство финансов": "public", "Арбитражный суд города": "public place", "ООО «Администрация плюс»": "", "ООО «...»": "unfilled", "Ромашка": "place", "АБ-1200К": "product", "ООО «АБ-1200»": "", "г. Москва": "place", "г. Москва, ул. Лесная, д. 5": "sufficient",
    "ст. 15 ГК РФ": "citation", "example.com": "website", "Фонд ____": "unfilled", "насос 5 кВт": "product", "Тверская область": "place", "ФНС": "public",
}
_FILTERS = {"public": R.is_public_body, "unfilled": R.is_unfilled, "product": R.is_product, "place": R.is_place_alone, "citation": R.is_legal_citation, "website": R.is_website, "sufficient": R.sufficient_address}


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), F.col("o_orderkey")


def _spread(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows of fewer file pieces than cores dealt to all cores, for work that outweighs moving a key."""
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def surface_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = _orders(spark, sf_dir)
    s = F.element_at(F.array(*map(F.lit, SURFACES)), (k % len(SURFACES) + 1).cast("int"))
    return rows.select("o_orderkey", s.alias("s")).select("o_orderkey", *[f(F.col("s")).alias(n) for n, f in _FILTERS.items()])


def span_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names freed of what stands in front of them, addresses with their houses, organisations' own names."""
    rows, k = _orders(spark, sf_dir)
    number = k.cast("string")
    text = F.concat(F.lit("Истец Иванов Иван, ООО «Ромашка-"), number, F.lit("» (далее – Клиент), ул. Лесная, д. "), (k % 90 + 1).cast("string"), F.lit(", кв. "), (k % 7 + 1).cast("string"), F.lit("; 10 мая"))
    rows = rows.select("o_orderkey", text.alias("t"))
    org = F.instr("t", "ООО") - 1
    org_end = F.instr("t", ", ул.") - 1
    street = F.instr("t", "ул.") - 1
    core = R.organisation_core(F.col("t"), org, org_end)
    return rows.select("o_orderkey", R.person_start(F.col("t"), F.lit(0), F.lit(17)).alias("person"), core["start"].alias("org_start"), core["end"].alias("org_end"), R.address_end(F.col("t"), street + 10).alias("address_end"))


def linked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spellings of each customer's made-up name, by the entity they stand for; every tenth initial is shared by two."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    name = F.concat(F.lit("Образц"), F.translate((F.col("k") - F.col("k") % 10).cast("string"), "0123456789", "абвгдежзик"))
    last = F.when(F.col("k") % 10 == 1, "Петрович").when(F.col("k") % 10 == 2, "Павлович")
    rows = c.where(F.col("k") % 10 <= 2).select(F.explode(F.array_compact(F.array(F.concat(name, F.lit(" Иван "), last), F.concat(name, F.lit(" И.П.")), F.concat(F.lit("И. П. "), name)))).alias("text")).withColumn("label", F.lit("PER"))
    return G.linked_entities(rows).select("surface", "entity")


def repaired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = _orders(spark, sf_dir)
    n = k.cast("string")
    line = F.concat(F.lit("Догoвор  No "), n, F.lit(" 《Ромашка 》, код 77O-ОО1, a"), n, F.lit(" @@ mаil.ru"))
    return _spread(spark, rows).select("o_orderkey", P.recognised_line(line).alias("line"))


def flowed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a made-up page of each order put together."""
    rows, k = _orders(spark, sf_dir)
    n = k.cast("string")
    page = F.concat(F.lit("ДОГОВОР\nдлинная строка номер "), n, F.lit(", которая продолжается на следующей стро-\nке до точки.\nИНН "), n, F.lit("\n\nитого:\nа | "), n)
    return rows.select("o_orderkey", F.array_join(P.paragraphs(page), "¶").alias("text"))


QUERIES = {f.__name__: f for f in (surface_filters, span_bounds, linked_names, repaired_lines, flowed_paragraphs)}

_IN = lambda name: "v IN ({})".format(", ".join("'" + v + "'" for v, takes in SURFACES.items() if name in takes.split()))
ORACLE = {
    "surface_filters": f"WITH w AS (SELECT o_orderkey, [{', '.join(chr(39) + v + chr(39) for v in SURFACES)}][o_orderkey % {len(SURFACES)} + 1] AS v FROM orders) SELECT o_orderkey, {', '.join(f'{_IN(n)} AS {n}' for n in _FILTERS)} FROM w",
    "span_bounds": """WITH w AS (SELECT o_orderkey, length(CAST(o_orderkey AS VARCHAR)) AS n, length(CAST(o_orderkey % 90 + 1 AS VARCHAR)) AS h FROM orders)
SELECT o_orderkey, 6 AS person, 24 AS org_start, CAST(32 + n AS INT) AS org_end, CAST(52 + n + 10 + 5 + h + 7 AS INT) AS address_end FROM w""",
    "linked_names": """WITH c AS (SELECT DISTINCT c_custkey // 10 * 10 AS g, c_custkey % 10 AS r, 'Образц' || translate(CAST(c_custkey // 10 * 10 AS VARCHAR), '0123456789', 'абвгдежзик') AS name FROM customer WHERE c_custkey % 10 <= 2),
f AS (SELECT g, name, name || ' Иван ' || CASE r WHEN 1 THEN 'Петрович' ELSE 'Павлович' END AS surface FROM c WHERE r > 0), n AS (SELECT g, count(*) AS n, min(lower(surface)) AS one FROM f GROUP BY 1),
s AS (SELECT g, surface FROM f UNION ALL SELECT DISTINCT g, name || ' И.П.' FROM c UNION ALL SELECT DISTINCT g, 'И. П. ' || name FROM c)
SELECT surface, CASE WHEN n = 1 THEN one WHEN n IS NULL THEN (SELECT min(lower(x.surface)) FROM s x WHERE x.g = s.g) ELSE lower(surface) END AS entity FROM s LEFT JOIN n USING (g)""",
    "repaired_lines": "SELECT o_orderkey, 'Договор № ' || o_orderkey || ' «Ромашка», код 770-001, a' || o_orderkey || '@mail.ru' AS line FROM orders",
    "flowed_paragraphs": "SELECT o_orderkey, 'ДОГОВОР¶длинная строка номер ' || o_orderkey || ', которая продолжается на следующей строке до точки.¶ИНН ' || o_orderkey || '¶итого:¶а | ' || o_orderkey AS text FROM orders",
}
