"""Queries of every validator over values made from the orders' keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import checksums as C
from veilspan.functions import values as V


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), k, F.lpad(k.cast("string"), 9, "0")


def number_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons against tax ids of 10 and 12 digits and registration numbers of 13 and 15, short, long and spelt out."""
    rows, k, nine = _keys(spark, sf_dir)
    last = (k % 10).cast("string")
    inn = F.when(k % 5 == 0, F.concat(nine, F.lit("x"))).when(k % 5 == 1, nine).when(k % 5 == 2, F.concat(F.lit("5"), nine, F.lpad((k % 97).cast("string"), 2, "0"))).otherwise(F.concat(nine, F.lit(" "), last))
    ogrn = F.when(k % 6 == 0, F.concat(F.lit("x"), nine)).when(k % 6 == 1, nine).when(k % 6 == 2, F.concat(F.lit("30412"), nine, last)).when(k % 6 == 3, F.concat(F.lit("50412"), nine, last)).when(k % 6 == 4, F.concat(F.lit("002"), nine, last)).otherwise(F.concat(F.lit("102 "), nine, last))
    return rows.select("o_orderkey", C.inn_problem(inn).alias("inn"), C.ogrn_problem(ogrn).alias("ogrn"))


def bank_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account numbers, bank codes, cards and policies."""
    rows, k, nine = _keys(spark, sf_dir)
    country = F.element_at(F.array(*map(F.lit, ("DE", "de", "QQ", "GB", "D1"))), (k % 5 + 1).cast("int"))
    iban = F.concat(country, F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" 37040044-0"), nine)
    swift = F.concat(F.lit("DEUT"), F.element_at(F.array(*map(F.lit, ("DE", "qq", "FR", "D"))), (k % 4 + 1).cast("int")), F.lit("FF"), F.when(k % 3 == 0, F.lit("500")).otherwise(F.lit("")))
    card = F.concat(F.element_at(F.array(*map(F.lit, ("4", "9", "5", "220"))), (k % 4 + 1).cast("int")), F.lit("1111 1-"), nine, (k % 10).cast("string"))
    bik = F.concat(F.element_at(F.array(*map(F.lit, ("04", "05"))), (k % 2 + 1).cast("int")), F.lpad((k % 3).cast("string"), 2, "0"), F.substring(nine, 5, 5))
    return rows.select("o_orderkey", C.iban_problem(iban).alias("iban"), C.valid_iban(iban).alias("lenient"), C.swift_problem(swift).alias("swift"), C.valid_card(card).alias("card"), C.valid_bik(bik).alias("bik"), C.valid_oms(F.concat(F.lit("7700 11"), nine, (k % 10).cast("string"))).alias("oms"))


def document_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passports, division codes and court cases."""
    rows, k, nine = _keys(spark, sf_dir)
    series = F.concat(F.lpad((k % 5).cast("string"), 2, "0"), F.lit(" "), F.lpad((k % 100).cast("string"), 2, "0"))
    code = F.concat(F.lpad((k % 4 * 250).cast("string"), 3, "0"), F.lit("-"), F.lpad((k % 7 * 111).cast("string"), 3, "0"))
    case = F.element_at(F.array(F.concat(F.lit("А40-"), k.cast("string"), F.lit("/2024")), F.concat(F.lit("2-"), k.cast("string"), F.lit("/24")), F.concat(k.cast("string"), F.lit("/2006")), F.concat(F.lit("33-"), k.cast("string"), F.lit("/1875"))), (k % 4 + 1).cast("int"))
    return rows.select("o_orderkey", C.valid_passport(series, F.substring(nine, 4, 6)).alias("passport"), C.valid_division_code(code).alias("division"), C.valid_court_case(case).alias("court_case"))


# Sentences of our own for the value checks: value, and which checks take it.
VALUES = {
    "ул. Лесная": "sufficient marks field", "г. Город": "marks field", "дом 5": "marks field attorney contract", "пос. Сосновка 12": "sufficient marks field attorney contract", "Атолл": "marks", "р-н Южный, д. 3": "sufficient marks field attorney contract",
    "договор по ул. Лесная, д. 1": "sufficient attorney contract", "121-ФЗ": "policy", "Д-17/24": "contract attorney court policy", "ГОСТ 17": "attorney", "без": "", "AB12": "contract attorney visa", "12-АБ7-31": "contract attorney court tour policy", "Россия": "citizenship marks",
    "граждане Чили": "", "Гражданин Республики Чили": "citizenship field person", "в Чили": "", "Старший инженер": "", "работник": "", "и оклад": "", "АО Ромашка": "person", "договор": "",
    "РТО 12345": "tour policy contract attorney", "12345 руб": "policy contract attorney", "Иванов Пётр": "person", "Иванов": "marks",
}
_CHECKS = {
    "sufficient": V.sufficient_address, "field": V.address_field, "contract": V.contract_number, "attorney": V.power_of_attorney, "visa": V.visa, "court": V.court_case, "citizenship": V.citizenship, "policy": V.insurance_policy, "tour": V.tour_operator_number,
    "marks": V.address_of_marks, "place": V.birth_place, "title": V.job_title, "employer": V.employer, "person": V.person_field,
}


def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences numbered by the orders' keys through the checks of field values."""
    rows, k, _ = _keys(spark, sf_dir)
    value = F.element_at(F.array(*map(F.lit, VALUES)), (k % len(VALUES) + 1).cast("int"))
    return rows.select("o_orderkey", value.alias("v")).select("o_orderkey", *[f(F.col("v")).alias(name) for name, f in _CHECKS.items()])


QUERIES = {f.__name__: f for f in (number_problems, bank_problems, document_checks, value_checks)}

_B = "lpad(CAST(o_orderkey AS VARCHAR), 9, '0')"
_D = "CAST(substr({}, {}, 1) AS INT)"


def _sum(column: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * {_D.format(column, i + 1)}" for i, w in enumerate(weights)) + ")"


def _luhn(column: str, digits: int) -> str:
    return "(" + " + ".join(f"(CASE WHEN {_D.format(column, i)} * {f} > 9 THEN {_D.format(column, i)} * {f} - 9 ELSE {_D.format(column, i)} * {f} END)" for i in range(1, digits + 1) for f in [1 + (digits - i) % 2]) + ")"


_TWELVE = f"({_sum('i', [7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10)"
_IN = lambda name: "v IN ({})".format(", ".join("'" + v + "'" for v, takes in VALUES.items() if name in takes.split()) or "''")

_OWN = {
    "title": "v NOT IN ('работник', 'и оклад')", "employer": "v NOT LIKE '%договор%'",
    "place": "regexp_matches(v, '[А-ЯЁа-яё]{2,}') AND NOT regexp_matches(lower(v), 'пол|гражданств|паспорт|сери|номер|адрес')",
}

ORACLE = {
    "number_problems": f"""WITH v AS (SELECT o_orderkey, o_orderkey % 5 AS a, o_orderkey % 6 AS b, CASE o_orderkey % 5 WHEN 2 THEN '5' || {_B} || lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') ELSE {_B} || (o_orderkey % 10) || '00' END AS i,
CASE WHEN o_orderkey % 6 IN (2, 3) THEN '30412' || {_B} ELSE '102' || {_B} || '000' END AS o, o_orderkey % 10 AS last FROM orders)
SELECT o_orderkey, CASE a WHEN 0 THEN 'format' WHEN 1 THEN 'length' WHEN 2 THEN CASE WHEN {_TWELVE} = {_D.format('i', 11)} AND ({_sum('i', [3, 7, 2, 4, 10, 3, 5, 9, 4, 6])} + 8 * {_TWELVE}) % 11 % 10 = {_D.format('i', 12)} THEN NULL ELSE 'checksum' END
  ELSE CASE WHEN {_sum('i', [2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = last THEN NULL ELSE 'checksum' END END AS inn,
CASE b WHEN 0 THEN 'format' WHEN 1 THEN 'length' WHEN 2 THEN CASE WHEN CAST(substr(o, 1, 14) AS BIGINT) % 13 % 10 = last THEN NULL ELSE 'checksum' END WHEN 3 THEN 'component' WHEN 4 THEN 'component' ELSE CASE WHEN CAST(substr(o, 1, 12) AS BIGINT) % 11 % 10 = last THEN NULL ELSE 'checksum' END END AS ogrn FROM v""",
    "bank_problems": f"""WITH v AS (SELECT o_orderkey AS k, {_B} AS b FROM orders), w AS (SELECT k, b, CAST('370400440' || b || CASE k % 5 WHEN 3 THEN '1611' WHEN 2 THEN '2626' ELSE '1314' END || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 AS ok,
  CASE k % 4 WHEN 0 THEN '4' WHEN 1 THEN '9' WHEN 2 THEN '5' ELSE '220' END || '11111' || b || (k % 10) AS c, '770011' || b || (k % 10) AS o FROM v)
SELECT k AS o_orderkey, CASE k % 5 WHEN 4 THEN 'format' WHEN 2 THEN 'component' ELSE CASE WHEN k % 5 = 3 OR ok THEN CASE WHEN ok AND k % 5 = 3 THEN NULL WHEN k % 5 = 3 THEN 'checksum' END ELSE 'checksum' END END AS iban,
k % 5 <> 4 AND ok AS lenient, CASE k % 4 WHEN 1 THEN 'component' WHEN 3 THEN 'format' END AS swift,
CASE WHEN k % 4 = 3 THEN {_luhn('c', 18)} % 10 = 0 ELSE k % 4 <> 1 AND (k % 4 <> 2 OR substr(c, 2, 1) = '1') AND {_luhn('c', 16)} % 10 = 0 END AS card,
k % 2 = 0 AND k % 3 <> 0 AS bik, {_luhn('o', 16)} % 10 = 0 AS oms FROM w""",
    "document_checks": """SELECT o_orderkey, o_orderkey % 5 <> 0 AND (o_orderkey % 100 >= 97 OR o_orderkey % 100 <= 30) AS passport, o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0 AS division, o_orderkey % 4 IN (0, 1) AS court_case FROM orders""",
    "value_checks": f"WITH w AS (SELECT o_orderkey, [{', '.join(chr(39) + v + chr(39) for v in VALUES)}][o_orderkey % {len(VALUES)} + 1] AS v FROM orders) SELECT o_orderkey, {', '.join(f'{_OWN.get(n) or _IN(n)} AS {n}' for n in _CHECKS)} FROM w",
}
