"""Queries of the synthetic records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import coverage as V
from veilspan.operators import gold as G


def coverage_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.positives(spark).drop("synthetic")


def coverage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.negatives(spark).drop("synthetic")


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.coverage(V.positives(spark).unionByName(V.negatives(spark)))


def coverage_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many templates there are and how many occur in several splits."""
    rows = V.positives(spark).unionByName(V.negatives(spark))
    return rows.agg(F.count_distinct("template_id").alias("templates")).crossJoin(G.template_leaks(rows).agg(F.count("*").alias("leaks")))


QUERIES = {f.__name__: f for f in (coverage_positives, coverage_negatives, coverage_counts, coverage_leaks)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_DIGEST = "lpad(CAST(CAST('0x' || substr(sha256('" + V.SEED + ":{}:' || i), 1, 16) AS UBIGINT) % {} AS VARCHAR), {}, '0')"
_D = "CAST(substr({}, {}, 1) AS INT)"


def _sum(column: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * {_D.format(column, k + 1)}" for k, w in enumerate(weights)) + ")"


_INN, _OGRN, _OGRNIP, _CARD = "'77' || " + _DIGEST.format("INN", 10**7, 7), "'1' || " + _DIGEST.format("OGRN", 10**11, 11), "'3' || " + _DIGEST.format("OGRNIP", 10**13, 13), "'411111' || " + _DIGEST.format("CARD", 10**9, 9)
_SNILS = "CAST(100000001 + i AS VARCHAR)"
_LUHN = " + ".join(f"(CASE WHEN {_D.format('b', k)} * {2 if k % 2 else 1} > 9 THEN {_D.format('b', k)} * 2 - 9 ELSE {_D.format('b', k)} * {2 if k % 2 else 1} END)" for k in range(1, 16))
_BUILT = {
    "@inn": f"(SELECT b || {_sum('b', (2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 FROM (SELECT {_INN} AS b))", "@ogrn": f"(SELECT b || CAST(b AS BIGINT) % 11 % 10 FROM (SELECT {_OGRN} AS b))", "@ogrnip": f"(SELECT b || CAST(b AS BIGINT) % 13 % 10 FROM (SELECT {_OGRNIP} AS b))",
    "@snils": f"(SELECT substr(b, 1, 3) || '-' || substr(b, 4, 3) || '-' || substr(b, 7, 3) || ' ' || lpad(CAST({_sum('b', tuple(range(9, 0, -1)))} % 101 % 100 AS VARCHAR), 2, '0') FROM (SELECT {_SNILS} AS b))",
    "@card": f"(SELECT b || (10 - ({_LUHN}) % 10) % 10 FROM (SELECT {_CARD} AS b))", "@iban": "('DE' || lpad(CAST(98 - CAST('37040044053201' || lpad(CAST(i AS VARCHAR), 4, '0') || '131400' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || '37040044053201' || lpad(CAST(i AS VARCHAR), 4, '0'))",
}


def _value(spec: V.Spec) -> str:
    if spec.format in _BUILT:
        return _BUILT[spec.format]
    number = lambda p: f"CAST({p[1]} + {'i' if p[2] is None else f'i % {p[2]}'} AS VARCHAR)"
    return "(" + " || ".join(_q(p) if isinstance(p, str) else f"CASE WHEN length({number(p)}) < {p[0]} THEN lpad({number(p)}, {p[0]}, '0') ELSE {number(p)} END" for p in V.parts_of(spec.format)) + ")"


_S = f"s(label, grp, cue, kind) AS (VALUES {', '.join(f'({_q(s.label)}, {_q(s.group)}, {_q(s.cue)}, {_q(s.kind)})' for s in V.SPECS)})"
_T = "t(split, turn, n, name, layout, a, b, c) AS (VALUES " + ", ".join(f"('{k}', {i}, {len(ts)}, " + ", ".join(map(_q, t)) + ")" for k, ts in V.TEMPLATES.items() for i, t in enumerate(ts)) + ")"
_N = f"g(kind, v) AS (VALUES {', '.join('({}, [{}])'.format(_q(k), ', '.join(map(_q, vs))) for k, vs in V.NEGATIVE_VALUES.items())})"
_OUT = """SELECT 'cov_' || substr(sha256('{seed}:' || label || ':{kind}:' || i), 1, 16) AS id, label, grp AS "group", r.split, r.split || ':{mark}' || name AS template_id, a || cue || b || v || c AS text, v AS surface,
CAST(length(a || cue || b) AS INT) AS start, CAST(length(a || cue || b || v) AS INT) AS "end", layout, {neg} AS negative FROM r JOIN t ON t.split = r.split AND turn = {turn} % n"""
_POS = f"""{_T}, {_S}, r AS (SELECT i, s.*, CASE label {' '.join(f'WHEN {_q(s.label)} THEN {_value(s)}' for s in V.SPECS)} END AS v, CASE WHEN i < 140 THEN 'train' WHEN i < 170 THEN 'dev' ELSE 'test' END AS split FROM range(200) AS x(i), s)"""
_NEG = f"""{_T}, {_S}, {_N}, r AS (SELECT i, s.*, g.v[i % 5 + 1] AS v, ['train', 'dev', 'test'][i % 3 + 1] AS split FROM range(40) AS x(i), s JOIN g USING (kind))"""
_P, _M = _OUT.format(seed=V.SEED, kind="pos", mark="", neg="false", turn="i"), _OUT.format(seed=V.SEED, kind="neg", mark="negative_", neg="true", turn="(i // 3)")

ORACLE = {
    "coverage_positives": f"WITH {_POS} {_P}",
    "coverage_negatives": f"WITH {_NEG} {_M}",
    "coverage_counts": f"WITH {_S} SELECT label, CAST(200 AS BIGINT) AS positive, CAST(40 AS BIGINT) AS negative, CAST(140 + 14 AS BIGINT) AS train, CAST(30 + 13 AS BIGINT) AS dev, CAST(30 + 13 AS BIGINT) AS test FROM s",
    "coverage_leaks": f"WITH u AS ((WITH {_POS} {_P}) UNION ALL (WITH {_NEG} {_M})) SELECT count(DISTINCT template_id) AS templates, (SELECT count(*) FROM (SELECT template_id FROM u GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaks FROM u",
}
