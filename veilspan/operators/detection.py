"""Rule candidates with context scores, their resolution, and selection of spans, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import checksums as C
from veilspan.functions.text import CHANGED, SPAN, SQUEEZED, normalize, placed, unsqueezed

#: Fixed value: of a candidate's confidence in the normalised text.
NORMALIZED = 0.98


@dataclass(frozen=True)
class Rule:
    """A pattern, words that speak for and against it nearby, and its weights."""

    name: str
    label: str
    pattern: str
    positive: tuple[str, ...]
    negative: tuple[str, ...]
    priority: int
    base: float
    validator: Callable[[Column], Column] | None = None
    near: int = 40
    far: int = 140
    weight: float = 0.40
    needs_positive: bool = False
    tail: int = 0  # of a match, only its last characters are the span
    gate: str | None = None  # what every match holds: a text without it isn't searched


#: Six digits with single separators, which all numbers of documents hold; and what the others hold.
_NUMBER = r"(?U)\d(?:[-\s]?\d){5}"
_GATES = {"court_case_number": r"(?U)\d/\d{2}", "ip_address": r"(?U)\d\.\d", "iban_international": r"(?U)[A-Z]{2}\d{2}[A-Z0-9]", "swift_bic": r"[A-Z]{6}"}


# Words near passport data.
_PASSPORT_NEGATIVE = ("паспорт сделки", "паспорт проекта", "паспорт безопасности", "технический паспорт", "паспорт объекта", "паспорт отходов", "техпаспорт")
_DIVISION_POSITIVE = (
    "код подразделения", "код подр.", "код подр", "подразделение", "подразделения", "подразделением", "оуфмс", "уфмс", "мвд", "овд", "гувд", "рофмс", "тп", "паспорт", "паспорта", "выдан", "выдавший",
)
_DIVISION_NEGATIVE = (
    "руб", "руб.", "рубля", "рублей", "коп", "коп.", "копеек", "копейки", "₽", "$", "€", "стоимость", "цена", "цене", "сумме", "сумма", "сумму", "суммой", "размер", "размере", "расчет", "расчету",
    "расчёт", "остаток", "остатка", "задолженность", "задолженности", "пошлина", "пошлины", "пошлину", "оплата", "оплате", "оплату", "выплата", "выплате", "платеж", "платежа", "предел", "превышает",
    "тысяч", "тысячи", "тыс", "тыс.", "млн", "млрд", "долг", "долга", "акт", "актом", "счет", "счету", "счёт", "счёту", "спецификация", "спецификации", "договор", "договору", "договора", "телефон",
    "тел.", "факс", "индекс", "заказ", "артикул", "версия", "статья", "пункт",
)

# Candidate shapes, keywords and weights of the deterministic rules.
RULES: tuple[Rule, ...] = (
    Rule("inn_checksum", "INN", r"(?<!\d)(?:\d{10}|\d{12})(?!\d)", ("инн", "идентификационный номер", "inn", "инн/кпп", "инн/бик", "инн плательщика", "инн получателя"), ("счет", "счёт", "оквэд", "октмо", "гост", "код ошибки", "артикул", "заказ"), 95, 0.40, C.valid_inn),
    Rule("snils_checksum", "SNILS", r"(?U)(?<!\d)\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2}(?!\d)", ("снилс", "snils", "страховой номер", "лицевой счет физлица", "страховое свидетельство"), ("телефон", "счет", "индекс", "паспорт"), 95, 0.45, C.valid_snils),
    Rule("ogrn_checksum", "OGRN", r"(?<!\d)\d{13}(?!\d)", ("огрн", "ogrn", "егрюл", "основной государственный регистрационный номер"), ("счет", "номер карты", "заказ", "штрихкод"), 95, 0.50, C.valid_ogrn),
    Rule("ogrnip_checksum", "OGRNIP", r"(?<!\d)\d{15}(?!\d)", ("огрнип", "ogrnip", "егрип", "индивидуальный предприниматель"), ("счет", "номер карты", "заказ"), 95, 0.50, C.valid_ogrn),
    Rule("bank_card_luhn", "BANK_CARD", r"(?U)(?<!\d)(?:\d{4}[-\s]?){3}\d{4}(?!\d)|(?<!\d)\d{16,19}(?!\d)", ("карта", "карты", "банковская карта", "visa", "mastercard", "мир", "mir", "maestro", "номер карты", "card number", "pan"), ("счет", "счёт", "лицевой", "инн", "огрн", "снилс", "телефон"), 90, 0.30, C.valid_card),
    Rule("bik_bank", "BIK", r"(?<!\d)04\d{7}(?!\d)", ("бик", "bik", "банк", "к/с", "р/с", "корреспондентский"), ("кпп", "инн", "телефон"), 85, 0.55, C.valid_bik),
    Rule("oms_policy", "OMS_POLICY", r"(?<!\d)\d{16}(?!\d)", ("омс", "полис омс", "полис", "страховой полис", "медстрах"), ("карта", "счет", "банковская карта"), 85, 0.40, C.valid_oms),
    Rule("passport_series_rf", "PASSPORT_SERIES", r"(?iU)(?<!\d)\d{2}\s?\d{2}(?=\s*(?:№|#|номер|n\b)?\s*\d{6}(?!\d))", ("паспорт", "серия", "паспорта", "выдан", "кем выдан", "дата выдачи", "паспортные данные", "удостоверение личности"), _PASSPORT_NEGATIVE, 85, 0.30, near=60, far=180),
    Rule("passport_number_rf", "PASSPORT_NUMBER", r"(?iU)(?<!\d)\d{2}\s?\d{2}[,\s]*(?:№|#|номер|n\b)?\s*\d{6}(?!\d)", ("паспорт", "номер", "паспорта", "выдан", "кем выдан", "дата выдачи", "паспортные данные", "удостоверение личности"), _PASSPORT_NEGATIVE, 85, 0.30, near=60, far=180, tail=6),
    Rule("passport_division_code", "PASSPORT_DIVISION_CODE", r"(?U)(?<!\d[\s\u00a0.,])(?<!\d)\d{3}[-\s]\d{3}(?!\d)(?![,\.]\d{2})(?![\s\u00a0]\d{3})", _DIVISION_POSITIVE, _DIVISION_NEGATIVE, 85, 0.30, C.valid_division_code, near=60, needs_positive=True),
    Rule("court_case_number", "COURT_CASE_NUMBER", r"(?U)\bА\d{1,2}-\d{1,8}/\d{2,4}\b|\b(?:\d{1,3}-)?\d{1,8}/\d{2,4}\b|\b\d{1,2}[а-яёА-ЯЁ]?-\d{1,8}/\d{2,4}\b", ("дело", "делу", "арбитражный суд", "суд", "иск", "исковое заявление", "определение", "постановление", "решение суда", "производство"), ("фз", "гост", "договор", "закон", "снип", "статья"), 80, 0.45, C.valid_court_case),
    Rule("ip_address", "IP_ADDRESS", r"(?U)\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b", ("ip", "ip-адрес", "хост", "сеть", "адрес", "сервер", "шлюз"), ("пункт", "п.", "ст.", "версия"), 80, 0.50),
    Rule("iban_international", "IBAN", r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", ("iban", "счёт", "банк", "перевод", "swift"), ("паспорт", "снилс"), 85, 0.40, C.valid_iban),
    Rule("swift_bic", "SWIFT", r"(?U)\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", ("swift", "bic", "банк", "корреспондент", "перевод"), ("паспорт", "инн", "огрн"), 85, 0.40, C.valid_swift),
)


RULES = tuple(replace(r, gate=_GATES.get(r.name, _NUMBER)) for r in RULES)


def _nearest(left: Column, right: Column, word: Column) -> Column:
    """Characters between the candidate and the word's nearest place in either window; null if none."""
    before = F.when(F.contains(left, word), F.char_length(F.call_function("substring_index", left, word, F.lit(-1))))
    after = F.when(F.contains(right, word), F.call_function("instr", right, word) - 1)
    return F.least(before, after)


def _specs(rules: tuple[Rule, ...]) -> Column:
    """The rules' parameters as one constant array, looked up by a candidate's rule number (one parsed
    expression: hundreds of literal columns would take seconds to build)."""

    def words(ws: tuple[str, ...]) -> str:
        return "CAST(array(" + ", ".join(f"'{w}'" for w in ws) + ") AS array<string>)"

    def fields(r: Rule) -> str:
        return (
            f"'label', '{r.label}', 'rule', '{r.name}', 'priority', {r.priority}, 'base', {r.base}D, 'weight', {r.weight}D, 'near', {r.near}, 'far', {r.far}, "
            f"'checked', {str(r.validator is not None).lower()}, 'strict', {str(r.needs_positive).lower()}, 'positive', {words(r.positive)}, 'negative', {words(r.negative)}"
        )

    return F.expr("array(" + ", ".join(f"named_struct({fields(r)})" for r in rules) + ")")


def row_key(text: Column) -> Column:
    """Tells rows of one id apart by their text; rows equal in both are equal in all results."""
    return F.xxhash64(text)


def keys_of(df: DataFrame) -> list[str]:
    """The columns that name a row of texts: doc_id, and row where it is there."""
    return [c for c in ("doc_id", "row") if c in df.columns]


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", external: DataFrame | None = None) -> DataFrame:
    """doc_id, row, start, end, text, label, rule, priority, confidence and keyword_score of every candidate.

    Two passes in one scan: the text, and where normalisation changes it the normalised text, its
    candidates placed in the original at ``NORMALIZED`` of the confidence.  Of candidates with equal
    row, place and label the most confident stays (the one shuffle).  In a pass there's a row for
    each rule that occurs in a text, then a row for each match with the words around it (no row of a
    match holds the text), then its score; each regular expression runs once on a text it occurs in.
    A negative word within ``near`` vetoes; the score of a positive word falls from 1 at ``near`` to 0
    at ``far``; a passed validator lifts the confidence to .85, with a positive word to .95.  Spans of
    another detector (doc_id, start, end, label over the same ids) join as ``external``.  Null texts
    have no candidates; repeated ids are told apart by ``row``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()).withColumn("row", row_key(F.col("_text")))
    given = None if external is None else external_candidates(rows, external)
    # the original and its squeezed runs go along with a normalised text
    rows = rows.withColumn("_changed", F.col("_text").rlike(CHANGED))
    squeezed = (F.regexp_extract_all("_text", F.lit(SQUEEZED), F.lit(0)), F.split("_text", SQUEEZED, -1))
    rows = rows.select("doc_id", "row", "_text", F.when(F.col("_changed"), normalize(F.col("_text"))).alias("_norm"), *[F.when(F.col("_changed"), c).alias(k) for k, c in zip(("found", "gaps"), squeezed, strict=True)])
    raw = F.struct(F.col("_text").alias("text"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast(f"array<{SPAN}>").alias("runs"))
    norm = F.struct(F.col("_norm").alias("text"), F.col("_text").alias("origin"), placed(F.col("found"), F.col("gaps")).alias("runs"))
    rows = rows.select("doc_id", "row", F.explode(F.array_compact(F.array(raw, F.when(F.col("_norm") != F.col("_text"), norm)))).alias("v"))
    rows = rows.select("doc_id", "row", F.col("v.text").alias("_text"), F.col("v.origin").alias("origin"), F.col("v.runs").alias("runs"))
    gates = {g: f"_gate{k}" for k, g in enumerate(dict.fromkeys(r.gate for r in rules if r.gate))}
    rows = rows.withColumns({name: F.col("_text").rlike(g) for g, name in gates.items()})
    open_ = lambda r: F.col(gates[r.gate]) if r.gate else F.lit(True)
    occurs = F.array(*[F.when(open_(r) & F.col("_text").rlike(r.pattern), F.struct(F.lit(i).alias("rule"), F.lit(r.pattern).alias("pattern"), F.lit(r.tail).alias("tail"), F.lit(r.far).alias("far"))) for i, r in enumerate(rules)])
    by_rule = rows.select("doc_id", "row", "_text", "origin", "runs", F.explode(F.array_compact(occurs)).alias("o"))
    cut = by_rule.select(
        "doc_id", "row", "origin", "runs", "o.rule", "o.tail", "o.far", F.lower("_text").alias("lower"), F.regexp_extract_all("_text", F.col("o.pattern"), F.lit(0)).alias("found"), F.split("_text", F.col("o.pattern"), -1).alias("gaps"),
    )

    def around(s: Column) -> Column:
        tail, far, lower, origin, runs = (F.col(c) for c in ("tail", "far", "lower", "origin", "runs"))
        begin = F.when(tail > 0, s["end"] - tail).otherwise(s["start"])
        left = F.substr(lower, F.greatest(begin - far, F.lit(0)) + 1, F.least(begin, far))
        start, end = (F.when(origin.isNull(), at).otherwise(unsqueezed(at, runs)) for at in (begin, s["end"]))
        found = F.when(tail > 0, F.substr(s["text"], -tail)).otherwise(s["text"])
        surface = F.when(origin.isNull(), found).otherwise(F.substr(origin, start + 1, end - start))
        fields = {"start": start, "end": end, "found": found, "text": surface, "left": left, "right": F.substr(lower, s["end"] + 1, far), "again": origin.isNotNull()}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    each = cut.select("doc_id", "row", "rule", F.explode(F.transform(placed(F.col("found"), F.col("gaps")), around)).alias("m")).select("doc_id", "row", "rule", "m.*")
    checked = [(i, r.validator) for i, r in enumerate(rules) if r.validator]
    if checked:
        valid = reduce(lambda acc, c: acc.when(F.col("rule") == c[0], c[1](F.col("found"))), checked[1:], F.when(F.col("rule") == checked[0][0], checked[0][1](F.col("found"))))
        each = each.where(valid.otherwise(F.lit(True)))
    near_by = each.withColumn("spec", F.get(_specs(rules), F.col("rule")))
    left, right, spec = F.col("left"), F.col("right"), F.col("spec")

    def decay(word: Column) -> Column:
        d = _nearest(left, right, word)
        return F.coalesce(F.when(d <= spec["near"], F.lit(1.0)).when(d >= spec["far"], F.lit(0.0)).otherwise((spec["far"] - d) / (spec["far"] - spec["near"])), F.lit(0.0))

    near_by = near_by.where(~F.exists(spec["negative"], lambda w: F.coalesce(_nearest(left, right, w) <= spec["near"], F.lit(False))))
    scored = near_by.withColumn("keyword_score", F.coalesce(F.array_max(F.transform(spec["positive"], decay)), F.lit(0.0))).where(~spec["strict"] | (F.col("keyword_score") > 0))
    confidence = spec["base"] + F.col("keyword_score") * spec["weight"]
    confidence = F.when(spec["checked"], F.greatest(confidence, F.when(F.col("keyword_score") > 0, 0.95).otherwise(0.85))).otherwise(confidence)
    confidence = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) * F.when(F.col("again"), NORMALIZED).otherwise(1.0)
    out = scored.where("end > start").select("doc_id", "row", "start", "end", "text", "spec.label", "spec.rule", "spec.priority", confidence.alias("confidence"), "keyword_score")
    if given is not None:
        out = out.unionByName(given)
    best = F.max(F.struct("confidence", "keyword_score", "priority", "rule", "text")).alias("b")
    return out.groupBy("doc_id", "row", "start", "end", "label").agg(best).select("doc_id", "row", "start", "end", "b.text", "label", "b.rule", "b.priority", "b.confidence", "b.keyword_score")


# Priorities and confidence of spans that another detector gives.
EXTERNAL_PRIORITY = {"PER": 80, "ORG": 75}
EXTERNAL_OTHER, EXTERNAL_CONFIDENCE = 70, 0.92


def external_candidates(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans of another detector (doc_id, start, end, label) as candidates of every row of their id, or of the
    one row where they have ``row`` (as ``fields.field_spans`` gives them); spans outside the text, and
    empty ones, are left out."""
    priority = F.lit(EXTERNAL_OTHER)
    for label, value in EXTERNAL_PRIORITY.items():
        priority = F.when(F.col("label") == label, value).otherwise(priority)
    own = [F.col("row").alias("_row")] if "row" in spans.columns else []
    given = spans.select(F.col("doc_id").alias("_id"), *own, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    both = rows.join(given, same & (F.col("row") == F.col("_row")) if own else same).where((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.char_length("_text")))
    surface = F.substr("_text", F.col("start") + 1, F.col("end") - F.col("start"))
    return both.select("doc_id", "row", "start", "end", surface.alias("text"), "label", F.lit("external").alias("rule"), priority.alias("priority"), F.lit(EXTERNAL_CONFIDENCE).alias("confidence"), F.lit(0.0).alias("keyword_score"))


def merge_exact(found: DataFrame) -> DataFrame:
    """One row per span: noisy-or confidence (each clamped to .01 to .99), text and label of the largest
    (priority, confidence), of equal ones that of the earlier rule, the largest priority, and the rules
    joined by plus signs."""
    order = F.coalesce(F.array_position(F.lit([r.name for r in RULES]), F.col("rule")), F.lit(0))
    doubts = F.array_sort(F.collect_list(1 - F.least(F.greatest("confidence", F.lit(0.01)), F.lit(0.99))))
    keys = keys_of(found)
    best = F.max(F.struct("priority", "confidence", (-order).alias("order"), "label", "text")).alias("best")
    sources = F.array_join(F.array_sort(F.collect_set("rule")), "+").alias("sources")
    merged = found.groupBy(*keys, "start", "end").agg(best, (1 - F.aggregate(doubts, F.lit(1.0), lambda p, d: p * d)).alias("merged"), F.count("*").alias("n"), sources)
    confidence = F.when(F.col("n") == 1, F.col("best.confidence")).otherwise(F.col("merged"))
    return merged.select(*keys, "start", "end", "best.text", "best.label", "best.priority", confidence.alias("confidence"), "sources")


def _overlap(a: Column, b: Column) -> Column:
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def resolve(found: DataFrame) -> DataFrame:
    """Non-overlapping spans: exact merges, then a fold in order of priority, confidence and length.

    A group is one row's candidates, not a corpus key; its order and the choice are one expression,
    without Python.  Candidates need doc_id (and row, where ids repeat), start, end, text, label, rule,
    priority and confidence."""
    merged = merge_exact(found)
    key = F.struct((-F.col("priority")).alias("p"), (-F.bround("confidence", 2)).alias("c"), (F.col("start") - F.col("end")).alias("l"), "start", "end", "text", "label", "priority", "confidence", "sources")

    def step(kept: Column, c: Column) -> Column:
        def dominates(e: Column) -> Column:
            holds = (e["start"] <= c["start"]) & (c["end"] <= e["end"])
            held = (c["start"] <= e["start"]) & (e["end"] <= c["end"])
            strong = (e["priority"] >= 90) & (c["priority"] < 90)
            return _overlap(e, c) & F.when(holds, ~((c["priority"] >= 90) & (e["priority"] < 90))).when(held, strong).otherwise(~(c["priority"] * c["confidence"] > e["priority"] * e["confidence"]))

        return F.when(F.exists(kept, dominates), kept).otherwise(F.array_append(F.filter(kept, lambda e: ~_overlap(e, c)), c))

    keys = keys_of(found)
    grouped = merged.groupBy(*keys).agg(F.sort_array(F.collect_list(key)).alias("all"))
    kept = F.aggregate("all", F.filter(F.slice("all", 1, 1), lambda x: F.lit(False)), step)
    return grouped.select(*keys, F.explode(kept).alias("s")).select(*keys, *[f"s.{c}" for c in ("start", "end", "text", "label", "priority", "confidence", "sources")])


def longest_first(found: DataFrame) -> DataFrame:
    """Non-overlapping spans by greatest length, earlier ones first on equal lengths."""
    keys = keys_of(found)
    grouped = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("l"), "start", "end", "label", "text"))).alias("all"))
    kept = F.aggregate("all", F.filter(F.slice("all", 1, 1), lambda x: F.lit(False)), lambda acc, c: F.when(F.exists(acc, lambda e: _overlap(e, c)), acc).otherwise(F.array_append(acc, c)))
    return grouped.select(*keys, F.explode(kept).alias("s")).select(*keys, "s.start", "s.end", "s.text", "s.label")
