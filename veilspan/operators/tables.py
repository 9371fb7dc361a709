"""Labels of table cells, kinds of sheets and the values that their headers declare.

A cell is a row (doc_id, sheet, row, col, value), rows and columns counted from 0.  Of repeated places
the largest value counts; null and blank values are empty cells.  Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.fields import field_label, folded, is_pure_label
from veilspan.functions.text import spans

SHEET = ["doc_id", "sheet"]
PLACE = [*SHEET, "row", "col"]
HEADER_ROWS, PROFILE_ROWS, TOP_ROWS = 10, 3, 12
NO_SPANS = "array<struct<start:int,end:int,text:string,label:string>>"


def filled(cells: DataFrame) -> DataFrame:
    """The cells that hold something, one per place."""
    rows = cells.select("doc_id", "sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("string").alias("value"))
    return rows.where(r"value RLIKE '\\S'").groupBy(*PLACE).agg(F.max("value").alias("value"))


def table_contexts(cells: DataFrame, max_distance: int = 2) -> DataFrame:
    """The filled cells with label, label_row and label_col (null without one), analysis_text (label,
    tab, value) and value_offset.

    A label is the nearest filled cell to the left or above within ``max_distance``, if that one is a
    caption (the left one on equal distance), else its column's last caption in the first ten rows that is
    not repeated in its row.  A year in the two rows under an education heading is dated by it; captions
    themselves have no label.

    A filled cell tells the few places to its right and below it, so groups are single cells: a sheet
    of any length fills no task.
    """
    own = F.when(is_pure_label(F.col("value")), field_label(F.col("value")))
    known = filled(cells).withColumn("own", own)

    reach = lambda d: F.when(F.col("own").isNotNull() | F.lit(d < max_distance), F.lit(d))  # noqa: E731  (what hides labels needs no row at the last distance)
    seen = lambda row, col, d: F.when(reach(d).isNotNull(), F.struct(row.alias("row"), col.alias("col"), F.lit(d).alias("d"), (col - F.col("col")).alias("right")))
    told = [F.struct(F.col("row").alias("row"), F.col("col").alias("col"), F.lit(0).alias("d"), F.lit(0).alias("right"))]
    for d in range(1, max_distance + 1):
        told += [seen(F.col("row"), F.col("col") + d, d), seen(F.col("row") + d, F.col("col"), d)]
    out = known.select("doc_id", "sheet", F.col("row").alias("from_row"), F.col("col").alias("from_col"), "value", "own", F.explode(F.array_compact(F.array(*told))).alias("t"))
    near = F.struct(F.col("t.d").alias("d"), F.col("from_col").alias("c"), F.col("from_row").alias("r"), F.col("own").alias("label"))
    placed = out.groupBy("doc_id", "sheet", F.col("t.row").alias("row"), F.col("t.col").alias("col")).agg(
        F.max(F.when(F.col("t.d") == 0, F.col("value"))).alias("value"),
        F.max(F.when(F.col("t.d") == 0, F.col("own"))).alias("own"),
        F.min(F.when((F.col("t.d") > 0) & (F.col("t.right") > 0), near)).alias("left"),
        F.min(F.when((F.col("t.d") > 0) & (F.col("t.right") == 0), near)).alias("above"),
    ).where("value IS NOT NULL")
    labelled = lambda s: F.when(s["label"].isNotNull(), s)
    nearest = F.least(labelled(F.col("left")), labelled(F.col("above")))

    captions = known.where("own IS NOT NULL").select(*PLACE, "own")
    single = captions.where(F.col("row") < HEADER_ROWS).groupBy(*SHEET, "row", "own").agg(F.count("*").alias("n"), F.min("col").alias("col")).where("n = 1")
    headers = single.groupBy(*SHEET, "col").agg(F.max(F.struct("row", "own")).alias("h"))
    taught = captions.where("own = 'Образование'").select(*SHEET, F.explode(F.array(F.col("row") + 1, F.col("row") + 2)).alias("row")).distinct().withColumn("taught", F.lit(True))

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        right = reduce(lambda d, k: d.withColumnRenamed(k, f"_{k}"), keys, right)
        return left.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left").drop(*[f"_{k}" for k in keys])

    rows = joined(joined(placed.withColumn("near", nearest), headers, [*SHEET, "col"]), taught, [*SHEET, "row"])
    year = F.coalesce(F.col("taught"), F.lit(False)) & F.col("value").rlike(r"^\s*(?:19|20)\d{2}\s*$")
    below = F.when(F.col("row") > F.col("h.row"), F.col("h"))
    pick = lambda by_year, by_near, by_header: F.when(F.col("own").isNull(), F.when(year, by_year).when(F.col("near").isNotNull(), by_near).otherwise(by_header))
    label = pick(F.lit("Дата образования"), F.col("near.label"), below["own"])
    rows = rows.select(*PLACE, "value", label.alias("label"), pick(F.col("row") - 1, F.col("near.r"), below["row"]).alias("label_row"), pick(F.col("col"), F.col("near.c"), F.when(below.isNotNull(), F.col("col"))).alias("label_col"))
    return rows.withColumn("analysis_text", F.concat_ws("\t", "label", "value")).withColumn("value_offset", F.coalesce(F.char_length("label") + 1, F.lit(0)))


def project_to_value(start: Column, end: Column, offset: Column, value: Column) -> Column:
    """A span of ``analysis_text`` as (start, end) in the value; null if it touches the label or is void."""
    return F.when((start >= offset) & (end <= offset + F.char_length(value)) & (start < end), F.struct((start - offset).alias("start"), (end - offset).alias("end")))


def sheet_profiles(cells: DataFrame) -> DataFrame:
    """doc_id, sheet (its title) and profile of every sheet with filled cells: the kind that words of the
    first rows or the title tell, or generic.  Partial aggregates; no sheet is collected."""
    n = folded(F.col("value"))
    has = lambda word, rows=PROFILE_ROWS: F.max(F.coalesce((F.col("row") < rows) & F.contains(n, F.lit(word)), F.lit(False)))
    title = folded(F.col("sheet"))
    # Words of headers and titles.
    profile = (
        F.when(has("инвентарный номер") | title.isin("мц", "ос", "ано осв"), "inventory")
        .when(has("полное наименование фсо"), "public_org_registry")
        .when(has("полное наименование ип"), "sole_trader_registry")
        .when(has("назначение платежа") & (has("вх.номер") | has("контрагент")), "payment_register")
        .when(has("назначение платежа") & has("номер документа"), "bank_operations")
        .when(has("владелец счета"), "simple_bank_statement")
        .when(title.startswith("выписка"), "bank_statement")
        .when(has("образец заполнения платежного поручения", TOP_ROWS), "payment_order")
        .when(has("организация") & has("телефон") & has("сайт"), "supplier_directory")
        .otherwise("generic")
    )
    return filled(cells).groupBy(*SHEET).agg(profile.alias("profile"))


def header_map(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, col and header: the first filled cell of each column in the first twelve rows."""
    top = filled(cells.where(F.col("row") < TOP_ROWS))
    return top.groupBy(*SHEET, "col").agg(F.min_by(folded(F.col("value")), "row").alias("header"))


# Shapes of declared values.
_DATE = r"(?<!\d)(?:0?[1-9]|[12]\d|3[01])[.](?:0?[1-9]|1[0-2])[.](?:19|20)\d{2}(?!\d)"
_ACCOUNT = r"(?<!\d)(?:\d[ \u00a0]*){20}(?!\d)"
_EMAIL = r"(?iU)(?<![\w.+-])[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w.-])"
_PHONE = r"(?<!\d)(?:\+?7|8|9)[\s\u00a0()\-–—‒]*(?:\d[\s\u00a0()\-–—‒]*){9,11}(?!\d)"
_AFTER_NUMBER = r"(?iU)(\b(?:сч[её]т(?:у|а)?|сч\.?|счету)\s*№\s*)([A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9./\-]*)"
_TAX = r"(?i)(ИНН\s*:\s*)(\d{10,12})"
_TRADER = r"(?iu)^\s*(?:индивидуальный\s+предприниматель|ип)\s+"
_PERSONAL = r"(?iu)^\s*индивидуальный\s+предприниматель\s+"
#: Labels of a neighbouring caption that tell what a number is.
NUMBER_LABELS = {
    "инн": "INN", "кпп": "KPP", "бик": "BIK", "огрн": "OGRN", "огрнип": "OGRNIP", "расчетный счет": "RU_ACCOUNT", "лицевой счет": "RU_ACCOUNT", "номер счета": "RU_ACCOUNT",
    "номер карты счета": "RU_ACCOUNT", "номер карты / счета": "RU_ACCOUNT", "счет": "RU_ACCOUNT", "банковский счет": "RU_ACCOUNT", "номер документа": "DOCUMENT_NUMBER",
}


def _span(start: Column, end: Column, text: Column, label: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), F.lit(label).alias("label"))


def _matches(text: Column, pattern: str, label: str, value_group: int | None = None) -> Column:
    """Matches as labelled spans; of a pattern with a prefix only its value, which ends the match."""

    def one(s: Column) -> Column:
        value = s["text"] if value_group is None else F.regexp_extract(s["text"], pattern, value_group)
        return _span(s["end"] - F.char_length(value), s["end"], value, label)

    return F.transform(spans(text, pattern), one)


def _union(*parts: Column) -> Column:
    """Spans of all parts; one that overlaps a span of an earlier part is left out."""
    return reduce(lambda a, b: F.concat(a, F.filter(b, lambda y: ~F.exists(a, lambda x: (x["start"] < y["end"]) & (y["start"] < x["end"])))), parts)


def _rest(text: Column, label: str, begin: Column | None = None, ending: Column | None = None) -> Column:
    """One span from ``begin`` to the end less ``ending`` characters; its value without white space at the ends."""
    begin = F.lit(0) if begin is None else begin
    end = F.char_length(text) if ending is None else F.char_length(text) - ending
    return F.array(_span(begin, end, F.trim(F.substr(text, begin + 1, end - begin)), label))


def cell_spans(text: Column, profile: Column, row: Column, col: Column, header: Column) -> Column:
    """(spans, handled) of a cell: what its sheet's profile and its column's header declare, as spans
    (start, end, text, label) to be replaced; a handled cell needs no further detection."""
    none = F.array().cast(NO_SPANS)
    header = F.coalesce(header, F.lit(""))
    dates, accounts = _matches(text, _DATE, "DATE"), _matches(text, _ACCOUNT, "RU_ACCOUNT")
    contacts = _union(_matches(text, _EMAIL, "EMAIL"), _matches(text, _PHONE, "PHONE_NUMBER"))
    numbered = _matches(text, _AFTER_NUMBER, "DOCUMENT_NUMBER", 2)
    whole = lambda label: _rest(text, label)
    prefix = lambda pattern: F.char_length(F.regexp_extract(text, pattern, 0))
    has = lambda word: F.contains(header, F.lit(word))

    trader = (
        F.when(has("полное наименование ип") | has("сокращенное наименование ип"), _rest(text, "PER", prefix(_TRADER)))
        .when(header == "инн", whole("INN")).when(header.isin("огрн", "огрнип"), whole("OGRNIP")).when(has("адрес"), whole("ADDRESS")).when(has("контакт"), contacts).otherwise(none)
    )
    payment = (
        F.when(has("дата"), F.when((F.size(dates) == 0) & text.rlike(r"^\s*\d{4}-\d{2}-\d{2}(?:\s+00:00:00)?\s*$"), whole("DATE")).otherwise(dates))
        .when(has("номер"), whole("DOCUMENT_NUMBER")).when(has("назначение платежа"), _union(numbered, dates)).when((profile == "payment_register") & has("контрагент"), whole("ORG")).otherwise(none)
    )
    declared = has("дата") | has("номер") | has("назначение платежа")
    colon = F.instr(text, ":")
    statement = (
        F.when((col == 1) & (row >= 17) & text.rlike(r"^\s*\d+\s*$"), whole("DOCUMENT_NUMBER"))
        .when((col == 2) & (row >= 17) & ~F.lower(text).startswith("контрагент"), whole("ORG"))
        .when(col == 3, _union(_matches(text, r"(?iu)(БИК\s*:\s*)(\d{9})", "BIK", 2), _matches(text, _TAX, "INN", 2), _matches(text, r"(?iu)(Р\s*/\s*С\s*:\s*)((?:\d\s*){20})", "RU_ACCOUNT", 2)))
        .when(col == 5, _union(numbered, dates))
        .otherwise(F.when(F.contains(F.lower(text), F.lit("клиент:")), _rest(text, "ORG", colon)).otherwise(_union(dates, accounts, _matches(text, _TAX, "INN", 2))))
    )
    owner = text.rlike(r"\(ИП\)\s*$")
    simple = (
        F.when((row == 0) & (col == 1), whole("RU_ACCOUNT")).when((row == 1) & (col == 1), dates)
        .when((row == 2) & (col == 1), F.when(owner, _rest(text, "PER", None, F.char_length(F.regexp_extract(text, r"\s*\(ИП\)\s*$", 0)))).otherwise(whole("PER")))
        .when((row == 3) & (col == 1), whole("INN")).when((row == 4) & (col == 1), whole("BIK")).when((row >= 12) & (col == 0), dates).when((row >= 12) & (col == 1), whole("DOCUMENT_NUMBER"))
        .when((row >= 12) & (col == 3), F.when(text.rlike(_PERSONAL), _rest(text, "PER", prefix(_PERSONAL))).otherwise(whole("ORG"))).otherwise(none)
    )
    at = lambda r, c: (row == r) & (col == c)
    order = F.when(at(5, 17), whole("BIK")).when(at(6, 17) | at(8, 17), whole("RU_ACCOUNT")).when(at(8, 0), whole("INN")).when(at(8, 8), whole("KPP"))
    star = F.when(text.endswith("*"), F.lit(1)).otherwise(F.lit(0))
    supplier = (
        F.when(header == "организация", whole("ORG")).when(header == "сайт", _rest(text, "WEBSITE", None, star))
        .when((header == "телефон") & ~F.lower(text).rlike("[xх]"), whole("PHONE_NUMBER")).otherwise(none)
    )

    is_header = F.coalesce(F.when(profile == "bank_operations", row == 1).when(profile.isin("public_org_registry", "sole_trader_registry", "payment_register", "supplier_directory"), row == 0), F.lit(False))
    blank = ~F.coalesce(text.rlike(r"\S"), F.lit(False))
    found = (
        F.when(blank | is_header, none).when(profile == "public_org_registry", F.when(has("контакт"), contacts).otherwise(none)).when(profile == "sole_trader_registry", trader)
        .when(profile.isin("payment_register", "bank_operations"), payment).when(profile == "bank_statement", statement).when(profile == "simple_bank_statement", simple)
        .when(profile == "payment_order", F.coalesce(order, none)).when(profile == "supplier_directory", supplier).otherwise(none)
    )
    open_cell = (profile == "generic") | (~blank & (((profile == "bank_operations") & ~is_header & ~declared) | ((profile == "payment_order") & order.isNull())))
    return F.struct(found.alias("spans"), F.coalesce(~open_cell, F.lit(False)).alias("handled"))


def targeted_cells(cells: DataFrame) -> DataFrame:
    """The filled cells with their sheet's profile, their column's header, spans and handled."""
    # filled() already groups by place; profiles and headers are small sides that adaptive execution may broadcast
    rows = filled(cells)
    kinds, heads = sheet_profiles(cells), header_map(cells)
    for right, keys in ((kinds, SHEET), (heads, [*SHEET, "col"])):
        right = reduce(lambda d, k: d.withColumnRenamed(k, f"_{k}"), keys, right)
        rows = rows.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left").drop(*[f"_{k}" for k in keys])
    return rows.withColumn("c", cell_spans(F.col("value"), F.col("profile"), F.col("row"), F.col("col"), F.col("header"))).select(*PLACE, "value", "profile", "header", "c.spans", "c.handled")


def number_spans(text: Column, label: Column) -> Column:
    """Spans of a short number that the label beside it explains, else of document numbers in the text."""
    key, none = folded(label), F.array().cast(NO_SPANS)
    kinds = sorted(set(NUMBER_LABELS.values()))
    direct = reduce(lambda acc, kind: acc.when(key.isin(*[k for k, v in NUMBER_LABELS.items() if v == kind]), _rest(text, kind)), kinds, F.when(F.lit(False), none))
    account = text.rlike(r"^\s*\d{20}\s*$") & key.rlike("счет|карт|account|р/с")
    return F.when(text.isNull(), none).when(text.rlike(r"^\s*[\d \u00a0./-]+\s*$") & key.isin(*NUMBER_LABELS), direct).when(account, _rest(text, "RU_ACCOUNT")).otherwise(_matches(text, _AFTER_NUMBER, "DOCUMENT_NUMBER", 2))


def file_name_spans(name: Column) -> Column:
    """Accounts, bank codes, dates and invoice numbers in a file's name, its extension left alone."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^./\\ ]+$", "")
    return _union(_matches(stem, _ACCOUNT, "RU_ACCOUNT"), _matches(stem, _DATE, "DATE"), _matches(stem, r"(?iU)(\b(?:бик\s*)?)(\d{9})(?!\d)", "BIK", 2), _matches(stem, r"(?iU)(\bсч[её]т\s*№\s*)([\w./-]+)", "DOCUMENT_NUMBER", 2))


def title_spans(title: Column) -> Column:
    """Accounts in a sheet's title."""
    return _matches(title, _ACCOUNT, "RU_ACCOUNT")


def title_token(token: Column) -> Column:
    """A placeholder with the characters that a sheet's title may not hold replaced."""
    return F.translate(token, "[]/", "()-")
