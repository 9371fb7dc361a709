from pyspark.sql import functions as F

from veilspan.functions import fields
from veilspan.operators import refinement as R
from veilspan.operators import tables as T

CELLS = "doc_id long, sheet string, row int, col int, value string, extra string"


def cells(spark, *sheets):
    rows = [(i, title, r, c, v, "x") for i, (title, grid) in enumerate(sheets) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, CELLS)


def test_field_labels(spark):
    want = {
        "ИНН": ("ИНН", True), " Ф.И.О: ": ("ФИО", True), "Ф.И.О.:": ("ФИО", False), "ИНН / КПП покупателя": ("ИНН/КПП", True), "ИНН 7707083893": ("ИНН", False), "Наименование банка": ("Наименование", False),
        "Наименование полное": ("Наименование", True), "Номер  расчётного счёта": ("Расчётный счёт", True), "счастье": (None, False), "": (None, False), None: (None, False), "ИНН" + "x" * 99: (None, False),
        "ОГРНИП": ("ОГРНИП", True), "телефон " + "y" * 40: (None, False),
    }
    df = spark.createDataFrame([(t,) for t in want], "t string").select("t", fields.field_label(F.col("t")).alias("label"), fields.is_pure_label(F.col("t")).alias("pure"))
    got = {r.t: (r.label, r.pure) for r in df.collect()}
    want["Наименование банка"] = ("Наименование", True)
    assert got == want


def test_contexts(spark):
    sheets = (
        ("form", [["ФИО", "Иванов"], ["Адрес", None, "Москва"], [" ", "x", "y"]]),
        ("down", [["Кадастровый номер", "Сумма"], ["77:01:0000000:1", "5"], [None, "6"], ["a", "7"], ["b", "8"]]),
        ("cv", [["Образование", "Образование"], ["2001", "МГУ"], ["z", "1999 "]]),
    )
    df = cells(spark, *sheets)
    got = {(r.sheet, r.row, r.col): (r.label, r.label_row, r.label_col) for r in T.table_contexts(df.unionByName(df)).collect()}
    assert got[("form", 0, 0)] == (None, None, None) and got[("form", 0, 1)] == ("ФИО", 0, 0) and got[("form", 1, 2)] == ("Адрес", 1, 0)
    assert got[("form", 2, 1)] == (None, None, None) and ("form", 2, 0) not in got and ("form", 1, 1) not in got
    assert got[("down", 1, 0)] == got[("down", 3, 0)] == got[("down", 4, 0)] == ("Кадастровый номер", 0, 0) and got[("down", 1, 1)] == (None, None, None)
    assert got[("cv", 1, 0)] == ("Дата образования", 0, 0) and got[("cv", 2, 1)] == ("Дата образования", 1, 1) and got[("cv", 2, 0)] == (None, None, None)
    assert T.table_contexts(df.where("false")).count() == 0
    one = T.table_contexts(df).where("sheet = 'form' AND row = 0 AND col = 1").select("analysis_text", T.project_to_value(F.lit(4), F.lit(7), F.col("value_offset"), F.col("value")).alias("s"), T.project_to_value(F.lit(0), F.lit(7), F.col("value_offset"), F.col("value")).alias("none")).first()
    assert one.analysis_text == "ФИО\tИванов" and tuple(one.s) == (0, 3) and one.none is None


def test_sheets(spark):
    sheets = (
        ("Лист1", [["Наименование", "Инвентарный номер"], ["Машина Смита", "000000004340"]]),
        ("s", [["№", "Организация", "Телефон", "Сайт"], ["1", " ГлавЭксперт ", "+7 (XXX) XXX-XX-XX", "example.ru*"]]),
        ("p", [["Дата", "Списание", "Назначение платежа", "Контрагент", "Вх.номер"], ["08.09.2025", "2155200", "Оплата по счету №190 от 08.09.2025", "СИНТЕЗ ООО", "287"]]),
        ("ип", [["Полное наименование ИП", "ИНН", "Контакты"], ["Индивидуальный предприниматель Иванов И.И.", "7707083893", "a@b.ru, 8 (495) 123-45-67"]]),
        ("Выписка 1", [["x", "y", "z", "БИК: 044525225 ИНН: 7707083893"], ["Клиент: ООО Ромашка"]]),
        ("g", [["любой"]]),
    )
    got = {(r.sheet, r.row, r.col): r for r in T.targeted_cells(cells(spark, *sheets)).collect()}
    spans = {k: [tuple(s) for s in r.spans] for k, r in got.items()}
    kinds = {k[0]: r.profile for k, r in got.items()}
    assert kinds == {"Лист1": "inventory", "s": "supplier_directory", "p": "payment_register", "ип": "sole_trader_registry", "Выписка 1": "bank_statement", "g": "generic"}
    assert spans[("Лист1", 1, 1)] == [] and got[("Лист1", 1, 1)].handled and not got[("g", 0, 0)].handled
    assert spans[("s", 1, 1)] == [(0, 13, "ГлавЭксперт", "ORG")] and spans[("s", 1, 2)] == [] and spans[("s", 1, 3)] == [(0, 10, "example.ru", "WEBSITE")]
    assert spans[("p", 1, 1)] == [] and spans[("p", 1, 2)] == [(17, 20, "190", "DOCUMENT_NUMBER"), (24, 34, "08.09.2025", "DATE")] and spans[("p", 1, 4)] == [(0, 3, "287", "DOCUMENT_NUMBER")]
    assert spans[("ип", 1, 0)] == [(31, 42, "Иванов И.И.", "PER")] and [s[3] for s in spans[("ип", 1, 2)]] == ["EMAIL", "PHONE_NUMBER"]
    assert [s[2:] for s in spans[("Выписка 1", 0, 3)]] == [("044525225", "BIK"), ("7707083893", "INN")] and spans[("Выписка 1", 1, 0)] == [(7, 19, "ООО Ромашка", "ORG")]


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("Счет № 2 от 13.02.2026 40702810800000012345.xlsx",), (None,), ("",)], "n string").select(T.file_name_spans(F.col("n")).alias("s"))
    got = [r.s for r in df.collect()]
    assert {(s.text, s.label) for s in got[0]} == {("40702810800000012345", "RU_ACCOUNT"), ("13.02.2026", "DATE"), ("2", "DOCUMENT_NUMBER")} and not got[1] and got[2] == []
    df = spark.createDataFrame([("7707083893", "ИНН"), ("x", "ИНН"), ("1" * 20, "Карта"), ("счет № A-1", None), (None, "ИНН")], "t string, l string")
    assert [[s.label for s in r.s] for r in df.select(T.number_spans(F.col("t"), F.col("l")).alias("s")).collect()] == [["INN"], [], ["RU_ACCOUNT"], ["DOCUMENT_NUMBER"], []]


def test_refinement(spark):
    df = spark.createDataFrame(
        [("Телефон: +7 495 1234567", 0, 23, "PHONE_NUMBER"), ("x\n101000, Адрес: г. Москва", 10, 26, "ADDRESS"), ("a\n101000, г. Москва", 10, 19, "ADDRESS"), ("факс: 1", 0, 7, "PHONE_NUMBER"), ("Телефон: 123", 0, 12, "ORG"), (None, 1, 2, "ADDRESS")],
        "t string, s int, e int, l string",
    )
    assert [r.x for r in df.select(R.refined_start(F.col("t"), F.col("s"), F.col("e"), F.col("l")).alias("x")).collect()] == [9, 17, 2, 0, 0, 1]
    df = spark.createDataFrame([("ст. 15 ГК РФ",), ("www.пример.рф",), ("1.2",), (None,)], "t string")
    assert [(r.a, r.b) for r in df.select(R.is_legal_citation(F.col("t")).alias("a"), R.is_website(F.col("t")).alias("b")).collect()] == [(True, False), (False, True), (False, False), (False, False)]
    df = spark.createDataFrame([("по постановлению Правительства № 15", 33, "15"), ("договор. № 15", 11, "15"), ("x", 0, "152-ФЗ"), ("проживает по адресу: Тверь", 21, "Тверь"), (None, 0, None)], "t string, s int, v string")
    got = df.select(R.is_official_number(F.col("t"), F.col("s"), F.col("v")).alias("a"), R.has_address_marker(F.col("t"), F.col("s")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, False), (False, False), (True, False), (False, True), (False, False)]
