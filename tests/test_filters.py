import json

from pyspark.sql import functions as F

from veilspan.operators import refinement as R
from veilspan.operators import registries as G
from veilspan.operators import review as V


def one(spark, f, text, part=None):
    a = text.index(part) if part else 0
    b = a + len(part) if part else len(text)
    return spark.createDataFrame([(text, a, b)], "t string, a int, b int").select(f(F.col("t"), F.col("a"), F.col("b")).alias("x")).first().x


def test_predicates(spark):
    public = {"Министерство финансов": True, "Арбитражный суд города": True, "ООО «Администрация плюс»": False, "Ромашка": False, None: False}
    df = spark.createDataFrame([(k, v) for k, v in public.items()], "s string, want boolean")
    assert all(r.got == r.want for r in df.select("want", R.is_public_body(F.col("s")).alias("got")).collect())
    for f, yes, no in ((R.is_unfilled, "ООО «...»", "ООО «Ромашка»"), (R.is_product, "АБ-1200К", "ООО «АБ-1200»"), (R.is_place_alone, "г. Москва", "г. Москва, ул. Лесная, д. 5")):
        assert one(spark, lambda t, a, b, f=f: f(t), yes) and not one(spark, lambda t, a, b, f=f: f(t), no)
    date = lambda t, a, b: R.is_act_date(t, a)
    assert one(spark, date, "согласно закону № 1 от 01.02.2003", "01.02") and one(spark, date, "сведения по состоянию на 01.02.2003", "01.02")
    assert not one(spark, date, "по закону стороны заключили договор от 01.02.2003", "01.02") and not one(spark, date, "родился 01.02.2003", "01.02")
    form = lambda t, a, b: R.has_legal_form_before(t, a)
    assert one(spark, form, "между ООО «Ромашка»", "Ромашка") and not one(spark, form, "цветок «Ромашка»", "Ромашка")


def test_bounds(spark):
    text = "Генеральный директор Иванов Иван и ООО «Ромашка» (далее – Заказчик), «Лютик» (АО «Лт»)"
    start = one(spark, R.person_start, text, "Генеральный директор Иванов Иван")
    assert text[start:].startswith("Иванов Иван")
    core = lambda part: (lambda r: text[r.start : r.end])(one(spark, R.organisation_core, text, part))
    assert core("ООО «Ромашка» (далее – Заказчик)") == "Ромашка" and core("ООО «Ромашка»") == "Ромашка"
    assert [text[r.start : r.end] for r in one(spark, R.alias_cores, text, "«Лютик» (АО «Лт»)")] == ["Лютик", "Лт"]
    names = spark.createDataFrame([("выписка 40702810900000000001 БИК 044525225 от 01.02.2024.xlsx",), (None,)], "n string")
    assert [r.x for r in names.select(R.masked_filename(F.col("n")).alias("x")).collect()] == ["выписка [RU_ACCOUNT] БИК [BIK] от [DATE].xlsx", ""]
    assert len(names.select(R.masked_sheet_title(F.col("n")).alias("x")).first().x) == 31


def test_names_of_one_person(spark):
    surfaces = ["Иванов Иван Петрович", "Иванов И.П.", "И. П. Иванов", "Петров П.П.", "Петров Пётр Павлович", "Петров Павел Петрович", "Сидоров С."]
    rows = {r.surface: r.entity for r in G.linked_entities(spark.createDataFrame([("PER", s) for s in surfaces] + [("ORG", "Иванов И.П.")], "label string, text string")).where("label = 'PER'").collect()}
    assert len({rows[s] for s in surfaces[:3]}) == 1 and len({rows[s] for s in surfaces[3:6]}) == 3 and rows["Сидоров С."] == "сидоров с."


def test_registries_that_differ(spark):
    a = spark.createDataFrame([("[A_1]", "x"), ("[A_2]", "y")], "token string, original string")
    assert G.differences(a, a).isEmpty() and {(r.token, r.side) for r in G.differences(a, a.where("token = '[A_1]'")).collect()} == {("[A_2]", "first")}


def test_queue_pages(spark):
    raw = spark.createDataFrame([("d1", "p1", "inn", "[INN_1]", 0.9, "pending"), ("d1", "p2", "snils", "[X_1]", 0.2, "accepted"), ("d2", "p1", "inn", "[INN_2]", 0.8, "pending")], "document_ref string, location string, entity_type string, placeholder string, confidence double, status string")
    queue = V.findings(raw)
    rows, counts = V.page_with_counts(queue, 1, entity_type="inn")
    n = {(r.scope, r.status): r.n for r in counts.collect()}
    assert rows.count() == 1 and n["all", "total"] == 3 and n["filtered", "pending"] == 2 and n["filtered", "accepted"] == 0
    ident = queue.first().finding_id
    assert V.found(queue, ident).count() == 1 and V.found(queue, "none").count() == 0
    out = {r.document_ref: json.loads(r.findings) for r in V.export(queue).collect()}
    assert len(out["d1"]["items"]) == 2 and out["d1"]["summary"] == {"pending": 1, "accepted": 1, "rejected": 0, "skipped": 0}
