from pyspark.sql import functions as F

from veilspan.functions import pages as P
from veilspan.operators import refinement as R
from veilspan.plans import filters as Q


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_recognised_lines(spark):
    lines = {
        "mail: иvan@mаil.ru": "mail: иvan@mail.ru", "СВИФТ: DЕUТDЕFF": "СВИФТ: DEUTDEFF", "код 77O-ОО1": "код 770-001", "No 5 《Ромашка 》": "№ 5 «Ромашка»", "a @@ b.ru": "a@b.ru", "u1 @ mail . ru": "u1@mail.ru",
        "Догoвор": "Договор", "Hоuse": "House", "  много   мест ": "много мест", "тbIква": "тыква", None: "",
    }
    df = spark.createDataFrame([(k, v) for k, v in lines.items()], "t string, want string").select("t", "want", P.recognised_line(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in df.collect()] == [(r.t, r.want) for r in df.collect()]


def test_each_step_reads_the_line_once(spark):
    """Steps put around each other don't double the expression: before, 63 and 255 searches were planned."""
    searches = lambda c: spark.range(1).select(F.lit("a").alias("t")).select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(")
    assert searches(P.recognised_line(F.col("t"))) == 6
    nested = F.col("t")
    for _ in range(8):
        nested = P.rewritten(nested, "[аb]+", P.to_latin)
    assert searches(nested) == 8


def test_lines_of_one_row_group_on_all_cores(spark, tmp_path):
    orders = spark.range(1000).select(F.col("id").alias("o_orderkey")).coalesce(1)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines = Q.repaired_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert {(r.o_orderkey, r.line) for r in lines.collect()} == {(k, f"Договор № {k} «Ромашка», код 770-001, a{k}@mail.ru") for k in range(1000)}


def test_lines_with_marks_and_odd_words(spark):
    lines = {
        "\uffffиvan@mаil.ru\uffff 77O-ОО1": "\uffffиvan@mail.ru\uffff 770-001", "\uffff": "\uffff", "12O-О45-О12": "120-045-О12", "VIN№ ХTА21099043576182": "VIN№ XTA21099043576182", "БИК:  DЕUTDEFF, DЕUTDЕFF": "БИК: DEUTDEFF, DEUTDEFF",
        "cоnо": "соnо", "abcо": "abco", "aб": "aб", "абвcex": "абвcex", "дgжs": "дgжs", "«  а  б » «\u00a0в": "«а б» « в", "a_Ь-c@д.e": "a_Ь-c@д.e",
    }
    df = spark.createDataFrame(list(lines.items()), "t string, want string").select("want", P.recognised_line(F.col("t")).alias("got"))
    rows = df.collect()
    assert [r.got for r in rows] == [r.want for r in rows] and not df.schema["got"].nullable


def test_paragraphs(spark):
    text = "ДОГОВОР\n1. Предмет договора\nдлинная строка, которая продолжается на следующей стро-\nке и ещё дальше без конца и без начала,\nдо точки.\nИНН 77\n\nвторой блок:\nпункт | два"
    want = ["ДОГОВОР", "1. Предмет договора", "длинная строка, которая продолжается на следующей строке и ещё дальше без конца и без начала, до точки.", "ИНН 77", "второй блок:", "пункт | два"]
    got = [r.p for r in spark.createDataFrame([(text,), (None,), (" \n ",)], "t string").select(P.paragraphs(F.col("t")).alias("p")).collect()]
    assert got == [want, [], []]


def test_regions_in_a_text(spark):
    region = "struct<page:int,text:string,box:struct<x1:double,y1:double,x2:double,y2:double>,confidence:double>"
    box = lambda y: (0.0, y, 1.0, y + 0.1)
    pages = spark.createDataFrame([(1, "ab cd\nab ef", [(1, "ab", box(0.1), 0.9), (1, "cd", box(0.1), 0.8), (2, "ab", box(0.2), 0.7), (2, "zz", box(0.3), 0.1), (2, "", box(0.3), 0.1), (2, "ef", box(0.3), 0.5)]), (2, "", [])], f"doc_id long, text string, regions array<{region}>")
    places = P.region_places(pages)
    assert [(r.start, r.end, r.page, r.confidence) for r in places.orderBy("start").collect()] == [(0, 2, 1, 0.9), (3, 5, 1, 0.8), (6, 8, 2, 0.7), (9, 11, 2, 0.5)]
    spans = spark.createDataFrame([(1, 4, 7), (1, 2, 3), (3, 0, 1)], "doc_id long, start int, end int")
    assert {(r.start, r.page, r.confidence) for r in P.region_of_span(spans, places).collect()} == {(4, 1, 0.8), (2, None, None), (0, None, None)}


def test_addresses(spark):
    text = "Юридический адрес: 101000, г. Город, ул. Лесная, д. 5, кв. 7, тел. 1. Выезд 10 февраля; офис: ул. Полевая, д. 2 и г. Другой, страна"
    at = lambda s: (text.index(s), text.index(s) + len(s))
    spans = [(*at("г. Город"), "ADDRESS"), (*at("ул. Лесная"), "ADDRESS"), (*at("ул. Полевая"), "ADDRESS"), (*at("г. Другой"), "ADDRESS"), (*at("Выезд"), "ORG")]
    out = R.merged_addresses(spark.createDataFrame([(1, *s) for s in spans], "doc_id long, start int, end int, label string"), spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = sorted((text[r.start : r.end], r.label) for r in out.collect())
    assert got == sorted([("101000, г. Город, ул. Лесная, д. 5, кв. 7", "ADDRESS"), ("ул. Полевая, д. 2", "ADDRESS"), ("Выезд", "ORG")])
    s, e = at("г. Город")
    assert one(spark, R.is_explicit_postal_address(F.col("t"), F.lit(at("101000")[0]), F.lit(e)), t=text) is True
    assert one(spark, R.is_explicit_postal_address(F.col("t"), F.lit(at("г. Другой")[0]), F.lit(at("г. Другой")[1])), t=text) is False


def test_terms_and_epithets(spark):
    def term(text, word):
        a = text.index(word)
        return one(spark, R.is_term(F.col("t"), F.lit(a), F.lit(a + len(word))), t=text)

    assert term("далее РИМ (Рекламно-информационные материалы)", "РИМ") and term("1.1. Товар – вещь", "Товар") and term("показатель ВВП растёт", "ВВП")
    assert not term("живёт в городе г. РИМ давно", "РИМ") and not term("наш Город растёт", "Город")
    text = "Университет имени Иванова и Пётр"
    assert one(spark, R.is_institution_epithet(F.col("t"), F.lit(text.index("Иванова"))), t=text) and not one(spark, R.is_institution_epithet(F.col("t"), F.lit(text.index("Пётр"))), t=text)
