from pyspark.sql import functions as F

from veilspan.operators import detection as D
from veilspan.operators import fields as L
from veilspan.plans import fields as P


def test_every_sample_gives_its_value_alone(spark):
    rows = [(i, f"Запись {i}; {c}{v}" + (";\nконец" if i % 2 else ".")) for i, (_, c, v) in enumerate(P.SAMPLES)]
    got = {}
    for r in L.field_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.label, r.text, r.start))
    for i, (label, caption, value) in enumerate(P.SAMPLES):
        assert got.get(i, []) == ([(label, value, len(f"Запись {i}; {caption}"))] if label else []), caption
    assert len({s[0] for s in P.SAMPLES if s[0]}) >= 85


def test_passports_and_rows(spark):
    docs = spark.createDataFrame([(1, "паспорт 45 09 123456; паспорт № 123456"), (1, "серия паспорта 45 09"), (None, "ИНН 7707083893, ИНН 7707083893"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.label, r.start, r.end) for r in L.field_spans(docs).collect()), key=repr)
    assert got == sorted([(1, "PASSPORT", 8, 20), (1, "PASSPORT_NUMBER", 32, 38), (1, "PASSPORT_SERIES", 15, 20), (None, "INN", 4, 14), (None, "INN", 20, 30)], key=repr)


def test_fields_join_the_candidates(spark):
    docs = spark.createDataFrame([(1, "должность: ведущий инженер; ip 10.0.0.1"), (1, "другое")], "doc_id long, text string")
    found = D.resolve(D.candidates(docs, external=L.field_spans(docs)))
    assert {(r.label, r.text) for r in found.collect()} == {("JOB_TITLE", "ведущий инженер"), ("IP_ADDRESS", "10.0.0.1")} and found.select(F.count_distinct("row")).first()[0] == 1
