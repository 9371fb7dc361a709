from pyspark.sql import functions as F

from veilspan.functions import checksums as C
from veilspan.operators import coverage as V


def test_records_hold_their_values(spark):
    rows = V.positives(spark).unionByName(V.negatives(spark)).collect()
    assert len(rows) == len(V.SPECS) * 240 and len({r.id for r in rows}) == len(rows) and len({s.label for s in V.SPECS}) == len(V.SPECS) == 100
    assert all(r.text[r.start : r.end] == r.surface for r in rows)
    seen = {}
    for r in rows:
        seen.setdefault(r.template_id, set()).add(r.split)
    assert all(len(s) == 1 for s in seen.values()) and len(seen) == 22


def test_check_digits_are_valid(spark):
    rows = V.positives(spark)
    checks = {"INN": C.valid_inn, "OGRN": C.valid_ogrn, "OGRNIP": C.valid_ogrn, "SNILS": C.valid_snils, "BANK_CARD": C.valid_card, "IBAN": lambda v: C.iban_problem(v).isNull(), "BIK": C.valid_bik, "PASSPORT_DIVISION_CODE": C.valid_division_code}
    for label, check in checks.items():
        assert rows.where(F.col("label") == label).where(~check(F.col("surface"))).isEmpty(), label


def test_written_by_split(spark, tmp_path):
    V.write_coverage(V.negatives(spark, V.SPECS[:2], 6), f"{tmp_path}/c")
    assert {r.split: r["count"] for r in spark.read.json(f"{tmp_path}/c").groupBy("split").count().collect()} == {"train": 4, "dev": 4, "test": 4}
