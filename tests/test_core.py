import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import checksums as C
from veilspan.functions import text as X
from veilspan.operators import detection as D
from veilspan.operators import evaluation as E
from veilspan.operators import masking as M


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (C.valid_inn, "7707083893", "7707083894"),
        (C.valid_inn, "500100732259", "500100732250"),
        (C.valid_ogrn, "1027700132195", "1027700132196"),
        (C.valid_snils, "112-233-445 95", "112-233-445 96"),
        (C.valid_card, "4111 1111 1111 1111", "4111 1111 1111 1112"),
        (C.valid_bik, "044525225", "054525225"),
        (C.valid_iban, "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"),
        (C.valid_swift, "DEUTDEFF", "DEUTDEF"),
        (C.valid_court_case, "А40-12345/2025", "152/2006"),
        (C.valid_division_code, "770-001", "770-000"),
    ],
)
def test_checksums(spark, check, good, bad):
    df = spark.createDataFrame([(good,), (bad,), (None,), ("",)], "v string")
    assert [r.ok for r in df.select(check(F.col("v")).alias("ok")).collect()] == [True, False, False, False]


def test_spans_and_offsets(spark):
    df = spark.createDataFrame([("a😀12b345",), ("",), ("none",)], "t string")
    got = [r.s for r in df.select(X.spans(F.col("t"), r"\d+").alias("s")).collect()]
    assert [tuple(x) for x in got[0]] == [(2, 4, "12"), (5, 8, "345")] and got[1] == got[2] == []
    r = spark.createDataFrame([("x  y­z",)], "t string").select(X.normalize(F.col("t")).alias("n"), X.offset_map(F.col("t")).alias("o")).first()
    assert r.n == "x yz" and r.o == [0, 1, 3, 5, 6]


def test_detect_resolve_mask_restore(spark):
    docs = spark.createDataFrame([(1, "карта 4111 1111 1111 1111, ip 10.0.0.1"), (2, "ip 10.0.0.1 и ИНН 7707083893"), (3, None), (4, "")], "doc_id long, text string")
    found = D.resolve(D.candidates(docs))
    assert {(r.doc_id, r.label) for r in found.collect()} == {(1, "BANK_CARD"), (1, "IP_ADDRESS"), (2, "IP_ADDRESS"), (2, "INN")}
    reg = M.registry(found)
    masked = M.mask(docs, found, reg)
    got = {r.doc_id: r.masked for r in masked.collect()}
    assert got == {1: "карта [BANK_CARD_1], ip [IP_ADDRESS_1]", 2: "ip [IP_ADDRESS_1] и ИНН [INN_1]", 3: "", 4: ""}
    assert {r.doc_id: r.text for r in M.restore(masked, reg).collect()}[2] == "ip 10.0.0.1 и ИНН 7707083893"


def test_metrics(spark):
    g = spark.createDataFrame([(1, 0, 3, "p", "A"), (1, 5, 9, "p", "B")], "doc_id long, start long, end long, layout string, label string")
    p = spark.createDataFrame([(1, 0, 3, "p", "A"), (1, 5, 9, "p", "C")], g.schema)
    micro = E.span_metrics(g, p).where("scope = 'micro'").first()
    assert (micro.tp, micro.fp, micro.fn, micro.f1) == (1, 1, 1, 0.5)
    assert [tuple(r) for r in E.confusion(g, p).collect()] == [("B", "C", 1)]


def test_places_in_the_normalised_text(spark):
    texts = ["a\u00ad b", "x  y\u00adz", " \u200b \u00a0a\u00ad\u200b", "\ufeff\tа\t\u3000б \nв  ", "plain", "😀\u2009 😀 \u00ad", "\u00ad"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalize(F.col("t")).alias("n"), X.offset_map(F.col("t")).alias("o"), X.spans(F.col("t"), X.SQUEEZED).alias("runs"))
    for r in df.select("n", "o", F.transform(F.sequence(F.lit(0), F.char_length("n")), lambda i: X.unsqueezed(i.cast("int"), F.col("runs"))).alias("got")).collect():
        assert r.got == r.o, r.n


def test_identifiers_with_typographic_characters(spark):
    card, snils = "4111 1111 1111 1111", "112-233-445 95"
    texts = {1: "карта " + card.replace(" ", "\u00a0"), 2: "СНИЛС " + snils.replace("-", "\u2013").replace(" ", "\u00a0"), 3: "«карта»  4111\u00ad1111\u200b1111\u00a0 1111.", 4: "код подразделения 770\u2011001", 5: "карта " + card, 6: "ИНН\t77070\u00ad83893", 7: "код подразделения 770\u00a0001"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cands = {(r.doc_id, r.label): r for r in D.candidates(docs).collect()}
    want = {
        (1, "BANK_CARD"): (0.95, texts[1][6:]), (2, "SNILS"): (0.931, texts[2][6:]), (3, "BANK_CARD"): (0.931, texts[3][9:-1]), (4, "PASSPORT_DIVISION_CODE"): (0.931, texts[4][18:]),
        (5, "BANK_CARD"): (0.95, card), (6, "INN"): (0.931, texts[6][4:]), (7, "PASSPORT_DIVISION_CODE"): (0.95, texts[7][18:]),
    }
    assert {k: (round(cands[k].confidence, 6), cands[k].text) for k in want} == want
    found = D.resolve(D.candidates(docs))
    got = {r.doc_id: r.masked for r in M.mask(docs, found, M.registry(found)).collect()}
    assert not any(re.search(r"\d", re.sub(r"\[[A-Z_]+_\d+\]", "", t)) for t in got.values())


def test_rows_of_one_id_are_masked_apart(spark):
    docs = spark.createDataFrame([(1, "адрес 10.0.0.2 и 10.0.0.1"), (1, "ip 10.0.0.1"), (1, "ip 10.0.0.1"), (None, "ip 10.0.0.3"), (2, None), (None, None)], "doc_id long, text string")
    found = D.resolve(D.candidates(docs))
    reg = M.registry(found)
    masked = M.mask(docs, found, reg)
    got = sorted(((r.doc_id, r.masked, r.n_replaced) for r in masked.collect()), key=repr)
    token = {r.original: r.token for r in reg.collect()}
    a, b, c = (token[f"10.0.0.{i}"] for i in (1, 2, 3))
    want = [(1, f"адрес {b} и {a}", 2), (1, f"ip {a}", 1), (1, f"ip {a}", 1), (None, f"ip {c}", 1), (2, "", 0), (None, "", 0)]
    assert got == sorted(want, key=repr) and sorted(token.values()) == [f"[IP_ADDRESS_{i}]" for i in (1, 2, 3)]
    back = sorted(((r.doc_id, r.text) for r in M.restore(masked, reg).collect()), key=repr)
    assert back == sorted([(r.doc_id, r.text or "") for r in docs.collect()], key=repr)
    nulls = spark.createDataFrame([(1, None), (1, "[X_1] [Y_1]")], "doc_id long, masked string")
    assert sorted(M.restore(nulls, spark.createDataFrame([("[X_1]", "a"), ("[X_1]", "a")], "token string, original string")).collect(), key=repr) == [(1, "a [Y_1]"), (1, None)]


def test_spellings_of_one_number_are_one_entity(spark):
    found = spark.createDataFrame([(1, 0, "112-233-445 95", "SNILS"), (2, 0, "11223344595", "SNILS"), (3, 0, "Doe  Jane", "FOREIGN_PER"), (4, 0, "Jane Doe", "FOREIGN_PER")], "doc_id long, start int, text string, label string")
    assert {(r.token, r.original) for r in M.registry(found).collect()} == {("[SNILS_1]", "112-233-445 95"), ("[FOREIGN_PER_1]", "Doe  Jane")}
    known = M.registry(found)
    more = spark.createDataFrame([(9, 0, "112 233 445 95", "SNILS"), (9, 5, "112-233-445 96", "SNILS")], found.schema)
    assert sorted(r.token for r in M.registry(more, known).collect()) == ["[FOREIGN_PER_1]", "[SNILS_1]", "[SNILS_2]"]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_numbering_in_pieces_is_the_numbering_in_one(spark, kind):
    ids = [-5, 0, 3, 3, 10**12, None, 7, 256, -(10**9)]
    rows = [(str(i) if kind == "string" and i is not None else i, k, f"t{k}", "L" if k % 3 else "M") for k, i in enumerate(ids)]
    got = {r.original: r.number for r in M.registry(spark.createDataFrame(rows, f"doc_id {kind}, start int, text string, label string")).collect()}
    for label in "LM":
        mine = sorted((r for r in rows if r[3] == label), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0 if kind == "long" else "", r[1]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))


def test_external_spans_join_the_candidates(spark):
    docs = spark.createDataFrame([(1, "Иван Петров, ip 10.0.0.1"), (1, "x")], "doc_id long, text string")
    given = spark.createDataFrame([(1, 0, 11, "PER"), (1, 13, 24, "ORG"), (1, 5, 99, "ORG")], "doc_id long, start long, end long, label string")
    got = {(r.text, r.label, r.priority) for r in D.resolve(D.candidates(docs, external=given)).collect()}
    assert got == {("Иван Петров", "PER", 80), ("ip 10.0.0.1", "ORG", 75)}  # it holds the address, whose priority is below 90
