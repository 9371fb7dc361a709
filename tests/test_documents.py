import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspan.functions import regions as R
from veilspan.operators import reconcile as X
from veilspan.operators import review as V
from veilspan.sources import exports, files, office
from veilspan.streaming.incremental import mask_stream


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = packed({
    "word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>One</w:t></w:r><w:ins/></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>b|c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/comments.xml": "<c/>",
})


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"a.txt": "﻿Привет".encode(), "sub/b.md": "Привет".encode("cp1251"), ".hidden.txt": b"x", "c.bin": b"x", "empty.txt": b"", "d.docx": DOCX, "bad.docx": b"no"}.items():
        (tmp_path / name).write_bytes(body)
    found = files.list_files(spark, str(tmp_path))
    assert sorted(r.name for r in found.select("name").collect()) == ["a.txt", "b.md", "bad.docx", "d.docx"]
    text = {r.path.rsplit("/", 1)[1]: r.text for r in files.texts(found.where("suffix <> 'docx'")).collect()}
    assert text == {"a.txt": "Привет", "b.md": "Привет"}
    blocks = office.blocks(found)
    assert [r.text for r in blocks.where("error IS NULL").orderBy("scope", "row", "col").collect()] == ["One", "a", "b|c"]
    assert blocks.where("error IS NOT NULL").first().error.startswith("BadZipFile")
    assert exports.sheet_markdown(blocks).first().table == "| a | b\\|c |\n| --- | --- |"
    kinds = {r.kind: r.n for r in office.hidden_kinds(found).where("error IS NULL").collect()}
    assert kinds == {"comments": 1, "tracked_changes": 1, "hidden_text": 1}


def test_unsafe_archives():
    for parts in ({"../x": "a"}, {"a.xml": "x", "A.xml": "y"}, {"a": "0" * 2_000_000}):
        content = packed(parts) if "a" not in parts else None
        if content is None:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("a", parts["a"])
            content = out.getvalue()
        with pytest.raises(office.UnsafeArchive):
            office.checked(content)


def test_chunks_put_together_are_the_text(spark):
    texts = {"1": "ab cd\nef gh" * 9, "2": "", "3": "x" * 50, "4": None}
    rows = files.chunks(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), 10).collect()
    for i, t in texts.items():
        assert "".join(r.text for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)) == (t or "")
    assert max(len(r.text) for r in rows) <= 10


def test_markdown(spark):
    df = spark.createDataFrame([("ДОГОВОР №1\n\n1. первый\n\n a | b \n c | d\n\nпросто\nтекст",), ("",), (None,)], "t string")
    assert [r.m for r in df.select(exports.markdown(F.col("t")).alias("m")).collect()] == ["## ДОГОВОР №1\n\n- первый\na | b\nc | d\n\nпросто текст\n".replace("- первый", "- 1. первый"), "", ""]


def test_regions(spark):
    df = spark.createDataFrame([("85",), ("0.5",), ("x",), (None,), ("-1",), ("NaN",)], "v string")
    assert [r.c for r in df.select(R.confidence(F.col("v")).alias("c")).collect()] == [0.85, 0.5, 0.0, 0.0, 0.0, 0.0]
    rows = [(1, 1, 0.5, 0.1, 0.6, 0.12, "b"), (1, 1, 0.1, 0.102, 0.2, 0.122, "a"), (1, 1, 0.1, 0.5, 0.2, 0.52, "c")]
    got = R.lines_of(spark.createDataFrame(rows, "doc_id long, page long, x1 double, y1 double, x2 double, y2 double, text string"))
    assert [(r.text, r.line) for r in got.orderBy("line", "place").collect()] == [("a", 1), ("b", 1), ("c", 2)]


def test_reconcile_is_the_plain_search(spark):
    entities = spark.createDataFrame([("INN", "7707083893", "[INN_1]", 1), ("PHONE_NUMBER", "+7 (900) 111-22-33", "[PHONE_NUMBER_1]", 1), ("PER", "Иван", "[PER_1]", 1), ("EMAIL", "A@b.ru", "[EMAIL_1]", 1), ("EMAIL", "xa@b.ru", "[EMAIL_2]", 2)], "label string, original string, token string, number long")
    texts = {1: "Иван 7707083893, 77070838931; тел +7 (900) 111-22-33 и a@B.RU, xa@b.ru", 2: "[INN_7707083893]", 3: None, 4: ""}
    got = {r.doc_id: (r.text, r.n) for r in X.reconcile(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), entities).collect()}
    assert got == {1: ("Иван [INN_1], 77070838931; тел [PHONE_NUMBER_1] и [EMAIL_1], [EMAIL_2]", 4), 2: ("[INN_7707083893]", 0), 3: ("", 0), 4: ("", 0)}


def test_reconciling_rows_of_one_id(spark):
    entities = spark.createDataFrame([("EMAIL", f"user{i}@mail.example.com", f"[EMAIL_{i}]", i) for i in range(1, 40)], "label string, original string, token string, number int")
    assert X.values(entities).groupBy("word").count().where("count > 1").isEmpty()  # not the domain, which they share
    rows = [(1, "to user3@mail.example.com"), (1, "to USER4@mail.example.com, user3@mail.example.com"), (None, "user5@mail.example.com"), (None, "user5@mail.example.com"), (2, None)]
    got = sorted(((r.doc_id, r.text, r.n) for r in X.reconcile(spark.createDataFrame(rows, "doc_id long, text string"), entities).collect()), key=repr)
    assert got == sorted([(1, "to [EMAIL_3]", 1), (1, "to [EMAIL_4], [EMAIL_3]", 2), (None, "[EMAIL_5]", 1), (None, "[EMAIL_5]", 1), (2, "", 0)], key=repr)


def test_review(spark):
    raw = spark.createDataFrame([("d1", "p1", "inn", "[INN_1]", 0.9, "odd", "secret"), ("d1", "p2", None, "[X_1]", 0.2, "accepted", "secret")], "document_ref string, location string, entity_type string, placeholder string, confidence double, status string, original string")
    queue = V.findings(raw)
    assert "original" not in queue.columns and V.upsert(queue, queue).count() == 2
    done = V.decide(queue, "rejected", least=50)
    assert {r.status: r.n for r in V.summary(done).collect()} == {"pending": 0, "accepted": 1, "rejected": 1, "skipped": 0, "total": 2}
    with pytest.raises(ValueError):
        V.decide(queue, "pending")


def test_stream_goes_on_with_the_registry(spark, tmp_path):
    def arrive(i, text):
        spark.createDataFrame([(i, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        q = mask_stream(spark, f"{tmp_path}/in", "doc_id long, text string", f"{tmp_path}/out", f"{tmp_path}/check")
        q.awaitTermination()
        return {r.doc_id: r.masked for r in spark.read.parquet(f"{tmp_path}/out/masked").collect()}

    arrive(1, "ip 10.0.0.1")
    assert run() == {1: "ip [IP_ADDRESS_1]"}
    arrive(2, "ip 10.0.0.2 и 10.0.0.1")
    assert run() == {1: "ip [IP_ADDRESS_1]", 2: "ip [IP_ADDRESS_2] и [IP_ADDRESS_1]"}


def test_fragments(spark):
    df = spark.createDataFrame([(" 0ab \n \n\n1cdefg\nh",), ("",), (None,), (" \n\n ",)], "t string")
    assert [r.f for r in df.select(files.fragments(F.col("t"), 4).alias("f")).collect()] == [["0ab", "1cde", "fg\nh"], [], [], []]


def test_files_as_texts(spark):
    w = 'xmlns:w="w"'
    docx = packed({
        "word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Глава</w:t></w:r></w:p><w:sdt><w:sdtContent><w:p><w:r><w:t>- пункт</w:t></w:r></w:p></w:sdtContent></w:sdt><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><w:t>АКТ сдачи</w:t></w:r></w:p><w:p><w:r><w:t>Текст</w:t></w:r></w:p></w:body></w:document>',
        "word/header1.xml": f"<w:hdr {w}><w:p><w:r><w:t>верх</w:t></w:r></w:p></w:hdr>", "word/footnotes.xml": f"<w:footnotes {w}><w:footnote><w:p><w:r><w:t>сноска</w:t></w:r></w:p></w:footnote></w:footnotes>",
    })
    deck = packed({f"ppt/slides/slide{n}.xml": f'<s xmlns:a="a"><a:p><a:t>- x{n}</a:t></a:p><a:p><a:t>Тема {n}</a:t></a:p></s>' for n in (1, 10, 2)} | {"ppt/notesSlides/notesSlide2.xml": '<s xmlns:a="a"><a:p><a:t>2</a:t></a:p><a:p><a:t>сказать</a:t></a:p></s>'})
    b = office.blocks(spark.createDataFrame([("d.docx", "docx", bytearray(docx)), ("p.pptx", "pptx", bytearray(deck))], "path string, suffix string, content binary")).cache()
    assert {(r.scope, r.kind, r.text) for r in b.where("kind IN ('margin', 'note') AND path = 'd.docx'").collect()} == {("header1", "margin", "верх"), ("footnotes", "note", "сноска")}
    assert exports.word_markdown(b.where("path = 'd.docx'")).first().markdown == "## Глава\n\n- - пункт\n| a | b |\n| --- | --- |\n\n## АКТ сдачи\n\nТекст\n"
    assert exports.word_text(b.where("path = 'd.docx'")).first().text == "Глава\n- пункт\na | b\n\nАКТ сдачи\nТекст\n"
    parts = exports.slides(b)
    assert [(r.number, r.title, r.notes) for r in parts.orderBy("number").collect()] == [(1, "Тема 1", []), (2, "Тема 2", ["сказать"]), (10, "Тема 10", [])]
    text = exports.slides_text(parts).first().text
    assert text.startswith("=== Слайд 1: Тема 1 ===\n- x1\nТема 1\n\n=== Слайд 2: Тема 2 ===\n- x2\nТема 2\n[Заметки:]\n  * сказать\n\n=== Слайд 10")
    assert exports.slides_markdown(parts).first().markdown.startswith("## Слайд 1: Тема 1\n\n- x1\nТема 1\n\n---\n")


def test_marked_up_xml(spark):
    xml = "<d><head><title>Имя</title></head><text><p><s><w>Раз</w><w>,</w><w>«</w><w>два</w><w>»</w><w>-</w><w>три</w></s><s><w>Ещё</w></s></p><p><s/></p><p><s><w>Конец</w><w>.</w></s></p></text></d>"
    df = spark.createDataFrame([(1, bytearray(xml.encode())), (2, bytearray(b"<no")), (3, None)], "id long, content binary")
    assert {r.id: r.text for r in files.marked_up_text(df).collect()} == {1: "Имя\nРаз, «два»-три Ещё\nКонец.", 2: None, 3: None}


def test_json_lines_with_faults(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[2]\nbad\n{"a": 3, "b": 4}\n')
    rows = files.numbered_json_lines(spark, str(tmp_path), "a long").orderBy("place").collect()
    assert [(r.parsed and r.parsed.a, r.wrong) for r in rows if not r.wrong] == [(1, False), (3, False)] and sum(r.wrong for r in rows) == 2
