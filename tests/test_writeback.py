import random
import zipfile
from io import BytesIO
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from veilspan.operators import masking as M
from veilspan.sources import writeback as B

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def packed(parts):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def run(*texts):
    return "".join(f"<w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r>" for t in texts)


DOCX = packed({
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/comments.xml" ContentType="x"/><Override PartName="/word/document.xml" ContentType="y"/></Types>',
    "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="comments.xml"/><Relationship Id="r2" Target="http://x" TargetMode="External"/></Relationships>',
    "word/document.xml": f"<w:document {W}><w:body><w:p>{run('mail a', '@b.r', 'u end')}<w:commentReference/></w:p><w:sdt><w:p>{run('ip 10.0', '.0.1')}<w:del>{run('old')}</w:del><w:ins>{run('new')}</w:ins></w:p></w:sdt><w:p/></w:body></w:document>",
    "word/header1.xml": f"<w:hdr {W}><w:p>{run('head [INN_1]')}</w:p></w:hdr>",
    "word/comments.xml": f"<w:comments {W}><w:p>{run('by [INN_1] and [INN_1]')}</w:p></w:comments>",
    "docProps/core.xml": '<c:p xmlns:c="c"><c:creator>Ann</c:creator><c:revision>3</c:revision></c:p>',
    "word/media/i.png": b"\x89PNG",
})
XLSX = packed({"xl/sharedStrings.xml": "<sst><si><t>to [INN_1]</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>", "xl/worksheets/sheet1.xml": "<s><c t='inlineStr'><is><t>10.0.0.1</t></is></c><c><v>5</v></c></s>"})
PPTX = packed({"ppt/slides/slide1.xml": f"<p:sld {A}><a:p><a:r><a:t>[INN</a:t></a:r><a:r><a:t>_1] x</a:t></a:r></a:p></p:sld>"})
SIGNED = packed({"word/document.xml": f"<w:document {W}/>", "_xmlsignatures/sig1.xml": "<s/>"})


@pytest.fixture
def files(spark):
    rows = [("d.docx", "docx", DOCX), ("x.xlsx", "xlsx", XLSX), ("p.pptx", "pptx", PPTX), ("bad.docx", "docx", b"no"), ("s.docx", "docx", SIGNED)]
    return spark.createDataFrame([(p, s, bytearray(c)) for p, s, c in rows], "path string, suffix string, content binary")


def texts(spark, written):
    out = B.text_units(written.withColumn("suffix", F.element_at(F.split("path", r"\."), -1)).where("content IS NOT NULL"))
    return {(r.path, r.part, r.unit): r.text for r in out.where("error IS NULL").collect()}


def test_units_and_restoring(spark, files):
    got = texts(spark, files)
    assert got["d.docx", "word/document.xml", 0] == "mail a@b.ru end" and got["d.docx", "word/document.xml", 1] == "ip 10.0.0.1oldnew" and got["x.xlsx", "xl/sharedStrings.xml", 1] == "ab" and got["p.pptx", "ppt/slides/slide1.xml", 0] == "[INN_1] x"
    names = spark.createDataFrame([("[INN_1]", "7707083893")], "token string, original string")
    out = B.restore_files(files, names)
    rows = {r.path: r for r in out.collect()}
    assert {p: r.n for p, r in rows.items()} == {"d.docx": 2, "x.xlsx": 1, "p.pptx": 1, "bad.docx": 0, "s.docx": 0} and rows["bad.docx"].content.startswith(b"no")
    back = texts(spark, out)
    assert back["d.docx", "word/comments.xml", 0] == "by 7707083893 and 7707083893" and back["x.xlsx", "xl/sharedStrings.xml", 0] == "to 7707083893" and back["p.pptx", "ppt/slides/slide1.xml", 0] == "7707083893 x"
    assert {k: v for k, v in back.items() if "INN" not in got[k]} == {k: v for k, v in got.items() if "INN" not in v}
    with zipfile.ZipFile(BytesIO(rows["d.docx"].content)) as z, zipfile.ZipFile(BytesIO(DOCX)) as old:
        assert z.namelist() == old.namelist() and z.read("word/media/i.png") == b"\x89PNG" and z.read("word/document.xml") == old.read("word/document.xml") and b"<w:b" in z.read("word/header1.xml")


def test_masking_files_keeps_runs(spark, files):
    def mask(units):
        found = units.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\d+\.\d+\.\d+\.\d+|\S+@[a-z.]+"), F.lit(0))).alias("s"), "text").select("doc_id", (F.instr("text", F.col("s")) - 1).alias("start"), (F.instr("text", F.col("s")) - 1 + F.length("s")).alias("end"), F.col("s").alias("text"), F.lit("ID").alias("label"))
        return M.mask(units, found, M.registry(found)).select("doc_id", F.col("masked").alias("text"))

    out = B.transform_files(files.where("path <> 'bad.docx'"), mask)
    got = texts(spark, out)
    assert got["d.docx", "word/document.xml", 0].startswith("mail [ID_") and got["d.docx", "word/document.xml", 0].endswith("] end") and got["x.xlsx", "xl/worksheets/sheet1.xml", 0].startswith("[ID_")
    with zipfile.ZipFile(BytesIO(next(r.content for r in out.collect() if r.path == "d.docx"))) as z:
        assert z.read("word/document.xml").count(b"<w:r>") == 7


def test_one_occurrence_is_set_back(spark, files):
    got = texts(spark, B.restore_occurrence(files, "d.docx", "word/comments.xml", 0, "[INN_1]", "77", 1))
    assert got["d.docx", "word/comments.xml", 0] == "by [INN_1] and 77" and got["d.docx", "word/header1.xml", 0] == "head [INN_1]"


def test_changed_texts_are_read_back(spark):
    rng = random.Random(2)
    for _ in range(400):
        nodes = [ET.Element("t") for _ in range(rng.randint(1, 4))]
        for n in nodes:
            n.text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 4)))
        old, new = "".join(n.text for n in nodes), "".join(rng.choice("ab ") for _ in range(rng.randint(0, 9)))
        span = B.change(old, new)
        if span and old:
            assert B.set_unit(nodes, [span]) == 1
            assert "".join(n.text for n in nodes) == new


def test_policy(spark, files):
    with pytest.raises(ValueError, match="policy"):
        B.apply_policy(files, {"comments": "burn"})
    with pytest.raises(ValueError, match="policy"):
        B.apply_policy(files, {"comment": "remove"})
    rows = {r.path: r for r in B.apply_policy(files, {"comments": "remove", "tracked_changes": "remove", "external_links": "remove", "macros": "keep"}).collect()}
    assert rows["d.docx"].removed == ["comments", "external_links", "tracked_changes"] and rows["x.xlsx"].removed == [] and "signed" in rows["s.docx"].error and rows["bad.docx"].content is None
    with zipfile.ZipFile(BytesIO(rows["d.docx"].content)) as z:
        assert "word/comments.xml" not in z.namelist() and b"comments" not in z.read("[Content_Types].xml") and b"Relationship " not in z.read("word/_rels/document.xml.rels")
        body = z.read("word/document.xml")
        assert b"old" not in body and b"new" in body and b"commentReference" not in body and b"w:ins" not in body
    hidden = B.apply_policy(files, {"comments": "anonymize"}, lambda units: units.select("doc_id", F.regexp_replace("text", r"\[INN_1\]", "*").alias("text")))
    assert texts(spark, hidden)["d.docx", "word/comments.xml", 0] == "by * and *" and texts(spark, hidden)["d.docx", "word/header1.xml", 0] == "head [INN_1]"
    meta = {r.path: r for r in B.without_metadata(files).collect()}
    assert meta["d.docx"].fields == ["creator"] and meta["bad.docx"].error
    with zipfile.ZipFile(BytesIO(meta["d.docx"].content)) as z:
        assert b"Ann" not in z.read("docProps/core.xml") and b"3" in z.read("docProps/core.xml")
    assert {r.path: r.safe_to_release for r in B.safe_report(spark.createDataFrame([("a", "comments", 1, None), ("b", None, 0, "BadZipFile")], "path string, kind string, n long, error string")).collect()} == {"a": True, "b": False}
