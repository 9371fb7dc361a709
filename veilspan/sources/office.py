"""Blocks, cells and hidden data of zipped office files; archives are checked before they are read."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

# An archive's limits, and the parts and elements that hold hidden data.
MOST_FILES, MOST_BYTES, MOST_RATIO, RATIO_FROM = 10_000, 500 * 1024 * 1024, 100.0, 1024 * 1024
PART_KINDS = (
    (r"word/(?:comments|commentsextended|persons)[^/]*\.xml", "comments"),
    (r"word/footnotes\.xml", "footnotes"),
    (r"word/endnotes\.xml", "endnotes"),
    (r"(?:word|xl|ppt)/embeddings/.*", "embedded_objects"),
    (r"customxml/.*", "custom_xml"),
    (r".*vbaproject\.bin", "macros"),
    (r"docprops/(?:custom\.xml|thumbnail\.jpeg|thumbnail\.png)", "document_properties"),
    (r"_xmlsignatures/.*|.*/sig1\.xml", "digital_signature"),
)
REVISIONS = ("ins", "del", "moveFrom", "moveTo", "commentRangeStart", "commentRangeEnd", "commentReference")


class UnsafeArchive(ValueError):
    """An archive that isn't read."""


def checked(content: bytes) -> zipfile.ZipFile:
    """The archive, if its names, links, sizes and ratios are within the limits."""
    package = zipfile.ZipFile(io.BytesIO(content))
    infos = package.infolist()
    names = Counter(posixpath.normpath(i.filename.replace("\\", "/")).lower() for i in infos)
    faults = {
        "files": len(infos) > MOST_FILES,
        "size": sum(i.file_size for i in infos) > MOST_BYTES,
        "path": any(".." in i.filename or i.filename[:1] in "/\\" or i.filename[1:2] == ":" for i in infos),
        "duplicate": any(n > 1 for n in names.values()),
        "link": any((i.external_attr >> 16) & 0o170000 == 0o120000 for i in infos),
        "ratio": any(i.file_size > RATIO_FROM and i.file_size > MOST_RATIO * max(1, i.compress_size) for i in infos),
    }
    found = [name for name, bad in faults.items() if bad]
    if found:
        raise UnsafeArchive(",".join(found))
    return package


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _text(node: ET.Element, tag: str) -> str:
    return "".join(n.text or "" for n in node.iter() if _local(n) == tag)


def _blocks(parent: ET.Element) -> Iterator[ET.Element]:
    """Paragraphs and tables of a part, those within content controls too."""
    for node in parent:
        if _local(node) in ("p", "tbl"):
            yield node
        elif _local(node) in ("sdt", "sdtContent", "footnote", "endnote"):
            yield from _blocks(node)


def _paragraph_kind(paragraph: ET.Element) -> str:
    """``paragraph``, or ``heading`` and its level by the paragraph's style."""
    style = next((v for n in paragraph.iter() if _local(n) == "pStyle" for k, v in n.attrib.items() if k.rpartition("}")[2] == "val"), "")
    level = re.search(r"(?i)(?:heading|заголовок)\s*([1-6])", style)
    return f"heading {level[1]}" if level else "paragraph"


def _docx(package: zipfile.ZipFile) -> Iterator[tuple]:
    body = next(n for n in ET.fromstring(package.read("word/document.xml")) if _local(n) == "body")
    for i, block in enumerate(_blocks(body)):
        if _local(block) == "p":
            yield "body", i, 0, _paragraph_kind(block), _text(block, "t")
        else:
            for r, row in enumerate(n for n in block if _local(n) == "tr"):
                for c, cell in enumerate(n for n in row if _local(n) == "tc"):
                    yield f"table {i}", r, c, "cell", "\n".join(_text(p, "t") for p in cell.iter() if _local(p) == "p")
    for name in sorted(package.namelist()):
        part = re.fullmatch(r"word/((?:header|footer)\d*|footnotes|endnotes)\.xml", name)
        if part:
            for i, block in enumerate(_blocks(ET.fromstring(package.read(name)))):
                text = _text(block, "t")
                if text:
                    yield part[1], i, 0, "note" if part[1].endswith("notes") else "margin", text


def _column(ref: str) -> int:
    n = 0
    for letter in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _xlsx(package: zipfile.ZipFile) -> Iterator[tuple]:
    names = set(package.namelist())
    shared = [_text(s, "t") for s in ET.fromstring(package.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    relations = {r.get("Id"): r.get("Target") for r in ET.fromstring(package.read("xl/_rels/workbook.xml.rels"))}
    for sheet in (n for n in ET.fromstring(package.read("xl/workbook.xml")).iter() if _local(n) == "sheet"):
        target = relations[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        root = ET.fromstring(package.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        for r, row in enumerate(n for n in root.iter() if _local(n) == "row"):
            for c, cell in enumerate(n for n in row if _local(n) == "c"):
                value = _text(cell, "v")
                if cell.get("t") == "s" and value:
                    value = shared[int(value)]
                elif cell.get("t") == "inlineStr":
                    value = _text(cell, "t")
                yield sheet.get("name"), int(row.get("r", r + 1)) - 1, _column(cell.get("r", "")) if cell.get("r") else c, "cell", value


def _pptx(package: zipfile.ZipFile) -> Iterator[tuple]:
    for part, kind in (("slides/slide", "paragraph"), ("notesSlides/notesSlide", "note")):
        numbered = [(int(m[1]), m[0]) for m in (re.fullmatch(rf"ppt/{part}(\d+)\.xml", n) for n in package.namelist()) if m]
        for number, name in sorted(numbered):
            for i, p in enumerate(n for n in ET.fromstring(package.read(name)).iter() if _local(n) == "p"):
                yield f"slide {number}", i, 0, kind, _text(p, "t")


_READERS = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}


def hidden_data(content: bytes) -> Counter:
    """Counts of hidden data by kind."""
    found: Counter = Counter()
    with checked(content) as package:
        for name in package.namelist():
            low = name.lower()
            found.update(kind for pattern, kind in PART_KINDS if re.fullmatch(pattern, low))
            if low.endswith((".xml", ".rels")) and low != "[content_types].xml":
                for node in ET.fromstring(package.read(name)).iter():
                    tag = _local(node)
                    found["tracked_changes"] += tag in REVISIONS
                    found["hidden_text"] += tag == "vanish"
                    found["external_links"] += node.get("TargetMode") == "External"
    return +found


def _per_file(files: DataFrame, work: Callable[[str, bytes], Iterator[tuple]], blank: tuple, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, suffix, content in frame.itertuples(index=False):
                try:
                    rows = [(path, *row, None) for row in work(suffix, bytes(content))]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, StopIteration, UnsafeArchive) as e:
                    rows = [(path, *blank, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "suffix", "content").mapInPandas(run, schema)


def blocks(files: DataFrame) -> DataFrame:
    """path, scope (body, table, sheet or slide), row, col, kind, text and error of office files.

    A file that can't be read gives one row with its error and no text, and the rest goes on."""
    return _per_file(files.where(files["suffix"].isin(*_READERS)), lambda suffix, content: _READERS[suffix](checked(content)), (None, 0, 0, "error", None), "path string, scope string, row long, col long, kind string, text string, error string")


def hidden_kinds(files: DataFrame) -> DataFrame:
    """path, kind, n and error of office files; a file that can't be read gives one row with its error."""
    return _per_file(files.where(files["suffix"].isin(*_READERS)), lambda suffix, content: iter(hidden_data(content).items()), (None, 0), "path string, kind string, n long, error string")
