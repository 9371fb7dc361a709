"""Office files with changed texts: units of text out, changed units in, all other parts byte for byte.

A unit is a paragraph (docx, pptx) or a string (xlsx) with all its text nodes, in every part that holds
text: body, tables, content controls and text boxes, headers, footers, notes, comments, slides, shared and
inline strings.  Texts change as DataFrames between ``text_units`` and ``write_units``, so any operator on
texts works on files; a file's change list is one row of the table, bounded by the file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import replace_nth
from veilspan.operators.masking import restore
from veilspan.operators.reconcile import reconcile
from veilspan.sources.office import PART_KINDS, UnsafeArchive, _local, checked, hidden_data

#: Parts with text of each format, and the element that is a unit there.
TEXT_PARTS = {
    "docx": (r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", "p"),
    "pptx": (r"ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml", "p"),
    "xlsx": (r"xl/(?:sharedStrings|worksheets/[^/]+)\.xml", "si|is"),
}
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"


def _namespaces(data: bytes) -> None:
    """Registers a part's prefixes, so that it's written with them again."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)


def _units(root: ET.Element, unit: str) -> list[list[ET.Element]]:
    """Text nodes of each unit, in order; a node belongs to its nearest unit."""
    names = set(unit.split("|"))
    out: list[list[ET.Element]] = []

    def visit(node: ET.Element, own: list[ET.Element] | None) -> None:
        name = _local(node)
        if name in names:
            own = []
            out.append(own)
        elif name == "t" and own is not None:
            own.append(node)
        for child in node:
            visit(child, own)

    visit(root, None)
    return out


def _parts(suffix: str, package: zipfile.ZipFile) -> Iterator[tuple[str, bytes, str]]:
    pattern, unit = TEXT_PARTS[suffix]
    number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
    for name in sorted(package.namelist(), key=number):
        if re.fullmatch(pattern, name):
            yield name, package.read(name), unit


def set_unit(nodes: list[ET.Element], spans: list[tuple[int, int, str]]) -> int:
    """Applies (start, end, token) spans over the joined text of the nodes, right to left: the token goes into
    the node in which the span starts, the rest of it is cut from the others, and no node is lost.  Spans out
    of range or over another that was applied are skipped; returns how many were applied."""
    length, done, edge = sum(len(n.text or "") for n in nodes), 0, None
    for start, end, token in sorted(spans, reverse=True):
        if not 0 <= start < end <= length or (edge is not None and end > edge):
            continue
        at, put = 0, False
        for node in nodes:
            text = node.text or ""
            a, b = max(start - at, 0), min(end - at, len(text))
            if a < b:
                node.text = text[:a] + ("" if put else token) + text[b:]
                put = True
                if node.text != node.text.strip():
                    node.set(_SPACE, "preserve")
            at += len(text)
        edge, done = start, done + 1
    return done


def change(old: str, new: str) -> tuple[int, int, str] | None:
    """The one span in which two texts differ; null if they are equal."""
    if old == new:
        return None
    a = 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    b = 0
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    if a == len(old) - b:  # only inserted: a span needs a character to start in
        if a:
            a -= 1
        else:
            b -= 1
    return a, len(old) - b, new[a : len(new) - b]


def rewritten(content: bytes, edit: Callable[[str, bytes], bytes | None]) -> bytes:
    """The archive with each part as ``edit(name, data)`` gives it; null leaves a part out."""
    out = io.BytesIO()
    with checked(content) as package, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for info in package.infolist():
            data = edit(info.filename, package.read(info.filename))
            if data is not None:
                target.writestr(info, data)
    return out.getvalue()


def _xml(root: ET.Element) -> bytes:
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def set_texts(suffix: str, content: bytes, changes: list[tuple[str, int, str]]) -> bytes:
    """The file with units (part, number, text) changed; what is written is read again and compared."""
    pattern, unit = TEXT_PARTS[suffix]
    wanted: dict[str, dict[int, str]] = {}
    for part, number, text in changes:
        wanted.setdefault(part, {})[number] = text

    def edit(name: str, data: bytes) -> bytes:
        if name not in wanted or not re.fullmatch(pattern, name):
            return data
        _namespaces(data)
        root = ET.fromstring(data)
        units = _units(root, unit)
        for number, text in wanted[name].items():
            nodes = units[number]
            span = change("".join(n.text or "" for n in nodes), text)
            if span and not nodes[0:1]:
                raise ValueError(f"no text node in unit {number} of {name}")
            if span and not set_unit(nodes, [span]):
                nodes[0].text = text  # an empty unit
            if "".join(n.text or "" for n in nodes) != text:
                raise ValueError(f"unit {number} of {name} isn't what was to be written")
        return _xml(root)

    return rewritten(content, edit)


_FAULTS = (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError, UnsafeArchive)


def _mapped(files: DataFrame, work: Callable[..., list[tuple]], failed: tuple, schema: str, *columns: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, *fields in frame.itertuples(index=False):
                try:
                    rows = [(path, *row, None) for row in work(*fields)]
                except _FAULTS as e:
                    rows = [(path, *failed, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", *columns).mapInPandas(run, schema)


def text_units(files: DataFrame) -> DataFrame:
    """path, part, unit, text and error of every unit of docx, xlsx and pptx files; a file that can't be read
    gives one row with its error."""

    def read(suffix: str, content: bytes) -> list[tuple]:
        with checked(bytes(content)) as package:
            return [(part, k, "".join(n.text or "" for n in nodes)) for part, data, unit in _parts(suffix, package) for k, nodes in enumerate(_units(ET.fromstring(data), unit))]

    return _mapped(files.where(F.col("suffix").isin(*TEXT_PARTS)), read, (None, 0, None), "path string, part string, unit long, text string, error string", "suffix", "content")


def write_units(files: DataFrame, units: DataFrame) -> DataFrame:
    """path, content, n and error of every file with the units (path, part, unit, text) given for it written
    in, and how many; a file without any stays as it is, a failed one has no content (never a half-done
    file)."""
    per = units.where(F.col("part").isNotNull()).groupBy("path").agg(F.collect_list(F.struct("part", "unit", "text")).alias("changes"))
    rows = files.where(F.col("suffix").isin(*TEXT_PARTS)).join(per, "path", "left")

    def write(suffix: str, content: bytes, changes) -> list[tuple]:
        todo = [] if changes is None else [(c["part"], int(c["unit"]), c["text"]) for c in changes]
        return [(set_texts(suffix, bytes(content), todo) if todo else bytes(content), len(todo))]

    return _mapped(rows, write, (None, 0), "path string, content binary, n long, error string", "suffix", "content", "changes")


def transform_files(files: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Files with all their units put through ``transform``: a table (doc_id, text), with an id for each unit,
    to one (doc_id, text).  Only units whose text changed are written; files that couldn't be read fail."""
    units = text_units(files).withColumn("doc_id", F.to_json(F.struct("path", "part", "unit")))
    new = transform(units.where("error IS NULL").select("doc_id", "text")).select("doc_id", F.col("text").alias("new"))
    changed = units.join(new, "doc_id").where(~F.col("new").eqNullSafe(F.col("text")))
    return write_units(files, changed.select("path", "part", "unit", F.col("new").alias("text")))


def restore_files(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Files with every known placeholder replaced by its original."""
    return transform_files(files, lambda units: restore(units, entities, "text"))


def reconcile_files(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Files with every remaining value of the registry replaced by its placeholder."""
    return transform_files(files, lambda units: reconcile(units, entities).select("doc_id", "text"))


def restore_occurrence(files: DataFrame, path: str, part: str, unit: int, token: str, original: str, nth: int = 0) -> DataFrame:
    """Files with one occurrence of a token in one unit (a rejected finding) set back to its original."""
    here = text_units(files.where(F.col("path") == path)).where((F.col("part") == part) & (F.col("unit") == unit))
    return write_units(files, here.select("path", "part", "unit", replace_nth(F.col("text"), token, original, nth).alias("text")))


# What may be done about a kind of hidden data, and which of them are texts.
ACTIONS = ("keep", "anonymize", "remove")
KINDS = ("comments", "footnotes", "endnotes", "embedded_objects", "custom_xml", "macros", "document_properties", "tracked_changes", "hidden_text", "external_links", "digital_signature")
TEXT_KINDS = ("comments", "footnotes", "endnotes")
_DROPPED = {"comments": {"commentRangeStart", "commentRangeEnd", "commentReference"}, "footnotes": {"footnoteReference"}, "endnotes": {"endnoteReference"}, "tracked_changes": {"del", "moveFrom"}}
_UNWRAPPED = {"tracked_changes": {"ins", "moveTo"}}
#: Elements of the property parts whose text names people, firms and programs.
_PROPERTIES = {"creator", "lastModifiedBy", "Company", "Manager", "description", "keywords", "subject", "title", "category", "Application", "Template"}


def _without(root: ET.Element, remove: set[str]) -> set[str]:
    """Removes elements of the kinds and returns the kinds found."""
    drop = {t: k for k in remove for t in _DROPPED.get(k, ())}
    unwrap = {t: k for k in remove for t in _UNWRAPPED.get(k, ())}
    found: set[str] = set()

    def visit(parent: ET.Element) -> None:
        at = 0
        while at < len(parent):
            child = parent[at]
            name = _local(child)
            if "hidden_text" in remove and name == "r" and any(_local(n) == "vanish" for n in child.iter()):
                found.add("hidden_text")
                parent.remove(child)
            elif name in drop:
                found.add(drop[name])
                parent.remove(child)
            elif name in unwrap:
                found.add(unwrap[name])
                inner = list(child)
                parent.remove(child)
                for k, x in enumerate(inner):
                    parent.insert(at + k, x)
            else:
                visit(child)
                at += 1

    visit(root)
    return found


def cleaned(content: bytes, remove: set[str]) -> tuple[bytes, list[str]]:
    """The file without hidden data of the kinds, its relations and content types repaired, and the kinds
    that were removed.  A signed file isn't touched: its signature would be void."""
    if "digital_signature" in hidden_data(content):
        raise ValueError("a signed file can't be changed")
    with checked(content) as package:
        gone = {n: kind for n in package.namelist() for pattern, kind in PART_KINDS if kind in remove and re.fullmatch(pattern, n.lower())}
    removed = set(gone.values())

    def edit(name: str, data: bytes) -> bytes | None:
        low = name.lower()
        if name in gone:
            return None
        if low == "[content_types].xml" or low.endswith(".rels"):
            _namespaces(data)
            root = ET.fromstring(data)
            for x in list(root):
                target = (x.get("PartName") or x.get("Target") or "").lstrip("/")
                if "external_links" in remove and x.get("TargetMode") == "External":
                    removed.add("external_links")
                    root.remove(x)
                elif target and any(g == target or g.endswith("/" + target.replace("../", "")) for g in gone):
                    root.remove(x)
            return _xml(root)
        if low.endswith(".xml") and remove & {*_DROPPED, "hidden_text"} and low.startswith("word/"):
            _namespaces(data)
            root = ET.fromstring(data)
            found = _without(root, remove)
            removed.update(found)
            return _xml(root) if found else data
        return data

    return rewritten(content, edit), sorted(removed)


def apply_policy(files: DataFrame, actions: dict[str, str], transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """path, content, removed and error of office files after what ``actions`` say for each kind of hidden
    data: keep it, remove it, or anonymize its texts by ``transform``.  An unknown kind or action fails at
    once; a signed or unreadable file has an error and no content."""
    wrong = {k: v for k, v in actions.items() if k not in KINDS or v not in ACTIONS}
    texts = {k for k, v in actions.items() if v == "anonymize"}
    if wrong or texts - set(TEXT_KINDS) or (texts and transform is None):
        raise ValueError(f"no such policy: {wrong or texts}")
    remove = {k for k, v in actions.items() if v == "remove"}
    schema = "path string, content binary, removed array<string>, error string"
    out = _mapped(files.where(F.col("suffix").isin(*TEXT_PARTS)), lambda content: [cleaned(bytes(content), remove)], (None, None), schema, "content")
    if not texts:
        return out
    kept = out.where("error IS NULL").join(files.select("path", "suffix"), "path")
    units = text_units(kept).where(F.col("part").rlike("|".join(texts))).withColumn("doc_id", F.to_json(F.struct("path", "part", "unit")))
    new = transform(units.where("error IS NULL").select("doc_id", "text")).select("doc_id", F.col("text").alias("new"))
    written = write_units(kept, units.join(new, "doc_id").select("path", "part", "unit", F.col("new").alias("text")))
    done = written.select("path", F.col("content").alias("_c"), F.col("error").alias("_e"))
    both = out.join(done, "path", "left")
    return both.select("path", F.when(F.col("error").isNull(), F.col("_c")).alias("content"), "removed", F.coalesce("error", "_e").alias("error"))


def without_metadata(files: DataFrame) -> DataFrame:
    """path, content, fields and error of office files whose properties name no people, firms or programs;
    ``fields`` are the ones that were emptied."""

    def clean(content: bytes) -> list[tuple]:
        fields: set[str] = set()

        def edit(name: str, data: bytes) -> bytes | None:
            if name.lower() == "docprops/custom.xml":
                fields.add("custom")
                return _xml(ET.Element("{http://schemas.openxmlformats.org/officeDocument/2006/custom-properties}Properties"))
            if name.lower() not in ("docprops/core.xml", "docprops/app.xml"):
                return data
            _namespaces(data)
            root = ET.fromstring(data)
            for node in root.iter():
                if _local(node) in _PROPERTIES and node.text:
                    fields.add(_local(node))
                    node.text = ""
            return _xml(root)

        return [(rewritten(bytes(content), edit), sorted(fields))]

    return _mapped(files.where(F.col("suffix").isin(*TEXT_PARTS)), clean, (None, None), "path string, content binary, fields array<string>, error string", "content")


def safe_report(hidden: DataFrame) -> DataFrame:
    """path, kinds (a map of counts), errors and safe_to_release from ``office.hidden_kinds``: counts alone,
    and safe only without an error."""
    rows = hidden.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("kind", "n"))))).alias("kinds"), F.count("error").alias("errors"))
    return rows.withColumn("safe_to_release", F.col("errors") == 0)
