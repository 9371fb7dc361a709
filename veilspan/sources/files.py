"""Files of a folder as documents: listing, text of several encodings, JSON lines, chunks, XML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Suffixes of plain and office formats, and the largest file taken.
TEXT_SUFFIXES = ("txt", "text", "md", "rst", "log", "csv", "json", "xml")
OFFICE_SUFFIXES = ("docx", "xlsx", "pptx")
LARGEST = 500 * 1024 * 1024

_HIGH = "".join(chr(i) for i in range(128, 256))
_WINDOWS = bytes(range(128, 256)).decode("cp1251", "replace")


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES + OFFICE_SUFFIXES, left_out: str = "_masked") -> DataFrame:
    """path, name, suffix, length, modificationTime and content of a folder's files, in any depth.

    Hidden and lock files, those under a folder named ``left_out``, other suffixes and larger files
    are left out, and so are files of no bytes (the source gives no row for them).  Listing is Spark's; nothing is read before a query needs ``content``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumns({"name": name, "suffix": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))})
    return files.where(F.col("suffix").isin(*suffixes) & ~F.col("name").rlike(r"^(?:\.|~\$)") & ~F.contains("path", F.lit(f"/{left_out}/")) & (F.col("length") <= LARGEST))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark if they are valid, else the Cyrillic Windows code page."""
    single = F.translate(F.decode(content, "ISO-8859-1"), _HIGH, _WINDOWS)
    return F.regexp_replace(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(single), "^﻿", "")


def texts(files: DataFrame) -> DataFrame:
    """path, sha256 of the bytes, and text of files with content."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), decoded(F.col("content")).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON lines file of a stated schema; a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def fragments(text: Column, longest: int = 8000) -> Column:
    """Pieces between blank lines, longer ones cut at ``longest`` characters; whitespace alone is none."""
    pieces = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")
    cut = F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(p) - 1) / longest).cast("int")), lambda i: F.substr(p, i * longest + 1, F.lit(longest))))
    return F.flatten(cut)


def chunks(docs: DataFrame, longest: int = 30_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start and text of pieces of at most ``longest`` characters, cut at the last newline,
    else the last space, else anywhere; put together they are the text.  Null texts have none."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                at, last = 0, False
                while not last:
                    end = min(len(text), at + longest)
                    last = end == len(text)
                    if not last:
                        places = (text.rfind(mark, at + 1, end) for mark in "\n ")
                        end = next((p for p in places if p > at), end)
                    out.append((doc_id, at, text[at:end]))
                    at = end
            yield pd.DataFrame(out, columns=["doc_id", "start", "text"]).astype({"doc_id": "object"})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInPandas(cut, "doc_id string, start long, text string")


def xml_text(content: Column, tag: str = "p") -> Column:
    """The text of every ``tag`` element, by lines; null if the XML is malformed."""
    return F.array_join(F.filter(F.transform(F.xpath(content, F.lit(f"//{tag}//text()")), lambda x: F.trim(x)), lambda t: t != ""), "\n")


# Marks that no space stands before or behind when words are put together.
NO_SPACE_BEFORE, NO_SPACE_AFTER = set(".,;:!?%)]}»”"), set("([{«“")


def join_words(words: list[str]) -> str:
    """Words of a marked-up sentence as plain text: a space between two unless a mark or dash forbids it."""
    out = ""
    for word in filter(None, words):
        tight = not out or word[0] in NO_SPACE_BEFORE or out[-1] in NO_SPACE_AFTER or word[0] in "-–—" or out[-1] in "-–—"
        out += word if tight else " " + word
    return out


def marked_up_text(contents: DataFrame, content_col: str = "content") -> DataFrame:
    """All columns of ``contents`` and text: the title, and the paragraphs of the sentences of the words of an
    XML document (head/title, p, s, w), a line each; null if it is no XML."""
    from xml.etree import ElementTree as ET

    def plain(content: bytes | None) -> str | None:
        try:
            root = ET.fromstring(bytes(content))
        except (ET.ParseError, TypeError):
            return None
        title = root.find("./head/title")
        lines = ["".join(title.itertext()).strip()] if title is not None else []
        for p in root.findall(".//p"):
            lines.append(" ".join(filter(None, (join_words(["".join(w.itertext()) for w in s.findall(".//w")]) for s in p.findall(".//s")))))
        return "\n".join(filter(None, lines))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[plain(c) for c in frame[content_col]])

    return contents.mapInPandas(run, StructType([*[f for f in contents.schema.fields if f.name != "text"], StructType().add("text", "string")[0]]))


def numbered_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """path, place (of the line in its file, by bytes), value and wrong of every line of JSON files that isn't
    blank; a line that is no object of the schema has a null value and is wrong."""
    lines = spark.read.option("wholetext", "false").text(path).withColumns({"path": F.col("_metadata.file_path"), "place": F.monotonically_increasing_id()})
    value = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    lines = lines.where(F.trim("value") != "")
    return lines.select("path", "place", value.alias("parsed"), (~F.col("value").rlike(r"^\s*\{.*\}\s*$") | F.get_json_object("value", "$").isNull()).alias("wrong"))
