"""Markdown, plain text and JSON lines from texts, blocks and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles that make a heading, and marks of a list item.
TITLES = "ДОГОВОР|СОГЛАШЕНИЕ|АКТ|ПРИКАЗ|РЕШЕНИЕ|ОПРЕДЕЛЕНИЕ|ПРЕТЕНЗИЯ|ОТВЕТ НА ПРЕТЕНЗИЮ"
ITEM = r"^(?:[0-9]+(?:\.[0-9]+)*\.?|[а-яёa-z]\)|-|•|\*)\s+"


def escape_cell(text: Column) -> Column:
    """A table cell: pipes escaped, whitespace squeezed; null is empty."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))


def markdown(text: Column) -> Column:
    """Blocks between blank lines: those with pipes stay, titles become headings, list items bullets,
    others paragraphs.  Null and empty texts are empty."""

    def block(b: Column) -> Column:
        lines = F.filter(F.transform(F.split(b, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
        whole = F.array_join(lines, " ")
        title = F.when(whole.rlike(rf"(?U)^(?:{TITLES})\b"), F.concat(F.lit("## "), whole, F.lit("\n"))).when(whole.rlike(ITEM), F.concat(F.lit("- "), whole))
        return F.when(b.contains("|"), F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.coalesce(title, F.concat(whole, F.lit("\n"))))

    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    parts = F.filter(F.split(stripped, r"\n\s*\n+"), lambda b: b.rlike(r"\S"))
    joined = F.array_join(F.transform(parts, block), "\n")
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.regexp_replace(joined, r"^\s+|\s+$", ""), F.lit("\n")))


def cell_rows(blocks: DataFrame) -> DataFrame:
    """path, scope, row and cells (by column, gaps empty) of the rows of tables that aren't blank; of a repeated
    cell the largest text counts."""
    cells = blocks.where("kind = 'cell'").groupBy("path", "scope", "row", "col").agg(F.max("text").alias("text"))
    rows = cells.groupBy("path", "scope", "row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), F.coalesce("text", F.lit(""))))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    return rows.select("path", "scope", "row", cells.alias("cells")).where(F.exists("cells", lambda c: F.trim(c) != ""))


def sheet_markdown(blocks: DataFrame) -> DataFrame:
    """path, scope and the pipe table of each sheet, its first row the header, rows padded alike."""
    sheets = cell_rows(blocks).groupBy("path", "scope").agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("rs"), F.max(F.size("cells")).alias("w"))
    padded = F.transform("rs", lambda r: F.transform(F.concat(r["cells"], F.array_repeat(F.lit(""), F.col("w") - F.size(r["cells"]))), escape_cell))
    drawn = F.transform(padded, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("w")), " | "), F.lit(" |"))
    return sheets.select("path", "scope", F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, F.lit(2), F.size("rs"))), "\n").alias("table"))


def sheet_text(blocks: DataFrame) -> DataFrame:
    """path, scope and the rows of each sheet, cells between tabs."""
    return cell_rows(blocks).groupBy("path", "scope").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda r: F.array_join(r["cells"], "\t")), "\n").alias("text"))


def _trimmed(lines: Column, sep: str = "\n") -> Column:
    return F.concat(F.regexp_replace(F.array_join(lines, sep), r"^\s+|\s+$", ""), F.lit("\n"))


def _placed(blocks: DataFrame, tables: DataFrame, line: Column) -> DataFrame:
    """path, place and line of the paragraphs and tables of documents."""
    body = blocks.where("scope = 'body' AND trim(text) <> ''").select("path", F.col("row").alias("place"), line.alias("line"))
    return body.unionByName(tables.select("path", F.regexp_extract("scope", r"(\d+)", 1).cast("long").alias("place"), "line"))


def word_markdown(blocks: DataFrame) -> DataFrame:
    """path and Markdown of every docx from its blocks: headings by style or by a title's word, list items,
    paragraphs and pipe tables in their order; headers, footers and notes are left out."""
    text = F.trim("text")
    level = F.regexp_extract("kind", r"heading (\d)", 1)
    line = (
        F.when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), text, F.lit("\n"))).when(text.rlike(rf"(?U)^(?:{TITLES})\b"), F.concat(F.lit("## "), text, F.lit("\n")))
        .when(text.rlike(ITEM), F.concat(F.lit("- "), text)).otherwise(F.concat(text, F.lit("\n")))
    )
    tables = sheet_markdown(blocks.where("scope LIKE 'table %'")).select("path", "scope", F.concat("table", F.lit("\n")).alias("line"))
    return _placed(blocks, tables, line).groupBy("path").agg(_trimmed(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])).alias("markdown"))


def word_text(blocks: DataFrame) -> DataFrame:
    """path and plain text of every docx: paragraphs and table rows (cells between pipes, a blank line behind a
    table) in their order."""
    rows = cell_rows(blocks.where("scope LIKE 'table %'")).groupBy("path", "scope").agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("rs"))
    drawn = F.array_join(F.transform("rs", lambda r: F.array_join(F.transform(r["cells"], lambda c: F.trim(c)), " | ")), "\n")
    tables = rows.select("path", "scope", F.concat(drawn, F.lit("\n")).alias("line"))
    return _placed(blocks, tables, F.trim("text")).groupBy("path").agg(_trimmed(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])).alias("text"))


def workbook_text(blocks: DataFrame) -> DataFrame:
    """path and plain text of every workbook: each sheet under a line with its name, by name."""
    sheets = sheet_text(blocks).select("path", "scope", F.concat(F.lit("=== Лист: "), "scope", F.lit(" ===\n"), "text").alias("line"))
    return sheets.groupBy("path").agg(_trimmed(F.transform(F.array_sort(F.collect_list(F.struct("scope", "line"))), lambda x: x["line"]), "\n\n").alias("text"))


def slides(blocks: DataFrame) -> DataFrame:
    """path, number, title, paragraphs and notes of every slide; the title is its first short line that is no
    list item, else its number.  A note that is a number alone is none."""
    rows = blocks.where("scope LIKE 'slide %' AND trim(text) <> ''").withColumn("number", F.regexp_extract("scope", r"(\d+)", 1).cast("int"))
    lines = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("row", F.trim("text").alias("t"))))), lambda x: x["t"])
    out = rows.groupBy("path", "number").agg(lines("paragraph").alias("paragraphs"), F.filter(lines("note"), lambda n: ~n.rlike(r"^\d+$")).alias("notes"))
    title = F.try_element_at(F.filter("paragraphs", lambda p: (F.char_length(p) < 120) & ~p.rlike(r"^[-•*]")), F.lit(1))
    return out.select("path", "number", F.coalesce(title, F.concat(F.lit("Слайд "), F.col("number").cast("string"))).alias("title"), "paragraphs", "notes")


def _decks(parts: DataFrame, lines: Column, column: str) -> DataFrame:
    rows = parts.select("path", "number", lines.alias("lines"))
    return rows.groupBy("path").agg(_trimmed(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", "lines"))), lambda x: x["lines"]))).alias(column))


def slides_text(parts: DataFrame) -> DataFrame:
    """path and plain text of every deck of ``slides``."""
    head = F.concat(F.lit("=== Слайд "), F.col("number").cast("string"), F.lit(": "), "title", F.lit(" ==="))
    notes = F.when(F.size("notes") > 0, F.concat(F.array(F.lit("[Заметки:]")), F.transform("notes", lambda n: F.concat(F.lit("  * "), n)))).otherwise(F.array().cast("array<string>"))
    return _decks(parts, F.concat(F.array(head), "paragraphs", notes, F.array(F.lit(""))), "text")


def slides_markdown(parts: DataFrame) -> DataFrame:
    """path and Markdown of every deck of ``slides``: a heading for each slide, notes quoted, a rule behind it."""
    head = F.concat(F.lit("## Слайд "), F.col("number").cast("string"), F.lit(": "), "title", F.lit("\n"))
    body = F.transform("paragraphs", lambda p: F.when(p.rlike(r"^[-•*]\s+"), p).otherwise(F.concat(p, F.lit("\n"))))
    quoted = F.concat(F.array(F.lit("\n> **Заметки докладчика:**")), F.transform("notes", lambda n: F.concat(F.lit("> - "), n)), F.array(F.lit("")))
    notes = F.when(F.size("notes") > 0, quoted).otherwise(F.array().cast("array<string>"))
    return _decks(parts, F.concat(F.array(head), body, notes, F.array(F.lit("---\n"))), "markdown")


def write_texts(rows: DataFrame, path: str, column: str = "text") -> None:
    """One text file of each row in ``column``; an existing folder is an error, and the files appear when all
    are written."""
    rows.select(F.col(column).alias("value")).write.mode("errorifexists").option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def json_line(rows: DataFrame) -> DataFrame:
    """One column ``value``: each row as JSON, its fields in the order of their names."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    json_line(rows).write.mode("errorifexists").text(path)
