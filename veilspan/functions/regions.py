"""Recognised page regions: confidences, boxes, reading order, and a gate for extracted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the text gate: least length, share of letters and digits, and the same by page.
LEAST_LENGTH, LEAST_SHARE = 20, 0.25
LEAST_TEXT, TEXT_A_PAGE = 40, 20
LEAST_DISTINCT, DISTINCT_A_PAGE = 30, 8


def confidence(value: Column) -> Column:
    """0 to 1: values over 1 up to 100 are percentages; null, NaN and text that is no number are 0."""
    v = value.try_cast("double")
    v = F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)
    return F.least(F.greatest(F.when((v > 1) & (v <= 100), v / 100).otherwise(v), F.lit(0.0)), F.lit(1.0))


def box(xs: Column, ys: Column, width: Column, height: Column, from_bottom: bool = False) -> Column:
    """(x1, y1, x2, y2) in 0 to 1 from the top left, around a region's points; the whole page if the
    points are null or empty.  Sizes below 1 count as 1."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    w, h = F.greatest(F.coalesce(width, F.lit(1)).cast("double"), F.lit(1.0)), F.greatest(F.coalesce(height, F.lit(1)).cast("double"), F.lit(1.0))
    top, low = F.array_min(ys) / h, F.array_max(ys) / h
    if from_bottom:
        top, low = 1 - low, 1 - top
    known = (F.size(F.coalesce(xs, F.array())) > 0) & (F.size(F.coalesce(ys, F.array())) > 0)
    sides = {"x1": F.array_min(xs) / w, "y1": top, "x2": F.array_max(xs) / w, "y2": low}
    return F.struct(*[F.when(known, clamp(c)).otherwise(F.lit(1.0 if name[1] == "2" else 0.0)).alias(name) for name, c in sides.items()])


def _alnum(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def text_quality(text: Column, pages: Column | None = None, watermark: str = r"(?i)scanned (?:with|by) \S.*") -> Column:
    """``ok``, or why a text can't stand for its document: ``empty``, ``unreadable``, ``watermark``
    (lines of that shape alone), ``sparse`` or ``repeated`` (for its number of pages).  Null is empty."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    telling = F.filter(lines, lambda x: ~x.rlike(f"^(?:{watermark})$"))
    n = F.greatest(F.coalesce(pages, F.lit(1)) if pages is not None else F.lit(1), F.lit(1))
    return (
        F.when(squeezed == "", "empty")
        .when((F.char_length(squeezed) < LEAST_LENGTH) | (_alnum(squeezed) / F.char_length(squeezed) < LEAST_SHARE), "unreadable")
        .when(F.size(telling) == 0, "watermark")
        .when((n > 1) & (_alnum(F.array_join(telling, " ")) < F.greatest(F.lit(LEAST_TEXT), n * TEXT_A_PAGE)), "sparse")
        .when((n > 1) & (_alnum(F.array_join(F.array_distinct(F.transform(telling, F.lower)), " ")) < F.greatest(F.lit(LEAST_DISTINCT), n * DISTINCT_A_PAGE)), "repeated")
        .otherwise("ok")
    )


def lines_of(regions: DataFrame) -> DataFrame:
    """Regions (doc_id, page, x1, y1, x2, y2, text) with ``line`` and ``place`` in it.

    A line goes on while a region's middle lies within max(0.015, 0.45 of its height) of the mean
    middle of the line so far: one fold over a page's regions in the order of (y1, x1).
    """
    item = F.struct("y1", "x1", "x2", "y2", "text")
    pages = regions.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(item)).alias("all"))
    start = F.struct(F.lit(0).alias("line"), F.lit(0.0).alias("mean"), F.lit(0).alias("n"), F.expr("CAST(array() AS array<int>)").alias("lines"))

    def step(acc: Column, r: Column) -> Column:
        middle = (r["y1"] + r["y2"]) / 2
        same = (acc["n"] > 0) & (F.abs(middle - acc["mean"]) <= F.greatest(F.lit(0.015), (r["y2"] - r["y1"]) * 0.45))
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        mean = F.when(same, (acc["mean"] * acc["n"] + middle) / (acc["n"] + 1)).otherwise(middle)
        return F.struct(line.alias("line"), mean.alias("mean"), F.when(same, acc["n"] + 1).otherwise(1).alias("n"), F.array_append(acc["lines"], line).alias("lines"))

    placed = pages.withColumn("lines", F.aggregate("all", start, step)["lines"]).select("doc_id", "page", F.explode(F.arrays_zip("all", "lines")).alias("z"))
    rows = placed.select("doc_id", "page", F.col("z.lines").alias("line"), "z.all.x1", "z.all.y1", "z.all.x2", "z.all.y2", "z.all.text")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "page", "line").orderBy("x1", "y1", "text")))
