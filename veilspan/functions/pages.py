"""Recognised lines and pages: repair of mixed alphabets, paragraphs put together, places of regions in a text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that look alike in the two alphabets, in pairs.
LATIN, CYRILLIC = "ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху"


def to_latin(text: Column) -> Column:
    return F.translate(text, CYRILLIC, LATIN)


def to_cyrillic(text: Column) -> Column:
    return F.translate(text, LATIN, CYRILLIC)


#: Put around matches; a text that holds it already is matched and split instead.
_MARK = "\uffff"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: Spark shares nothing that higher-order functions read,
    so an expression that reads its input twice doubles with each one put around it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _holds(text: Column, held: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(x) for x in held])


def rewritten(text: Column, pattern: str, change: Callable[[Column], Column], held: tuple[str, ...] = ("",)) -> Column:
    """``text`` with every match of a pattern (none of them empty) changed; every match holds one of ``held``."""

    def marked(t: Column) -> Column:
        def changed(m: Column) -> Column:
            parts = F.transform(F.split(m, _MARK, -1), lambda part, i: F.when(i % 2 == 1, change(part)).otherwise(part))
            return F.when(m.contains(_MARK), F.array_join(parts, "")).otherwise(m)

        return bound(F.regexp_replace(t, pattern, f"{_MARK}$0{_MARK}"), changed)

    def split(t: Column) -> Column:
        found, gaps = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        return F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.transform(found, change), F.array(F.lit(""))), lambda g, m: F.array(g, m))), "")

    return bound(text, lambda t: F.when(~_holds(t, held), t).when(t.contains(_MARK), split(t)).otherwise(marked(t)))


def _replaced(text: Column, pattern: str, by: str, *held: str) -> Column:
    """Every match of a pattern replaced; every match holds one of ``held``."""
    return bound(text, lambda t: F.when(_holds(t, held), F.regexp_replace(t, pattern, by)).otherwise(t))


# Words with letters of both alphabets, and of those the ones with one or two letters of one and more, or two, of the other.
_WORD, _CYR, _LAT = r"\p{L}\d_\-", r"\x{0400}-\x{04ff}", "A-Za-z"
_MIXED = rf"(?<![{_WORD}])(?=[{_WORD}&&[^{_LAT}]]*+[{_LAT}])(?=[{_WORD}&&[^{_CYR}]]*+[{_CYR}])[{_WORD}]++"
_FEW = r"^(?=[^{0}]*+[{0}][^{0}]*+[{0}])(?:[^{1}]*+[{1}]){{1,2}}[^{1}]*+\z"


def _one_script(word: Column) -> Column:
    """A word of mixed letters in the alphabet that most of its letters are of, if only one or two aren't."""
    return F.when(word.rlike(_FEW.format(_CYR, _LAT)), to_cyrillic(word)).when(word.rlike(_FEW.format(_LAT, _CYR)), to_latin(word)).otherwise(word)


def recognised_line(text: Column) -> Column:
    """A line of a recogniser with the usual faults mended, in this order: alphabets of addresses, links,
    bank codes and vehicle numbers; letters O in division codes; number signs and quotes; spaces in
    addresses; words of mixed alphabets; ``bI`` for a letter; spaces.  Null is empty."""
    # A look at one character before a word bound or a look back of several lengths only spares these where they can't hold.
    s = F.coalesce(text, F.lit(""))
    s = rewritten(s, r"(?U)\b[\p{L}\d._%+-]++@[\p{L}\d.-]+\.\p{L}{2,}\b", to_latin, ("@",))
    s = rewritten(s, r"(?U)\bhttps?://[\p{L}\d.-]+(?:/\S*)?", to_latin, ("http",))
    s = rewritten(s, r"(?iU)(?<=[:\s])(?<=\b(?:SWIFT|BIC|БИК|СВИФТ)[:\s]{1,3})[\p{L}\d]{8,11}\b", to_latin)
    s = rewritten(s, r"(?iU)(?<=[:\s№#])(?<=\b(?:VIN|ВИН)[:\s№#]{1,3})[\p{L}\d]{17}\b", to_latin)
    s = rewritten(s, r"(?U)(?=[0-9OО])\b[0-9OО]{3}[-—][0-9OО]{3}\b", lambda c: F.translate(c, "OО—", "00-"), ("-", "—"))
    s = _replaced(F.translate(s, "《》中Φ", "«»ФФ"), r"(?U)(?=N)\bN[º°o]\.?\s*", "№ ", "N")
    s = _replaced(s, r"\s*@{2,}\s*", "@", "@@")
    s = _replaced(s, r"([A-Za-z0-9._%+-]++)\s*@\s*([A-Za-z0-9.-]+)\s*\.\s*([A-Za-z]{2,})", "$1@$2.$3", "@")
    s = rewritten(s, _MIXED, _one_script)
    s = _replaced(_replaced(s, r"(?<=\p{L})bI", "ы", "bI"), r"(?<=\p{L})BI", "Ы", "BI")
    s = _replaced(s, r"(?<=«)\s+|\s+(?=»)", "", "«", "»")
    return F.coalesce(F.trim(F.regexp_replace(s, r"(?U)\s{2,}|[\s&&[^ ]]", " ")), F.lit(""))


# Words that begin a part of a document, and captions of its requisites.
HEADINGS = "ДОГОВОР|СОГЛАШЕНИЕ|АКТ|ПРИЛОЖЕНИЕ|УТВЕРЖДАЮ|РАСПОРЯЖЕНИЕ|ПРИКАЗ|РЕШЕНИЕ|ОПРЕДЕЛЕНИЕ|ПОСТАНОВЛЕНИЕ|ПРЕАМБУЛА|ПРЕДМЕТ|ПРАВА И ОБЯЗАННОСТИ|ОТВЕТСТВЕННОСТЬ|РЕКВИЗИТЫ|ПОДПИСИ СТОРОН"
REQUISITES = r"Заказчик|Исполнитель|Арендатор|Арендодатель|Покупатель|Продавец|Истец|Ответчик|Судья|Адрес|ИНН|КПП|ОГРН|БИК|Р/с|К/с|Банк|Тел|E-mail|Генеральный директор|Директор|Подпись|М\.П\."
_NEW = rf"(?U)^(?:(?:{HEADINGS})\b|[0-9]+(?:\.[0-9]+)*\.?\s+[А-ЯЁA-Z]|(?:[0-9]+(?:\.[0-9]+)*\.?|[а-яёa-z]\)|-|•|\*)\s+|(?i:{REQUISITES})\s*:?)"


def paragraphs(text: Column) -> Column:
    """Lines put together to paragraphs: a blank line, heading, list item, caption, pipe, a line behind a
    colon, or one behind a short line without a comma begins a new one; a hyphen at a line's end goes.
    An empty array of null and blank texts."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"))

    def closed(acc: Column) -> Column:
        return F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], F.trim(F.array_join(acc["now"], " ")))).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        last = F.element_at(acc["now"], -1)
        new = line.rlike(_NEW) | last.endswith(":") | ((F.char_length(last) < 45) & ~last.endswith(",")) | line.contains("|")
        head = F.slice(acc["now"], F.lit(1), F.size(acc["now"]) - 1)
        joined = F.array_append(head, F.concat(F.substr(last, F.lit(1), F.char_length(last) - 1), line))
        here = F.when(last.endswith("-"), joined).otherwise(F.array_append(acc["now"], line))
        return F.when(F.size(acc["now"]) == 0, F.struct(acc["done"].alias("done"), F.array(line).alias("now"))).when(new, F.struct(closed(acc).alias("done"), F.array(line).alias("now"))).otherwise(F.struct(acc["done"].alias("done"), here.alias("now")))

    def block(b: Column) -> Column:
        lines = F.filter(F.transform(F.split(b, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
        return F.aggregate(lines, start, step, closed)

    blocks = F.split(F.coalesce(text, F.lit("")), r"\n\s*\n+")
    return F.filter(F.flatten(F.transform(blocks, block)), lambda p: p != "")


def region_places(pages: DataFrame) -> DataFrame:
    """doc_id, start, end, page, box and confidence of the regions of each text, found one after another from
    the end of the one before (else from the start of the text); ``pages`` has doc_id, text and regions
    (array of page, text, box, confidence in reading order).  Regions that don't occur are left out."""
    kind = "array<struct<start:int,end:int,page:int,box:struct<x1:double,y1:double,x2:double,y2:double>,confidence:double>>"
    begin = F.struct(F.lit(1).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        ahead = F.call_function("locate", r["text"], F.col("text"), acc["at"])
        at = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", r["text"], F.col("text"), F.lit(1)))
        end = at + F.char_length(r["text"])
        place = F.struct((at - 1).cast("int").alias("start"), (end - 1).cast("int").alias("end"), r["page"].cast("int").alias("page"), r["box"].alias("box"), r["confidence"].alias("confidence"))
        return F.when((F.coalesce(r["text"], F.lit("")) == "") | (at == 0), acc).otherwise(F.struct(end.cast("int").alias("at"), F.array_append(acc["out"], place).alias("out")))

    return pages.select("doc_id", F.explode(F.aggregate("regions", begin, step)["out"]).alias("r")).select("doc_id", "r.*")


def region_of_span(spans: DataFrame, places: DataFrame) -> DataFrame:
    """``spans`` (doc_id, start, end, ...) with page, box and confidence of the first region that each overlaps;
    null where none does."""
    p = places.select(F.col("doc_id").alias("_id"), F.struct(F.col("start").alias("s"), "page", "box", "confidence").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e"))
    kept = spans.columns
    first = spans.distinct().join(p, hit).groupBy(*kept).agg(F.min_by("_p", "_s").alias("_p"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in kept]
    first = first.select(*[F.col(c).alias(f"_k_{c}") for c in kept], "_p")
    return spans.join(first, same, "left").select(*kept, "_p.page", "_p.box", "_p.confidence")
