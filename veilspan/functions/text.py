"""Text normalisation, spans of pattern matches and log redaction as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that normalisation drops and folds.
DROPPED = "\u00ad\u200b\u200c\u200d\ufeff"
SPACES = "\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
DOUBLE_QUOTES = "\u00ab\u00bb\u201c\u201d\u201e\u201f"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b"

SPAN = "struct<start:int,end:int,text:string>"


def normalize(text: Column) -> Column:
    """Invisible characters dropped, spaces, dashes and quotes folded, runs of spaces squeezed."""
    folded = F.translate(text, SPACES + DASHES + DOUBLE_QUOTES + SINGLE_QUOTES + DROPPED, " " * len(SPACES) + "-" * len(DASHES) + '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES))
    return F.regexp_replace(folded, " {2,}", " ")


def offset_map(text: Column) -> Column:
    """For each character of ``normalize(text)`` its place in ``text``; at last the text's length."""
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(i.alias("i"), F.translate(c, SPACES, " " * len(SPACES)).alias("c")))
    kept = F.filter(chars, lambda x: ~F.lit(DROPPED).contains(x["c"]))
    first = F.filter(F.transform(kept, lambda x, k: F.struct(x["i"].alias("i"), ((x["c"] == " ") & (k > 0) & (F.try_element_at(kept, F.greatest(k, F.lit(1)))["c"] == " ")).alias("again"))), lambda x: ~x["again"])
    return F.concat(F.transform(first, lambda x: x["i"]), F.array(F.char_length(text)))


def to_original(start: Column, end: Column, offsets: Column, length: Column) -> tuple[Column, Column]:
    """A span of the normalised text in the original, clamped."""
    last = F.size(offsets) - 1
    at = lambda i: F.least(F.get(offsets, F.least(F.greatest(i, F.lit(0)), last)), length)
    return at(start), F.greatest(at(start), at(end))


#: Runs of the original that ``normalize`` shortens: to one space, or to nothing.
SQUEEZED = f"[ {SPACES}][ {SPACES}{DROPPED}]+|[{DROPPED}]+"


#: What ``normalize`` changes: a text without it is its own normal form.
CHANGED = f"[{SPACES}{DASHES}{DOUBLE_QUOTES}{SINGLE_QUOTES}{DROPPED}]| {{2}}"


def unsqueezed(place: Column, runs: Column) -> Column:
    """A place in ``normalize(text)`` as a place in ``text``, given the spans of ``SQUEEZED`` in it: as
    ``offset_map`` has it, without an array of all characters."""

    def step(cut: Column, r: Column) -> Column:
        left = F.when(F.lit(DROPPED).contains(F.substring(r["text"], 1, 1)), 0).otherwise(1)
        return F.when(r["start"] - cut + left <= place, cut + r["end"] - r["start"] - left).otherwise(cut)

    return place + F.aggregate(runs, F.lit(0), step)


def placed(found: Column, gaps: Column) -> Column:
    """Matches of a pattern and the text between them (columns, not expressions: both are read at
    every step), put end to end as (start, end, text) in code points."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["gap"])
        end = begin + F.char_length(p["text"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), p["text"].alias("text"))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, t: F.struct(g.alias("gap"), t.alias("text")))
    return F.aggregate(pairs, start, step)["out"]


def spans(text: Column, pattern: str) -> Column:
    """Every match of a pattern as (start, end, text), in code points.  No Python."""
    return placed(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))


# Ordered redactions of log lines, pattern and replacement.
USER_PATHS = (
    (r"(?iU)\b[a-z]:[\\/]users[\\/][^\s\\/:]+", "[USER_PATH]"),
    (r"(?U)(?<!\w)/Users/[^\s\\/:]+", "[USER_PATH]"),
    (r"(?U)(?<!\w)/home/[^\s\\/:]+", "[USER_PATH]"),
)
REDACTIONS = (
    (r"(?U)\bAIza[0-9A-Za-z\-_]{20,50}\b", "[REDACTED_API_KEY]"),
    (r"(?iU)\bBearer\s+[A-Za-z0-9\-_.]+\b", "Bearer [REDACTED_TOKEN]"),
    (r"(?iU)\b(api[_-]?key|password|secret|token)\s*[:=]\s*['\"]?([^\s'\"]+)['\"]?", "$1=[REDACTED]"),
    (r"(?U)\b\d{2}\s*\d{2}\s+\d{6}\b", "[REDACTED_PASSPORT]"),
    (r"(?U)\b\d{3}[-\s]\d{3}[-\s]\d{3}[-\s]\d{2}\b", "[REDACTED_SNILS]"),
    (r"(?U)\b[34]\d{19}\b", "[REDACTED_ACCOUNT]"),
    (r"(?U)\b(?:\d{4}[-\s]){3}\d{4}\b", "[REDACTED_CARD]"),
    (r"(?iU)\b(инн\s*[:#№]?\s*)\d{10,12}\b", "$1[REDACTED_INN]"),
    (r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"(?U)(?:\+7|8)[\s\-(]*\d{3}[\s\-)]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}\b", "[REDACTED_PHONE]"),
    *USER_PATHS,
)


def sanitize_paths(text: Column, home: str | None = None) -> Column:
    """User folders (and ``home``, the folder of the process' own user, if given) as a mark."""
    if home:
        text = F.replace(F.replace(text, F.lit(home), F.lit("[USER_PATH]")), F.lit(home.replace("\\", "/")), F.lit("[USER_PATH]"))
    for pattern, mark in USER_PATHS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def sanitize_log(text: Column, longest: int | None = None, home: str | None = None) -> Column:
    """Log lines without user folders, keys, passwords, document numbers, accounts, addresses and phones;
    beyond ``longest`` characters they end with three dots.  Null stays."""
    text = sanitize_paths(text, home)
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text if longest is None else F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("..."))).otherwise(text)


def sanitize_error(kind: Column, message: Column, longest: int = 500) -> Column:
    """Of an exception its class alone, as its message may hold any text; else the redacted message."""
    return F.when(kind.isNotNull(), sanitize_log(kind, longest)).otherwise(sanitize_log(F.coalesce(message, F.lit("")), longest))


def replace_nth(text: Column, token: str, replacement: str, nth: int = 0) -> Column:
    """Only the occurrence of that number (from 0); unchanged if there are fewer."""
    parts = F.split(text, "\\Q" + token + "\\E", -1)
    head, tail = F.array_join(F.slice(parts, 1, nth + 1), token), F.array_join(F.slice(parts, F.lit(nth + 2), F.greatest(F.size(parts) - nth - 1, F.lit(0))), token)
    return F.when(F.size(parts) > nth + 1, F.concat(head, F.lit(replacement), tail)).otherwise(text)


TOKEN = r"\[[A-Z][A-Z_]*_\d+\]"

# Fixed value: placeholders of the four bracket styles.
_BODY = r"[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9 _.:\-]{0,119}"
PLACEHOLDER = r"(?:\{\{[^{}\n]{1,120}\}\}|\[\[[^\[\]\n]{1,120}\]\]|/" + _BODY + r"/|\[[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9 _.:/\-]{0,119}\])"


def placeholders(text: Column) -> Column:
    """All placeholder tokens of the four bracket styles, in order; none of a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)), F.array().cast("array<string>"))


def is_placeholder(value: Column) -> Column:
    """Whether a whole value is a token of a registry: square brackets or slashes around a short name."""
    body = r"[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9 _.:/\-]{0,119}"
    return F.coalesce((F.char_length(value) <= 160) & value.rlike(rf"^(?:\[{body}\]|/{body}/)\z"), F.lit(False))


def protect_placeholders(text: Column) -> Column:
    """(text, tokens): every token as a numbered sentinel, and the tokens in order."""
    found, gaps = placeholders(text), F.split(F.coalesce(text, F.lit("")), PLACEHOLDER, -1)
    marks = F.transform(found, lambda t, i: F.concat(F.lit("<<PH"), i.cast("string"), F.lit(">>")))
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.concat(marks, F.array(F.lit(""))), lambda g, m: F.array(g, m))), "")
    return F.struct(whole.alias("text"), found.alias("tokens"))


# Words whose change changes what a sentence says.
MODALITY = r"(?iU)\b(?:не|нет|нельзя|можно|может|могут|могу|можем|мог\w*|долж\w*|обязан\w*|вправе|запрещ\w*|разреш\w*|must|shall|may|can|cannot|not|should)\b"
NUMBERS = r"\d+(?:[.,:/-]\d+)*"


def rewrite_problem(generated: Column, protected: Column, similarity: Column, least: float = 0.72) -> Column:
    """Why a rewritten text (with sentinels) isn't taken for the protected one (``protect_placeholders``);
    null if it is: sentinels, numbers and modal words must be the same in order, no token invented, the
    length within 0.65 to 1.35 and the similarity (a ratio of matching characters) at least ``least``."""
    generated = F.coalesce(generated, F.lit(""))
    text = protected["text"]

    def same(pattern: str, fold: bool = False) -> Column:
        a, b = (F.lower(c) if fold else c for c in (generated, text))
        return F.regexp_extract_all(a, F.lit(pattern), F.lit(0)) == F.regexp_extract_all(b, F.lit(pattern), F.lit(0))

    bare = [F.regexp_replace(c, "<<PH[0-9]+>>", "") for c in (generated, text)]
    ratio = F.char_length(generated) / F.greatest(F.char_length(text), F.lit(1))
    numbers = F.regexp_extract_all(bare[0], F.lit(NUMBERS), F.lit(0)) == F.regexp_extract_all(bare[1], F.lit(NUMBERS), F.lit(0))
    return (
        F.when(~same("<<PH[0-9]+>>"), "sentinels").when(F.size(placeholders(generated)) > 0, "invented placeholder").when(~numbers, "numbers").when(~same(MODALITY, fold=True), "modality")
        .when(~ratio.between(0.65, 1.35), "length").when(similarity < least, "similarity")
    )


def unprotect(text: Column, tokens: Column) -> Column:
    """A text with sentinels, the tokens back in their places."""
    return F.aggregate(F.transform(tokens, lambda t, i: F.struct(F.concat(F.lit("<<PH"), i.cast("string"), F.lit(">>")).alias("mark"), t.alias("t"))), text, lambda acc, p: F.replace(acc, p["mark"], p["t"]))


# What copies, edits and versions add to a document's name.
_EDITS = (
    r"\(\d+\)|\(\s*копия(?:\s*\d+)?\s*\)|-\s*копия(?:\s*\d+)?|"
    r"cleaned(?:[_\-]?\d+)?|чистовик(?:[_\-]?\d+)?|правки?(?:[_\-]?\d+)?|исправлен(?:ный|ная|ное|ые)?(?:[_\-]?\d+)?|отредактирован(?:ный|ная|ное|ые)?(?:[_\-]?\d+)?|"
    r"изменен(?:ный|ная|ное|ые|о)?(?:[_\-]?\d+)?|восстановлен(?:ный|ная|ное|ые|о)?(?:[_\-]?\d+)?|пдн(?:[_\-]?\d+)?|копия(?:[_\-]?\d+)?|"
    r"ред(?:акция)?(?:[_\-]?\d+)?|версия(?:[_\-]?\d+)?|v\d+|new|draft|final|"
    r"edited?|mod(?:ified)?|rev(?:ised|ision)?(?:[_\-]?\d+)?|output|result|"
    r"llm|ai|chatgpt|gpt(?:[_\-]?\d+)?|claude(?:[_\-]?\d+)?|qwen(?:[_\-]?\d+)?|deepseek(?:[_\-]?\d+)?|gemini(?:[_\-]?\d+)?|copilot(?:[_\-]?\d+)?"
)
_EDIT_MARKS = (
    "правк", "чистовик", "исправлен", "отредактирован", "изменен", "ред", "пдн", "копия", "llm", "claude", "chatgpt", "gpt", "qwen", "deepseek", "gemini", "copilot", "ai", "edit", "rev", "draft", "v",
)


def document_stem(stem: Column) -> Column:
    """A document's name without the marks of copies, edits and versions; the name itself if nothing else
    is left, empty for null."""
    stem = F.coalesce(stem, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(stem, rf"(?iu)(?:[\s_\-\.]*(?:{_EDITS})[\s_\-\.]*)+$", ""), r"^[ _.\-]+|[ _.\-]+$", "")
    return F.when(bare == "", stem).otherwise(bare)


def is_edited_stem(stem: Column) -> Column:
    """Whether a document's name says that it's an edited copy."""
    low = F.lower(F.coalesce(stem, F.lit("")))
    marks = F.exists(F.array(*[F.lit(m) for m in _EDIT_MARKS]), lambda m: F.contains(low, m)) | F.trim(low).rlike(r"\(\d+\)$")
    return (F.lower(document_stem(stem)) != low) & marks


def replacement_rule(rule: Column) -> Column:
    """(source, target) of a user's rule ``a=>b``, ``a->b``, ``a=b`` or ``a:b`` (the first of these signs that
    occurs, in this order); null for an empty rule, a comment, or one without a source."""
    line = F.trim(F.coalesce(rule, F.lit("")))
    out = F.lit(None).cast("struct<source:string,target:string>")
    for sign in (":", "=", "->", "=>"):
        at = F.instr(line, sign)
        pair = F.struct(F.trim(F.substr(line, F.lit(1), at - 1)).alias("source"), F.trim(F.substr(line, at + len(sign))).alias("target"))
        here = (at > 0) & (pair["source"] != "")
        out = F.when(here, pair).otherwise(out)
    return F.when((line == "") | line.startswith("#"), F.lit(None).cast("struct<source:string,target:string>")).otherwise(out)
