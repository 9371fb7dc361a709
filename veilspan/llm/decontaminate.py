"""Benchmark decontamination by one Aho-Corasick automaton over normalised benchmark windows.

Text and items are cut into words alike (ASCII letters lower-cased; letters, digits and everything
outside ASCII belong to words) and joined by single spaces, on UTF-8 bytes.  The automaton holds each
distinct window, with a space on both sides, so one scan of a document's normal form finds every
occurrence on word borders.  Places in the normal form are mapped to word numbers, and for the spans
on to code points of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import fresh, staged

#: Words of a window, and the bytes of distinct windows that one automaton takes (a worker needs about
#: 46 bytes for each, measured: 280 MB); a larger benchmark is scanned for in blocks of that size.
WINDOW, BLOCK_BYTES = 8, 6 << 20
#: Bytes counted for a window and its item beside the window's own.
_ENTRY_BYTES = 64

_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | set(range(128, 256))
_NORMAL = bytes(ord(chr(b).lower()) if b < 128 and b in _WORD else b if b in _WORD else 32 for b in range(256))
_RUNS = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows_of(text: str | None, window: int = WINDOW) -> tuple[int, set[bytes]]:
    """Words of a window, and the distinct windows of an item; an item of fewer words is one window."""
    w = words_of(text)
    n = min(window, len(w))
    return n, {b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


class Windows:
    """The automaton over (window, words, item), with the items of each window."""

    def __init__(self, entries: Iterable[tuple[bytes, int, int | None]]):
        import ahocorasick

        by: dict[bytes, tuple[int, set]] = {}
        for pattern, n, item in entries:
            by.setdefault(pattern, (n, set()))[1].add(item)
        self.automaton = ahocorasick.Automaton() if by else None
        for pattern, (n, ids) in by.items():
            self.automaton.add_word(f" {pattern.decode('latin-1')} ", (n, len(pattern) + 2, tuple(ids)))
        if by:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit stretches of word numbers (half-open, merged, ascending), the items found and the words
        of the longest window found."""
        if self.automaton is None or not words:
            return [], set(), 0
        normal = f" {b' '.join(words).decode('latin-1')} "
        found = [(end, info) for end, info in self.automaton.iter(normal)]
        if not found:
            return [], set(), 0
        # a word starts after each space but the last
        spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
        items: set = set()
        stretches = []
        for end, (n, size, ids) in found:
            first = int(np.searchsorted(spaces, end - size + 1))
            stretches.append((first, first + n))
            items.update(ids)
        stretches.sort()
        merged = [stretches[0]]
        for a, b in stretches[1:]:
            if a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items, max(n for _, (n, _, _) in found)


def spans_in(text: str, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as half-open code-point spans of the original text."""
    raw = text.encode()
    places = [m.span() for m in _RUNS.finditer(raw.translate(_NORMAL))]
    # code points before each byte: bytes that aren't continuations
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[places[a][0]]), int(points[places[b - 1][1]])) for a, b in stretches]


@lru_cache(maxsize=1)
def _windows(entries: tuple) -> Windows:
    return Windows(entries)


_ADDED = {
    "n_words": "long", "stretches": "array<struct<first:int,last:int>>", "spans": "array<struct<start:int,end:int>>", "items": "array<long>", "widest": "int",
}
_KINDS = (
    pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64()), pa.int32(),
)


def _scan(docs: DataFrame, entries: list[tuple], text: str) -> DataFrame:
    """``docs`` and what one block of the benchmark finds in them."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(entries))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _windows(held.value)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t in b.column(text).to_pylist():
                w = words_of(t)
                stretches, ids, widest = automaton.scan(w)
                out[0].append(len(w))
                out[1].append([{"first": x, "last": y} for x, y in stretches])
                out[2].append([{"start": x, "end": y} for x, y in (spans_in(t, stretches) if stretches else ())])
                out[3].append(sorted(ids, key=lambda i: (i is None, i or 0)))
                out[4].append(widest)
            yield pa.record_batch([*b.columns, *[pa.array(x, k) for x, k in zip(out, _KINDS, strict=True)]], [*b.schema.names, *added])

    added = [fresh(c, docs.columns) for c in _ADDED]
    out = docs.sparkSession.createDataFrame([], docs.schema).selectExpr("*", *[f"CAST(NULL AS {k}) AS `{a}`" for a, k in zip(added, _ADDED.values(), strict=True)]).schema
    return docs.mapInArrow(scanned, out)


def _entries(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (pattern, n, item) of all items; a null id is one item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, found = windows_of(text.as_py(), window)
                if found:
                    yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array([n] * len(found), pa.int32()), pa.array([item] * len(found), pa.int64())], ["pattern", "n", "item"])

    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "pattern binary, n int, item long").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` and, added, n_words, stretches (hit words), spans (in the original),
    items found and widest (words of the longest window found); also the names that these five got
    (underscored where a column has the name).

    Documents are scanned where they are read, without a shuffle.  The distinct windows with their
    items are measured first: up to ``block_bytes`` they go to every worker as one automaton; more are
    cut by hash into blocks that hold no more, each scanned for in turn over the staged outcome of the
    one before, so a worker never holds two.  Null texts have no words; items without words find
    nothing; items without an id find together what one item would (a null among ``items``); repeated
    items count once; an empty benchmark hits nothing.
    """
    entries = _entries(benchmark, window, item_col, item_text_col)
    size = F.coalesce(F.sum(F.octet_length("pattern") + _ENTRY_BYTES), F.lit(0)).alias("size")
    total = entries.agg(size).first()[0]
    blocks = 1
    if total > block_bytes:
        entries = staged(entries, "windows")
        blocks = 2 * -(-total // max(1, block_bytes))
    place = F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks))
    out, first = docs, None
    for k in range(blocks):
        part = entries if blocks == 1 else entries.where(place == k)
        before = out.columns
        out = _scan(out, sorted(map(tuple, part.collect()), key=repr), text_col)
        now = dict(zip(_ADDED, out.columns[len(before) :], strict=True))
        if first is None:
            first = now
        else:
            merged = {
                first["items"]: F.array_sort(F.array_union(first["items"], now["items"])),
                first["stretches"]: merge_stretches(F.concat(first["stretches"], now["stretches"]), "first", "last"),
                first["spans"]: merge_stretches(F.concat(first["spans"], now["spans"]), "start", "end"),
                first["widest"]: F.greatest(first["widest"], now["widest"]),
            }
            out = out.withColumns(merged).drop(*now.values())
        if blocks > 1:
            out = staged(out, "scanned")
    return out, first


def merge_stretches(column: Column, a: str, b: str) -> Column:
    """Union of half-open stretches, ascending."""

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last[a].alias(a), F.greatest(last[b], x[b]).alias(b))))
        return F.when((F.size(acc) > 0) & (x[a] <= F.try_element_at(acc, F.lit(-1))[b]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(column), F.slice(column, F.lit(1), F.lit(0)), add)


def hit_words(stretches: Column) -> Column:
    return F.aggregate(stretches, F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]))


def items_digest(items: Column) -> Column:
    """Lowercase hex SHA-256 of the item ids, sorted as strings and comma-joined (null ids left out)."""
    return F.sha2(F.array_join(F.array_sort(F.transform(F.array_compact(items), lambda i: i.cast("string"))), ","), 256)
