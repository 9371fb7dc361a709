"""Best-fit packing of token pieces into sequences by bin completion.

Documents longer than a sequence are cut; full pieces are sequences by themselves.  The others are
dealt into groups of bounded size by a hash, and each group is packed on its own: the largest piece
left opens a bin, and the fillings around it that no other dominates (no piece of a filling can be
changed for a larger one that still fits) are searched by branch and bound.  Best-fit solutions are
the incumbents: the best-fit-decreasing filling of each bin, and the best-fit-decreasing packing of
the whole group.  A branch ends where the waste so far is beyond what the incumbent leaves.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.chunked_encoding import encoder
from veilspan.llm.common import staged

CAPACITY = 2048
#: Pieces of a group on average, nodes of the search for one bin's filling, and bins opened anew by
#: backtracking in a group.
GROUP, FILL_NODES, BACKTRACKS = 4096, 400, 64


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs: by the sum, and by pieces over half that exclude each other."""
    half = sum(1 for x in lengths if 2 * x > capacity)
    return max(-(-sum(lengths) // capacity), half)


class _Pool:
    """Lengths left, as counts and as a bit set for finding the largest that fits, and which sums the
    lengths up to one can reach (of all lengths at the start: a bound for any later pool)."""

    def __init__(self, lengths: list[int], capacity: int):
        self.count: dict[int, int] = {}
        self.bits = 0
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
            self.bits |= 1 << x
        mask, sums = (2 << capacity) - 1, 1
        self.sums: dict[int, int] = {}
        for x in sorted(self.count):
            for _ in range(min(self.count[x], capacity // x)):
                more = (sums | sums << x) & mask
                if more == sums:
                    break
                sums = more
            self.sums[x] = sums

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            self.bits &= ~(1 << x)

    def give(self, x: int) -> None:
        self.count[x] = self.count.get(x, 0) + 1
        self.bits |= 1 << x

    def largest(self, limit: int) -> int:
        """The largest length up to ``limit``; 0 if there is none."""
        return max(0, (self.bits & ((2 << limit) - 1)).bit_length() - 1)

    def least_waste(self, left: int, longest: int) -> int:
        """What lengths up to ``longest`` (one of the lengths) leave of ``left`` at least."""
        return left + 1 - (self.sums[longest] & ((2 << left) - 1)).bit_length()


def dominated(pool: _Pool, left: int, chosen: list[int]) -> bool:
    """Whether a piece that the filling leaves out fits, or could take the place of one smaller piece of
    it, or of two that are no larger together: then that filling does as well with less left for others."""
    if pool.largest(left):
        return True
    for i, y in enumerate(chosen):
        if pool.largest(y + left) > y:
            return True
        for z in chosen[i + 1 :]:
            if pool.largest(y + z + left) >= y + z:
                return True
    return False


def fillings(pool: _Pool, room: int, keep: int = 3, nodes: int = FILL_NODES, whole: bool = True) -> list[tuple[int, list[int]]]:
    """Up to ``keep`` undominated fillings of ``room`` as (waste, lengths), least waste first.

    Depth-first over lengths in descending order; the best-fit filling comes first (no other dominates
    it) and is the incumbent.  A branch ends where the sums that its lengths can reach leave no less
    than the worst kept; the search ends at a filling without waste, when all are tried, or after
    ``nodes`` lengths tried; if not ``whole``, also where a next length over half of the room would leave
    more than the ``keep`` best fillings come by, though smaller ones might fill it (smaller lengths are left for later bins).
    """
    found: list[tuple[int, list[int]]] = []
    #: Least wastes of all fillings come by, dominated ones too.
    wastes: list[int] = []
    budget = [nodes]

    def search(left: int, limit: int, chosen: list[int]) -> bool:
        x = pool.largest(min(left, limit))
        if not x:
            entry = (left, chosen.copy())
            wastes[:] = sorted([*wastes, left])[:keep]
            if entry not in found and not dominated(pool, left, chosen):
                found.append(entry)
                found.sort(key=lambda f: (f[0], len(f[1])))
                del found[keep:]
                return left == 0
            return False
        while x:
            if whole and len(found) == keep and pool.least_waste(left, x) >= found[-1][0]:
                return False
            budget[0] -= 1
            if budget[0] < 0 and found:
                return True
            pool.take(x)
            chosen.append(x)
            done = search(left - x, x, chosen)
            chosen.pop()
            pool.give(x)
            if done:
                return True
            nxt = pool.largest(x - 1)
            if not nxt or (not whole and len(wastes) == keep and nxt * (left // nxt) < left - wastes[-1] and left // nxt < 2):
                return False
            x = nxt
        return False

    search(room, room, [])
    return found


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The incumbent of a whole group."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    bits = 0
    for x in sorted(lengths, reverse=True):
        fits = bits >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                bits &= ~(1 << room)
            bins[k].append(x)
        else:
            room, k = capacity, len(bins)
            bins.append([x])
        room -= x
        by_room.setdefault(room, []).append(k)
        bits |= 1 << room
    return bins


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of lengths (0 < length <= capacity), as few as the bounded searches find: with fillings that
    leave small lengths for later, then with whole fillings."""
    if not lengths:
        return []
    incumbent = best_fit_decreasing(lengths, capacity)
    least = lower_bound(lengths, capacity)
    for whole in (False, True):
        if len(incumbent) > least:
            incumbent = _completed(lengths, capacity, incumbent, least, whole)
    return incumbent


def _completed(lengths: list[int], capacity: int, incumbent: list[list[int]], least: int, whole: bool) -> list[list[int]]:
    """The incumbent or a packing of fewer bins, by bin completion."""
    pool, total, n = _Pool(lengths, capacity), sum(lengths), len(lengths)
    bins: list[list[int]] = []
    #: Fillings not yet tried of each open bin, with the waste before it.
    others: list[list[tuple[int, list[int]]]] = []
    waste = [0]
    left, backtracks = n, BACKTRACKS
    while True:
        allowed = (len(incumbent) - 1) * capacity - total  # waste of a packing with one bin less
        if left == 0:
            incumbent = bins.copy()
            if len(incumbent) == least:
                return incumbent
        elif waste[-1] <= allowed:
            x = pool.largest(capacity)
            pool.take(x)
            options = fillings(pool, capacity - x, whole=whole)
            chosen = options.pop(0)
            for y in chosen[1]:
                pool.take(y)
            bins.append([x, *chosen[1]])
            left -= 1 + len(chosen[1])
            others.append(options)
            waste.append(waste[-1] + chosen[0])
            continue
        # a full packing, or too much waste: back to the last bin with a filling that may do
        while bins:
            backtracks -= 1
            options = others[-1]
            for y in bins[-1][1:]:
                pool.give(y)
            left += len(bins[-1]) - 1
            waste.pop()
            nxt = options.pop(0) if options and backtracks > 0 else None
            if nxt and waste[-1] + nxt[0] <= (len(incumbent) - 1) * capacity - total:
                bins[-1] = [bins[-1][0], *nxt[1]]
                for y in nxt[1]:
                    pool.take(y)
                left -= len(nxt[1])
                waste.append(waste[-1] + nxt[0])
                break
            left += 1
            pool.give(bins.pop()[0])
            others.pop()
        if not bins or backtracks <= 0:
            return incumbent


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary) of every piece of every row.

    Null text is empty: one piece with the end id.  Repeated rows give their pieces again.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(tokenizer), struct.pack("<I", end_id), 4 * capacity
        for b in batches:
            out: list[tuple] = []
            held = 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                held += len(ids)
                if held > 8 << 20:
                    yield _pieces(out)
                    out, held = [], 0
            if out:
                yield _pieces(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    A full piece's sequence is numbered by a count within its partition; the others' by group and
    bin.  The number of groups follows the number of pieces, so a task's share doesn't grow.  A
    group's pieces come from a hash of all their columns and a row number, so no document, length or
    repeated row fills a group.  An empty table gives no row.
    """
    short = pieces.where(F.col("length") < capacity)
    n = short.count()
    groups = max(1, n // group)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") >= capacity).select(*names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if n == 0:
        return full

    def packed(key: tuple, t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_pylist()
        rows: dict[int, list[int]] = {}
        for i, x in enumerate(lengths):
            rows.setdefault(x, []).append(i)
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        first = -(key[0].as_py() << 32) - 1  # below zero: full pieces count up from 0
        for k, bin_ in enumerate(pack(lengths, capacity)):
            at = 0
            for x in bin_:
                i = rows[x].pop()
                sequence[i], offset[i] = first - k, at
                at += x
        return t.select(names).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = short.withColumn("g", F.pmod(F.xxhash64(*[F.col(c) for c in names], F.monotonically_increasing_id()), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return full.unionByName(dealt.groupBy("g").applyInArrow(packed, schema))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where every piece of every document goes: the pieces' columns, sequence_id and offset.

    The pieces' places are staged before packing, so no text is encoded twice.
    """
    pieces = staged(cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids=False).drop("ids"), "pieces")
    return assign_sequences(pieces, capacity)
