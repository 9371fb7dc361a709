"""Token counts of a SentencePiece BPE vocabulary by rank-synchronous merging of numpy arrays.

Texts are cut where no piece of the vocabulary can reach across (before a space mark that follows
another character, around line feeds); every distinct pre-token is counted once per worker.  The
pre-tokens that a batch meets for the first time are held together as one ragged array of symbol
ids.  In each round every sequence finds the lowest rank among its adjacent pairs (leftmost on
equal ranks) and all sequences apply theirs at once; sequences without a pair leave.  What survives
are the tokens; a symbol outside the vocabulary counts its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Pre-tokens kept by a worker; the longest kept, in characters; above SEGMENT, a pre-token is cut
#: between characters that no piece holds side by side, and what is still longer is merged by a heap.
CACHE_ENTRIES, CACHE_CHARS, SEGMENT = 500_000, 64, 256

_RUNS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class PieceCounter:
    def __init__(self, model: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = library.get_piece_size()
        pieces = {library.id_to_piece(i): library.get_score(i) for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))}
        ranks = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self._supported(library, pieces)
        #: Symbols: pieces first, then characters that occur in pieces only together with others.
        self.symbol = {p: k for k, p in enumerate(pieces)}
        self.n_pieces = len(pieces)
        for p in pieces:
            for c in p:
                self.symbol.setdefault(c, len(self.symbol))
        self.other = len(self.symbol)
        self.base = self.other + 1
        merges = [(self.symbol[p[:k]] * self.base + self.symbol[p[k:]], ranks[s], self.symbol[p]) for p, s in pieces.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        merges.sort()
        keys, rank, merged = zip(*merges, strict=True)
        self.keys, self.rank, self.merged = np.array(keys, np.int64), np.array(rank, np.int64), np.array(merged, np.int64)
        self.pairs = {k: (r, m) for k, r, m in merges}
        self.beside = {a + b for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self.bytes_of = np.array([1 if k < self.n_pieces else len(s.encode()) for s, k in self.symbol.items()] + [0], np.int64)
        self.counts: dict[str, int] = {}

    @staticmethod
    def _supported(library, pieces: dict[str, float]) -> None:
        """The cuts hold for a model without rewriting rules whose pieces don't reach across them."""
        probe = "x  y\tz"
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces) or library.normalize(probe) not in (probe.replace(" ", MARK), MARK + probe.replace(" ", MARK)):
            raise ValueError("a model with normalization, or with pieces that reach across words, isn't supported")
        if not library.normalize(probe).startswith(MARK):
            raise ValueError("a model without the leading space mark isn't supported")

    # --- counting pre-tokens

    def _merge_together(self, words: list[str]) -> np.ndarray:
        get, other = self.symbol.get, self.other
        flat = "".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = np.fromiter((get(c, other) for c in flat), np.int64, len(flat))
        total = np.zeros(len(words), np.int64)
        # what the vocabulary lacks never merges: its bytes count at once
        seq = np.repeat(np.arange(len(words)), sizes)
        lost = np.flatnonzero(sym == other)
        np.add.at(total, seq[lost], np.fromiter((len(flat[i].encode()) for i in lost), np.int64, len(lost)))
        while len(sym):
            key = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            pair = np.flatnonzero((self.keys[at] == key) & (seq[:-1] == seq[1:]))
            # the lowest (rank, place) of each sequence
            order = self.rank[at[pair]] * len(sym) + pair
            heads = np.flatnonzero(np.diff(seq[pair], prepend=-1))
            best = np.minimum.reduceat(order, heads) % len(sym) if len(heads) else heads
            going = np.zeros(len(words), bool)
            going[seq[best]] = True
            stay = going[seq]
            np.add.at(total, seq[~stay], self.bytes_of[sym[~stay]])
            sym[best] = self.merged[at[best]]
            stay[best + 1] = False
            sym, seq = sym[stay], seq[stay]
        return total

    def _merge_long(self, text: str) -> int:
        """The same merging order for one long sequence, by a heap of (rank, place)."""
        sym = [self.symbol.get(c, self.other) for c in text]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, base = self.pairs, self.base
        heap = [(*pairs[k], i, sym[i], sym[i + 1]) for i in range(n - 1) if (k := sym[i] * base + sym[i + 1]) in pairs]
        heap = [(r, i, m, a, b) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = m, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (k := sym[x] * base + sym[y]) in pairs:
                    heapq.heappush(heap, (pairs[k][0], x, pairs[k][1], sym[x], sym[y]))
        return sum(len(text[i].encode()) if s == self.other else int(self.bytes_of[s]) for i, s in enumerate(sym) if s >= 0)

    def _segments(self, word: str) -> list[str]:
        beside, out, start = self.beside, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in beside:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def count_words(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token (with its space marks)."""
        short = [w for w in words if len(w) <= SEGMENT]
        found = dict(zip(short, self._merge_together(short).tolist(), strict=True)) if short else {}
        for w in words:
            if w not in found:
                parts = self._segments(w)
                short = [p for p in parts if len(p) <= SEGMENT]
                found[w] = int(self._merge_together(short).sum()) + sum(self._merge_long(p) for p in parts if len(p) > SEGMENT)
        return [found[w] for w in words]

    # --- counting texts

    def _pretokens(self, text: str) -> list[str]:
        """Keys of the text's pre-tokens: a word stands for the space mark and itself; a key that
        starts with a line feed or a mark (``\\n``, mark) stands for what follows its first character."""
        if "  " in text or MARK in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " ":
            return [w[1:] if w[0] == MARK and w[1:2] not in ("", MARK, "\n") else "\n" + w for w in _RUNS.findall(MARK + text.replace(" ", MARK))]
        if "\n" in text:
            return [y for x in text.split(" ") for y in ([x] if "\n" not in x else self._lines(x))]
        return text.split(" ")

    @staticmethod
    def _lines(chunk: str) -> list[str]:
        first, *rest = chunk.split("\n")
        out = [first] if first else ["\n" + MARK]
        for x in rest:
            out += ("\n\n", "\n" + x) if x else ("\n\n",)
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text, as the library gives them."""
        counts = self.counts
        if len(counts) > CACHE_ENTRIES:
            counts.clear()
        split = [self._pretokens(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in counts})
        long = {}
        if new:
            sizes = self.count_words([w[1:] if w[:1] == "\n" else MARK + w for w in new])
            for w, n in zip(new, sizes, strict=True):
                (counts if len(w) <= CACHE_CHARS else long)[w] = n
        if long:
            return [sum([counts[w] if w in counts else long[w] for w in words]) for words in split]
        return [sum(map(counts.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def piece_counter(model: str) -> PieceCounter:
    """One per Python worker and model."""
    return PieceCounter(model)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    A narrow transformation: no shuffle, one batch of texts in memory.  Null and empty texts have no
    bytes or tokens; null and repeated ids stay as they are; other columns are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = 256
                b = batch.slice(at, n)
                at += n
                texts = [t or "" for t in b.column(1).to_pylist()]
                tokens = counter.count(texts)
                yield pa.record_batch(
                    [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
