"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of lexicon words (a fixed list of insults, and words that the training fold
shows in toxic documents far more often than in others), their hits near the second person, capitals,
punctuation and obfuscation (digits or marks within words, spelt-out words).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import gbt
from veilspan.llm.common import staged
from veilspan.llm.scoring import TRAINING_ROWS, learned_fold, training_matrix, training_rows, with_score

#: General insults of the four languages, as a start for the learned lexicon.
INSULTS = (
    "abschaum arschloch asshole bastard bitch bollocks connard crap cretin cretino damn depp desgraciado disgusting dumb dummkopf escoria estupido estúpido fool freak fuck "
    "garbage hate hated horrible idiot idiota idiote idioten idiots imbécil imbécile inútil jerk kill liar loser losers lügner maldito merde mierda moron morons moronic nasty "
    "ordure pathetic pathétique payaso perdedor pig punk salaud scum scumbag shit shut sot stupid stupide stupidity suck sucks trash trottel ugly vermin verlierer verpiss "
    "wanker widerlich wertlos worthless clown coward despicable filth filthy"
).split()
SECOND_PERSON = frozenset("you your yours you're youre u ur yourself du dich dir dein deine deinen deiner ihr euch tu te ti toi ton ta tes vous votre vos tú tus usted ustedes vosotros".split())
#: Words that the lexicon learns, at most; contexts that must hold one; how much likelier in toxic rows.
LEARNED_WORDS, LEAST_ROWS, LEAST_ODDS = 200, 8, 12.0
NEAR = 5

FEATURES = ("log_words", "fixed", "fixed_density", "learned", "learned_density", "learned_weight", "undone", "near_second", "second", "capitals", "upper_words", "exclaims", "questions", "mark_runs", "other_marks", "digits_inside", "marks_inside", "spelt", "distinct_hits")

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HIDDEN = re.compile(r"(?<!\S)[^\W\d_]+(?:[0-9@$!*+|#._-]+[^\W\d_]+)+|(?<!\S)(?:[0-9@$!|]+[^\W\d_]{2,})")
#: The characters that ``_HIDDEN`` takes within words or before them: it finds nothing without one.
_BREAKS = b"0123456789@$!*+|#._-"
_SPELT = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_RUN = re.compile(r"[!?]{2,}")
_PLAIN = str.maketrans("013457@$!|+", "oieastasiit")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def _normal(word: str) -> str:
    """A hidden word's likely plain form."""
    return _NOT_LETTER.sub("", word.lower().translate(_PLAIN))


def features(texts: list[str], weights: dict[str, float]) -> np.ndarray:
    """Rows of ``FEATURES``; an empty text is all zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    fixed = frozenset(INSULTS)
    for k, text in enumerate(texts):
        lower = text.lower()
        words = _WORD.findall(lower)
        if not words:
            continue
        m, n = len(words), len(text)
        distinct = set(words)
        bad, learned = distinct & fixed, distinct & weights.keys()
        n_fixed = n_learned = near = 0
        weight = 0.0
        if bad or learned:
            either = bad | learned
            places = [i for i, w in enumerate(words) if w in either]
            for i in places:
                n_fixed += words[i] in bad
                n_learned += words[i] in learned
                weight += weights.get(words[i], 0.0)
                near += not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1])
        second = 0
        if not SECOND_PERSON.isdisjoint(distinct):
            second = sum(map(SECOND_PERSON.__contains__, words))
        raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        hidden = _HIDDEN.findall(text) if any(map(raw.__getitem__, _BREAKS)) else []
        undone = sum(1 for h in hidden if (p := _normal(h)) in fixed or p in weights)
        inside_digits = sum(1 for h in hidden if any(map(str.isdigit, h)))
        spelt = _SPELT.findall(text)
        undone += sum(1 for s in spelt if (p := _normal(s)) in fixed or p in weights)
        out[k] = (
            math.log(m), n_fixed, n_fixed / m, n_learned, n_learned / m, weight, undone, near, second / m, raw[65:91].sum() / n,
            sum(map(str.isupper, text.split())) / m, raw[33] / n, raw[63] / n, len(_RUN.findall(text)) / m if raw[33] + raw[63] > 1 else 0, (raw[34:48].sum() + raw[58:63].sum() + raw[91:97].sum()) / n,
            inside_digits / m, (len(hidden) - inside_digits) / m, len(spelt), len(bad | learned),
        )
    return out


def half_of(ids: np.ndarray) -> np.ndarray:
    """Which half of the training rows (0 or 1) each id is in."""
    return np.array([zlib.crc32(int(i).to_bytes(8, "little", signed=True)) & 1 for i in ids], np.int64)


def learn_lexicons(rows: DataFrame, words: int = LEARNED_WORDS) -> list[dict[str, float]]:
    """Words with their log odds, learned from all training rows, from half 0 and from half 1 of them:
    counted in one pass by a partial aggregate; at most ``words`` of each reach the driver.

    What is counted are different contexts (the words on both sides of a word's first place), so
    copies of one document don't make its rare words look like insults.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                w: list[str] = []
                c: list[int] = []
                y: list[int] = []
                halves: list[int] = []
                for t, label, half in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), half_of(part.column(0).to_numpy()).tolist(), strict=True):
                    found = ["", *_WORD.findall(t.lower()), ""]
                    first = {x: i for i, x in zip(range(len(found) - 2, 0, -1), found[-2:0:-1], strict=True)}
                    w += first
                    c += [zlib.crc32(f"{found[i - 1]} {found[i + 1]}".encode()) for i in first.values()]
                    y += [label] * len(first)
                    halves += [half] * len(first)
                yield pa.record_batch({"w": pa.array(w, pa.string()), "c": pa.array(c, pa.int64()), "y": pa.array(y, pa.int32()), "half": pa.array(halves, pa.int32())})

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(half_of(b.column(0).to_numpy()), pa.int32())], ["doc_id", "y", "half"])

    counts = rows.select("doc_id", "y").distinct().mapInArrow(sizes, "doc_id long, y int, half int").groupBy("half").agg(F.count("*").alias("n"), F.sum("y").alias("t")).collect()
    by_half = {r.half: (r.n, r.t) for r in counts}
    sums = [tuple(map(sum, zip((0, 0), *by_half.values(), strict=True))), by_half.get(0, (0, 0)), by_half.get(1, (0, 0))]
    if not 0 < sums[0][1] < sums[0][0]:
        return [{}, {}, {}]
    # the label of a word's context in each half; null where the half has none
    halves = [F.max(F.when(F.col("half") == k, F.col("y"))).alias(f"y{k}") for k in (0, 1)]
    seen = rows.mapInArrow(contexts, "w string, c long, y int, half int").groupBy("w", "c").agg(*halves).withColumn("y", F.greatest("y0", "y1"))
    names = {"y": "", "y0": "0", "y1": "1"}
    counted = seen.groupBy("w").agg(*[x for y, k in names.items() for x in (F.coalesce(F.sum(y), F.lit(0)).alias(f"a{k}"), F.count(y).alias(f"c{k}"))])
    counted = staged(counted.where((F.col("c") >= LEAST_ROWS) & (F.col("a") > 0)), "lexicon")
    out = []
    for k, (n, toxic) in zip(names.values(), sums, strict=True):
        a, c = F.col(f"a{k}"), F.col(f"c{k}")
        odds = F.log((a + 0.5) / (toxic + 1)) - F.log((c - a + 0.5) / (n - toxic + 1))
        top = counted.where((c >= LEAST_ROWS) & (a > 0)).select("w", odds.alias("odds"), a.alias("a")).where(F.col("odds") >= math.log(LEAST_ODDS))
        out.append({r.w: r.odds for r in top.orderBy(F.desc(F.col("odds") * F.sqrt("a")), "w").limit(words).collect()})
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    trees: gbt.Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str]) -> np.ndarray:
        raw = self.trees.raw(features(texts, self.weights))
        return np.clip(np.interp(raw, *self.knots), 0, 1) if len(self.knots[0]) else self.trees.probability(features(texts, self.weights))


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, modulus: int = 5, held_out: int = 0) -> ToxicityModel:
    """Learns ``labels.toxic`` from at most ``limit`` labelled rows outside the held-out fold.

    Lexicon and trees learn from all these rows.  The calibration learns from scores of rows that
    neither a lexicon nor trees have seen: each half of the rows is scored by the lexicon and trees of
    the other.  Without labelled rows every score is one half; of fewer than 40 there's no calibration.
    """
    rows = training_rows(docs, labels, "toxic", learned_fold(modulus, held_out), limit)
    lexicons = learn_lexicons(rows)
    x, y, ids = training_matrix(rows, lambda texts: np.hstack([features(texts, w) for w in lexicons]))
    every, *by_half = np.split(x, 3, axis=1) if len(y) else [x] * 3
    trees = gbt.fit(every, y)
    unseen, half = np.zeros(len(y)), half_of(ids)
    if len(y) >= 40 and 0 < half.sum() < len(y):
        for k in (0, 1):
            learned = by_half[k]
            unseen[half != k] = gbt.fit(learned[half == k], y[half == k]).raw(learned[half != k])
        return ToxicityModel(lexicons[0], trees, gbt.isotonic(unseen, y))
    return ToxicityModel(lexicons[0], trees, (np.zeros(0), np.zeros(0)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "toxicity_score", text_col: str = "text") -> DataFrame:
    """``docs`` with the score (0 to 1, higher: more toxic) of every whole text; null text is empty, repeated
    rows and other columns stay as they are."""
    return with_score(docs, model.score, column, text_col)
