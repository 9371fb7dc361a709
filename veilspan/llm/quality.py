"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from veilspan.llm import gbt
from veilspan.llm.scoring import TRAINING_ROWS, learned_fold, training_matrix, training_rows, with_score

FEATURES = (
    "log_bytes", "log_words", "mean_word", "word_spread", "upper", "digit", "space", "control", "non_ascii", "comma_stop", "odd_marks", "exclaim",
    "byte_entropy", "distinct_words", "top_word", "repeated_neighbour", "log_lines", "distinct_lines", "mean_line_words", "single_marks", "odd_ends", "plain_ends", "upper_words", "title_words",
)

_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "space": (32,), "control": (*range(9), *range(11, 32), 127), "non_ascii": range(128, 256),
    "comma_stop": (44, 46), "odd_marks": (*range(35, 39), 42, 43, *range(60, 63), 64, *range(91, 97), *range(123, 127)), "exclaim": (33, 63),
}
_MASKS = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _MASKS[list(_bytes), _k] = 1
#: The last byte of a word: a letter, a usual mark, or something else.
_END = re.compile(rb"[^\w\s.,;:!?'\")\]\x80-\xff](?=\s|$)")
_PLAIN_END = re.compile(rb"[.,](?=\s|$)")


def statistics(texts: list[str]) -> np.ndarray:
    """Rows of ``FEATURES``; an empty text is all zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for k, text in enumerate(texts):
        raw = text.encode()
        words = raw.split()
        if not words:
            continue
        n, m = len(raw), len(words)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        share = counts / n
        seen = share[share > 0]
        sizes = np.fromiter(map(len, words), np.int64, m)
        by_word = Counter(words)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        upper = sum(map(bytes.isupper, words))
        out[k] = (
            np.log(n), np.log(m), sizes.mean(), sizes.std(), *(share @ _MASKS),
            -(seen * np.log2(seen)).sum(), len(by_word) / m, max(by_word.values()) / m, sum(map(bytes.__eq__, words, words[1:])) / m,
            np.log(len(lines)), len(set(lines)) / len(lines), m / len(lines), int((sizes == 1).sum()) / m, len(_END.findall(raw)) / m, len(_PLAIN_END.findall(raw)) / m, upper / m, sum(map(bytes.istitle, words)) / m,
        )
    return out


@dataclass(frozen=True)
class QualityModel:
    trees: gbt.Trees

    def score(self, texts: list[str]) -> np.ndarray:
        return self.trees.probability(statistics(texts))


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, modulus: int = 4, held_out: int = 2) -> QualityModel:
    """Learns ``labels.quality`` from at most ``limit`` labelled rows outside the held-out fold.

    Only the rows' statistics (24 numbers each) reach the driver.  Without labelled rows every score
    is one half; with one class only, near that class.
    """
    rows = training_rows(docs, labels, "quality", learned_fold(modulus, held_out), limit)
    x, y, _ = training_matrix(rows, statistics)
    return QualityModel(gbt.fit(x, y))


def score_quality(docs: DataFrame, model: QualityModel, column: str = "quality_score", text_col: str = "text") -> DataFrame:
    """``docs`` with the score (0 to 1, higher: better) of every whole text; null text is empty, repeated
    rows and other columns stay as they are."""
    return with_score(docs, model.score, column, text_col)
