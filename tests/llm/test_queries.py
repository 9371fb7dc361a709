"""The registered queries over the smallest test tables, against brute force."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from veilspan.llm import gbt, quality, queries, scoring, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def walked(trees, row):
    """A row down every tree, a node at a time."""
    total = trees.start
    for k in trees.roots.tolist():
        while trees.left[k] != k:
            k = int(trees.left[k]) + int(row[trees.feature[k]] > trees.threshold[k])
        total += trees.value[k]
    return total


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_token_ids(spark, docs):
    tok, at = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_shards(spark, SF).collect()}
    assert len(got) == len(docs)
    for i in sorted(docs):
        ids = [*tok.encode(docs[i], add_special_tokens=False).ids, 0]
        assert got[i] == (at, len(ids), zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids)))
        at += len(ids)


def test_token_counts(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    for r in queries.op3_token_counts(spark, SF).collect():
        n = len(lib.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


@pytest.mark.parametrize(("query", "modulus", "held", "least"), [("op4_quality", 4, 2, 0.7), ("op9_toxicity", 5, 0, 0.5)])
def test_classifiers(spark, docs, query, modulus, held, least):
    rows = queries.QUERIES[query](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (fold(r.doc_id, modulus) == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for fit, column, modulus, held in ((quality.fit_quality, "quality", 4, 2), (toxicity.fit_toxicity, "toxic", 5, 0)):
        turned = labels.withColumn(column, F.when(~scoring.learned_fold(modulus, held), 1 - F.col(column)).otherwise(F.col(column)))
        assert turned.exceptAll(labels).count() > 0
        texts = [r.text or "" for r in docs.orderBy("doc_id").limit(50).collect()]
        a, b = fit(docs, labels).score(texts), fit(docs, turned).score(texts)
        assert np.array_equal(a, b)


def test_trees_are_walked_as_by_hand(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(60).collect()] + [""]
    q = quality.fit_quality(docs, labels)
    assert len(q.trees.roots) > 10
    for row, score in zip(quality.statistics(texts), q.score(texts), strict=True):
        assert abs(1 / (1 + math.exp(-walked(q.trees, row))) - score) < 1e-9
    t = toxicity.fit_toxicity(docs, labels)
    knots = list(zip(*(k.tolist() for k in t.knots), strict=True))
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(knots, knots[1:], strict=False))
    for row, score in zip(toxicity.features(texts, t.weights), t.score(texts), strict=True):
        raw = walked(t.trees, row)
        below, above = [k for k in knots if k[0] <= raw], [k for k in knots if k[0] >= raw]
        want = knots[0][1] if not below else knots[-1][1] if not above else below[-1][1] if above[0][0] == below[-1][0] else below[-1][1] + (raw - below[-1][0]) / (above[0][0] - below[-1][0]) * (above[0][1] - below[-1][1])
        assert abs(want - score) < 1e-9


def test_statistics_are_the_plain_ones(docs):
    texts = [*list(docs.values())[:80], "", " \n", "One Two two\n\nONE, 3!"]
    for text, row in zip(texts, quality.statistics(texts), strict=True):
        words, raw, lines = text.split(), text.encode(), [x for x in text.split("\n") if x.strip()]
        got = dict(zip(quality.FEATURES, row, strict=True))
        if not raw.split():
            assert not row.any()
            continue
        words = raw.split()
        counts = Counter(raw)
        want = {
            "log_bytes": math.log(len(raw)), "log_words": math.log(len(words)), "mean_word": sum(map(len, words)) / len(words), "upper": sum(65 <= b <= 90 for b in raw) / len(raw), "space": raw.count(32) / len(raw),
            "byte_entropy": -sum(c / len(raw) * math.log2(c / len(raw)) for c in counts.values()), "distinct_words": len(set(words)) / len(words), "top_word": max(Counter(words).values()) / len(words),
            "repeated_neighbour": sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), "log_lines": math.log(len(lines)), "distinct_lines": len(set(lines)) / len(lines), "single_marks": sum(len(w) == 1 for w in words) / len(words),
        }
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), (text[:40], {k: (got[k], v) for k, v in want.items() if abs(got[k] - v) >= 1e-9})


def test_toxic_features_are_the_plain_ones(docs):
    weights = {"grump": 2.0, "zonk": 1.5}
    texts = [*list(docs.values())[:60], "", "You IDIOT! such a gr4mp, z-o-n-k grump!!", "nothing here", "idiot idiot zonk you"]
    for text, row in zip(texts, toxicity.features(texts, weights), strict=True):
        got = dict(zip(toxicity.FEATURES, row, strict=True))
        words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", text.lower())
        if not words:
            assert not row.any()
            continue
        places = [i for i, w in enumerate(words) if w in toxicity.INSULTS or w in weights]
        want = {
            "log_words": math.log(len(words)), "fixed": sum(w in toxicity.INSULTS for w in words), "learned": sum(w in weights for w in words), "learned_weight": sum(weights.get(w, 0) for w in words),
            "near_second": sum(any(w in toxicity.SECOND_PERSON for w in words[max(0, i - 5) : i + 6]) for i in places), "second": sum(w in toxicity.SECOND_PERSON for w in words) / len(words),
            "capitals": sum("A" <= c <= "Z" for c in text) / len(text), "exclaims": text.count("!") / len(text), "distinct_hits": len({words[i] for i in places}),
        }
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), text[:60]


def test_a_repeated_id_is_one_training_row(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(8, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = scoring.training_rows(docs, labels, "quality", F.lit(True), limit=10)
    x, y, ids = scoring.training_matrix(rows, quality.statistics)
    assert len(x) == 2 and ids.tolist() == [7, 8] and y.tolist() == [1, 0]
    for empty in (labels.where("false"), labels.where("quality = 1")):
        for model in (quality.fit_quality(docs, empty), toxicity.fit_toxicity(docs, empty)):
            assert ((s := model.score(["", "x"])) >= 0).all() and (s <= 1).all()
    assert quality.score_quality(docs.where("false"), quality.QualityModel(gbt.fit(np.zeros((0, 24)), np.zeros(0)))).count() == 0


def test_packing_is_whole(spark, docs):
    tok = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows, bins = queries.op10_packing(spark, SF).collect(), {}
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    total = 0
    for i, text in docs.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part, r = ids[at : at + 2048], pieces.pop((i, k))
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(b"".join(t.to_bytes(4, "little") for t in part)))
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not pieces and -(-total // 2048) <= len(bins) <= -(-total // 2048) + 2
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
