"""The corpus pipeline against a brute-force version, stage by stage, on the smallest test tables."""

import os
import re
import zlib
from itertools import combinations

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline as P
from veilspan.llm.common import table
from veilspan.llm.quality import fit_quality, score_quality
from veilspan.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.001"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _without_near_copies(rows):
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", _lower(r.text))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in sets if find(i) == i}


def _clean(rows, items):
    """Rows without eight words in a row of an item of eight words or more."""

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))

    windows = {tuple(w[i : i + 8]) for w in (words(i.text) for i in items) for i in range(len(w) - 7)}
    kept = set()
    for r in rows:
        w = words(r.text)
        if not any(tuple(w[i : i + 8]) in windows for i in range(len(w) - 7)):
            kept.add(r.doc_id)
    return kept


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_are_the_brute_force_ones(spark):
    docs, labels = table(spark, SF, "documents").cache(), table(spark, SF, "labels")

    scores = score_quality(docs.select(P.COLUMNS), fit_quality(docs, labels), "score").collect()
    good = P.keep_quality(spark, docs, SF)
    assert good.columns == P.COLUMNS
    rows = good.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in scores if r.score >= 0.7} and len(rows) > 20
    good = spark.createDataFrame(rows, good.schema)

    scores = score_toxicity(good, fit_toxicity(good, labels), "score").collect()
    civil = P.drop_toxic(spark, good, SF)
    rows = civil.collect()
    assert civil.columns == P.COLUMNS and {r.doc_id for r in rows} == {r.doc_id for r in scores if r.score < 0.5} and len(rows) > 20
    civil = spark.createDataFrame(rows, civil.schema)

    single = P.drop_near_duplicates(spark, civil, SF).collect()
    assert sorted(r.doc_id for r in single) == sorted(_without_near_copies(rows))

    # a passage of one item in one more document, and nearly one in another
    items = table(spark, SF, "benchmark").collect()
    long = max((i.text.split() for i in items), key=len)
    single = spark.createDataFrame([*single, (10**9, "so " + " ".join(long[:30]), "en", "s", 1), (10**9 + 1, " x ".join(" ".join(long[i : i + 5]) for i in range(0, 30, 5)), "en", "s", 1)], civil.schema)
    rows = single.collect()
    clean = P.drop_contaminated(spark, single, SF).collect()
    assert sorted(r.doc_id for r in clean) == sorted(_clean(rows, items)) and {10**9, 10**9 + 1} & {r.doc_id for r in clean} == {10**9 + 1}

    pieces = P.pack(spark, spark.createDataFrame(clean, civil.schema), SF).collect()
    tok = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == {r.doc_id for r in clean}
    for r in clean:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        want = [(i, at, len(ids[at : at + 2048]), zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids[at : at + 2048]))) for i, at in enumerate(range(0, len(ids), 2048))]
        assert sorted((p.piece, p.start, p.length, p.ids_crc32) for p in by_doc[r.doc_id]) == want
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_passages_of_one_item_are_dropped(spark, tmp_path):
    item, short = "what is the name of the river that flows through the old town", "yes or no"
    spark.createDataFrame([(1, item), (2, short)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {
        1: f"before {item} after", 2: item.upper(), 3: "x " + " ".join(item.split()[3:11]) + " y",  # whole, whole, one window
        4: " ".join(item.split()[:7]), 5: "clean words of a document", 6: "say yes or no", 7: None, 8: "", 9: "yes or no yes or no yes or no",
    }
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.drop_contaminated(spark, docs, str(tmp_path)).collect()} == {4, 5, 6, 7, 8, 9}


def test_null_and_repeated_ids_leave_one_row_of_each_group(spark):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcdef")
    near = a + " more"
    rows = [
        (1, a), (None, near), (None, b),  # a null-id copy of 1; a unique text with a null id
        (2, c), (3, c), (3, d),  # 3 has a copy of 2 and a text of its own
        (4, e), (4, e), (4, e + " more"),  # rows with the component's id
        (None, f), (None, f), (None, f + " more"),  # null ids alone
        (None, None), (5, ""), (5, " \n"), (None, ""), (5, ""),  # without words: no group
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.drop_near_duplicates(spark, docs, "")
    assert out.columns == P.COLUMNS
    got = [(r.doc_id, r.text) for r in out.collect()]
    wordy = [r for r in got if (r[1] or "").strip()]
    assert {r for r in wordy if r[0] in (1, 2, 3)} == {(1, a), (2, c), (3, d)} and (None, b) in wordy
    assert len(wordy) == 6 and sum(r[0] == 4 for r in wordy) == 1 and sum(r[0] is None and r[1][0] == "f" for r in wordy) == 1
    assert sorted(map(repr, (r for r in got if r not in wordy))) == sorted(map(repr, rows[-5:]))
