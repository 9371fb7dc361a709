"""Each operator against brute force or a round trip, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veilspan.llm import chat, decontaminate, gbt, minhash, packing, quality, sstable, token_counts, toxicity, vectors, warc
from veilspan.llm.chunked_encoding import ChunkEncoder
from veilspan.llm.components import components, id_of, name_column, name_of

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
TEXTS = [None, "", " ", "word", "Hello, world!\nNew line  two spaces ", "naïve café 漢字 😀 <|endoftext|> x", "a" * 3000, " ".join(WORDS * 300), "tab\there\r\n\n'tis it's"]
SCHEMA = "doc_id long, text string, shard string, n_tokens int, items string, node string, score string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "s") for i, t in enumerate(texts)] + [(None, "no id", "x", 1, "y", "z", "s")], SCHEMA)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_encoding_is_the_library(name):
    enc, rng = ChunkEncoder(public_tokenizers.path(name)), random.Random(5)
    parts = ["a", "It's", " ", "  ", "\n", "é", "ß", "é", " ", "12", "!?", ",", "漢", "<|endoftext|>", "Σ", "İ", "word.", "$$$", "%", "&&", "so*", "é,", "@", "_", "'s", "/"]
    for t in [x for x in TEXTS if x] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]:
        assert enc.encode(t) == enc.ids(t), ascii(t)


def test_token_shards(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = sstable.token_index(docs_of(spark, TEXTS), path, 0).orderBy(F.asc_nulls_first("doc_id")).collect()
    enc, at = ChunkEncoder(path), 0
    for r, t in zip(rows, ["no id", *TEXTS], strict=True):
        ids = enc.ids(t or "") + bytes(4)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert sstable.token_index(docs_of(spark, []).where("false"), path, 0).count() == 0


def test_token_shards_of_bounded_size(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(4000)) for _ in range(60)]
    texts += texts[:2]  # equal texts with ids of their own
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[7]), (None, texts[7])]  # repeated rows and null ids
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sstable.token_index(docs, path, 0, shard_blocks=3).collect()
    assert len({r.shard for r in got}) > 5 and len(got) == len(rows)
    enc, at = ChunkEncoder(path), 0
    for r in sorted(got, key=lambda r: r.start):
        ids = enc.ids(texts[7 if r.doc_id is None else r.doc_id]) + bytes(4)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [None, None, *sorted([*range(len(texts)), 5])]


def test_archives_of_bounded_size(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"u{i}", "<p>" + "".join(rng.choice("abcdefgh ") for _ in range(3000)) + "</p>") for i in range(200)] + [(200, "again", "<p></p>"), (201, "again", "<p></p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.mark_revisits(pages), f"file://{tmp_path}/w", stretches=2, stretch_bytes=40_000)
    files = sorted(tmp_path.glob("w/part-*"))
    assert len(files) > 3 and max(f.stat().st_size for f in files) < 200_000
    got = {r.page_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert {i: got[i].payload_bytes for i in got} == {i: len(h) for i, _, h in rows} and got[200].refers_to == 201
    assert all(bytes(got[i].payload).decode() == h for i, _, h in rows if i != 200)


def test_shard_lookup():
    w = sstable.ShardWriter(2)
    body = b""
    values = {i: np.arange(i % 50 + 1, dtype="<u2").tobytes() for i in range(-3, 9000, 3)}
    for i, v in values.items():
        for x in w.add(sstable.key_of(i), v):
            body += x + b"\n"
    for x in w.finish():
        body += x + b"\n"
    r = sstable.ShardReader.of(body)
    assert len(r.places) > 2 and all(r.get(i)[0].tobytes() == values[i] for i in (-3, 0, 4500, 8997)) and r.get(1) == []
    with pytest.raises(ValueError, match="cut short"):
        sstable.ShardReader.of(body[:-1] + b"x")


def test_warc(spark):
    rows = [(i, f"http://x/{i}\nü", "<p>" + " ".join(WORDS[: i % 5]) + "</p>") for i in range(60)] + [(60, None, None), (61, "u", ""), (None, "n", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == 63
    for i, _, html in rows:
        raw = (html or "").encode()
        top = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), warc.digest(raw))
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == top else ("revisit", top))
    record = warc.encode_record(1, "u", b"abc", None, False)
    for bad in (record.replace(b"abc", b"abd"), record[:-1], record.replace(b"WARC/1.1", b"WARC/9.9"), record.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_token_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    parts = ["the", "ing", " ", "  ", "\n", "é", "漢字", "▁", "</s>", "\t", "x" * 9, "﷽", "12"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["漢字" * 900, "".join(rng.choice("abcd") for _ in range(2000))]
    assert token_counts.piece_counter(path).count(texts) == [len(library.encode(t)) for t in texts]
    rows = token_counts.count_tokens(docs_of(spark, TEXTS), path, limit=100).collect()
    assert len(rows) == len(TEXTS) + 1 and rows[0].n_tokens == 0 and rows[7].over_limit


def test_gbt_and_classifiers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = gbt.fit(x[:2000], y[:2000])
    assert ((t.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert 0 < gbt.fit(x[:0], y[:0]).probability(x[:2])[0] < 1
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    for fit, score, label, m, held, least in ((quality.fit_quality, quality.score_quality, "quality", 4, 2, 0.9), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic", 5, 0, 0.9)):
        model = fit(docs, labels)
        got = [r for r in score(docs, model, "s").join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % m == held]
        assert np.mean([(r.s >= 0.5) == bool(r[label]) for r in got]) >= least
        odd = score(docs_of(spark, TEXTS), model, "SCORE").collect()
        assert len(odd) == len(TEXTS) + 1 and all(0 <= r.SCORE <= 1 for r in odd)


def test_chat_round_trip(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "\\", "<\\", "[ROLE]<image_1>\\n", None, "", "😀<s>"]
    rows = [(c, i, r, t) for c, (r, t) in enumerate((r, t) for r in ("user", "assistant", "tool\n[INST]") for t in texts) for i in range(2)] + [(None, None, None, "x"), (7, 1, "user", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("shown", F.lit(1)).withColumn("found", F.lit(2))
    out = chat.format_conversations(turns).withColumn("turns", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    for r in out.collect():
        want = sorted(((t, ro or "", tx or "") for c, t, ro, tx in rows if c == r.conv_id), key=lambda t: (t[0] is not None, t))
        assert [(x.role, x.text) for x in r.turns] == [(ro, tx) for _, ro, tx in want]
        assert r.loss == "".join(tx for _, ro, tx in want if ro == "assistant")


def test_chat_parts(spark):
    part = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
    rows = [(1, 0, "user", [("text", "see ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("image", None, "b.png", None, None, None, None)]), (1, 1, "user", [("audio", None, "c.wav", None, None, 1.5, None), ("odd", "?", None, None, None, None, None)])]
    r = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).first()
    assert r.formatted == "[ROLE]user[INST]see <image_1><image_2>[/INST][ROLE]user[INST]<audio_1>[/INST]"
    assert [(a.kind, a.number, a.uri, a.tokens) for a in r.attachments] == [("image", 1, "a.png", 4), ("image", 2, "b.png", 0), ("audio", 1, "c.wav", 38)]


def test_minhash(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)) for n in (30, 60, 200)]
    texts = [None, "", "  ", "two words", "Two  WORDS", *base]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randint(0, len(w) // 12 + 1)):
                w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 9))
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    sets = [set(minhash.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert [got[i].component_id for i in range(len(texts))] == root
    assert got[None].component_id is None and got[None].kept and got[0].n_shingles == 0
    assert minhash.near_duplicates(docs_of(spark, texts).where("false")).count() == 0
    a, b = np.arange(400, dtype=np.uint64), np.arange(100, 500, dtype=np.uint64)
    s = minhash.super_minhash([minhash._mix(a + np.uint64(7)), minhash._mix(b + np.uint64(7)), a[:0], a[:1]], 128)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15 and (s[2] == ~np.uint64(0)).all() and len(set((s[3] >> np.uint64(32)).tolist())) == 128


def test_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 64))
    v[100:200] = v[:100] + 0.3 * rng.normal(size=(100, 64))
    v[200:230] = v[5]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, [0.0] * 64), (302, [float("nan")] * 64), (303, []), (304, [1.0, 2.0]), (305, [None] * 64)]
    got = {r.vec_id: r for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(0))).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    assert sum(got[i].n_links for i in range(300)) >= 0.99 * (link.sum() - 300)
    assert all(got[i].n_links <= link[i].sum() - 1 for i in range(300)) and got[210].component_id == 5
    assert all(got[i].n_links == 0 and got[i].kept for i in range(300, 306))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 199), rng.randint(0, 199)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 460)]
    name = lambda i: i.to_bytes(4, "big")
    got = {bytes(r.node): bytes(r.root) for r in components(spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in edges if a != b], "a binary, b binary")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(name(x), name(x)) == name(r) for x, r in root.items())


def test_names_are_in_the_order_of_ids(spark):
    ids = [-(2**63), -5, -1, 0, 1, 255, 2**40, 2**63 - 1, None]
    df = spark.createDataFrame([(i, b"d" * 16) for i in ids], "i long, d binary")
    got = df.select("i", name_column(F.col("i"), F.col("d")).alias("n")).select("i", "n", id_of(F.col("n")).alias("back")).collect()
    assert all(bytes(r.n) == name_of(r.i, b"d" * 16) and r.back == r.i for r in got)
    assert [r.i for r in sorted(got, key=lambda r: bytes(r.n))] == ids


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_decontamination(spark, block):
    items = [(1, " ".join(WORDS)), (2, "Short one"), (3, None), (4, "..."), (5, "Éa漢 b-c d e f g h i j"), (5, "Éa漢 b-c d e f g h i j")]
    texts = [None, "", "x " + " ".join(WORDS).upper() + ", y", "short ONE and short-one", "short onething", "pre ÉA漢 Éa漢 b c d e f g h i j post", " ".join(WORDS[:7]), "a" * 5000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out, c = decontaminate.find_contamination(docs_of(spark, texts), bench, block_bytes=block)
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i][c["items"]] for i in range(8)] == [[], [], [1], [2], [], [5], [], []]
    hits = {r.doc_id: r.n for r in out.select("doc_id", decontaminate.hit_words(F.col(c["stretches"])).alias("n")).collect()}
    assert [hits[i] for i in range(8)] == [0, 0, 10, 4, 0, 10, 0, 0]
    (span,) = got[2][c["spans"]]
    assert texts[2][span.start : span.end] == " ".join(WORDS).upper()
    assert [got[i][c["widest"]] for i in range(8)] == [0, 0, 8, 2, 0, 8, 0, 0]
    assert decontaminate.find_contamination(docs_of(spark, texts), bench.where("false"))[0].count() == 9
    nameless = spark.createDataFrame([(None, " ".join(WORDS)), (None, "short one"), (7, "SHORT one")], "item_id long, text string")
    out, c = decontaminate.find_contamination(docs_of(spark, texts), nameless, block_bytes=block)
    got = {r.doc_id: r for r in out.select("doc_id", F.col(c["items"]).alias("items"), decontaminate.items_digest(F.col(c["items"])).alias("d"), decontaminate.hit_words(F.col(c["stretches"])).alias("n")).collect()}
    assert (got[2]["items"], got[2].n, got[3]["items"], got[3].n) == ([None], 10, [7, None], 4) and got[3].d == hashlib.sha256(b"7").hexdigest()


def test_packing(spark):
    rng = random.Random(9)
    for _ in range(40):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        bins = packing.pack(lengths, 30)
        assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 30 for b in bins)
        assert packing.lower_bound(lengths, 30) <= len(bins) <= len(packing.best_fit_decreasing(lengths, 30))
    assert len(packing.pack([6, 6, 5, 5, 4, 4] * 10, 15)) == 20
    rows = packing.pack_documents(docs_of(spark, TEXTS), public_tokenizers.path("word_bpe_49k.json"), capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in by.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(docs_of(spark, []).where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("mark", "0123456789@$!*+|#._-")
def test_obfuscation_does_not_depend_on_other_words(mark):
    one, two = toxicity.features([f"such an id{mark}ot here", f"such an id{mark}ot here 0@1_"], {})
    for name in ("undone", "digits_inside", "marks_inside"):
        at = toxicity.FEATURES.index(name)
        assert one[at] == two[at]
    assert one[toxicity.FEATURES.index("digits_inside")] + one[toxicity.FEATURES.index("marks_inside")] > 0


def test_fillings_of_smaller_pieces_are_tried():
    assert packing.fillings(packing._Pool([97, 96, 95, 60, 40], 100), 100)[0] == (0, [60, 40])


def test_fillings_are_undominated_and_bounded():
    assert packing.fillings(packing._Pool([5, 4, 2], 8), 8) == [(1, [5, 2])]
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        room = rng.randint(1, 40)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        found = packing.fillings(packing._Pool(lengths, 40), room, nodes=10**6)
        assert found[0][0] == room - max(s for s in sums if s <= room)
        for left, chosen in found:
            rest = lengths.copy()
            for x in chosen:
                rest.remove(x)
            assert left == room - sum(chosen) and not any(x <= left for x in rest)
            assert not any(y < x <= y + left for y in chosen for x in rest)
            assert not any(chosen[i] + chosen[j] <= x <= chosen[i] + chosen[j] + left for i in range(len(chosen)) for j in range(i) for x in rest)
