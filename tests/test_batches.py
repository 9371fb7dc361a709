import pytest
from pyspark.sql import functions as F

from veilspan.operators import masking as M
from veilspan.operators import registries as R
from veilspan.streaming import batches as B


def test_a_batch_is_swept_until_nothing_is_left(spark):
    docs = spark.createDataFrame([(1, "СНИЛС 112-233-445 95"), (2, "телефон 112-233-445 95"), (3, None), (4, "карта 4111 1111 1111 1111")], "doc_id long, text string")
    texts, entities = B.mask_batch(docs)
    got = {r.doc_id: r.text for r in texts.collect()}
    assert got[1] == "СНИЛС [SNILS_1]" and got[4] == "карта [BANK_CARD_1]" and got[2] == "телефон [SNILS_1]" and got[3] == ""  # the second isn't found by rule
    assert {r.token for r in entities.collect()} == {"[SNILS_1]", "[BANK_CARD_1]"}
    grows = lambda d: d.select("doc_id", F.xxhash64("text").alias("row"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.uuid().alias("text"), F.lit("X").alias("label"))
    with pytest.raises(B.NotSettled):
        B.mask_batch(docs, grows, sweeps=1)


def test_progress_of_batches(spark, tmp_path):
    p = B.Progress(spark, str(tmp_path / "state"))
    paths = lambda *x: spark.createDataFrame([(i,) for i in x], "path string")
    p.start("b1", paths("a", "b", "c", "c"))
    p.start("b2", paths("z"))
    docs = spark.createDataFrame([(1, 0, "10.0.0.1", "IP_ADDRESS")], "doc_id long, start int, text string, label string")
    p.update("b1", spark.createDataFrame([("a", None, 2), ("b", "broken", 0)], "path string, error string, replacements long"), M.registry(docs))
    p.close("b2")
    again = B.Progress(spark, str(tmp_path / "state"))
    (r,) = again.open_batches().collect()
    assert (r.batch_id, r.files, r.processed, r.failed, r.remaining, r.replacements) == ("b1", 3, 1, 1, 2, 2)
    assert sorted(x.path for x in again.remaining("b1").collect()) == ["b", "c"] and again.entities("b1").first().token == "[IP_ADDRESS_1]"
    again.update("b1", spark.createDataFrame([("b", None, 1)], "path string, error string, replacements long"), M.registry(docs))
    assert [x.path for x in again.remaining("b1").collect()] == ["c"] and again.entities("b1").count() == 1
    again.close("b1", "discarded")
    assert again.open_batches().isEmpty()
    assert [x.folder for x in B.orphaned_runs(paths("/x/.incomplete-1/a", "/x/.incomplete-1/b/c", "/x/done/a")).collect()] == ["/x/.incomplete-1"]


def test_registries(spark):
    e = spark.createDataFrame([("INN", "77", "[INN_1]", "77"), ("PER", "ann", "[PER_1]", "Ann")], "label string, key string, token string, original string")
    text = R.to_json(e).first().registry
    rows = spark.createDataFrame([(text,), ('{"[PER_2]": "Bob", "__meta__": "{}"}',), ('{"PER_2": "Bob"}',), ('{"[PER_2]": {"type": "PER"}}',), ("[]",), (None,)], "registry string")
    assert [r.ok for r in rows.select(R.is_registry(F.col("registry")).alias("ok")).collect()] == [True, True, False, False, False, False]
    back = {(r.token, r.label, r.original) for r in R.entities_of(rows).collect()}
    assert back == {("[INN_1]", "INN", "77"), ("[PER_1]", "PER", "Ann"), ("[PER_2]", None, "Bob")}
    assert R.ambiguous(e).isEmpty() and R.ambiguous(e.unionByName(e.withColumn("token", F.lit("[INN_9]")))).count() == 2
    assert spark.range(1).select(R.token(F.lit("PER"), F.lit(3), "slash", {"PER": "ФИО"}).alias("t")).first().t == "/ФИО_3/"


def test_bindings_and_batches(spark):
    docs = spark.createDataFrame([("r/a/b/x.docx", "h1"), ("r/y.docx", "h2"), ("q/z.docx", "h3")], "path string, sha256 string")
    registries = spark.createDataFrame([("r/registry.json", "g1"), ("s/other.json", "g2")], "path string, sha256 string")
    bound = R.bindings(docs.where("sha256 = 'h2'"), "g2", "run1")
    assert {r.path: r.registry for r in R.bound_registry(docs, bound, registries).collect()} == {"r/a/b/x.docx": "r/registry.json", "r/y.docx": "s/other.json", "q/z.docx": None}
    manifest = spark.createDataFrame([("r/y.docx", "h2"), ("r/a/b/x.docx", "h0"), ("../x", "h"), ("gone", "h"), ("q/z.docx", "h3")], "path string, sha256 string")
    problems = {r.path: r.problem for r in R.batch_problems(manifest, docs, bound, "run1", "g2").collect()}
    assert problems == {"r/a/b/x.docx": "changed", "../x": "path", "gone": "missing", "q/z.docx": "unbound"}
    assert {r.problem for r in R.batch_problems(manifest.where("sha256 = 'h2'"), docs, bound, "run2", "g2").collect()} == {"another run"}


def test_drafts(spark):
    e = spark.createDataFrame([("[PER_1]", "Ann Lee"), ("[INN_1]", "7707083893"), ("[X_1]", "ab")], "token string, original string")
    drafts = spark.createDataFrame([(1, "[PER_1] owes [INN_1]"), (2, "ann LEE owes [INN_9], ab"), (3, None), (4, "[PER_1] №x7707083893y")], "draft_id long, text string")
    got = {r.draft_id: (r.unknown, r.without_tokens, r.leaks) for r in R.draft_problems(drafts, e).collect()}
    assert got == {1: ([], False, []), 2: (["[INN_9]"], False, ["[PER_1]"]), 3: ([], True, []), 4: ([], False, ["[INN_1]"])}


def test_forms_and_vault(spark):
    e = spark.createDataFrame([("[PER_1]", "Иванов", {"DATIVE": "Иванову", "GENITIVE": "Иванова"})], "token string, original string, forms map<string,string>")
    masked = spark.createDataFrame([(1, "иск к [PER_1] от [PER_1]; [PER_1] и [PER_2]"), (1, "Согласно [PER_1]"), (2, None)], "doc_id long, masked string")
    assert {(r.doc_id, r.text) for r in R.restore_forms(masked, e).collect()} == {(1, "иск к Иванову от Иванова; Иванов и [PER_2]"), (1, "Согласно Иванову"), (2, None)}
    key, other = F.lit("0123456789abcdef"), F.lit("0123456789abcdee")
    df = spark.createDataFrame([("f1", "тайна")], "id string, c string").withColumn("s", R.sealed(F.col("id"), F.col("c"), key))
    r = df.select(R.unsealed(F.col("id"), F.col("s"), key).alias("a"), R.unsealed(F.col("id"), F.col("s"), other).alias("b"), R.unsealed(F.lit("f2"), F.col("s"), key).alias("c")).first()
    assert (r.a, r.b, r.c) == ("тайна", None, None)
