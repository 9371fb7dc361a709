"""Registries as JSON: their form, tokens, bindings to documents, and the checks of what was restored or
drafted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.functions.text import PLACEHOLDER, is_placeholder
from veilspan.operators.masking import entity_key

SCHEMA = "veilspan-registry-v1"
# Fixed value: keys beside the tokens of a registry without an envelope.
META = ("__meta__", "__binding__", "schema", "run_id", "documents")
#: Left and right of a token in each style.
BRACKETS = {"square": ("[", "]"), "slash": ("/", "/")}


def token(label: Column, number: Column, style: str = "square", names: dict[str, str] | None = None) -> Column:
    """A placeholder; ``names`` gives labels a name of their own (several labels may share one)."""
    left, right = BRACKETS[style]
    base = label if not names else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), label), label)
    return F.concat(F.lit(left), base, F.lit("_"), number.cast("string"), F.lit(right))


def to_json(entities: DataFrame) -> DataFrame:
    """``registry``: one JSON document of all entities (label, key, token, original), by token, in an envelope.
    The registry of one batch of documents is one file by its nature; larger ones stay tables."""
    record = F.struct(F.col("label").alias("type"), "original", F.col("key").alias("normalized"))
    mapping = F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", record.alias("record")))))
    return entities.agg(F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), mapping.alias("mapping"))).alias("registry"))


def entries(registry: Column) -> Column:
    """token -> record (JSON, or a plain original) of a registry with or without an envelope; null if it's no
    JSON object."""
    whole = F.from_json(registry, "map<string,string>")
    inner = F.when(F.try_element_at(whole, F.lit("schema")) == SCHEMA, F.from_json(F.get_json_object(registry, "$.mapping"), "map<string,string>"))
    return F.coalesce(inner, F.map_filter(whole, lambda k, v: ~k.isin(*META)))


def original_of(record: Column) -> Column:
    """The original of a record, or the plain string itself; null for an object without one."""
    return F.when(record.startswith("{"), F.get_json_object(record, "$.original")).otherwise(record)


def is_registry(registry: Column) -> Column:
    """Whether it's a JSON object whose keys are all tokens and whose records all have an original."""
    e = entries(registry)
    return F.coalesce(F.forall(F.map_keys(e), is_placeholder) & F.forall(F.map_values(e), lambda v: original_of(v).isNotNull()), F.lit(False))


def entities_of(registries: DataFrame, column: str = "registry") -> DataFrame:
    """token, label, key and original of every record of registries (others than valid ones give none); a plain
    string has no label."""
    rows = registries.where(is_registry(F.col(column))).select(F.explode(entries(F.col(column))).alias("token", "record"))
    label, original = F.when(F.col("record").startswith("{"), F.get_json_object("record", "$.type")), original_of(F.col("record"))
    key = F.coalesce(F.when(F.col("record").startswith("{"), F.get_json_object("record", "$.normalized")), entity_key(F.coalesce(label, F.lit("")), original))
    return rows.select("token", label.alias("label"), key.alias("key"), original.alias("original"))


def ambiguous(entities: DataFrame) -> DataFrame:
    """label, key and tokens of entities that have more than one token: such a registry isn't gone on with."""
    return entities.groupBy("label", "key").agg(F.array_sort(F.collect_set("token")).alias("tokens")).where(F.size("tokens") > 1)


def bindings(outputs: DataFrame, registry_sha256: str, run_id: str) -> DataFrame:
    """Binds each output (path, sha256) to the registry and run it came from."""
    return outputs.select("path", F.col("sha256").alias("output_sha256"), F.lit(registry_sha256).alias("registry_sha256"), F.lit(run_id).alias("run_id"))


def bound_registry(documents: DataFrame, bound: DataFrame, registries: DataFrame, most_levels: int = 4) -> DataFrame:
    """document path and registry path of every document (path, sha256): the registry (path, sha256) that its
    hash is bound to, else the nearest one in its folder or up to ``most_levels`` folders above.  Documents
    without either have a null registry; of several in one folder the first by name counts.
    """
    exact = documents.join(bound.select(F.col("output_sha256").alias("sha256"), "registry_sha256"), "sha256")
    exact = exact.join(registries.select(F.col("sha256").alias("registry_sha256"), F.col("path").alias("registry")), "registry_sha256").groupBy("path").agg(F.min("registry").alias("bound"))
    parts = F.split("path", "/")
    levels = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(most_levels + 1)) - 1), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1 - i), "/").alias("folder")))
    above = documents.where(F.size(parts) > 1).select("path", F.explode(levels).alias("l")).select("path", "l.level", "l.folder")
    places = registries.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.min("path").alias("registry"))
    near = above.join(places, "folder").groupBy("path").agg(F.min_by("registry", "level").alias("near"))
    return documents.select("path").distinct().join(exact, "path", "left").join(near, "path", "left").select("path", F.coalesce("bound", "near").alias("registry"))


def batch_problems(manifest: DataFrame, files: DataFrame, bound: DataFrame, run_id: str, registry_sha256: str) -> DataFrame:
    """path and problem of every output of a manifest (path, sha256) that isn't what was written: missing,
    changed, outside its folder, or bound to another run or registry; none for a batch that may be used."""
    rows = manifest.join(files.select("path", F.col("sha256").alias("_now")), "path", "left").join(bound.select("path", "output_sha256", F.col("registry_sha256").alias("_r"), F.col("run_id").alias("_run")), "path", "left")
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    problem = (
        F.when(unsafe, "path").when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("sha256"), "changed").when(F.col("output_sha256").isNull(), "unbound")
        .when(F.col("output_sha256") != F.col("sha256"), "bound to another file").when(F.col("_run") != run_id, "another run").when(F.col("_r") != registry_sha256, "another registry")
    )
    return rows.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def corpus(texts: DataFrame) -> DataFrame:
    """One text of each source (source, path, text): its first output by path, under a line with its name;
    sources stay rows, in no row more than one of them."""
    first = texts.withColumn("_n", F.row_number().over(W.partitionBy("source").orderBy("path"))).where("_n = 1")
    return first.select("source", F.concat(F.lit("=== "), "source", F.lit(" ===\n"), F.coalesce("text", F.lit(""))).alias("text"))


def draft_problems(drafts: DataFrame, entities: DataFrame, shortest: int = 4) -> DataFrame:
    """draft_id, unknown (tokens that the registry hasn't), without_tokens and leaks (tokens whose originals,
    of ``shortest`` characters or more, stand in the text outside tokens) of every draft (draft_id, text).

    Drafts are few and short; the registry's originals are sought by the draft's runs of words, not each
    original in each draft: those that begin with a word of the draft are compared.
    """
    rows = drafts.select("draft_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tokens": F.array_distinct(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0))), "bare": F.lower(F.regexp_replace("text", PLACEHOLDER, "\u0000"))})
    known = rows.select("draft_id", F.explode("tokens").alias("token")).join(entities.select("token").distinct().withColumn("_k", F.lit(True)), "token", "left")
    unknown = known.where("_k IS NULL").groupBy("draft_id").agg(F.array_sort(F.collect_set("token")).alias("unknown"))
    word = r"[\\p{L}\\p{N}]+".replace("\\\\", "\\")
    first = F.regexp_extract(F.lower("original"), word, 0)
    sought = entities.where(F.char_length(F.trim("original")) >= shortest).select("token", F.lower(F.trim("original")).alias("value"), first.alias("word"))
    words = rows.select("draft_id", "bare", F.explode(F.array_distinct(F.regexp_extract_all("bare", F.lit(word), F.lit(0)))).alias("_w"))
    # an original may begin within a longer word, so every ending of a word is looked up
    ends = words.select("draft_id", "bare", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("_w")), lambda i: F.substr("_w", i))).alias("_e"))
    starts = ends.select("draft_id", "bare", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("_e")), lambda i: F.substr("_e", F.lit(1), i))).alias("word")).distinct()
    hits = starts.join(sought.where("word <> ''"), "word").where(F.contains("bare", F.col("value")))
    leaks = hits.groupBy("draft_id").agg(F.array_sort(F.collect_set("token")).alias("leaks"))
    out = rows.join(unknown, "draft_id", "left").join(leaks, "draft_id", "left")
    none = F.array().cast("array<string>")
    return out.select("draft_id", F.coalesce("unknown", none).alias("unknown"), (F.size("tokens") == 0).alias("without_tokens"), F.coalesce("leaks", none).alias("leaks"))


def sealed(finding_id: Column, context: Column, key: Column) -> Column:
    """An original's context, encrypted (AES-GCM) with the finding's id as authenticated data."""
    return F.base64(F.aes_encrypt(context, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), finding_id))


def unsealed(finding_id: Column, secret: Column, key: Column) -> Column:
    """The context of ``sealed``; null if key or id are others."""
    return F.try_aes_decrypt(F.unbase64(secret), key, F.lit("GCM"), F.lit("DEFAULT"), finding_id).cast("string")


# What stands before a name in each case, tried in this order.
CASES = (
    (r"(?:согласно|вопреки)\s*$", "DATIVE"),
    (r"(?:по\s+отношению\s+к|обратиться\s+к|иск\s+к|к)\s*$", "DATIVE"),
    (r"(?:передал|передала|направил|направила|вручил|вручила|сообщил|сообщила)\s+[А-Яа-яЁё-]+\s*$", "DATIVE"),
    (r"(?:в\s+отношении|в\s+пользу|со\s+стороны|для|без|из|от|до|у)\s*$", "GENITIVE"),
    (r"(?:в\s+соответствии\s+с|вместе\s+с|заключ(?:ить|ен|ён|ила|ило)\s+с|совместно\s+с|с|со)\s*$", "INSTRUMENTAL"),
    (r"(?:о|об|обо|при)\s*$", "PREPOSITIONAL"),
    (r"(?:обязать|уведомить|назначить|вызвать)\s*$", "ACCUSATIVE"),
)


def case_at(text: Column, start: Column, fallback: Column | None = None) -> Column:
    """The grammatical case that the 100 characters before a place ask for; else the fallback (nominative)."""
    before = F.lower(F.substr(text, F.greatest(start - 100, F.lit(0)) + 1, F.least(start, F.lit(100))))
    out = F.lit("NOMINATIVE") if fallback is None else fallback
    for pattern, case in reversed(CASES):
        out = F.when(before.rlike(f"(?U){pattern}"), case).otherwise(out)
    return out


def form_of(original: Column, forms: Column, case: Column) -> Column:
    """The form of a name that was seen in a case (a map case -> form), else the original as it is: no form
    is made up without a dictionary."""
    return F.coalesce(F.try_element_at(forms, case), original)


def restore_forms(masked: DataFrame, entities: DataFrame, masked_col: str = "masked") -> DataFrame:
    """doc_id and text of every row of ``masked``, each known token (token, original, forms) replaced by the form
    that its surroundings ask for.  As ``masking.restore`` else."""
    rows = masked.select("doc_id", F.col(masked_col).alias("_t")).withColumn("row", F.xxhash64("_t"))
    rows = rows.withColumn("found", F.regexp_extract_all("_t", F.lit(PLACEHOLDER), F.lit(0)))
    names = entities.select("token", F.struct("original", "forms").alias("r")).dropDuplicates(["token"])
    tokens = rows.select("doc_id", "row", F.explode(F.array_distinct("found")).alias("token")).distinct().join(names, "token")
    maps = tokens.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("token", "r"))).alias("names"))
    both = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("row").eqNullSafe(F.col("_row")), "left").withColumn("gaps", F.split("_t", PLACEHOLDER, -1))

    def step(acc: Column, p: Column) -> Column:
        before = F.concat(acc["masked"], p["gap"])
        known = F.try_element_at(F.col("names"), p["token"])
        form = F.coalesce(form_of(known["original"], known["forms"], case_at(before, F.char_length(before))), p["token"], F.lit(""))
        return F.struct(F.concat(before, F.coalesce(p["token"], F.lit(""))).alias("masked"), F.concat(acc["out"], p["gap"], form).alias("out"))

    pairs = F.zip_with("gaps", "found", lambda g, t: F.struct(g.alias("gap"), t.alias("token")))
    text = F.aggregate(pairs, F.struct(F.lit("").alias("masked"), F.lit("").alias("out")), step)["out"]
    return both.select("doc_id", F.when(F.size("found") > 0, text).otherwise(F.col("_t")).alias("text"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """token, original and side (``first`` or ``second``) of the entries that only one of two registries has:
    none if a document's registry is the one it is bound to."""
    x, y = (d.select("token", "original") for d in (a, b))
    return x.exceptAll(y).withColumn("side", F.lit("first")).unionByName(y.exceptAll(x).withColumn("side", F.lit("second")))


def name_aliases(label: Column, surface: Column) -> Column:
    """The keys that a name may be met under: the entity's key, and of a person (surname, two names or two
    initials, in either order) the surname with both initials.  One initial never links."""
    key = entity_key(label, surface)
    full = r"^(\p{Lu}[\p{Ll}-]+)\s+(\p{Lu})[\p{Ll}-]+\s+(\p{Lu})[\p{Ll}-]+$"
    behind, ahead = r"^(\p{Lu}[\p{Ll}-]+)\s+(\p{Lu})\.\s?(\p{Lu})\.$", r"^(\p{Lu})\.\s?(\p{Lu})\.\s?(\p{Lu}[\p{Ll}-]+)$"
    text = F.trim(surface)
    sign = lambda p, s, a, b: F.lower(F.concat(F.lit("~"), F.regexp_extract(text, p, s), F.lit(" "), F.regexp_extract(text, p, a), F.regexp_extract(text, p, b)))
    person = F.when(text.rlike(full), sign(full, 1, 2, 3)).when(text.rlike(behind), sign(behind, 1, 2, 3)).when(text.rlike(ahead), sign(ahead, 3, 1, 2))
    return F.array_compact(F.array(key, F.when(label == "PER", person)))


def linked_entities(found: DataFrame) -> DataFrame:
    """label, surface and entity (the key that stands for all surfaces of one entity) of every distinct surface
    of spans (label, text): surfaces that share a name's sign are one, unless the sign stands for two different
    full names, which then link with neither.
    """
    rows = found.groupBy("label", F.col("text").alias("surface")).agg(F.count("*").alias("_n")).drop("_n")
    rows = rows.withColumns({"key": entity_key(F.col("label"), F.col("surface")), "sign": F.get(name_aliases(F.col("label"), F.col("surface")), F.lit(1))})
    whole = F.when(~F.col("surface").contains("."), F.col("key"))
    named = rows.where("sign IS NOT NULL").groupBy("label", "sign").agg(F.count_distinct(whole).alias("names"), F.min(F.coalesce(whole, F.col("key"))).alias("first"), F.min(whole).alias("full"))
    named = named.select(F.col("label").alias("_l"), F.col("sign").alias("_s"), "names", F.coalesce("full", "first").alias("entity"))
    both = rows.join(named, (F.col("label") == F.col("_l")) & (F.col("sign") == F.col("_s")), "left")
    return both.select("label", "surface", F.when(F.col("names") <= 1, F.col("entity")).otherwise(F.col("key")).alias("entity"))
