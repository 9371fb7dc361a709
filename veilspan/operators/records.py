"""Candidate records of documents without their texts, checks of records, counts and certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.operators.masking import splice

# The record's version and the labels that a record may hold.
RECORD_VERSION = "corpus-annotation-v1"
STATUSES = ("candidate", "accepted", "rejected")


def document_id(path: Column, text: Column) -> Column:
    """``doc_`` and the first 12 hex digits of the hash of path and text."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat(F.coalesce(path, F.lit("")), F.lit("\0"), F.coalesce(text, F.lit(""))), 256), 1, 12))


def mask_surfaces(text: Column, spans: Column) -> Column:
    """``text`` with spans (start, end, label; not overlapping) as ``[LABEL]``, and every other place of a
    masked surface too, longer surfaces first (of equal lengths in their order as texts)."""
    length = F.char_length(text)
    good = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= length))
    marked = F.transform(good, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), F.concat(F.lit("["), s["label"], F.lit("]")).alias("token")))
    surfaces = F.transform(good, lambda s: F.struct(-(s["end"] - s["start"]).cast("int").alias("n"), F.substr(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")).alias("surface"), F.concat(F.lit("["), s["label"], F.lit("]")).alias("token")))
    return F.aggregate(F.array_sort(F.array_distinct(surfaces)), splice(text, marked), lambda t, s: F.replace(t, s["surface"], s["token"]))


def annotations(found: DataFrame, texts: DataFrame) -> DataFrame:
    """document_id, text hash and length, and the annotations of every text (doc_id, path, text), numbered by
    place: id, start, end, label, detectors, status and the surface's hash and length, never the surface.

    Texts without spans have an empty array; null texts count as empty.
    """
    rows = texts.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    sources = F.col("sources") if "sources" in found.columns else F.lit("rules")
    per = found.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", sources.alias("sources")))).alias("spans"))
    both = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string,sources:string>>")))
    both = both.withColumn("document_id", document_id(F.col("path"), F.col("text")))

    def one(s: Column, i: Column) -> Column:
        surface = F.substr(F.col("text"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        number = F.concat(F.col("document_id"), F.lit(":a"), F.lpad((i + 1).cast("string"), 4, "0"))
        fields = {"id": number, "start": s["start"], "end": s["end"], "label": s["label"], "detectors": F.array_sort(F.array_distinct(F.split(s["sources"], r"\+"))), "status": F.lit("candidate"), "surface_sha256": F.sha2(surface, 256), "surface_length": F.char_length(surface)}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    masked = mask_surfaces(F.col("text"), F.col("spans"))
    return both.select(
        F.lit(RECORD_VERSION).alias("schema_version"), "document_id", "doc_id", "path", F.char_length("text").alias("text_length"), F.sha2("text", 256).alias("text_sha256"),
        F.transform("spans", one).alias("annotations"), F.sha2(masked, 256).alias("masked_text_sha256"),
    )


def record_errors(labels: Column, text: Column | None = None, masked: Column | None = None) -> Column:
    """What is wrong with a record, as an array of names: its fields, spans out of range, overlapping or of
    unknown labels; with the text also hashes that don't match; with the masked text also a mask that
    differs from the one the spans give, and surfaces that remain in it."""
    a, length = F.col("annotations"), F.col("text_length")
    ordered = F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    ends = F.aggregate(ordered, F.struct(F.lit(-1).cast("long").alias("end"), F.lit(False).alias("bad")), lambda acc, s: F.struct(F.greatest(acc["end"], s["end"].cast("long")).alias("end"), (acc["bad"] | (s["start"] < acc["end"])).alias("bad")))
    wrong = {
        "schema_version": F.col("schema_version") != RECORD_VERSION, "document_id": F.coalesce("document_id", F.lit("")) == "", "text_length": length < 0, "annotations": a.isNull(),
        "coordinates": F.exists(a, lambda s: ~((s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= length))), "overlap": ends["bad"], "label": F.exists(a, lambda s: ~F.array_contains(labels, s["label"])),
        "surface_sha256": F.exists(a, lambda s: F.length(F.coalesce(s["surface_sha256"], F.lit(""))) != 64), "status": F.exists(a, lambda s: ~s["status"].isin(*STATUSES)),
    }
    if text is not None:
        at = lambda s: F.substr(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        wrong |= {"source_length": F.char_length(text) != length, "source_hash": F.sha2(text, 256) != F.col("text_sha256"), "surface_hash": F.exists(a, lambda s: F.sha2(at(s), 256) != s["surface_sha256"])}
        if masked is not None:
            wrong |= {"masked_text": masked != mask_surfaces(text, a), "leak": F.exists(a, lambda s: F.contains(masked, at(s)) & (at(s) != ""))}
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(name in ("schema_version", "text_length"))), name) for name, bad in wrong.items()]))


def invalid_records(records: DataFrame, labels: Column) -> DataFrame:
    """rows and invalid: how many records there are and how many have an error."""
    return records.select(record_errors(labels).alias("e")).agg(F.count("*").alias("rows"), F.count_if(F.size("e") > 0).alias("invalid"))


def clean_counts(counts: DataFrame) -> DataFrame:
    """files, replacements and the counts by entity type (a map; names upper-cased and cut at 80 characters)
    of counts (files, replacements, entities: map) with nothing else in them; what is no number is 0."""
    number = lambda c: F.greatest(F.coalesce(c.try_cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    entities = F.transform_values(F.transform_keys("entities", lambda k, v: F.substring(F.upper(k), 1, 80)), lambda k, v: number(v))
    return counts.select(number(F.col("files")).alias("files"), number(F.col("replacements")).alias("replacements"), entities.alias("entities"))


def certificates(outputs: DataFrame, counts: DataFrame, rules_version: str, generated_at: Column) -> DataFrame:
    """path and a JSON certificate of each output (path, input_sha256, input_bytes, output_sha256, output_bytes)
    with its counts by entity type (path, entity_type, n): hashes, sizes and numbers, no values."""
    per = counts.groupBy("path").agg(F.sum("n").alias("replacements"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("entities"))
    rows = outputs.join(per, "path", "left")
    side = lambda k: F.struct(F.col(f"{k}_sha256").alias("sha256"), F.col(f"{k}_bytes").alias("size_bytes"))
    body = F.struct(
        F.lit("privacy-audit-v1").alias("schema_version"), F.lit(rules_version).alias("rules_version"), generated_at.alias("generated_at_utc"), side("input").alias("input"), side("output").alias("output"),
        F.struct(F.coalesce("replacements", F.lit(0).cast("long")).alias("replacements"), F.col("entities").alias("entities_by_type")).alias("counts"),
    )
    return rows.select("path", F.to_json(body).alias("certificate"))
