"""Exact-span metrics, confusion, splits, coverage, top-N queues and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["doc_id", "start", "end", "layout", "label"]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def counted_keys(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The key columns with g and p, how often each key occurs on either side: one aggregate over both, in
    which null keys are equal."""
    sides = [d.select(*KEY, F.lit(int(side == "g")).alias("g"), F.lit(int(side == "p")).alias("p")) for side, d in (("g", gold), ("p", predicted))]
    return sides[0].unionByName(sides[1]).groupBy(*KEY).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def with_scores(counts: DataFrame) -> DataFrame:
    """tp, fp and fn with precision, recall, f1 (0 where undefined) and support."""
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": precision, "recall": recall, "support": F.col("tp") + F.col("fn")})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def span_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """scope (micro, entity, layout), name, tp, fp, fn, precision, recall, f1 and support by exact multiset
    matching: one aggregate over both sides and one pass of grouping sets."""
    both = counted_keys(gold, predicted)
    both = both.select("label", "layout", F.least("g", "p").alias("tp"), F.greatest(F.col("p") - F.col("g"), F.lit(0)).alias("fp"), F.greatest(F.col("g") - F.col("p"), F.lit(0)).alias("fn"))
    sums = both.groupingSets([[F.col("label")], [F.col("layout")], []], "label", "layout").agg(F.grouping_id().alias("gid"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    scope = F.when(F.col("gid") == 3, "micro").when(F.col("gid") == 1, "entity").otherwise("layout")
    out = sums.select(scope.alias("scope"), F.coalesce("label", "layout", F.lit("")).alias("name"), "tp", "fp", "fn")
    return with_scores(out)


def macro_metrics(metrics: DataFrame, labels: DataFrame) -> DataFrame:
    """scope (macro: means over all registered labels; supported: over those with support or predictions),
    entities, precision, recall and f1."""
    known = labels.select("label").distinct()
    rows = known.join(metrics.where("scope = 'entity'").withColumnRenamed("name", "label"), "label", "left").na.fill(0)
    kinds = {"macro": F.lit(True), "supported": (F.col("support") + F.col("tp") + F.col("fp")) > 0}
    parts = F.explode(F.array(*[F.when(ok, F.lit(k)) for k, ok in kinds.items()])).alias("scope")
    means = rows.select(parts, "precision", "recall", "f1").where("scope IS NOT NULL").groupBy("scope").agg(F.count("*").alias("entities"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return means


def unmatched(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose key doesn't occur among ``others`` (false positives of predictions against gold, false
    negatives of gold against predictions): by presence, not by number, so every repeated row is given."""
    known = others.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
    return rows.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY], "left_anti")


def confusion(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Counts of (gold_label, predicted_label) at equal places with different labels; each prediction
    counts once, against one gold label of its place (the largest, where gold has several)."""
    place = [c for c in KEY if c != "label"]
    one = gold.groupBy(*place).agg(F.max("label").alias("gold_label")).select(*[F.col(c).alias(f"_{c}") for c in place], "gold_label")
    made = predicted.groupBy(*place, "label").agg(F.count("*").alias("c")).withColumnRenamed("label", "predicted_label")
    joined = made.join(one, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place])
    return joined.where("gold_label <> predicted_label").groupBy("gold_label", "predicted_label").agg(F.sum("c").alias("n"))


# Names of layouts.
_LAYOUTS = {"table": ("table", "spreadsheet", "cell", "xlsx"), "ocr": ("ocr", "scan", "image", "vision")}


def layout_of(*names: Column) -> Column:
    """table, ocr or text, by the first name that is given."""
    low = F.lower(F.coalesce(*[F.when(n != "", n) for n in names], F.lit("text")))
    out = F.lit("text")
    for layout, words in _LAYOUTS.items():
        out = F.when(low.isin(*words), layout).otherwise(out)
    return out


def safe_document_id(value: Column) -> Column:
    """Ids that a machine gave stay; anything else, which may be a path or a name, is hashed."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"(?i)^(?:doc|document|file)[_-][a-f0-9]{8,64}\z"), text).otherwise(F.concat(F.lit("docref_"), F.substring(F.sha2(text, 256), 1, 24)))


def safe_rows(rows: DataFrame) -> DataFrame:
    """document_id, start, end, label and layout alone: no text, path or surface."""
    return rows.select(safe_document_id(F.col("doc_id")).alias("document_id"), "start", "end", "label", layout_of(F.col("layout")).alias("layout"))


def accepted_real(rows: DataFrame) -> DataFrame:
    """Rows (status, annotator_status, real, synthetic) that are accepted, confirmed, real and not synthetic."""
    return rows.where((F.col("status") == "accepted") & (F.col("annotator_status") == "confirmed") & F.col("real") & ~F.coalesce("synthetic", F.lit(False)))


def expanded(records: DataFrame) -> DataFrame:
    """Rows of records with arrays of annotations (start, end, label, layout, status): one an annotation; a
    null status is ``candidate``.  Records without annotations give none."""
    kept = [c for c in records.columns if c != "annotations"]
    out = records.select(*kept, F.explode("annotations").alias("_a"))
    return out.select(*kept, "_a.start", "_a.end", "_a.label", layout_of(F.col("_a.layout")).alias("layout"), F.coalesce("_a.status", F.lit("candidate")).alias("status"))


def gold_coverage(rows: DataFrame, labels: DataFrame, minimum: int = 200) -> DataFrame:
    """label, confirmed, required and complete for every registered label, from accepted real rows."""
    counted = accepted_real(rows).groupBy("label").agg(F.count("*").alias("confirmed"))
    out = labels.select("label").distinct().join(counted, "label", "left").na.fill(0, ["confirmed"])
    return out.select("label", "confirmed", F.lit(minimum).cast("long").alias("required"), (F.col("confirmed") >= minimum).alias("complete"))


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """entities, complete entities, whether all are, and confirmed rows in all."""
    return coverage.agg(F.count("*").alias("entities"), F.count_if("complete").alias("complete_entities"), F.bool_and("complete").alias("all_complete"), F.coalesce(F.sum("confirmed"), F.lit(0)).alias("confirmed"))


def manifest(rows: DataFrame, order: str) -> DataFrame:
    """doc_id, digest and split of every document: the last hash (by ``order``) of its rows, a null one
    taken as the id's hash; null ids are left out."""
    last = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max_by("text_sha256", order).alias("digest"))
    return last.select("doc_id", "digest", split_of(F.coalesce(F.when(F.col("digest") != "", F.col("digest")), F.sha2(F.col("doc_id").cast("string"), 256))).alias("split"))


def layouts_by_label(rows: DataFrame) -> DataFrame:
    """label, text, table and ocr: how many rows of each layout."""
    layout = layout_of(F.col("layout"))
    return rows.groupBy("label").agg(*[F.count_if(layout == k).alias(k) for k in ("text", "table", "ocr")])


def split_of(digest: Column) -> Column:
    """train, dev or test (70, 10, 20 of 100) by the first eight hex digits of a hash."""
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket >= 80, "test").when(bucket >= 70, "dev").otherwise("train")


def top_per_label(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of each label (a review queue's length)."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def deficits(rows: DataFrame, labels: DataFrame, minimum: int) -> DataFrame:
    """label, available, documents, deficit for every known label."""
    counted = rows.groupBy("label").agg(F.count("*").alias("available"), F.count_distinct("doc_id").alias("documents"))
    out = labels.select("label").distinct().join(counted, "label", "left").na.fill(0, ["available", "documents"])
    return out.withColumn("deficit", F.greatest(F.lit(minimum) - F.col("available"), F.lit(0)))


def overlapping(rows: DataFrame) -> DataFrame:
    """Rows that start before the largest end of earlier rows of their document (by start, end and, if
    there's one, line); with a line, also the line of the row that holds that end."""
    line = ["line"] if "line" in rows.columns else []
    seen = W.partitionBy("doc_id").orderBy("start", "end", *line).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("earlier_end", F.max("end").over(seen))
    if line:
        # of equal ends the first holds it
        out = out.withColumn("earlier_line", F.max(F.struct("end", (-F.col("line")).alias("l"))).over(seen)["l"] * -1)
    return out.where("start < earlier_end")
