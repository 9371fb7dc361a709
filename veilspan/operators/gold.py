"""Gold annotations: tasks, transitions, row checks, manifests and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States in which a task may be decided.
OPEN = ("pending", "model_reviewed")


def task_id(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def import_candidates(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending tasks of the valid rows (doc_id, start, end, label, layout), one for equal ones, and
    the counts of what was left out by reason (``span``, ``label``, ``document``, ``duplicate``)."""
    known = labels.select("label").distinct().withColumn("_known", F.lit(True))
    reason = F.when(F.col("doc_id").isNull(), "document").when(F.col("_known").isNull(), "label").when(F.coalesce((F.col("start") < 0) | (F.col("end") <= F.col("start")), F.lit(True)), "span")
    checked = rows.join(known, "label", "left").withColumn("reason", reason)
    valid = checked.where("reason IS NULL").groupBy("doc_id", "start", "end", "label", "layout").agg(F.count("*").alias("_n"))
    tasks = valid.select(task_id(*[F.col(c) for c in ("doc_id", "start", "end", "layout", "label")]).alias("task_id"), "doc_id", "start", "end", "label", "layout", F.lit("pending").alias("status"))
    twice = valid.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).where("n > 0").select(F.lit("duplicate").alias("reason"), "n")
    return tasks, checked.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).unionByName(twice)


def annotate(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tasks with the decisions (task_id, decision) applied to open ones; of several decisions for a
    task the least in order counts; those that aren't accepted or rejected are ignored."""
    one = decisions.where(F.col("decision").isin("accepted", "rejected")).groupBy("task_id").agg(F.min("decision").alias("decision"))
    made = F.col("decision").isNotNull() & F.col("status").isin(*OPEN)
    return tasks.join(one, "task_id", "left").withColumn("status", F.when(made, F.col("decision")).otherwise(F.col("status"))).drop("decision")


def row_errors(label_known: Column) -> Column:
    """Names of the checks that a gold row (doc_id, start, end, label) fails."""
    checks = {"document": F.col("doc_id").isNotNull(), "label": label_known, "start": F.col("start") >= 0, "end": F.col("end") > F.col("start")}
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))


def coverage(records: DataFrame) -> DataFrame:
    """label, positive, negative, and counts by split of synthetic records."""
    kinds = [F.count_if(~F.col("negative")).alias("positive"), F.count_if(F.col("negative")).alias("negative")]
    return records.groupBy("label").agg(*kinds, *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "dev", "test")])


def template_leaks(records: DataFrame) -> DataFrame:
    """Templates that occur in more than one split."""
    return records.groupBy("template_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


# Versions of rows and states of a task.
VERSIONS = ("gold-annotation-v1", "gold-queue-v1")
STATES = ("pending", "model_reviewed", "accepted", "rejected")


def add_manual(tasks: DataFrame, added: DataFrame) -> DataFrame:
    """``tasks`` with tasks made by hand; one that is there already fails the query."""
    twice = added.join(tasks.select("task_id"), "task_id", "left_semi").withColumn("status", F.raise_error(F.lit("a task of that id exists")).cast("string"))
    return tasks.unionByName(added.join(tasks.select("task_id"), "task_id", "left_anti")).unionByName(twice)


def model_review(tasks: DataFrame, agrees: Column, model: str) -> DataFrame:
    """Pending tasks reviewed beforehand by a model: a state of its own with a fixed confidence (.55 where it
    agrees, else .35), never an acceptance."""
    review = F.struct(F.lit("model_reviewed").alias("status"), F.lit(model).alias("model"), F.when(agrees, 0.55).otherwise(0.35).alias("confidence"))
    pending = F.col("status") == "pending"
    return tasks.withColumn("review", F.when(pending, review)).withColumn("status", F.when(pending, F.lit("model_reviewed")).otherwise(F.col("status")))


def gold_errors(labels: Column, versions: tuple[str, ...] = VERSIONS) -> Column:
    """What is wrong with a gold row, as an array of names, from the columns schema_version, doc_id, task_id,
    source_sha256, text_sha256, surface_policy, real, start, end, label, layout, surface_sha256, status,
    annotator_status and annotator_id; ``labels`` is an array of the registered ones."""
    digest = r"^[a-f0-9]{64}\z"
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    accepted = F.coalesce(F.col("status") == "accepted", F.lit(False))
    checks = {
        "schema_version": F.col("schema_version").isin(*versions), "document_id": given("doc_id"), "task_id": given("task_id"), "source_sha256": F.col("source_sha256").rlike(digest),
        "text_sha256": F.col("text_sha256").rlike(digest), "surface_policy": F.col("surface_policy") == "hash_only", "real": F.col("real"), "span": (F.col("start") >= 0) & (F.col("end") > F.col("start")),
        "label": F.array_contains(labels, F.col("label")), "surface_sha256": ~given("surface_sha256") | F.col("surface_sha256").rlike(digest), "accepted_surface": ~accepted | F.col("surface_sha256").rlike(digest),
        "status": F.col("status").isin(*STATES), "annotator": ~accepted | ((F.col("annotator_status") == "confirmed") & given("annotator_id")),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))


def review_rows(queue: DataFrame, texts: DataFrame, around: int = 120) -> DataFrame:
    """Queue rows with their surface and its surroundings (the span in double angle brackets), from the
    texts (doc_id, text) by offset; rows whose surface doesn't have the queue's hash are left out."""
    both = queue.join(texts.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")), F.col("doc_id").eqNullSafe(F.col("_id")))
    start, end = F.col("start").cast("int"), F.col("end").cast("int")
    surface = F.substr("_t", start + 1, end - start)
    left = F.substr("_t", F.greatest(start - around, F.lit(0)) + 1, F.least(start, F.lit(around)))
    shown = F.concat(left, F.lit("\u27e6"), surface, F.lit("\u27e7"), F.substr("_t", end + 1, F.lit(around)))
    return both.where(F.sha2(surface, 256) == F.col("surface_sha256")).withColumns({"surface": surface, "context": shown}).drop("_id", "_t")
