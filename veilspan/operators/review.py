"""The review queue: findings without source text, filters, pages, decisions and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a finding.
STATES = ("pending", "accepted", "rejected", "skipped")
FIELDS = ("document_ref", "location", "entity_type", "placeholder")


def finding_id(*fields: Column) -> Column:
    """The first 20 hex digits of the hash of the fields, joined by a unit separator; null is empty."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256), 1, 20)


def findings(rows: DataFrame) -> DataFrame:
    """Rows with document_ref, location, entity_type, placeholder, confidence and, if they have it,
    status as findings; every other column is left out, so no source text can pass."""
    status = F.col("status") if "status" in rows.columns else F.lit(None).cast("string")
    out = rows.select(
        F.coalesce(F.col("document_ref").cast("string"), F.lit("")).alias("document_ref"), F.coalesce(F.col("location").cast("string"), F.lit("")).alias("location"),
        F.upper(F.coalesce("entity_type", F.lit("UNKNOWN"))).alias("entity_type"), F.coalesce("placeholder", F.lit("")).alias("placeholder"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.when(status.isin(*STATES), status).otherwise("pending").alias("status"),
    )
    return out.withColumn("finding_id", finding_id(*[F.col(c) for c in FIELDS]))


def upsert(queue: DataFrame, added: DataFrame) -> DataFrame:
    """``queue`` with findings of ``added``, which take the place of those of the same id."""
    return queue.join(added.select("finding_id").distinct(), "finding_id", "left_anti").unionByName(added)


def threshold(value: float | str | None) -> float | None:
    """A least confidence; over 1 it is a percentage; what is no number is none."""
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return number / 100 if number > 1 else number


def filtered(queue: DataFrame, entity_type: str = "", document: str = "", status: str = "", least: float | str | None = None) -> DataFrame:
    """Findings that meet all conditions given; ``document`` is sought within the reference."""
    if entity_type:
        queue = queue.where(F.col("entity_type") == entity_type.upper())
    if document:
        queue = queue.where(F.contains(F.lower("document_ref"), F.lit(document.lower())))
    if status:
        queue = queue.where(F.col("status") == status)
    number = threshold(least)
    return queue if number is None else queue.where(F.col("confidence") >= number)


def page(queue: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page in the order of document, location and id: the feature is the limit."""
    return queue.orderBy("document_ref", "location", "finding_id").offset(max(0, offset)).limit(max(1, limit))


def decide(queue: DataFrame, status: str, chosen: DataFrame | None = None, **conditions: object) -> DataFrame:
    """Pending findings of the ids in ``chosen`` (or that meet the conditions) in a new state."""
    if status not in STATES[1:]:
        raise ValueError(f"no decision: {status}")
    if chosen is None:
        chosen = filtered(queue, status="pending", **conditions)  # type: ignore[arg-type]
    ids = chosen.select("finding_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit") & (F.col("status") == "pending")
    return queue.join(ids, "finding_id", "left").withColumn("status", F.when(hit, status).otherwise(F.col("status"))).drop("_hit")


def summary(queue: DataFrame) -> DataFrame:
    """status and n of every state, those of none included, and of all as ``total``."""
    one = queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATES], F.count("*").alias("total"))
    return one.unpivot([], [*STATES, "total"], "status", "n")


def by_entity_type(queue: DataFrame) -> DataFrame:
    return queue.groupBy("entity_type").agg(F.count("*").alias("n"))


def found(queue: DataFrame, finding: str) -> DataFrame:
    """The finding of an id, or no row."""
    return queue.where(F.col("finding_id") == finding)


def export(queue: DataFrame) -> DataFrame:
    """One JSON document of each document's findings (by id) and their counts by status."""
    counts = F.map_from_entries(F.array(*[F.struct(F.lit(s).alias("k"), F.count_if(F.col("status") == s).alias("n")) for s in STATES]))
    items = F.array_sort(F.collect_list(F.struct("finding_id", "location", "entity_type", "placeholder", "confidence", "status")))
    return queue.groupBy("document_ref").agg(F.to_json(F.struct(items.alias("items"), counts.alias("summary"))).alias("findings"))


def page_with_counts(queue: DataFrame, limit: int | None = None, offset: int = 0, **conditions: object) -> tuple[DataFrame, DataFrame]:
    """A page of the findings that meet the conditions (all of them without a limit), and scope (all or
    filtered), status and n of the counts by status."""
    kept = filtered(queue, **conditions)  # type: ignore[arg-type]
    counts = [summary(rows).select(F.lit(scope).alias("scope"), "status", "n") for scope, rows in (("all", queue), ("filtered", kept))]
    return (kept if limit is None else page(kept, limit, offset)), counts[0].unionByName(counts[1])
