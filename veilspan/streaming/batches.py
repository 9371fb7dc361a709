"""Batches of documents: one registry for all, sweeps until nothing is left to mask, and their progress as
tables that a restarted batch goes on from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.functions.text import PLACEHOLDER
from veilspan.operators.detection import candidates, resolve
from veilspan.operators.masking import mask, registry
from veilspan.operators.reconcile import reconcile
from veilspan.sources.staging import staged

FILES = "batch_id string, path string"
EVENTS = "batch_id string, path string, error string, replacements long"
ENTITIES = "batch_id string, label string, key string, token string, number long, original string"
CLOSED = "batch_id string, how string"


class NotSettled(RuntimeError):
    """A batch in which values are still found after the last sweep."""


def mask_batch(docs: DataFrame, detect: Callable[[DataFrame], DataFrame] | None = None, known: DataFrame | None = None, sweeps: int = 4) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, n_replaced) of all documents (doc_id, text; ids unique) and their registry.

    Documents are masked with one registry, then every value of it that is left anywhere is replaced and
    texts are searched again, until a sweep finds nothing; after ``sweeps`` of them the batch fails, so no
    half-masked text is given out.  Each sweep is staged.
    """
    detect = detect or (lambda d: resolve(candidates(d)))
    found = staged(detect(docs), "found")
    entities = staged(registry(found, known), "entities")
    texts = staged(mask(docs, found, entities).select("doc_id", F.col("masked").alias("text"), "n_replaced"), "masked")
    for _ in range(sweeps):
        rest = reconcile(texts, entities)
        texts = staged(rest.join(texts.select("doc_id", "n_replaced"), "doc_id").select("doc_id", "text", (F.col("n_replaced") + F.col("n")).alias("n_replaced"), F.col("n").alias("_n")), "reconciled")
        # what stands within a token isn't found again
        bare = texts.select("doc_id", F.regexp_replace("text", PLACEHOLDER, " ").alias("text"))
        new = staged(detect(bare), "found-again")
        if new.isEmpty() and texts.where("_n > 0").isEmpty():
            return texts.drop("_n"), entities
        entities = staged(registry(new, entities), "entities")
        texts = texts.drop("_n")
    raise NotSettled(f"values are still found after {sweeps} sweeps")


class Progress:
    """The state of batches under a folder: files, events and entities are appended, never rewritten, so a
    batch that is cut off leaves what it had done."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        for name, schema in (("files", FILES), ("events", EVENTS), ("entities", ENTITIES), ("closed", CLOSED)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def start(self, batch_id: str, files: DataFrame) -> None:
        """Opens a batch of files (path)."""
        files.select(F.lit(batch_id).alias("batch_id"), "path").distinct().write.mode("append").parquet(f"{self.folder}/files")

    def update(self, batch_id: str, done: DataFrame, entities: DataFrame | None = None) -> None:
        """Adds files (path, error: null if it went well, replacements) and the entities they gave; the
        entities first, so that no file counts as done whose tokens aren't kept."""
        if entities is not None:
            entities.select(F.lit(batch_id).alias("batch_id"), "label", "key", "token", "number", "original").write.mode("append").parquet(f"{self.folder}/entities")
        done.select(F.lit(batch_id).alias("batch_id"), "path", "error", F.greatest("replacements", F.lit(0)).cast("long").alias("replacements")).write.mode("append").parquet(f"{self.folder}/events")

    def close(self, batch_id: str, how: str = "complete") -> None:
        """Ends a batch: ``complete`` or ``discarded``."""
        if how not in ("complete", "discarded"):
            raise ValueError(f"no end of a batch: {how}")
        self.spark.createDataFrame([(batch_id, how)], CLOSED).write.mode("append").parquet(f"{self.folder}/closed")

    def open_batches(self) -> DataFrame:
        """batch_id, files, processed, failed, remaining and replacements of the batches that weren't ended."""
        files = self._table("files", FILES).distinct().join(self._table("closed", CLOSED), "batch_id", "left_anti")
        done = self._table("events", EVENTS).groupBy("batch_id", "path").agg(F.bool_or(F.col("error").isNull()).alias("ok"), F.sum("replacements").alias("r"))
        both = files.join(done, ["batch_id", "path"], "left")
        ok = F.coalesce("ok", F.lit(False))
        return both.groupBy("batch_id").agg(F.count("*").alias("files"), F.count_if(ok).alias("processed"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("failed"), F.count_if(~ok).alias("remaining"), F.coalesce(F.sum("r"), F.lit(0)).alias("replacements"))

    def remaining(self, batch_id: str) -> DataFrame:
        """Files of a batch that weren't processed without an error."""
        done = self._table("events", EVENTS).where((F.col("batch_id") == batch_id) & F.col("error").isNull()).select("path")
        return self._table("files", FILES).where(F.col("batch_id") == batch_id).select("path").distinct().join(done, "path", "left_anti")

    def entities(self, batch_id: str) -> DataFrame:
        """The registry of a batch so far; a token with two originals fails the query."""
        own = self._table("entities", ENTITIES).where(F.col("batch_id") == batch_id)
        one = own.groupBy("label", "key", "token", "number").agg(F.min("original").alias("original"))
        twice = F.count("*").over(W.partitionBy("token")) > 1
        return one.withColumn("original", F.when(twice, F.raise_error(F.lit("a token of two entities")).cast("string")).otherwise(F.col("original")))


def orphaned_runs(paths: DataFrame, prefix: str = ".incomplete-") -> DataFrame:
    """Folders of runs that were cut off, from the paths of files: those of a name with the prefix."""
    folder = F.regexp_extract("path", rf"^(.*/{re.escape(prefix)}[^/]*)/", 1)
    return paths.select(folder.alias("folder")).where("folder <> ''").distinct()
