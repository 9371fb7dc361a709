"""New documents masked as they arrive, with a registry that goes on over batches and restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veilspan.operators.detection import candidates, resolve
from veilspan.operators.masking import mask, registry
from veilspan.sources.staging import staged

REGISTRY = "label string, key string, token string, number long, original string, batch long"


def known_entities(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The registry's rows of the batches before this one: a batch that runs again doesn't see its own."""
    spark.createDataFrame([], REGISTRY).write.mode("append").parquet(path)  # so that there is a folder to read
    return spark.read.schema(REGISTRY).parquet(path).where(F.col("batch") < before)


def masker(folder: str, detect: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch's work: each output is a folder of the batch's number, overwritten if it runs again,
    so that every document is masked once however often a batch is retried."""

    def work(docs: DataFrame, number: int) -> None:
        spark = docs.sparkSession
        known = known_entities(spark, f"{folder}/registry", number)
        docs = docs.select("doc_id", "text")
        found = staged(detect(docs), "spans")
        entities = registry(found, known.drop("batch"))
        added = entities.join(known.select("token"), "token", "left_anti").withColumn("batch", F.lit(number).cast("long"))
        added.select("label", "key", "token", "number", "original", "batch").write.mode("overwrite").parquet(f"{folder}/registry/part={number}")
        every = spark.read.schema(REGISTRY).parquet(f"{folder}/registry").where(F.col("batch") <= number)
        mask(docs, found, every).write.mode("overwrite").parquet(f"{folder}/masked/part={number}")

    return work


def mask_stream(spark: SparkSession, source: str, schema: StructType | str, folder: str, checkpoint: str, detect: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """All files of ``source`` (Parquet with doc_id and text) not seen before, masked; then it ends."""
    stream = spark.readStream.schema(schema).parquet(source)
    work = masker(folder, detect or (lambda docs: resolve(candidates(docs))))
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
