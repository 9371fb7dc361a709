"""A corpus pipeline over ``documents``: five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; every stage but the
last returns the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import staged, table
from veilspan.llm.decontaminate import WINDOW, find_contamination
from veilspan.llm.minhash import one_of_each
from veilspan.llm.packing import pack_documents
from veilspan.llm.quality import fit_quality, score_quality
from veilspan.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select(COLUMNS), model, "quality_score").where("quality_score >= 0.7").select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(COLUMNS), model, "toxicity_score").where("toxicity_score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, one with a null id only in a
    group without ids.  Null and repeated ids don't touch rows outside the group."""
    return one_of_each(docs.select(COLUMNS)).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, that is without a full window of an item's words
    (items shorter than a window, found alone or side by side, are no passage)."""
    found, added = find_contamination(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.col(added["widest"]) < WINDOW).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 2048 tokens."""
    return pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")), end_id=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores and token ids have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
