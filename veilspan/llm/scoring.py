"""What the two document classifiers share: bounded training rows, features in tasks, added columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that a classifier learns from, at most: those with the smallest hash of their id.
TRAINING_ROWS = 20_000

Features = Callable[[list[str]], np.ndarray]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``y`` and ``text`` of up to ``limit`` labelled documents of the rows that ``learn`` (over
    ``doc_id``) admits.

    The labels are narrowed to ``limit`` ids before the documents are touched, and these ids, of a
    bounded size, are broadcast: texts aren't shuffled.  Null ids and labels don't count, of repeated
    labels the largest does.  A repeated id gives all its rows here; ``training_matrix`` takes one.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(learn)
    picked = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")


def learned_fold(modulus: int, held_out: int, id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id's text isn't ``held_out`` modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus != held_out


def training_matrix(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and ids of the training rows, one row an id (of a repeated id, the row with the
    largest hash of its text), so the driver gets no more rows than ids were picked.

    Texts stay where they are read; their features are merged by id before the shuffle.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            x = features(texts)
            digests = [hashlib.md5(t.encode()).digest() for t in texts]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "h", "x"])

    one = rows.mapInArrow(measured, "doc_id long, y int, h binary, x binary").groupBy("doc_id").agg(F.max("y").alias("y"), F.max(F.struct("h", "x"))["x"].alias("x"))
    got = sorted(one.collect(), key=lambda r: r.doc_id)
    return (np.stack([np.frombuffer(r.x) for r in got]) if got else np.zeros((0, 1))), np.array([r.y for r in got], float), np.array([r.doc_id for r in got], np.int64)


def with_score(docs: DataFrame, score: Callable[[list[str]], np.ndarray], column: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` of every whole text in ``column`` (replaced if it was there, in any case):
    a narrow transformation, no shuffle.  A null text scores as the empty one, repeated rows score alike
    and all stay, an empty table gives none; other columns are carried through."""
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                s = score([t or "" for t in part.column(text_col).to_pylist()])
                yield pa.record_batch([*part.columns, pa.array(s, pa.float64())], [*kept, column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(scored, schema)
