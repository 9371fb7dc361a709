"""What the operators share: the cluster's shared folder, staged tables and text helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the executors are this process (as in tests) is a folder of this machine
    set; a cluster that names none is an error, as each executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "veilspan-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/veilspan/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Deletes what this application has staged.  Results read these files, so it comes after the last
    of them is written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    Lineage ends at files that outlive any executor, so a lost executor costs the tasks it ran and
    not the stages before them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column is called so (in any case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name
