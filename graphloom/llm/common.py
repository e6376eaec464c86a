"""Helpers that the training-data operators share: tables, shared storage, bounded Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch on the way to a Python worker. A text of 100 kB makes that 25 MB.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine, as in tests,
    a folder of it is set where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/graphloom-{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df as a Parquet table in the shared folder and reads that."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with batches of few rows, so a worker's memory doesn't follow the partition."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def pick(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the columns that an operator reads, under its own names: what else the input has,
    clashing names included, stays out of its way."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def keep_rows(docs: DataFrame, first: DataFrame, **keys: Column) -> DataFrame:
    """Rows of docs whose keys are in ``first`` (the names of keys), one a key, with docs' own columns, also
    where those have the keys' names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(whole, *[c.alias(k) for k, c in keys.items()])
    return keyed.join(first, list(keys), "left_semi").dropDuplicates(list(keys)).select("row.*")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
