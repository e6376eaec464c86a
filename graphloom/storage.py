"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a traversal that the driver holds itself; a step that finds more is written as a table.
FEW = 2000

#: Bytes in memory that a byte of a compressed file is counted as, where a plan has nothing but files to go by.
UNPACKED = 30


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only on one machine, as in tests, a folder is set here where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def plan_unpacked(spark: SparkSession) -> None:
    """Lets plans count a file as what it holds unpacked. Ids and names of a million nodes take a few MB of
    Parquet, which by that size would be broadcast and fill the driver; adaptive execution still broadcasts
    what it has measured to be small. A setting of the session's own stays."""
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1.0:
        spark.conf.set(key, str(UNPACKED))


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/graphloom-{tag}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    return path


def modified(spark: SparkSession, path: str) -> int:
    """When a file, or one of the files right below a folder, was last changed."""
    fs, at = _hadoop(spark, path)
    return max([fs.getFileStatus(at).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(at))])


def materialize(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df as a Parquet table in the shared folder and reads that."""
    plan_unpacked(df.sparkSession)
    path = new_path(df.sparkSession, tag)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    out._written_at = path
    return out


def release(df: DataFrame | None) -> None:
    """Deletes what ``materialize`` wrote, for tables that nothing reads again."""
    path = getattr(df, "_written_at", None)
    if path:
        fs, at = _hadoop(df.sparkSession, path)
        fs.delete(at, True)


class Levels:
    """Rows that a traversal finds, level by level. While they are few the driver holds them, so a step is
    one job without files; beyond FEW rows they are one table in the shared folder that grows by a folder
    a level. Either way a plan over all levels, or over the last ones, has one scan, however many there are."""

    def __init__(self, spark: SparkSession, schema: str, tag: str):
        self.spark, self.schema, self.tag = spark, schema, tag
        self.sizes: list[int] = []
        self.held: list[pa.Table] | None = []
        self.path: str | None = None

    def add(self, df: DataFrame) -> int:
        """Stores the next level; how many rows it has."""
        if self.held is not None:
            # After a level near the limit the next one is most likely over it.
            room = FEW - sum(self.sizes)
            rows = df.limit(room + 1).toArrow() if not self.sizes or self.sizes[-1] * 4 <= room else None
            if rows is not None and rows.num_rows <= room:
                self.held.append(rows)
                self.sizes.append(rows.num_rows)
                return rows.num_rows
            self.path = new_path(self.spark, self.tag)
            if self.held:
                self._few(self.held, 0).write.partitionBy("depth").parquet(self.path)
            self.held = None
        at = f"{self.path}/depth={len(self.sizes)}"
        df.write.parquet(at)
        self.sizes.append(self.spark.read.schema(self.schema).parquet(at).count())
        return self.sizes[-1]

    def _few(self, tables: list[pa.Table], first: int) -> DataFrame:
        table = pa.concat_tables([t.append_column("depth", pa.array([first + i] * t.num_rows, pa.int32())) for i, t in enumerate(tables)])
        return F.broadcast(self.spark.createDataFrame(table))

    def since(self, level: int = 0) -> DataFrame:
        """Rows of a level and those after it, with their depth."""
        level = max(0, level)
        if self.held is not None:
            return self._few(self.held[level:], level)
        rows = self.spark.read.schema(f"{self.schema}, depth int").parquet(self.path)
        return rows.where(F.col("depth") >= level) if level else rows

    def at(self, level: int) -> DataFrame:
        if self.held is not None:
            return self._few(self.held[level : level + 1], level)
        return self.since().where(F.col("depth") == level)

    def ids(self, level: int) -> set | None:
        """Of a level that the driver holds, else None."""
        return set(self.held[level].column("id").to_pylist()) if self.held is not None else None

    def row(self, level: int, id_: str) -> dict:
        """The row of an id that a level has."""
        if self.held is not None:
            return next(r for r in self.held[level].to_pylist() if r["id"] == id_)
        return self.at(level).where(F.col("id") == id_).first().asDict()
