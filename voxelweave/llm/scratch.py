"""Tables written to the shared scratch folder, which survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of local sessions that name none.
LOCAL: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; columns that a table lacks become nulls."""
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[(df[have[c]] if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    )


def base_folder(spark: SparkSession) -> str:
    """This application's part of ``spark.checkpoint.dir``.

    A machine-local folder serves only a local session that names none; on a cluster it would
    lose tables without a word, so there the setting must be given.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = LOCAL.setdefault("base", "file://" + tempfile.mkdtemp(prefix="voxelweave-"))
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, pattern: str) -> None:
    """Removes the folders that a path or glob pattern names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(path) or []:
        files.delete(found.getPath(), True)


def clear(spark: SparkSession) -> None:
    """Removes all scratch tables of this application; results not yet read are lost with them."""
    delete(spark, base_folder(spark))


class Scratch:
    """Writes DataFrames below ``spark.checkpoint.dir`` and reads them back.

    ``drop`` removes a table that a loop has superseded and ``close`` all of them, once the
    result has been read or written; ``clear`` does so for a whole application.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def put(self, df: DataFrame, label: str) -> DataFrame:
        where = self.path(label)
        df.write.parquet(where)
        return self.read(where, df)

    def read(self, where: str, like: DataFrame) -> DataFrame:
        out = self.spark.read.schema(like.schema).parquet(where)
        out._scratch_path = where
        return out

    def drop(self, df: DataFrame | None) -> None:
        where = getattr(df, "_scratch_path", None)
        if where:
            delete(self.spark, where)

    def close(self) -> None:
        delete(self.spark, self.root)
