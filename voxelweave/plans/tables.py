"""The test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("voxel_id"), F.col("embedding").cast("array<double>").alias("series"))


def series(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d).select("voxel_id", F.posexplode("series").alias("t", "value"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("voxel_id"), "label")


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """First sample of every series on a grid of 8 by 8 columns."""
    i = F.col("voxel_id")
    grid = [(i % 8).alias("x"), (F.floor(i / 8) % 8).alias("y"), F.floor(i / 64).alias("z")]
    return series(spark, d).select("voxel_id", *grid, "t", "value")


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def parts(df: DataFrame, rows: int = 500_000) -> int:
    """Partitions of at most about ``rows`` rows each, and enough of them to use the cores."""
    n = df.count()
    return max(1, -(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, n // (rows // 10)))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that share orders; the weight is the number of shared orders.

    The number of partitions follows the rows, so what a task holds does not grow with them; pairs
    of one order meet where its rows lie, and are counted where their edge lies.
    """
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("src"))
    n = parts(li)
    s = li.repartition(n, "l_orderkey").distinct()
    pairs = s.join(s.withColumnRenamed("src", "dst").hint("shuffle_hash"), "l_orderkey").filter("src < dst").select("src", "dst")
    return pairs.repartition(n, "src", "dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def decay(spark: SparkSession, d: str) -> DataFrame:
    """A falling signal per order: prices by line number."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("voxel_id"), F.col("l_linenumber").cast("double").alias("t")).agg(F.avg("l_extendedprice").alias("value"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("quality").alias("ref"), F.col("toxic").alias("cand"))
