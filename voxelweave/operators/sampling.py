"""Samples, permutations, concatenations and set operations of label sets and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_replacement(rows: DataFrame, percent: float, seed: int = 1) -> DataFrame:
    """Rows drawn with replacement: each as often as Spark's Poisson sampling says."""
    return rows.sample(withReplacement=True, fraction=percent / 100, seed=seed)


def subset(rows: DataFrame, percent: float, key: str, seed: int = 1) -> DataFrame:
    """A share of the rows without replacement, by a hash of a key, the same in every run."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000))
    return rows.filter(u < int(percent * 10_000))


def balanced(rows: DataFrame, key: str, label: str = "label", seed: int = 1) -> DataFrame:
    """As many rows of every label as the rarest has, without replacement.

    A row's place in its label is counted in blocks of a hash, so a label of any size is ranked by
    many tasks.
    """
    h = F.xxhash64(key, F.lit(seed))
    blocks = rows.withColumn("h", h).withColumn("block", F.shiftrightunsigned("h", 54))
    sizes = blocks.groupBy(label, "block").agg(F.count("*").alias("n"))
    least = sizes.groupBy(label).agg(F.sum("n").alias("n")).agg(F.min("n").alias("least"))  # one row
    before = F.coalesce(F.sum("n").over(Window.partitionBy(label).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(label, "block", before.alias("start"))
    inner = F.row_number().over(Window.partitionBy(label, "block").orderBy("h", key)) - 1
    ranked = blocks.withColumn("rank", inner).join(starts, [label, "block"]).crossJoin(F.broadcast(least))
    return ranked.filter(F.col("start") + F.col("rank") < F.col("least")).drop("h", "block", "rank", "start", "least")


def voxel_selection(images: DataFrame, labels: DataFrame, covariates: DataFrame, seed: int = 1) -> DataFrame:
    """Label, value of every image and covariates of a balanced sample of labelled voxels.

    images has image_id, voxel_id, value; the same voxels are taken from every image; covariates
    has a row an image.
    """
    chosen = balanced(labels.filter("label >= 1"), "voxel_id", "label", seed)
    return images.join(chosen, "voxel_id").join(covariates, "image_id", "left")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Series one after another in time."""
    out, start = parts[0], F.lit(0)
    for part in parts[1:]:
        last = out.agg(F.coalesce(F.max("t") + 1, F.lit(0)).alias("start"))  # one row
        later = part.crossJoin(F.broadcast(last)).withColumn("t", (F.col("t") + F.col("start")).cast("int")).drop("start")
        out = out.unionByName(later)
    return out.withColumn("t", (F.col("t") + start).cast("int"))


def block_bootstrap(series: DataFrame, samples: int, seed: int = 1) -> DataFrame:
    """Circular block bootstrap (sample, voxel_id, t, value): blocks of random place and length, from 2
    to 3 sqrt(T) samples, the same for all voxels, cut to the length of the series."""
    n = series.agg(F.max("t")).first()[0]
    if n is None:
        return series.withColumn("sample", F.lit(0)).limit(0).select("sample", "voxel_id", "t", "value")
    n += 1
    top = max(3, int(3 * n**0.5))
    draw = lambda k, high: 2 + F.pmod(F.xxhash64("sample", "block", F.lit(seed), F.lit(k)), F.lit(max(1, high - 2)))
    blocks = series.sparkSession.range(samples).select((F.col("id") + 1).cast("int").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("block"))
    blocks = blocks.select("sample", "block", draw(0, n).alias("offset"), draw(1, top).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("sample").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("start", before).filter(F.col("start") < n)  # n / 2 rows a sample
    each = placed.select("sample", "start", "offset", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k"))
    each = each.select("sample", (F.col("start") + F.col("k")).cast("int").alias("to"), F.pmod(F.col("offset") + F.col("k"), F.lit(n)).cast("int").alias("t")).filter(F.col("to") < n)
    return series.join(each, "t").select("sample", "voxel_id", F.col("to").alias("t"), "value")


def shared_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("label").intersect(b.select("label"))


def labels_only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("label").subtract(b.select("label"))


def without_volumes(series: DataFrame, outliers: DataFrame) -> DataFrame:
    """Series without the volumes that are marked as outliers."""
    return series.join(outliers.filter("outlier").select("t"), "t", "left_anti").select("voxel_id", "t", "value")
