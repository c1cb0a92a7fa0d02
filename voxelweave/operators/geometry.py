"""Selections, crops, shifts and label logic over voxel tables (voxel_id, x, y, z, t, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def extract_volumes(series: DataFrame, first: int, count: int = 1) -> DataFrame:
    """Volumes first .. first + count - 1, renumbered from 0."""
    return series.filter(F.col("t").between(first, first + count - 1)).withColumn("t", F.col("t") - first)


def skip_samples(series: DataFrame, begin: int, end: int) -> DataFrame:
    """Samples of [begin, T - end)."""
    last = series.agg(F.max("t").alias("last"))
    return series.crossJoin(F.broadcast(last)).filter((F.col("t") >= begin) & (F.col("t") <= F.col("last") - end)).drop("last")  # one row


def insert_volume(series: DataFrame, volume: DataFrame, at: int) -> DataFrame:
    """The series with its volume ``at`` replaced by (voxel_id, value)."""
    return series.filter(F.col("t") != at).unionByName(volume.select("voxel_id", F.lit(at).alias("t"), "value"))


def crop(voxels: DataFrame, start: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """Voxels within a box, with coordinates from its corner."""
    out = voxels
    for c, a, n in zip("xyz", start, size, strict=True):
        out = out.filter(F.col(c).between(a, a + n - 1)).withColumn(c, F.col(c) - a)
    return out


def clear_region(voxels: DataFrame, start: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    inside = F.lit(True)
    for c, a, n in zip("xyz", start, size, strict=True):
        inside = inside & F.col(c).between(a, a + n - 1)
    return voxels.withColumn("value", F.when(inside, F.lit(0.0)).otherwise(F.col("value")))


def reorient(voxels: DataFrame, axes: str, size: tuple[int, int, int]) -> DataFrame:
    """Axes in a new order, capital letters flipped: 'zXy' takes z, then x reversed, then y."""
    n = dict(zip("xyz", size, strict=True))
    new = [(F.col(a.lower()) if a.islower() else n[a.lower()] - 1 - F.col(a.lower())).alias(c) for a, c in zip(axes, "xyz", strict=True)]
    return voxels.select("voxel_id", *new, "value")


def mask_ordinal(mask: DataFrame, block: int = 4096) -> DataFrame:
    """Raster rank from 0 of every voxel of a non-zero mask.

    Ranks are counted within blocks of ids and shifted by the counts of earlier blocks, those
    within blocks of blocks, so no task orders the mask or all its blocks.
    """
    on = mask.filter("m <> 0").select("voxel_id", F.floor(F.col("voxel_id") / block).alias("block"))
    sizes = on.groupBy("block").agg(F.count("*").alias("n")).withColumn("upper", F.floor(F.col("block") / block))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sizes.groupBy("upper").agg(F.sum("n").alias("n"))
    tops = tops.select("upper", earlier(Window.orderBy("upper")).alias("shift"))  # a row for block * block ids
    starts = sizes.withColumn("inside", earlier(Window.partitionBy("upper").orderBy("block"))).join(tops, "upper").select("block", (F.col("shift") + F.col("inside")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("block").orderBy("voxel_id")) - 1
    return on.join(starts, "block").select("voxel_id", (F.col("before") + inner).alias("ordinal"))


def list_to_image(values: DataFrame, mask: DataFrame) -> DataFrame:
    """Values (i, value) put into the voxels of a mask in raster order."""
    return mask_ordinal(mask).join(values.withColumnRenamed("i", "ordinal"), "ordinal").select("voxel_id", "value")


def relative_coordinates(voxels: DataFrame, centre: DataFrame) -> DataFrame:
    """Coordinates minus those of the first voxel of ``centre`` in raster order."""
    first = centre.agg(F.min(F.struct("voxel_id", "x", "y", "z")).alias("c"))
    return voxels.crossJoin(F.broadcast(first)).select("voxel_id", *[(F.col(a) - F.col(f"c.{a}")).alias(a) for a in "xyz"])  # one row


def label_logic(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Voxelwise 'and', 'or' or 'minus' of two masks (voxel_id, m)."""
    both = a.select("voxel_id", (F.col("m") != 0).alias("p")).join(b.select("voxel_id", (F.col("m") != 0).alias("q")), "voxel_id")
    rule = {"and": F.col("p") & F.col("q"), "or": F.col("p") | F.col("q"), "minus": F.col("p") & ~F.col("q")}[how]
    return both.select("voxel_id", rule.cast("int").alias("m"))


def remove_isolated(labels: DataFrame, least: int) -> DataFrame:
    """Voxels (x, y, z) of face-connected parts with at least ``least`` voxels, with the part's size."""
    from .graph import merged

    steps = F.array(*[F.struct(*[F.lit(int(k == i)).alias(f"d{c}") for k, c in enumerate("xyz")]) for i in range(3)])
    next_ = labels.select(F.col("voxel_id").alias("src"), "x", "y", "z", F.explode(steps).alias("d"))
    next_ = next_.select("src", *[(F.col(c) + F.col(f"d.d{c}")).alias(c) for c in "xyz"])
    edges = next_.join(labels.select(F.col("voxel_id").alias("dst"), "x", "y", "z"), ["x", "y", "z"]).select("src", "dst")
    parts = labels.join(merged(edges).withColumnRenamed("node", "voxel_id"), "voxel_id", "left").select("voxel_id", F.coalesce("root", "voxel_id").alias("part"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return parts.join(sizes, "part").select("voxel_id", "part", "size")


def staple(votes: DataFrame, rounds: int = 30, prior: float = 0.5, start: float = 0.9) -> tuple[DataFrame, dict]:
    """Probability of each voxel from several raters' 0/1 votes (voxel_id, rater, v), and each
    rater's sensitivity and specificity, by expectation and maximisation."""
    raters = [r[0] for r in votes.select("rater").distinct().orderBy("rater").collect()]  # a row a rater
    quality = dict.fromkeys(raters, (start, start))
    for _ in range(rounds + 1):
        p = F.create_map(*[F.lit(x) for r in raters for x in (r, max(1e-6, min(1 - 1e-6, quality[r][0])))])
        q = F.create_map(*[F.lit(x) for r in raters for x in (r, max(1e-6, min(1 - 1e-6, quality[r][1])))])
        on = F.col("v") == 1
        yes = F.sum(F.log(F.when(on, p[F.col("rater")]).otherwise(1 - p[F.col("rater")])))
        no = F.sum(F.log(F.when(on, 1 - q[F.col("rater")]).otherwise(q[F.col("rater")])))
        w = votes.groupBy("voxel_id").agg((1 / (1 + F.exp(no - yes) * ((1 - prior) / prior))).alias("w"))
        if _ == rounds:
            return w, quality
        joined = votes.join(w, "voxel_id").groupBy("rater")
        sums = joined.agg(F.sum(F.col("w") * F.col("v")) / F.sum("w"), F.sum((1 - F.col("w")) * (1 - F.col("v"))) / F.sum(1 - F.col("w")))
        new = {r: (a, b) for r, a, b in sums.collect()}  # a row a rater
        moved = max(abs(new[r][k] - quality[r][k]) for r in raters for k in (0, 1))
        quality = new
        if moved < 1e-7:
            return w, quality
    raise AssertionError
