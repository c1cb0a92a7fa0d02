"""Region and image statistics, histograms, votes and overlap measures: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def exact_quantiles(df: DataFrame, by: list[str], fractions: dict[str, float], discrete: bool = False) -> DataFrame:
    """Exact quantiles of ``value`` per group, by name; interpolated, or (discrete) the first value
    whose share of values up to it reaches the fraction.

    Values are counted, dealt by range of (group, value) and checkpointed.  The sizes of the ranges
    tell which of them hold a wanted rank, and only those are put in order, so no task holds more
    than a range of distinct values, however large a group is.  Nulls do not count; null keys are a
    group; a group without values has null quantiles, and with no ``by`` there is always one row.
    """
    spark = df.sparkSession
    group = F.struct(*[F.col(c) for c in by] or [F.lit(0).alias("all")]).alias("g")
    counts = df.select(group, F.col("value").cast("double").alias("value")).groupBy("g", "value").agg(F.count("value").alias("n"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counts.repartitionByRange(ranges, "g", "value").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("g")
    before = inside.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("g", "part").agg(F.sum("n").alias("size"))  # ``ranges`` rows a group at most
    sizes = sizes.select("g", "part", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("size").over(inside).alias("total"))
    place = {name: F.greatest(F.ceil(F.col("total") * q) - 1, F.lit(0)).cast("double") if discrete else (F.col("total") - 1) * F.lit(float(q)) for name, q in fractions.items()}
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    held = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))
    hits = sizes.withColumn("ranks", held).filter((F.size("ranks") > 0) | (F.col("total") == 0)).drop("size")
    upto = Window.partitionBy("g", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.join(hits, ["g", "part"]).withColumn("last", F.col("before") + F.sum("n").over(upto))
    mine = F.filter("ranks", lambda r: (r >= F.col("last") - F.col("n")) & (r < F.col("last")))
    picked = rows.select("g", "total", "value", F.explode_outer(mine).alias("rank"))
    at = lambda f, p: F.max(F.when(F.col("rank") == f(p).cast("long"), F.col("value")))
    ends = picked.groupBy("g", "total").agg(*[at(f, p).alias(f"{name} {k}") for name, p in place.items() for k, f in (("low", F.floor), ("high", F.ceil))])
    between = lambda name, p: F.when(F.col(f"{name} low") == F.col(f"{name} high"), F.col(f"{name} low")).otherwise(
        F.col(f"{name} low") + (F.col(f"{name} high") - F.col(f"{name} low")) * (p - F.floor(p))
    )
    out = ends.select(*[F.col(f"g.{c}").alias(c) for c in by], *[between(name, p).alias(name) for name, p in place.items()])
    return out if by else out.agg(*[F.max(name).alias(name) for name in fractions])


def voxel_count(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Count, sum and mean of the values at or above a threshold."""
    return df.filter(F.col("value") >= threshold).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def masked_mean(df: DataFrame, mask: DataFrame, lower: float, upper: float) -> DataFrame:
    """Mean of the values within bounds, over voxels of a non-zero mask."""
    inside = df.join(mask.filter("m <> 0").select("voxel_id"), "voxel_id", "left_semi")
    return inside.filter(F.col("value").between(lower, upper)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def apply_mask(series: DataFrame, mask: DataFrame) -> DataFrame:
    return series.join(mask.filter("m <> 0").select("voxel_id"), "voxel_id", "left_semi")


def roi_series(series: DataFrame, labels: DataFrame, log: bool = False) -> DataFrame:
    """Mean and sample deviation of each label (1 or more) at each time."""
    value = F.log("value") if log else F.col("value")
    joined = series.join(labels.filter("label >= 1"), "voxel_id")
    return joined.groupBy("label", "t").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))


def global_signal(series: DataFrame) -> DataFrame:
    return series.groupBy("t").agg(F.avg("value").alias("mean"))


def vector_stats(df: DataFrame) -> DataFrame:
    """Count, moments, exact median and bounds of all values; nulls do not count, an empty table
    gives n = 0 and nulls."""
    stats = df.agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )
    middle = exact_quantiles(df, [], {"median": 0.5})
    return stats.crossJoin(F.broadcast(middle)).select("n", "mean", "sd", "median", "low", "high")  # one row each


def peak_per_volume(series: DataFrame) -> DataFrame:
    """Largest value of each volume and the first voxel in raster order that has it."""
    return series.groupBy("t").agg(F.max(F.struct("value", (-F.col("voxel_id")).alias("place"))).alias("p")).select(
        "t", (-F.col("p.place")).alias("voxel_id"), F.col("p.value").alias("value")
    )


def centre_of_gravity(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Value-weighted mean coordinates per group; null where the values sum to 0."""
    total = F.nullif(F.sum("value"), F.lit(0.0))
    return voxels.groupBy(*by).agg(*[(F.sum(F.col("value") * F.col(c)) / total).alias(f"c{c}") for c in "xyz"])


def motion_outliers(cog: DataFrame, threshold: float = 2.0, dilate: int = 1) -> DataFrame:
    """Volumes whose centre lies far from the median centre, after detrending, and their neighbours."""
    mid = cog.agg(*[F.median(f"c{c}").alias(f"m{c}") for c in "xyz"])
    away = F.sqrt(sum(F.pow(F.col(f"c{c}") - F.col(f"m{c}"), 2) for c in "xyz"))
    d = cog.crossJoin(F.broadcast(mid)).select("t", away.alias("d"))  # one row
    line = d.agg(F.regr_slope("d", "t").alias("a"), F.regr_intercept("d", "t").alias("b"))
    flat = d.crossJoin(F.broadcast(line)).select("t", (F.col("d") - F.coalesce("a", F.lit(0.0)) * F.col("t") - F.coalesce("b", F.lit(0.0))).alias("r"))
    spread = flat.agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    z = flat.crossJoin(F.broadcast(spread)).select("t", ((F.col("r") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).alias("z"))
    return z.withColumn("own", F.coalesce(F.abs("z") > threshold, F.lit(False))).join(
        z.filter(F.abs("z") > threshold).select(F.explode(F.sequence(F.col("t") - dilate, F.col("t") + dilate)).alias("t")).distinct().withColumn("near", F.lit(True)),
        "t", "left",
    ).select("t", "z", F.coalesce("near", F.lit(False)).alias("outlier"))


def majority_vote(df: DataFrame, by: list[str]) -> DataFrame:
    """Most frequent label from 1 up, the lowest on ties, 0 where there is none."""
    counts = df.groupBy(*by, "label").agg(F.count("*").alias("n"))
    votes = F.max(F.when(F.col("label") >= 1, F.struct("n", (-F.col("label")).alias("k"))))
    return counts.groupBy(*by).agg(F.coalesce(-votes["k"], F.lit(0)).alias("label"))


def entropy(df: DataFrame, by: list[str]) -> DataFrame:
    """-sum p ln p over labels from 1 up; the denominator counts zeros too."""
    counts = df.groupBy(*by, "label").agg(F.count("*").alias("n"))
    total = F.sum("n")
    term = F.when(F.col("label") >= 1, F.col("n") * F.log("n"))
    # -sum (n/T) ln(n/T) = (ln T * sum n - sum n ln n) / T over the labels that count
    used = F.sum(F.when(F.col("label") >= 1, F.col("n")))
    return counts.groupBy(*by).agg(F.coalesce((F.log(total) * used - F.sum(term)) / total, F.lit(0.0)).alias("entropy"))


def histogram(df: DataFrame, bins: int = 1000, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Count, density share and survival share of every bin of equal width in [low, high]."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col("value") - low) / width), F.lit(bins - 1))
    counts = df.filter(F.col("value").between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # ``bins`` rows whatever the input, so one window over them is bounded.
    filled = every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    whole = Window.partitionBy()
    after = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.nullif(F.sum("n").over(whole), F.lit(0))
    return filled.select(
        "bin", (low + F.col("bin") * width).alias("lower"), "n", (F.col("n") / total).alias("share"), (F.sum("n").over(after) / total).alias("survival")
    )


def median_normalised(df: DataFrame, target: float = 1000.0) -> DataFrame:
    """Values scaled so that the element n/2 of the sorted values equals ``target``; nulls stay null."""
    middle = exact_quantiles(df, [], {"m": 0.5}, discrete=True)
    return df.crossJoin(F.broadcast(middle)).withColumn("value", F.col("value") * target / F.col("m")).drop("m")  # one row


def iqr_bounds(df: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles less and plus 1.5 times their distance, per group; null for groups without values."""
    q1, q3 = F.col("q1"), F.col("q3")
    found = exact_quantiles(df, by, {"q1": 0.25, "q3": 0.75})
    return found.select(*by, (q1 - 1.5 * (q3 - q1)).alias("low"), (q3 + 1.5 * (q3 - q1)).alias("high"))


def median_deviation(df: DataFrame, by: list[str]) -> DataFrame:
    """Exact median and median absolute deviation per group; null for groups without values."""
    mid = exact_quantiles(df, by, {"median": 0.5})
    theirs = mid.select(*[F.col(c).alias(f"mid {c}") for c in by], "median")
    same = [F.col(c).eqNullSafe(F.col(f"mid {c}")) for c in by]
    away = df.select(*by, "value").join(theirs, same).select(*by, "median", F.abs(F.col("value") - F.col("median")).alias("value"))
    return exact_quantiles(away, [*by, "median"], {"mad": 0.5})


def overlap(pairs: DataFrame) -> DataFrame:
    """Sensitivity, specificity, Dice and counts of a candidate against a reference (0/1 columns)."""
    count = lambda r, c: F.count_if((F.col("ref") == r) & (F.col("cand") == c))
    n = pairs.agg(count(1, 1).alias("tp"), count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"))
    return n.select(
        "tp", "tn", "fp", "fn", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("sensitivity"), (F.col("tn") / (F.col("tn") + F.col("fp"))).alias("specificity"),
        (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("dice"),
    )


def roc(pairs: DataFrame, steps: int = 100) -> DataFrame:
    """True and false positive rates and Dice of ``prob`` >= threshold, for thresholds 0, 1/steps, ...

    Scores meet their bin in one aggregation; suffix sums over the bins give every threshold.
    """
    at = F.least(F.floor(F.col("prob") * steps + 1e-9), F.lit(steps - 1)).cast("int")
    bins = pairs.groupBy(at.alias("bin")).agg(F.sum((F.col("ref") == 1).cast("long")).alias("p"), F.sum((F.col("ref") == 0).cast("long")).alias("q"))
    every = pairs.sparkSession.range(steps).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(F.broadcast(bins), "bin", "left").na.fill(0)  # ``steps`` rows at most
    after, whole = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.partitionBy()
    tp, fp, pos, neg = F.sum("p").over(after), F.sum("q").over(after), F.sum("p").over(whole), F.sum("q").over(whole)
    return filled.select((F.col("bin") / steps).alias("threshold"), (tp / pos).alias("tpr"), (fp / neg).alias("fpr"), (2 * tp / (tp + fp + pos)).alias("dice"))


def label_geometry(voxels: DataFrame) -> DataFrame:
    """Volume, centroid and bounding box of each label from 1 up."""
    parts = [f(F.col(c)).alias(f"{n}_{c}") for c in "xyz" for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return voxels.filter("label >= 1").groupBy("label").agg(F.count("*").alias("volume"), *parts)


def bounding_box_crop(voxels: DataFrame, where: Column) -> DataFrame:
    """Voxels within the box of those that satisfy ``where``, with coordinates from 0."""
    box = voxels.filter(where).agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    near = voxels.crossJoin(F.broadcast(box))  # one row
    for c in "xyz":
        near = near.filter(F.col(c).between(F.col(f"lo{c}"), F.col(f"hi{c}")))
    return near.select("voxel_id", *[(F.col(c) - F.col(f"lo{c}")).alias(c) for c in "xyz"], "value")


def distinct_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("label >= 1").select("label").distinct()


def unique_values(values: DataFrame) -> DataFrame:
    """Distinct values with their counts, in a total order."""
    return values.groupBy("value").agg(F.count("*").alias("n")).orderBy("value")


def off_diagonal_peak(entries: DataFrame) -> DataFrame:
    """Largest entry of a matrix (i, j, value) off its diagonal, the first place on ties."""
    best = F.max(F.struct("value", (-F.col("i")).alias("a"), (-F.col("j")).alias("b")))
    return entries.filter("i <> j").agg(best.alias("p")).select((-F.col("p.a")).alias("i"), (-F.col("p.b")).alias("j"), "p.value")


def extreme_rows(rows: DataFrame) -> DataFrame:
    """Mean of each row's values (i, values), and the first rows of the least and the largest; -1 if none."""
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.size("values")
    low = F.min(F.struct("m", "i"))
    high = F.max(F.struct("m", (-F.col("i")).alias("k")))
    found = rows.filter("size(values) > 0").select("i", mean.alias("m")).agg(low.alias("a"), high.alias("b"))
    return found.select(F.coalesce("a.i", F.lit(-1)).alias("argmin"), F.col("a.m").alias("low"), F.coalesce(-F.col("b.k"), F.lit(-1)).alias("argmax"), F.col("b.m").alias("high"))


def image_histograms(images: DataFrame, bins: int = 250, cumulative: bool = False) -> DataFrame:
    """Share of the voxels of each image (image_id, value) in bins of [0, 1], with mean and population
    deviation over the images; ``cumulative`` sums the bins from each on."""
    at = F.least(F.floor(F.col("value") * bins), F.lit(bins - 1)).cast("int")
    inside = images.filter(F.col("value").between(0, 1))
    counts = inside.groupBy("image_id", at.alias("bin")).agg(F.count("*").alias("n"))
    every = images.select("image_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = every.join(counts, ["image_id", "bin"], "left").select("image_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))
    one = Window.partitionBy("image_id")  # ``bins`` rows an image
    n = F.sum("n").over(one.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)) if cumulative else F.col("n")
    share = filled.select("image_id", "bin", (n / F.nullif(F.sum("n").over(one), F.lit(0))).alias("share"))
    return share.groupBy("bin").agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("sd"), F.count("*").alias("n_images"))


def list_histogram(values: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """Density of equal bins with one bin below (-1) and one from ``high`` up (``bins``)."""
    width = (high - low) / bins
    at = F.when(F.col("value") < low, -1).when(F.col("value") >= high, bins).otherwise(F.floor((F.col("value") - low) / width)).cast("int")
    counts = values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(-1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    total = F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0))  # bins + 2 rows
    return every.join(F.broadcast(counts), "bin", "left").na.fill(0, ["n"]).select("bin", "n", (F.col("n") / total).alias("density"))


def probabilistic_similarity(pairs: DataFrame) -> DataFrame:
    """2 * sum of the probability inside the reference / (sum of probabilities + size of the reference)."""
    inside = F.sum(F.when(F.col("ref") == 1, F.col("prob")).otherwise(0.0))
    return pairs.agg((2 * inside / (F.sum("prob") + F.count_if(F.col("ref") == 1))).alias("similarity"))


def area_under(sweep: DataFrame) -> DataFrame:
    """Area under a sweep of ``roc`` by trapezoids, from (1, 1) to (0, 0)."""
    w = Window.orderBy("threshold")  # a row a threshold
    fpr, tpr = F.lead("fpr", 1, 0.0).over(w), F.lead("tpr", 1, 0.0).over(w)
    return sweep.select(((F.col("fpr") - fpr) * (F.col("tpr") + tpr) / 2).alias("a")).agg(F.sum("a").alias("auc"))


def auto_crop(voxels: DataFrame, least: float = 0.0) -> DataFrame:
    """Voxels in the box of those above a value."""
    return bounding_box_crop(voxels, F.col("value") > least)


def multi_crop(images: DataFrame, first: str, where: Column) -> DataFrame:
    """All images (image_id, x, y, z, value) cut to the box of one of them, with coordinates from 0."""
    own = images.filter(F.col("image_id") == first).filter(where)
    box = own.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    near = images.crossJoin(F.broadcast(box))
    for c in "xyz":
        near = near.filter(F.col(c).between(F.col(f"lo{c}"), F.col(f"hi{c}")))
    return near.select("image_id", *[(F.col(c) - F.col(f"lo{c}")).alias(c) for c in "xyz"], "value")


def label_axes(voxels: DataFrame) -> DataFrame:
    """Covariances of the coordinates of each label, for its axes and orientation."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return voxels.filter("label >= 1").groupBy("label").agg(*[F.covar_pop(a, b).alias(a + b) for a, b in pairs])
