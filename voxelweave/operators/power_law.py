"""Power-law fits: exponent by maximum likelihood, least value by the Kolmogorov-Smirnov distance.

Whole numbers have the discrete law, whose normaliser is Hurwitz's zeta function, others the
continuous one.  Every distinct value is a candidate for the least value xmin.  Suffix sums give each
candidate's exponent.  Values lie in blocks that follow the number of rows from a value on, so one holds
the same small share of what any candidate has left.  The distance of every candidate is bounded from
below at the ends of a few of them, spread over its own rows; the ends of all blocks bound the
distances of the most promising ones from above, those that can't be the best go, all blocks bound the
others, and only what is left meets all values, in passes that begin with the least bounds.

All steps carry a sample number, so the bootstrap is one fit of many samples side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: First exponent, step and last exponent that the discrete law tries.
GRID = (1.5, 0.01, 3.5)
#: Blocks to a doubling of the rows from a value on; also to a doubling of the value, for sums.
FINE = 64
#: Shares of a candidate's rows at which its distance is first looked at, and candidates that all
#: blocks then bound, to have a limit for the others.
SHARES, FIRST = np.linspace(0.98, 0.02, 24), 1000
#: Candidates of a sample that meet all values in a pass.
BATCH = 32
SLACK = 1e-12
#: Bernoulli numbers over factorials, B_2j / (2j)!, of the Euler-Maclaurin sum.  Fixed values.
EULER = (1 / 12, -1 / 720, 1 / 30240, -1 / 1209600, 1 / 47900160, -691 / 1307674368000)


def hurwitz(s: np.ndarray, q: np.ndarray, direct: int = 12) -> np.ndarray:
    """Sum over k >= 0 of (q + k) ** -s, for s > 1 and q > 0, elementwise."""
    s, q = np.broadcast_arrays(np.asarray(s, float), np.asarray(q, float))
    total = sum((q + k) ** -s for k in range(direct))
    a = q + direct
    power = a**-s
    total = total + a * power / (s - 1) + power / 2
    rising = s * power / a
    for j, c in enumerate(EULER):
        total = total + c * rising
        rising = rising * (s + 2 * j + 1) * (s + 2 * j + 2) / (a * a)
    return total


def grid_exponents(n: np.ndarray, logs: np.ndarray, xmin: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The grid's exponent of largest likelihood, -alpha * logs - n * ln zeta(alpha, xmin), which is
    concave: halving on the sign of its step finds the top."""
    low, high = np.zeros(len(n), int), np.full(len(n), len(grid) - 1)
    at = lambda i: -grid[i] * logs - n * np.log(hurwitz(grid[i], xmin))
    while (low < high).any():
        middle = (low + high) // 2
        up = (at(np.minimum(middle + 1, len(grid) - 1)) > at(middle)) & (low < high)
        low, high = np.where(up, middle + 1, low), np.where(up, high, middle)
    return grid[low]


def tails(alpha: np.ndarray, xmin: np.ndarray, v: np.ndarray, discrete: bool) -> np.ndarray:
    """A law's share from each v on, one row a law; at v < xmin of no meaning."""
    if not discrete:  # by logarithms: steep laws' powers of v and xmin themselves vanish
        return np.exp((1 - alpha)[:, None] * np.maximum(np.log(v)[None, :] - np.log(xmin)[:, None], 0))
    own, back = np.unique(alpha, return_inverse=True)
    return hurwitz(own[:, None], v[None, :])[back] / hurwitz(alpha, xmin)[:, None]


def bounds(xmin: np.ndarray, n: np.ndarray, alpha: np.ndarray, ends: dict[str, np.ndarray], discrete: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance that the ends of blocks (lo, hi, count from lo, count beyond hi) allow."""
    from_lo = tails(alpha, xmin, ends["lo"], discrete)
    beyond = tails(alpha, xmin, ends["hi"] + (1 if discrete else 0), discrete)
    live, later = ends["hi"][None, :] >= xmin[:, None], ends["lo"][None, :] > xmin[:, None]
    from_lo = np.where(later, from_lo, 1.0)
    at_lo = np.where(later, ends["from_lo"][None, :] / n[:, None], 1.0)
    after = ends["beyond"][None, :] / n[:, None]
    low = np.where(live, np.maximum(np.abs(from_lo - at_lo), np.abs(beyond - after)), 0).max(axis=1)
    high = np.where(live, np.maximum(from_lo - after, at_lo - beyond), 0).max(axis=1)
    return low, high


def least(xmin: np.ndarray, n: np.ndarray, alpha: np.ndarray, ends: dict[str, np.ndarray], discrete: bool) -> np.ndarray:
    """Least distance that a few blocks' first values allow, at SHARES of each candidate's rows."""
    at = np.maximum(np.searchsorted(-ends["from_lo"], -(n[:, None] * SHARES), side="right") - 1, 0)
    lo = ends["lo"][at]
    if discrete:
        share = hurwitz(alpha[:, None], lo) / hurwitz(alpha, xmin)[:, None]
    else:
        share = np.exp((1 - alpha)[:, None] * np.maximum(np.log(ends["lo"])[at] - np.log(xmin)[:, None], 0))
    return np.where(lo > xmin[:, None], np.abs(share - ends["from_lo"][at] / n[:, None]), 0).max(axis=1)


def suffix_sums(counts: DataFrame) -> DataFrame:
    """(sample, value, c) with n and logs: rows and sum of logarithms from the value on."""
    v = counts.withColumn("l", F.log("value") * F.col("c")).withColumn("block", F.floor(F.log2("value") * FINE))
    blocks = v.groupBy("sample", "block").agg(F.sum("c").alias("bc"), F.sum("l").alias("bl"))  # a few thousand a sample
    # From the largest on: a frame that ends at the row runs on, one that begins there is summed anew for each row.
    later = Window.partitionBy("sample").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("sample", "block", F.coalesce(F.sum("bc").over(later), F.lit(0)).alias("bc"), F.coalesce(F.sum("bl").over(later), F.lit(0.0)).alias("bl"))
    inner = Window.partitionBy("sample", "block").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return v.join(blocks, ["sample", "block"]).select("sample", "value", "c", (F.sum("c").over(inner) + F.col("bc")).alias("n"), (F.sum("l").over(inner) + F.col("bl")).alias("logs"))


def block_ends(v: DataFrame, per: int) -> dict[int, dict[str, np.ndarray]]:
    """Ends and counts of the blocks of each sample; a few hundred or thousand rows a sample."""
    block = F.floor(F.log2("n") * per)
    rows = v.groupBy("sample", block.alias("b")).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.max("n").alias("from_lo"), F.min(F.col("n") - F.col("c")).alias("beyond")
    )
    found = rows.toPandas().sort_values(["sample", "b"])
    return {int(k): {c: g[c].to_numpy(float) for c in ("lo", "hi", "from_lo", "beyond")} for k, g in found.groupby("sample")}


def bounded(candidates: DataFrame, ends: dict[int, dict[str, np.ndarray]], discrete: bool, few: bool = False) -> DataFrame:
    """Candidates with low and high, by all blocks; with ``few`` by some, which give no high."""
    known = candidates.sparkSession.sparkContext.broadcast(ends)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for sample, rows in part.groupby("sample"):
                own = known.value[int(sample)]
                step = max(1, (1 << 20) // (len(SHARES) if few else len(own["lo"])))
                for a in range(0, len(rows), step):
                    g = rows.iloc[a : a + step].copy()
                    given = g["xmin"].to_numpy(), g["n"].to_numpy(float), g["alpha"].to_numpy(), own, discrete
                    g["low"], g["high"] = (least(*given), np.inf) if few else bounds(*given)
                    yield g

    kept = candidates.drop("low", "high")
    return kept.mapInPandas(run, "sample int, xmin double, n long, logs double, alpha double, low double, high double")


def distances(v: DataFrame, asked: pd.DataFrame, discrete: bool) -> pd.DataFrame:
    """The exact distance of a few candidates of each sample, in one pass over the values."""
    known = v.sparkSession.sparkContext.broadcast({int(k): g for k, g in asked.groupby("sample")})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, float], float] = {}
        for part in parts:
            for sample, rows in part.groupby("sample"):
                g = known.value.get(int(sample))
                for a in range(0, len(rows) if g is not None else 0, 1 << 14):
                    own = rows.iloc[a : a + (1 << 14)]
                    ends = {"lo": own["value"].to_numpy(), "hi": own["value"].to_numpy(), "from_lo": own["n"].to_numpy(float), "beyond": (own["n"] - own["c"]).to_numpy(float)}
                    low, _ = bounds(g["xmin"].to_numpy(), g["n"].to_numpy(float), g["alpha"].to_numpy(), ends, discrete)
                    for x, d in zip(g["xmin"].tolist(), low.tolist(), strict=True):
                        best[int(sample), x] = max(d, best.get((int(sample), x), 0.0))
        yield pd.DataFrame([(*k, d) for k, d in best.items()], columns=["sample", "xmin", "ks"]).astype({"sample": "int32", "xmin": float, "ks": float})

    found = v.select("sample", "value", "c", "n").mapInPandas(run, "sample int, xmin double, ks double")
    return found.groupBy("sample", "xmin").agg(F.max("ks").alias("ks")).toPandas()


def fits(counts: DataFrame, discrete: bool, finite_size: bool, small: bool, grid: tuple[float, float, float]) -> list[tuple]:
    """(sample, alpha, xmin, ks, log likelihood, n) of each sample of counts (sample, value, c)."""
    steps = np.round(np.arange(grid[0], grid[2] + grid[1] / 2, grid[1]), 10)
    v = cut(suffix_sums(counts))
    ends = block_ends(v, FINE)
    if not ends:
        return []

    def candidates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            xmin, n, logs = (rows[c].to_numpy(float) for c in ("value", "n", "logs"))
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = grid_exponents(n, logs, xmin, steps) if discrete else 1 + n / (logs - n * np.log(xmin))
            yield pd.DataFrame({"sample": rows["sample"], "xmin": xmin, "n": rows["n"], "logs": logs, "alpha": alpha})

    # The largest value of a sample is no candidate: no other value would be left.
    left = v.filter("n > c").mapInPandas(candidates, "sample int, xmin double, n long, logs double, alpha double")
    left = cut(left.filter("alpha > 1 AND alpha < double('infinity')"))
    spark = v.sparkSession
    if not small:
        first = left.filter("(alpha - 1) / sqrt(n) > 0.1").groupBy("sample").agg(F.min("xmin").alias("stop"))
        left = cut(left.join(first, "sample", "left").filter("stop IS NULL OR xmin < stop").drop("stop"))

    def pruned(rows: DataFrame, best: dict[int, float]) -> DataFrame:
        limits = spark.createDataFrame([(k, x + SLACK) for k, x in best.items()], "sample int, least double")  # a row a sample
        return rows.join(F.broadcast(limits), "sample", "left").filter("least IS NULL OR low <= least").drop("least")

    def lowest(rows: DataFrame, most: int) -> DataFrame:
        order = F.row_number().over(Window.partitionBy("sample").orderBy("low", "xmin"))
        return rows.withColumn("k", order).filter(F.col("k") <= most)

    def highs(rows: DataFrame) -> dict[int, float]:
        return {r[0]: r[1] for r in rows.groupBy("sample").agg(F.min("high")).collect()}

    left = cut(bounded(left, ends, discrete, few=True))
    first = cut(bounded(lowest(left, FIRST).drop("k"), ends, discrete))
    limits = highs(first)
    asked = lowest(first, BATCH).toPandas()
    if len(asked):  # a limit that a block's width does not blur
        for r in distances(v, asked, discrete).itertuples():
            limits[r.sample] = min(limits[r.sample], r.ks)
    left = pruned(left, limits)
    left = cut(bounded(left, ends, discrete))
    left = cut(pruned(left, highs(left)))
    best: dict[int, tuple] = {}
    while True:
        asked = lowest(left, BATCH).toPandas()
        if not len(asked):
            break
        for r in asked.merge(distances(v, asked, discrete), on=["sample", "xmin"]).itertuples():
            own = (r.ks, r.xmin, r.n, r.alpha, r.logs)
            best[r.sample] = min(best.get(r.sample, own), own)
        done = spark.createDataFrame(asked[["sample", "xmin"]].astype({"sample": "int32"}), "sample int, xmin double")
        left = cut(pruned(left.join(F.broadcast(done), ["sample", "xmin"], "left_anti"), {k: x[0] for k, x in best.items()}))
    out = []
    for sample, (ks, xmin, n, alpha, logs) in sorted(best.items()):
        if finite_size:
            alpha = alpha * (n - 1) / n + 1 / n
        norm = float(np.log(hurwitz(alpha, xmin))) if discrete else -np.log(alpha - 1) - (alpha - 1) * np.log(xmin)
        out.append((int(sample), float(alpha), float(xmin), float(ks), float(-alpha * logs - n * norm), int(n)))
    return out


def positive(values: DataFrame) -> DataFrame:
    return values.select(F.col("value").cast("double").alias("value")).filter("value > 0 AND value < double('infinity')")


def whole(values: DataFrame) -> bool:
    return positive(values).filter("value <> floor(value)").isEmpty()


def power_law(values: DataFrame, finite_size: bool = False, discrete: bool | None = None, small: bool = True, grid: tuple[float, float, float] = GRID) -> DataFrame:
    """alpha, xmin, ks, log_likelihood and n of the power law of the positive values.

    The discrete law is fitted if all values are whole, unless ``discrete`` says otherwise.  Of equal
    distances the smaller xmin counts.  ``finite_size`` corrects alpha for n; without ``small``
    candidates end before the first whose (alpha - 1) / sqrt(n) exceeds 0.1.  Null, infinite and
    non-positive values are left out; fewer than two distinct values give no row.
    """
    kind = whole(values) if discrete is None else discrete
    counts = positive(values).groupBy("value").agg(F.count("*").alias("c")).select(F.lit(0).alias("sample"), "value", "c")
    found = [x[1:] for x in fits(counts, kind, finite_size, small, grid)]
    return values.sparkSession.createDataFrame(found, "alpha double, xmin double, ks double, log_likelihood double, n long")


def resampled(values: DataFrame, samples: int, seed: int) -> DataFrame:
    """(sample, value, c): each distinct value in each sample as often as a Poisson draw of its count."""
    counts = cut(positive(values).groupBy("value").agg(F.count("*").alias("c")).withColumn("h", F.xxhash64("value", F.lit(seed))))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for a in range(0, len(rows), 1024):
                own = rows.iloc[a : a + 1024]
                times = np.stack([np.random.default_rng(h % (1 << 63)).poisson(c, samples) for h, c in zip(own["h"].tolist(), own["c"].tolist(), strict=True)])
                i, j = np.nonzero(times)
                yield pd.DataFrame({"sample": j.astype("int32"), "value": own["value"].to_numpy()[i], "c": times[i, j]})

    return counts.mapInPandas(draw, "sample int, value double, c long")


def power_law_bootstrap(values: DataFrame, samples: int = 100, seed: int = 1, finite_size: bool = False, discrete: bool | None = None, small: bool = True, grid: tuple[float, float, float] = GRID) -> DataFrame:
    """Mean and deviation of alpha, xmin and log likelihood over bootstrap samples, each fitted anew.

    A sample has a Poisson number of each row, so its size varies a little around that of the values
    and rows are never copied.  ``samples`` is the number that had a fit.
    """
    kind = whole(values) if discrete is None else discrete
    found = fits(resampled(values, samples, seed), kind, finite_size, small, grid)
    rows = values.sparkSession.createDataFrame([(x[1], x[2], x[4]) for x in found], "alpha double, xmin double, log_likelihood double")
    columns = [f(c).alias(f"{n}_{c}") for c in rows.columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return rows.agg(*columns, F.count("*").alias("samples"))
