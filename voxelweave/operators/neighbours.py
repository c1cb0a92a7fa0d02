"""Exact neighbours over feature tables (id, features, label): cells around pivots, in rings.

Every training row lies in the cell of its nearest pivot and, within it, in a ring of its distance
to the pivot.  A row x of a ring from ``lo`` to ``hi`` around pivot c is at least d(q, c) - hi and
lo - d(q, c) from a query q, and, as c is its nearest pivot, at least half of d(q, c) less the
distance of q to its own pivot.  A query meets only rings whose bound is not above its radius.  For
the k nearest a first round meets the ring next to each query, whose k-th distance is the radius of
the second; so no row that could be among the k is left out.  Rounding of distances is allowed for.

Ids are distinct within each table.  Rows with null features, or with a null, NaN or infinite
component, take no part; all rows have features of one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Most pivots, and most rings of a cell: the driver and every task hold a number for each ring.
PIVOTS, RINGS = 1024, 256
#: Distances by products are right to this share of the lengths involved.
ROUNDING = 1e-6
FOUND = "id long, near long, label int, d2 double"


@dataclass
class Index:
    """Rows (ring, id, features, label), the pivots, and of each ring its pivot, bounds and number of rows."""

    rows: DataFrame
    pivots: np.ndarray
    cell: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray
    block: int


def usable(rows: DataFrame) -> DataFrame:
    finite = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("features").isNotNull()).filter(finite)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1), 0))


def matrix(features: pd.Series) -> np.ndarray:
    return np.stack(features.to_list()).astype(float)


def build(train: DataFrame, block: int = 4096) -> Index | None:
    """Index of the rows, with about ``block`` rows a ring; None if there are none.

    Pivots are the rows of the smallest hashes of their ids, one for every ``block`` rows up to PIVOTS;
    larger cells get more rings, up to RINGS, and rings beyond ``block`` rows are dealt in parts when
    they meet queries.
    """
    train = usable(train).select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"))
    total = train.count()
    if not total:
        return None
    if total <= block:  # one ring, which every query meets
        return Index(train.select(F.lit(0).alias("ring"), "id", "features", "label"), np.zeros((0, 0)), np.zeros(1, int), np.zeros(1), np.full(1, np.inf), np.array([total]), block)
    some = train.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-total // block))).select("features").toPandas()
    pivots = np.unique(matrix(some["features"]), axis=0)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            d = distances(matrix(part["features"]), pivots)
            at = d.argmin(axis=1)
            yield part.assign(cell=at.astype("int32"), d=d[np.arange(len(at)), at])

    rows = cut(train.mapInPandas(placed, "id long, features array<double>, label int, cell int, d double"))
    shares = F.percentile_approx("d", [i / RINGS for i in range(RINGS + 1)], 10_000)
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), shares.alias("q")).orderBy("cell").collect()  # a row a pivot
    start, edges, cell, lo, hi = np.zeros(len(pivots), int), {}, [], [], []
    for r in cells:
        rings = min(RINGS, 1 << int(np.log2(max(1, r["n"] / block))))
        inner = np.unique([x for x in r["q"][RINGS // rings : RINGS : RINGS // rings] if r["lo"] < x <= r["hi"]])
        start[r["cell"]], edges[r["cell"]] = len(cell), inner
        cell += [r["cell"]] * (len(inner) + 1)
        lo += [r["lo"], *inner]
        hi += [*inner, r["hi"]]

    def ringed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            ring = np.zeros(len(part), "int32")
            for c, at in part.groupby("cell").indices.items():
                ring[at] = start[c] + np.searchsorted(edges[c], part["d"].to_numpy()[at], side="right")
            yield part.assign(ring=ring)[["ring", "id", "features", "label"]]

    rows = cut(rows.mapInPandas(ringed, "ring int, id long, features array<double>, label int"))
    n = np.zeros(len(cell), int)
    for r in rows.groupBy("ring").count().collect():  # a row a ring
        n[r["ring"]] = r["count"]
    return Index(rows, pivots, np.array(cell), np.array(lo), np.array(hi), n, block)


def meetings(index: Index, query: DataFrame, k: int | None = None) -> DataFrame:
    """(id, fq, ring, parts, radius): the rings that each query meets, those within its ``radius``.

    With ``k``, the ring next to each query, and a radius that is sure to hold k rows, from the
    numbers and outer bounds of the rings.
    """
    if len(index.n) == 1:
        return query.select("id", "fq", F.lit(0).alias("ring"), F.lit(1).alias("parts"), F.lit(float("inf")).alias("radius") if k else "radius")
    pivots, cell, lo, hi, n = index.pivots, index.cell, index.lo, index.hi, index.n
    reach = float(np.sqrt((pivots**2).sum(axis=1)).max() + hi[np.isfinite(hi)].max(initial=0.0))
    step, parts = max(1, 4_000_000 // len(cell)), (-(-n // index.block)).astype("int32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), step):
                part = batch.iloc[a : a + step]
                x = matrix(part["fq"])
                d = distances(x, pivots)
                slack = ROUNDING * (np.sqrt((x * x).sum(axis=1)) + reach)
                apart = np.maximum(np.maximum(d[:, cell] - hi, lo - d[:, cell]), (d[:, cell] - d.min(axis=1)[:, None]) / 2)
                if k is None:
                    i, ring = np.nonzero((apart <= (part["radius"].to_numpy() + slack)[:, None]) & (n > 0))
                    radius = part["radius"].to_numpy()[i]
                else:
                    i, ring = np.arange(len(x)), np.where(n > 0, apart, np.inf).argmin(axis=1)
                    far = d[:, cell] + hi
                    order = far.argsort(axis=1)
                    held = n[order].cumsum(axis=1) >= k
                    at = np.take_along_axis(far, order, 1)[i, held.argmax(axis=1)] + slack
                    radius = np.where(held.any(axis=1), at, np.inf)
                yield pd.DataFrame({"id": part["id"].to_numpy()[i], "fq": part["fq"].to_numpy()[i], "ring": ring.astype("int32"), "parts": parts[ring], "radius": radius})

    fields = ["id", "fq"] + ["radius"] * (k is None)
    return query.select(*fields).mapInPandas(run, "id long, fq array<double>, ring int, parts int, radius double")


def compared(index: Index, met: DataFrame, k: int | None) -> DataFrame:
    """Rows within the radius of each query in the rings that it meets, (id, near, label, d2).

    With ``k`` the k nearest of each part of a ring.  A ring's rows and its queries are dealt in
    parts of about ``index.block``, so a group of equal rows makes many small tasks and not a large one.
    """
    asked = met.groupBy("ring").agg(F.max("parts").alias("parts"), F.ceil(F.count("*") / index.block).cast("int").alias("asks"))  # a row a ring
    share = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asked = F.broadcast(asked)  # at most PIVOTS * RINGS rows of three numbers
    right = index.rows.join(asked, "ring").withColumn("part", share("parts")).withColumn("ask", every("asks")).select("ring", "part", "ask", "id", "features", "label")
    left = met.drop("parts").join(asked, "ring").withColumn("ask", share("asks")).withColumn("part", every("parts")).select("ring", "part", "ask", "id", "fq", "radius")

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(t):
            x, y = matrix(q["fq"]), matrix(t["features"])
            radius, slack = q["radius"].to_numpy(), ROUNDING * (np.sqrt((x * x).sum(axis=1)) + np.sqrt((y * y).sum(axis=1)).max())
            for a in range(0, len(x), 256):
                d = distances(x[a : a + 256], y)
                top = radius[a : a + 256]
                if k is not None and k < len(y):
                    top = np.minimum(top, np.partition(d, k - 1, axis=1)[:, k - 1] + slack[a : a + 256])
                i, j = np.nonzero(d <= (top + slack[a : a + 256])[:, None])
                for b in range(0, len(i), 65536):  # distances of those that are near, from differences
                    p, r = i[b : b + 65536] + a, j[b : b + 65536]
                    d2 = np.cumsum((x[p] - y[r]) ** 2, axis=1)[:, -1] if x.shape[1] else np.zeros(len(p))
                    out.append(pd.DataFrame({"id": q["id"].to_numpy()[p], "near": t["id"].to_numpy()[r], "label": t["label"].to_numpy()[r], "d2": d2}))
        if not out:
            return pd.DataFrame({"id": [], "near": [], "label": [], "d2": []}).astype({"id": "int64", "near": "int64", "label": "float64", "d2": "float64"})
        found = pd.concat(out)
        return found if k is None else found.sort_values(["id", "d2", "near"]).groupby("id").head(k)

    keys = ["ring", "part", "ask"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, FOUND)


def asked(query: DataFrame) -> DataFrame:
    return usable(query).select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("fq"))  # own columns, if it is of the training rows


def knn(train: DataFrame, query: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The k nearest training rows of every query row, (id, rank, near, label, d2), by squared distance, then id.

    A query has fewer if there are fewer training rows.
    """
    index = build(train, block)
    q = asked(query)
    if index is None or k < 1:
        return q.sparkSession.createDataFrame([], "id long, rank int, near long, label int, d2 double")
    if len(index.n) == 1:
        met = meetings(index, q, k)
    else:
        first = cut(meetings(index, q, k))
        found = compared(index, first, k).groupBy("id").agg(F.array_sort(F.collect_list("d2")).alias("d"))  # k a part
        kth = found.filter(F.size("d") >= k).select("id", F.sqrt(F.element_at("d", k)).alias("kth"))
        radius = first.join(kth, "id", "left").select("id", "fq", F.least("radius", "kth").alias("radius"))
        met = cut(meetings(index, radius))
    found = compared(index, met, k)
    top = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "near", "label"))), 1, k).alias("top"))  # k rows a part
    return top.select("id", F.posexplode("top").alias("rank", "n")).select("id", (F.col("rank") + 1).alias("rank"), "n.near", "n.label", "n.d2")


def within_radius(train: DataFrame, query: DataFrame, radius: float, k: int | None = None, block: int = 4096) -> DataFrame:
    """Training rows within a radius of every query row, (id, near, d2), the k nearest if given."""
    index = build(train.select("id", "features", F.lit(None).cast("int").alias("label")), block)
    if index is None:
        return query.sparkSession.createDataFrame([], "id long, near long, d2 double")
    met = meetings(index, asked(query).withColumn("radius", F.lit(float(radius))))
    found = compared(index, met if len(index.n) == 1 else cut(met), k).select("id", "near", "d2").filter(F.col("d2") <= radius * radius)
    if k is None:
        return found
    w = Window.partitionBy("id").orderBy("d2", "near")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")
