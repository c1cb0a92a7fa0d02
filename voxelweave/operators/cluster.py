"""Clustering and classification over feature tables (id, features, label); neighbours are in ``neighbours``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut


def squared_distances(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of features as one array, without a Python object a row."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), len(flat) // len(column) if len(column) else 0)


def assigned_sums(rows: DataFrame, centres: np.ndarray, squares: bool = False) -> dict[int, tuple[int, np.ndarray, np.ndarray | None]]:
    """Number, sum of features (and of squares) and nothing else of the rows nearest to each centre.

    Tasks sum first and the sums meet in one aggregation, so the driver gets a row a centre however
    many partitions there are.
    """
    k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, more, n = np.zeros((k, d)), np.zeros((k, d)), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column("features"))
            own = squared_distances(centres, x).argmin(axis=1)[:, None] == np.arange(k)
            total += own.T.astype(float) @ x
            if squares:
                more += own.T.astype(float) @ (x * x)
            n += own.sum(axis=0)
        sums = np.concatenate([total, more], axis=1) if squares else total
        yield pa.RecordBatch.from_pydict({"c": pa.array(range(k), pa.int32()), "n": pa.array(n), "s": pa.array(list(sums), pa.list_(pa.float64()))})

    width = 2 * d if squares else d
    found = rows.select("features").mapInArrow(run, "c int, n long, s array<double>").filter("n > 0")
    sums = found.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]).collect()  # a row a centre
    return {r["c"]: (r["n"], np.array(r[2 : 2 + d]), np.array(r[2 + d :]) if squares else None) for r in sums}


def seeded_centres(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """k-means++ seeds: each next one drawn with a chance in proportion to the distance from the others.

    A row's draw is an exponential variable by its hash over its distance, and the least one wins, so
    a seed is one aggregation; a row at a seed is never drawn again.
    """
    first = rows.agg(F.min_by("features", F.xxhash64("id", F.lit(seed)))).first()[0]  # one row
    if first is None:
        return np.zeros((0, 0))
    centres = [np.array(first, float)]

    def far(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    away = np.sqrt(squared_distances(c, matrix(batch.column("features"))).min(axis=1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away)], ["id", "features", "d"])

        return run

    while len(centres) < k:
        d = rows.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")).mapInArrow(far(np.array(centres)), "id long, features array<double>, d double")
        u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(len(centres))), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        best = d.filter("d > 1e-9").agg(F.min_by("features", -F.log(u) / F.col("d"))).first()[0]  # one row
        if best is None:
            break
        centres.append(np.array(best, float))
    return np.array(centres)


def kmeans(rows: DataFrame, k: int, rounds: int | None = None, seed: int = 1, tolerance: float = 1e-6, centres: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """Assignments (id, cluster) and centres, by Lloyd's rounds from k-means++ seeds or given centres.

    Rounds go on until no centre moves by ``tolerance``, or for ``rounds`` if a number is given.  A
    cluster that loses its rows keeps its centre; fewer distinct rows than k give fewer clusters.
    """
    rows = cut(rows.select("id", "features"))  # every round reads it
    centres = seeded_centres(rows, k, seed) if centres is None else np.asarray(centres, float)
    done = 0
    while len(centres) and (rounds is None or done < rounds):
        new = centres.copy()
        for i, (n, s, _) in assigned_sums(rows, centres).items():
            new[i] = s / n
        moved, centres, done = np.sqrt(((new - centres) ** 2).sum(axis=1)).max(), new, done + 1
        if moved < tolerance:
            break
    return assigned(rows, centres), centres


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cluster): the nearest centre of every row; the centres go to the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = squared_distances(centres, matrix(batch.column("features"))).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at.astype(np.int32))], ["id", "cluster"])

    return rows.select(F.col("id").cast("long").alias("id"), "features").mapInArrow(run, "id long, cluster int")


def isodata(rows: DataFrame, k: int, least: int = 5, split: float = 1.0, lump: float = 0.5, pairs: int = 2, rounds: int = 10, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """ISODATA: k-means whose clusters are dropped, split and lumped between rounds.

    Clusters of fewer than ``least`` rows go; one whose largest deviation is over ``split`` becomes two
    if there are few clusters or it is looser than average and large; then the closest pairs, at most
    ``pairs``, nearer than ``lump`` become one.  Every other round splits, as do all while there are no
    more than k / 2 clusters.
    """
    centres = seeded_centres(rows, k, seed)
    for number in range(1, rounds + 1):
        sums = {i: v for i, v in assigned_sums(rows, centres, squares=True).items() if v[0] >= least}
        if not sums:
            break
        kept = sorted(sums)
        n = np.array([sums[i][0] for i in kept])
        centres = np.array([sums[i][1] / sums[i][0] for i in kept])
        spread = np.sqrt(np.maximum(np.array([sums[i][2] / sums[i][0] for i in kept]) - centres**2, 0))
        if number == rounds:
            break
        loose = np.sqrt((spread**2).sum(axis=1))
        average = (loose * n).sum() / n.sum()
        if len(centres) <= k / 2 or (number % 2 and len(centres) < 2 * k):
            new = []
            for c, s, m, q in zip(centres, spread, n, loose, strict=True):
                axis = int(s.argmax())
                if s[axis] > split and ((q > average and m > 2 * (least + 1)) or len(centres) <= k / 2):
                    step = np.zeros_like(c)
                    step[axis] = s[axis] / 2
                    new += [c + step, c - step]
                else:
                    new.append(c)
            centres = np.array(new)
        else:
            d = np.sqrt(squared_distances(centres, centres))
            order = sorted((d[i, j], i, j) for i in range(len(d)) for j in range(i) if d[i, j] < lump)
            used: set[int] = set()
            taken = [(i, j) for _, i, j in order if not (i in used or j in used or used.update((i, j)))][:pairs]
            gone = {x for p in taken for x in p}
            merged = [(centres[i] * n[i] + centres[j] * n[j]) / (n[i] + n[j]) for i, j in taken]
            centres = np.array([c for i, c in enumerate(centres) if i not in gone] + merged)
    return assigned(rows, centres), centres


def affinity_propagation(similarities: DataFrame, preference: float | None = None, damping: float = 0.5, rounds: int = 50) -> DataFrame:
    """(node, exemplar) from similarities (i, k, s) of different nodes, by message passing over the edges.

    A round's responsibilities need the two best sums of a row, its availabilities the positive sum of
    a column: both are aggregations, so a sparse graph costs its edges.  The preference of a node to be
    an exemplar is the least of the rows' medians if none is given.
    """
    from .graph import cut

    if preference is None:
        preference = similarities.groupBy("i").agg(F.percentile("s", 0.5).alias("m")).agg(F.min("m")).first()[0]  # one number
    nodes = similarities.select(F.col("i").alias("node")).union(similarities.select("k")).distinct()
    own = nodes.select(F.col("node").alias("i"), F.col("node").alias("k"), F.lit(float(preference or 0.0)).alias("s"))
    m = cut(similarities.select("i", "k", "s").unionByName(own).withColumns({"r": F.lit(0.0), "a": F.lit(0.0)}))
    for _ in range(rounds):
        first = F.max(F.struct((F.col("a") + F.col("s")).alias("v"), "k"))
        best = m.groupBy("i").agg(first.alias("one"))
        other = m.join(best, "i").filter(F.col("k") != F.col("one.k")).groupBy("i").agg(F.max(F.col("a") + F.col("s")).alias("two"))
        with_best = m.join(best, "i").join(other, "i", "left")
        rest = F.when(F.col("k") == F.col("one.k"), F.coalesce("two", F.lit(0.0))).otherwise(F.col("one.v"))
        r = damping * F.col("r") + (1 - damping) * (F.col("s") - rest)
        m = cut(with_best.select("i", "k", "s", r.alias("r"), "a"))
        column = m.groupBy("k").agg(F.sum(F.when(F.col("i") != F.col("k"), F.greatest("r", F.lit(0.0))).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("i") == F.col("k"), F.col("r")).otherwise(0.0)).alias("rkk"))
        support = F.col("p") - F.greatest("r", F.lit(0.0))
        new = F.when(F.col("i") == F.col("k"), F.col("p")).otherwise(F.least(F.lit(0.0), F.col("rkk") + support))
        m = cut(m.join(column, "k").select("i", "k", "s", "r", (damping * F.col("a") + (1 - damping) * new).alias("a")))
    chosen = m.filter("i = k AND r + a > 0").select("k")
    found = m.join(chosen, "k", "left_semi").groupBy("i").agg(F.max_by("k", F.struct((F.col("i") == F.col("k")).alias("own"), "s", (-F.col("k")).alias("t"))).alias("exemplar"))
    return nodes.join(found.withColumnRenamed("i", "node"), "node", "left")


def spectral(edges: DataFrame, k: int, seed: int = 1, sweeps: int = 60) -> DataFrame:
    """(node, cluster): k-means of the leading eigenvectors of the normalised adjacency I + D^-1/2 A D^-1/2.

    The vectors come from a block power iteration whose products are joins; only k x k matrices reach
    the driver.
    """
    from .graph import cut, laplacian

    entries = laplacian(edges, normalised=True)
    # 2 I - L has the same vectors with the order reversed and no negative value.
    entries = cut(entries.select("i", "j", (F.when(F.col("i") == F.col("j"), 2.0).otherwise(0.0) - F.col("value")).alias("value")))
    names = [f"v{c}" for c in range(k)]
    block = entries.select("i").distinct().select("i", *[(F.xxhash64("i", F.lit(seed), F.lit(c)) / F.lit(float(1 << 63))).alias(n) for c, n in enumerate(names)])
    for _ in range(sweeps):
        moved = entries.join(block.withColumnRenamed("i", "j"), "j")
        block = cut(moved.groupBy("i").agg(*[F.sum(F.col("value") * F.col(n)).alias(n) for n in names]))
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        dots = block.agg(*[F.sum(F.col(names[a]) * F.col(names[b])).alias(f"d{a}_{b}") for a, b in pairs]).first()  # k * k numbers
        gram = np.zeros((k, k))
        for (a, b), x in zip(pairs, dots, strict=True):
            gram[a, b] = gram[b, a] = x
        turn = np.linalg.inv(np.linalg.cholesky(gram + 1e-14 * np.trace(gram) * np.eye(k))).T
        block = block.select("i", *[sum((F.col(names[a]) * float(turn[a, b]) for a in range(k)), F.lit(0.0)).alias(names[b]) for b in range(k)])
    norm = F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)))
    rows = cut(block.select(F.col("i").alias("id"), F.array(*[F.col(n) / F.greatest(norm, F.lit(1e-300)) for n in names]).alias("features")))
    return kmeans(rows, k, seed=seed)[0].withColumnRenamed("id", "node")


def cluster_search(edges: DataFrame, thresholds: list[float], ks: list[int], repeats: int = 3) -> DataFrame:
    """(threshold, k, modularity): mean modularity of spectral clusters over a grid of parameters."""
    from .graph import cut, modularity, thresholded

    out = []
    for t in thresholds:
        e = cut(thresholded(edges, t))
        for k in ks:
            q = [modularity(e, spectral(e, k, seed)).first()["q"] for seed in range(1, repeats + 1)]
            out.append((float(t), k, float(np.mean([x for x in q if x is not None] or [0.0]))))
    return edges.sparkSession.createDataFrame(out, "threshold double, k int, modularity double")


def relabelled(labels: DataFrame, reference: DataFrame) -> DataFrame:
    """Labels (voxel_id, x, y, z, label) named after the reference label of the nearest centroid."""
    centre = lambda df, name: df.filter("label >= 1").groupBy(F.col("label").alias(name)).agg(*[F.avg(c).alias(f"{name}_{c}") for c in "xyz"])
    a, b = centre(labels, "own"), centre(reference, "ref")  # a row a label
    d = sum((F.pow(F.col(f"own_{c}") - F.col(f"ref_{c}"), 2) for c in "xyz"), F.lit(0.0))
    near = a.join(F.broadcast(b)).groupBy("own").agg(F.min_by("ref", F.struct(d.alias("d"), "ref")).alias("new"))
    return labels.join(F.broadcast(near), labels["label"] == near["own"], "left").select("voxel_id", F.coalesce("new", "label").alias("label"))


def train_table(images: DataFrame, labels: DataFrame, geometry: bool = True) -> DataFrame:
    """(id, features, label) of labelled voxels: values of all images, then, if asked, offsets from the
    mask's centre, distance and the three angles.  images has voxel_id, image_id, x, y, z, value."""
    named = images.join(labels, "voxel_id")
    centre = named.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])  # one row
    rows = named.groupBy("voxel_id", "x", "y", "z", "label").agg(F.array_sort(F.collect_list(F.struct("image_id", "value"))).alias("v"))  # a value an image
    values = F.transform("v", lambda s: s["value"])
    if not geometry:
        return rows.select(F.col("voxel_id").alias("id"), values.alias("features"), "label")
    d = {c: F.col(c) - F.col(f"m{c}") for c in "xyz"}
    far = F.sqrt(sum((v * v for v in d.values()), F.lit(0.0)))
    angles = [F.atan2(d["y"], d["x"]), F.atan2(d["z"], d["x"]), F.atan2(d["z"], d["y"])]
    return rows.crossJoin(F.broadcast(centre)).select(F.col("voxel_id").alias("id"), F.concat(values, F.array(*d.values(), far, *angles)).alias("features"), "label")


def classify(neighbours: DataFrame) -> DataFrame:
    """Most frequent label among the neighbours, the lowest on ties, and its share."""
    votes = neighbours.groupBy("id", "label").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("label")).alias("k")))
    return votes.groupBy("id").agg(best.alias("b"), F.sum("n").alias("all")).select("id", (-F.col("b.k")).alias("label"), (F.col("b.n") / F.col("all")).alias("share"))


def z_scored(rows: DataFrame) -> DataFrame:
    """Features in population deviations from their mean, per column; 0 for constant columns."""
    flat = rows.select("id", F.posexplode("features").alias("k", "v"))
    stats = flat.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0)
    return flat.join(F.broadcast(stats), "k").select("id", "k", z.alias("z"))  # a row a column
