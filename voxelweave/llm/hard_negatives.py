"""Hard negatives by maximum inner product search over ball trees.

Vectors of a label are dealt into parts, and each part becomes one tree of balls.  For an anchor a
and a ball of centre c and radius r, every inner product lies within a.c - |a| r and a.c + |a| r.
A task meets one tree with some anchors and walks it from the root: a ball goes for the anchors
whose score window it misses, and for those whose k-th score so far lies strictly above its bound.
Trees of the anchor's label give the positives; each positive's score then sets a window, with
which the anchor meets the trees of all other labels.  The best rows of all trees are the result.

Bounds are floating point with a margin; scores are exact whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from .scratch import Scratch, ensure_columns, read_table

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in percent of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Vectors of a tree and of a leaf, and anchors that meet a tree in one task.
TREE, LEAF, ANCHORS = 4096, 64, 2048

TREE_FIELDS = "tree long, label int, first array<int>, last array<int>, left array<int>, right array<int>, centre array<double>, radius array<double>, uid array<long>, vec_id array<long>, q array<long>"
FOUND = "uid long, anchor_id long, nth int, other_uid long, other_id long, score long"


def split_balls(q: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple]]:
    """Order of the rows and the balls (first, last, left, right, centre, radius) over it."""
    order = np.arange(len(q))
    balls: list[list] = []
    todo = [(0, len(q), -1, 0)]
    while todo:
        a, b, parent, child = todo.pop()
        rows = q[order[a:b]]
        centre = rows.mean(axis=0)
        far = ((rows - centre) ** 2).sum(axis=1)
        radius = float(np.sqrt(far.max()))
        me = len(balls)
        balls.append([a, b, -1, -1, centre, radius])
        if parent >= 0:
            balls[parent][child] = me
        if b - a > leaf and radius > 0:
            one = rows[far.argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            side = np.argpartition(rows @ (other - one), (b - a) // 2)
            order[a:b] = order[a:b][side]
            middle = a + (b - a) // 2
            todo += [(a, middle, me, 2), (middle, b, me, 3)]
    return order, balls


def tree_builder(dim: int, leaf: int = LEAF) -> Callable:
    def build(table: pa.Table) -> pa.Table:
        q = table.column("q").combine_chunks().flatten().to_numpy().reshape(table.num_rows, dim)
        order, balls = split_balls(q.astype(np.float64), leaf)
        table = table.take(pa.array(order))
        first, last, left, right, centre, radius = zip(*balls, strict=True)
        values = {
            "tree": table.column("tree")[0].as_py(), "label": table.column("label")[0].as_py(), "first": first, "last": last, "left": left, "right": right,
            "centre": np.concatenate(centre) if dim else [], "radius": radius, "uid": table.column("uid").to_pylist(), "vec_id": table.column("vec_id").to_pylist(), "q": q[order].ravel(),
        }
        kinds = {"tree": pa.int64(), "label": pa.int32(), "centre": pa.list_(pa.float64()), "radius": pa.list_(pa.float64())}
        kinds |= {c: pa.list_(pa.int32()) for c in ("first", "last", "left", "right")} | {c: pa.list_(pa.int64()) for c in ("uid", "vec_id", "q")}
        return pa.table({c: pa.array([values[c]], kinds[c]) for c in values})

    return build


def walk(a: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray, balls: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """(search, row, score) of at least the k best rows of each search within its window, ties kept.

    ``a`` are anchors; search i is anchor ``of[i]`` with scores from low[i] to high[i].
    """
    plain = a.astype(np.float64)
    norm = np.sqrt((plain**2).sum(axis=1))[:, None]
    middle = plain @ balls["centre"].T
    reach = norm * balls["radius"]
    margin = 1e-6 + 1e-9 * norm * (np.sqrt((balls["centre"] ** 2).sum(axis=1)) + balls["radius"])
    most, least = middle + reach + margin, middle - reach - margin
    none = -np.inf
    best = np.full((len(of), k), none, dtype=q.dtype)
    out = []
    todo = [(0, np.arange(len(of)))]
    while todo:
        ball, live = todo.pop()
        bound = most[of[live], ball]
        live = live[(bound >= best[live, 0]) & (bound >= low[live]) & (least[of[live], ball] <= high[live])]
        if not len(live):
            continue
        if balls["left"][ball] >= 0:
            pair = [balls["left"][ball], balls["right"][ball]]
            pair.sort(key=lambda x: most[of[live], x].mean())  # noqa: B023
            todo += [(x, live) for x in pair]
            continue
        begin = balls["first"][ball]
        anchors, mine = np.unique(of[live], return_inverse=True)
        s = (a[anchors] @ q[begin : balls["last"][ball]].T)[mine]
        good = (s >= low[live][:, None]) & (s <= high[live][:, None])
        top = np.concatenate([best[live], np.where(good, s, none)], axis=1)
        best[live] = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :]
        i, j = np.nonzero(good & (s >= best[live, 0][:, None]))
        out.append((live[i], begin + j, s[i, j]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), best[:0, 0]
    i, j, s = (np.concatenate(x) for x in zip(*out, strict=True))
    kept = s >= best[i, 0]
    return i[kept], j[kept], s[kept]


def percent_window(scores: list[int], low: int, high: int) -> tuple[list[int], list[int]]:
    return [-(-low * s // 100) for s in scores], [high * s // 100 for s in scores]


def searcher(dim: int, k: int, window: tuple[int, int] | None) -> Callable:
    """The k best rows of a tree for each anchor, or for each window (nth, score) that it carries."""

    def search(trees: pa.Table, anchors: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(6)]
        if trees.num_rows and anchors.num_rows:
            tree = {c: trees.column(c).combine_chunks().flatten() for c in ("first", "last", "left", "right", "centre", "radius", "uid", "vec_id", "q")}
            balls = {c: tree[c].to_numpy() for c in ("first", "last", "left", "right", "radius")}
            balls["centre"] = tree["centre"].to_numpy().reshape(len(balls["radius"]), dim)
            q = tree["q"].to_numpy().reshape(len(tree["uid"]), dim)
            a = anchors.column("q").combine_chunks().flatten().to_numpy().reshape(anchors.num_rows, dim)
            n = anchors.num_rows
            exact = dim * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) < 2**53
            a, q = (x.astype(np.float64 if exact else object) for x in (a, q))
            if window:
                asked = anchors.column("asked").to_pylist()
                of = np.repeat(np.arange(n), [len(x) for x in asked])
                nth = [y["nth"] for x in asked for y in x]
                low, high = (np.array(x, dtype=a.dtype) for x in percent_window([y["score"] for x in asked for y in x], *window))
            else:
                of, nth = np.arange(n), [0] * n
                low, high = np.full(n, -np.inf), np.full(n, np.inf)
            i, j, s = walk(a, of, low, high, q, balls, k)
            ids = tree["vec_id"].to_pandas()
            none = ids.isna().to_numpy()[j]
            vec = tree["vec_id"].fill_null(0).to_numpy()[j]
            order = np.lexsort((tree["uid"].to_numpy()[j], vec, none, -s, i))
            i, j, s = i[order], j[order], s[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, s = i[place < k], j[place < k], s[place < k]
            most = (1 << 63) - 1
            columns = [
                anchors.column("uid").combine_chunks().take(pa.array(of[i])), anchors.column("anchor_id").combine_chunks().take(pa.array(of[i])), [nth[x] for x in i.tolist()],
                tree["uid"].take(pa.array(j)), tree["vec_id"].take(pa.array(j)), [max(-most, min(most, int(x))) for x in s.tolist()],
            ]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["uid", "anchor_id", "nth", "other_uid", "other_id", "score"]
        return pa.table({c: x if isinstance(x, pa.Array) else pa.array(x, t) for c, x, t in zip(names, columns, kinds, strict=True)})

    return search


def ranked(rows: DataFrame, most: int, *by: str) -> DataFrame:
    order = Over.partitionBy(*by).orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other_uid")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scratch: Scratch | None = None
) -> DataFrame:
    """For the rows that ``anchor`` marks: their best rows of the same label, and for each of these
    the best rows of other labels with ``low`` to ``high`` percent of its score.

    A component x counts as floor(256 x).  Rows with a null label or vector, or a null or
    non-finite component, take no part; a shorter vector ends in zeros.  Repeated rows count each:
    an anchor's other rows include its own repeats, each repeat of an anchor has results of its
    own, and rows that tie in all else are taken in any order.  A null vec_id comes last among
    equal scores.  Other columns are ignored; an empty table gives no rows.  Scores beyond 2 ** 53
    are computed with Python's whole numbers and held to 64 bits.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "negatives")
    data = ensure_columns(vectors, vec_id="long", label="int", embedding="array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    data = data.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    data = data.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("q"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    data = scratch.put(data, "vectors")
    dim = data.agg(F.max(F.size("q"))).first()[0] or 0
    data = data.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("q"))))

    # Of rows with one label and vector only the first can be among the best: no others are indexed.
    equal = Over.partitionBy("label", "q").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    index = data.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= max(positives + 1, negatives)).drop("nth", "asks")
    index = scratch.put(index, "index")
    sizes = index.groupBy("label").agg(F.count("*").alias("n"))
    sizes = sizes.select("label", F.ceil(F.col("n") / TREE).cast("long").alias("parts"))
    sizes = scratch.put(sizes.withColumn("before", F.sum("parts").over(Over.orderBy("label")) - F.col("parts")), "sizes")
    dealt = index.join(sizes, "label").withColumn("tree", F.col("before") + F.pmod(F.xxhash64("uid"), "parts"))
    trees = scratch.put(dealt.select("tree", "label", "uid", "vec_id", "q").groupBy("tree").applyInArrow(tree_builder(dim), TREE_FIELDS), "trees")
    asking = data.filter("asks").select("uid", F.col("vec_id").alias("anchor_id"), "label", "q")
    n_trees, n_anchors = sizes.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0], asking.count()
    chunks = max(1, -(-n_anchors // ANCHORS))
    chunk = F.pmod(F.xxhash64("uid"), F.lit(chunks)).alias("chunk")
    there = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    own = F.explode(F.sequence("before", F.col("before") + F.col("parts") - 1)).alias("tree")
    close = asking.join(sizes, "label").select("uid", "anchor_id", "q", chunk, own)
    met = there.groupBy("tree", "chunk").cogroup(close.groupBy("tree", "chunk")).applyInArrow(searcher(dim, positives + 1, None), FOUND)
    near = ranked(met.filter("uid <> other_uid"), positives, "uid").select("uid", "anchor_id", F.col("rank").alias("nth"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = scratch.put(near, "positives")

    asked = near.groupBy("uid").agg(F.collect_list(F.struct("nth", F.col("positive_score").alias("score"))).alias("asked"))
    away = asking.join(asked, "uid").select("uid", "anchor_id", "label", "q", "asked", chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_trees - 1)).cast("long"))).alias("tree"))
    away = away.join(sizes, "label").filter("tree < before OR tree >= before + parts").select("uid", "anchor_id", "q", "asked", "tree", "chunk")
    met = there.groupBy("tree", "chunk").cogroup(away.groupBy("tree", "chunk")).applyInArrow(searcher(dim, negatives, (low, high)), FOUND)
    hard = ranked(met, negatives, "uid", "nth").select("uid", "nth", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(near, ["uid", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings`` for the rows whose vec_id is divisible by 50; nulls, repeats
    and empty tables as in ``hard_negatives``."""
    vectors = ensure_columns(read_table(spark, sf_dir, "embeddings"), vec_id="long", label="int", embedding="array<double>")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


ORACLE = r"""
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.uid AS other, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, other_id) AS nth FROM scores WHERE same) WHERE nth <= 5
), negatives AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.uid, p.nth ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM positives p JOIN scores s ON p.uid = s.uid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
