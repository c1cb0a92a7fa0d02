"""Graph measures over edge tables (src, dst, weight), one row per undirected edge with src < dst."""

from __future__ import annotations

import functools
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names; a local one only in a local session that
    names none, for on a cluster it would not be shared.

    The result leaves behind the size that Spark estimates for its plan: a checkpoint keeps it,
    joins multiply it, and after some twenty rounds planning with such numbers takes minutes.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="voxelweave-"))
    kept = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def thresholded(edges: DataFrame, t: float) -> DataFrame:
    """Edges of strictly greater weight, without loops."""
    return edges.filter((F.col("weight") > t) & (F.col("src") != F.col("dst")))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, in one pass over the edges."""
    arc = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "weight")
    return edges.select(F.inline(F.array(arc("src", "dst"), arc("dst", "src"))))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


#: Neighbours that a block of the triangle search should hold, about.
CELL = 1 << 22
#: Neighbours that a task looks up at a time; edges with an end of more than LONG are taken one by one.
PAIRS, LONG = 1 << 21, 32


def neighbour_blocks(edges: DataFrame, weighted: bool) -> DataFrame:
    """(g, nodes, size, near, code, weight): a row for each block of nodes, with their numbers of
    neighbours, and the neighbours as places in the sorted list ``near`` of all those of the block."""
    entries = 2 * edges.count()
    count = max(1, math.ceil(entries / CELL), min(8, 64 * entries // CELL))  # 36 pairs of blocks, for all cores
    arcs = both_ways(edges.filter("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")))
    g = F.pmod(F.xxhash64("src"), F.lit(count)).cast("int")
    dealt = arcs.select("src", "dst", *["weight"] * weighted).repartitionById(count, g)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        nodes, row = np.unique(table.column("src").to_numpy(), return_inverse=True)
        near, code = np.unique(table.column("dst").to_numpy(), return_inverse=True)
        order = np.argsort(row * len(near) + code)
        weight = table.column("weight").to_numpy()[order] if weighted else np.zeros(0)
        flat = [nodes, np.bincount(row).astype("i4"), near, code[order].astype("i4"), weight]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in flat], ["nodes", "size", "near", "code", "weight"])

    return cut(dealt.mapInArrow(pack, "nodes binary, size binary, near binary, code binary, weight binary").select(F.spark_partition_id().alias("g"), "*"))


def sums_of_edges(ends: tuple, blocks: tuple, columns: int, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Common neighbours of the two ends of each edge: their number, and the sum of the products of
    the weights to them.  ``ends`` are rows of the two blocks (start, code, weight or none)."""
    links, closed = np.zeros(len(ends[0])), np.zeros(len(ends[0]))
    size = [np.diff(b[0])[e] for e, b in zip(ends, blocks, strict=True)]
    short = np.minimum(*size) <= LONG
    for one, two, least in ((0, 1, size[0] <= size[1]), (1, 0, size[0] > size[1])):
        # ``one`` has the shorter list.
        (start, code, w), (far_start, far_code, far_w) = blocks[one], blocks[two]
        few = np.flatnonzero(least & short)
        if len(few):
            rows = np.repeat(np.arange(len(far_start) - 1), np.diff(far_start))
            keys = rows * (columns + 1) + far_code  # far lists are sorted but for places without a match
            order = None if (keys[1:] >= keys[:-1]).all() else np.argsort(keys)
            keys = keys if order is None else keys[order]
            total, at = np.cumsum(size[one][few]), 0
            while at < len(few):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
                e = few[at:to]
                n = size[one][e]
                of = np.repeat(np.arange(len(e)), n)
                place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[ends[one][e]][of]
                key = ends[two][e][of] * (columns + 1) + code[place]
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = np.flatnonzero((keys[found] == key) & (code[place] < columns))
                links[e] += np.bincount(of[hit], minlength=len(e))
                if w is not None:
                    closed[e] += np.bincount(of[hit], weights=w[place[hit]] * far_w[found[hit] if order is None else order[found[hit]]], minlength=len(e))
                at = to
        many = np.flatnonzero(least & ~short)
        many = many[np.argsort(ends[two][many], kind="stable")]
        firsts = np.flatnonzero(np.diff(ends[two][many], prepend=-1))
        mark, x = np.zeros(columns + 1, bool), np.zeros(columns + 1)
        low, high = start[ends[one][many]].tolist(), start[ends[one][many] + 1].tolist()
        n, s = np.zeros(len(many)), np.zeros(len(many))
        for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(many)], strict=False):
            row = ends[two][many[a]]
            own = slice(far_start[row], far_start[row + 1])
            lit = far_code[own]
            if counted:
                mark[lit] = True
                mark[columns] = False
                n[a:b] = [np.count_nonzero(mark.take(code[i:j])) for i, j in zip(low[a:b], high[a:b], strict=True)]
                mark[lit] = False
            if w is not None:
                x[lit] = far_w[own]
                x[columns] = 0
                s[a:b] = [x.take(code[i:j]).dot(w[i:j]) for i, j in zip(low[a:b], high[a:b], strict=True)]
                x[lit] = 0
        links[many], closed[many] = n, s
    return links, closed


def corners(edges: DataFrame, weighted: bool = True, counted: bool = True) -> DataFrame:
    """(node, links, closed): number and sum of products of weights of the triangles of each node that
    has one, each only if asked for.

    Nodes lie in blocks with the lists of their neighbours.  A task takes two blocks and the edges
    between them: the common neighbours of an edge's ends are its triangles.  Blocks are written once
    and read by the tasks, so edges are shuffled once, whatever the number of blocks.
    """
    blocks = neighbour_blocks(edges, weighted)
    two = [blocks.select(*[F.col(c).alias(f"{c}_{k}") for c in blocks.columns]) for k in (1, 2)]
    met = two[0].crossJoin(two[1]).filter("g_1 <= g_2")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from search_one(batch.slice(k, 1))

    def search_one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        def read(c: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
            return tuple(np.frombuffer(batch.column(f"{c}_{k}")[0].as_buffer(), kind) for k in (1, 2))

        nodes, size, near, code, weight = (read(c, t) for c, t in (("nodes", "i8"), ("size", "i4"), ("near", "i8"), ("code", "i4"), ("weight", "f8")))
        same, columns = batch.column("g_1")[0].as_py() == batch.column("g_2")[0].as_py(), len(near[1])

        def places(sorted_: np.ndarray) -> np.ndarray:
            """Of each neighbour of the first block, its place in a list, or the list's length."""
            at = np.searchsorted(sorted_, near[0])
            return np.where(sorted_[np.minimum(at, len(sorted_) - 1)] == near[0], at, len(sorted_))

        start = [np.concatenate([[0], np.cumsum(s, dtype=np.int64)]) for s in size]
        other = places(nodes[1])[code[0]]
        own = np.repeat(np.arange(len(nodes[0])), size[0])
        edge = np.flatnonzero((other < len(nodes[1])) & ((own < other) if same else True))
        ends = own[edge], other[edge]
        del own, other
        lists = (start[0], places(near[1])[code[0]], weight[0] if weighted else None), (start[1], code[1].astype(np.int64), weight[1] if weighted else None)
        links, closed = sums_of_edges(ends, lists, columns, counted)
        if weighted:
            closed *= weight[0][edge]
        for k in (0, 1):  # a triangle of a node is found on two of its edges
            n, s = (np.bincount(ends[k], weights=v, minlength=len(nodes[k])) / 2 for v in (links, closed))
            has = np.flatnonzero(np.bincount(ends[k], weights=(links > 0) | (closed != 0), minlength=len(nodes[k])))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k][has]), pa.array(n[has]), pa.array(s[has])], ["node", "links", "closed"])

    found = met.mapInArrow(search, "node long, links double, closed double").groupBy("node")
    return found.agg(*[F.round(F.sum("links")).cast("long").alias("links")] * counted, *[F.sum("closed").alias("closed")] * weighted)


def clustering_binary(edges: DataFrame) -> DataFrame:
    """2 * links / (k (k - 1)) of every node with two neighbours or more."""
    edges = cut(edges)
    deg = degree(edges).select("node", F.col("degree").alias("k"))
    c = 2 * F.coalesce("links", F.lit(0)) / (F.col("k") * (F.col("k") - 1))
    return deg.filter("k > 1").join(corners(edges, weighted=False), "node", "left").select("node", c.alias("clustering"))


def clustering_weighted(edges: DataFrame) -> DataFrame:
    """sum(w_ik w_il w_kl) / sum(w_ik w_il) over pairs of neighbours k, l of i."""
    edges = cut(edges)
    sums = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    pairs = sums.select("node", ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs")).filter("pairs > 0")
    c = F.coalesce("closed", F.lit(0.0)) / F.col("pairs")
    return pairs.join(corners(edges, counted=False), "node", "left").select("node", c.alias("clustering"))


def clustering_directed(arcs: DataFrame) -> DataFrame:
    """Fagiolo's coefficient over directed arcs (src, dst, weight): cycles of the cube roots of the
    weights of both directions, over k (k - 1) - 2 r with total degree k and r mutual neighbours."""
    root = F.cbrt(F.col("weight"))
    pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    joined = cut(arcs.filter("src <> dst").groupBy(*pair).agg(F.sum(root).alias("weight"), F.count("*").alias("n")))
    ends = joined.select(F.explode(F.array("src", "dst")).alias("node"), "n")
    deg = ends.groupBy("node").agg(F.sum("n").alias("k"), F.sum((F.col("n") - 1)).alias("mutual"))
    below = F.col("k") * (F.col("k") - 1) - 2 * F.col("mutual")
    c = F.when(F.coalesce("closed", F.lit(0.0)) == 0, 0.0).otherwise(F.col("closed") / below)
    return deg.join(corners(joined, counted=False), "node", "left").select("node", c.alias("clustering"))


def laplacian(edges: DataFrame, normalised: bool = False) -> DataFrame:
    """Entries of D - A, or of I - D^-1/2 A D^-1/2 on edges."""
    d = degree(edges)
    if normalised:
        e = both_ways(edges).join(d.select(F.col("node").alias("src"), F.col("strength").alias("a")), "src")
        e = e.join(d.select(F.col("node").alias("dst"), F.col("strength").alias("b")), "dst")
        off = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight") / F.sqrt(F.col("a") * F.col("b"))).alias("value"))
        return off.unionByName(d.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("value")))
    off = both_ways(edges).select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight")).alias("value"))
    return off.unionByName(d.select(F.col("node").alias("i"), F.col("node").alias("j"), F.col("strength").alias("value")))


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """sum over clusters of (inner weight / total) - (cluster strength / total)^2."""
    e = both_ways(edges)
    a = clusters.select(F.col("node").alias("src"), F.col("cluster").alias("ca"))
    b = clusters.select(F.col("node").alias("dst"), F.col("cluster").alias("cb"))
    joined = e.join(a, "src").join(b, "dst")
    per = joined.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inner"), F.sum("weight").alias("s"))
    total = F.sum("s")
    return per.agg((F.sum("inner") / total - F.sum(F.col("s") * F.col("s")) / (total * total)).alias("q"))


def hierarchy(edges: DataFrame) -> DataFrame:
    """Slope of ln(strength) on ln(clustering) over nodes with clustering."""
    edges = cut(edges)
    both = degree(edges).join(clustering_binary(edges), "node").filter("clustering > 0")
    return both.agg(F.regr_slope(F.log("strength"), F.log("clustering")).alias("beta"), F.count("*").alias("n"))


#: Distances that a cell of the path search holds, about, and edges that a component may send to a cell.
STRIPE, EDGES = 1 << 20, 1 << 23
#: Nearest edges of a node that make the sparse graph of a component of many more, and edges of a packed row.
NEAR, PACKED = 32, 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node, equal for nodes that edges connect.

    Each node, later each part, picks one neighbour, and only edges between the parts that the picks
    make go on, so long rounds of labels run over a row a node and not over all edges.
    """
    label, left = None, edges.select("src", "dst")
    while label is None or not left.isEmpty():
        ends = left.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))
        picks = ends.groupBy(F.col("a").alias("src")).agg(F.min(F.when(F.col("a") != F.col("b"), F.col("b"))).alias("b"))
        up = merged(picks.select("src", F.coalesce("b", "src").alias("dst")))
        if label is not None:
            label = label.join(up.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        label = up if label is None else cut(label)
        for c in ("src", "dst"):
            left = left.join(up.withColumnsRenamed({"node": c, "root": f"of_{c}"}), c)
        left = cut(left.filter("of_src <> of_dst").select(F.least("of_src", "of_dst").alias("src"), F.greatest("of_src", "of_dst").alias("dst")).distinct())
    return label


def distances_in_cell(starts: np.ndarray, nodes: int, u: np.ndarray, v: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Distances (node, start) over distinct arcs u to v: nodes whose row became shorter pass it on until none does.

    Short arcs go first.  An arc that is longer than a distance known between its ends, or not
    shorter than any distance, can't shorten one, so most long arcs of a dense graph are never passed.
    """
    found = np.full((nodes, len(starts)), np.inf)
    found[starts, np.arange(len(starts))] = 0
    column = np.full(nodes, -1)
    column[starts] = np.arange(len(starts))
    rank = np.sort(length)
    most, limit = 8 * nodes, 0.0
    while len(u):
        top = found.max()
        if limit >= min(top, rank[-1]):
            break
        limit = top if np.isfinite(top) else rank[min(most, len(rank)) - 1]
        most *= 4
        at = np.flatnonzero(length <= limit)
        at = at[np.argsort(u[at], kind="stable")]
        near, w, first = v[at], length[at], np.searchsorted(u[at], np.arange(nodes + 1))
        pending, down = np.isfinite(found).any(axis=1), False
        while pending.any():
            ask = np.flatnonzero(pending)
            for k in ask[::-1] if down else ask:
                pending[k] = False
                to = slice(first[k], first[k + 1])
                if to.start == to.stop:
                    continue
                own, rows = found[k] + w[to, None], found[near[to]]
                shorter = (own < rows).any(axis=1)
                if shorter.any():
                    hit = near[to][shorter]
                    found[hit] = np.minimum(own[shorter], rows[shorter])
                    pending[hit] = True
            down = not down
        # A start's own arc that is longer than a path between its ends is part of no shortest path.
        use = (column[u] < 0) | (length <= found[v, column[u]])
        u, v, length = u[use], v[use], length[use]
    return found


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Least sum of 1 / weight from each source to every node it reaches; weights are positive.

    A cell holds the distances from some sources of one connected component, STRIPE at most, and is
    sent that component's edges once, so nothing is shuffled a path.  Of a dense component only edges
    that no path over shorter ones replaces are sent.  Components of more than EDGES edges relax by
    joins in rounds.
    """
    e = cut(edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"), F.min("weight").alias("least")))
    if not e.filter("least <= 0").isEmpty():
        raise ValueError("weights must be positive")
    part = components(e)
    own = e.join(part.withColumnRenamed("node", "src"), "src").select("root", "src", "dst", "weight")
    sizes = part.groupBy("root").agg(F.count("*").alias("n")).join(own.groupBy("root").agg(F.count("*").alias("m")), "root")
    stripes = F.when(F.col("m") <= EDGES, F.ceil(F.least(F.col("n") * F.col("n") / STRIPE, F.col("n"))))
    sizes = cut(sizes.select("root", "m", stripes.alias("stripes"), (F.col("m") > 4 * NEAR * F.col("n")).alias("dense")))
    begin = sources.select("node").distinct()
    starts = cut(begin.join(part, "node").join(sizes, "root").select("root", "node", F.pmod(F.xxhash64("node"), "stripes").alias("stripe")))
    small = starts.filter("stripe IS NOT NULL")
    sent = own.join(sizes.filter("stripes IS NOT NULL AND NOT dense"), "root", "left_semi")
    dense = sizes.filter("stripes IS NOT NULL AND dense")
    if not dense.isEmpty():
        sent = sent.unionByName(thinned(own.join(dense, "root", "left_semi"), small))
    near = in_cells(sent, small, None)
    alone = begin.join(part, "node", "left_anti").select(F.col("node").cast("long").alias("source"), F.col("node").cast("long"), F.lit(0.0).alias("d"))
    out = near.unionByName(alone)
    if not sizes.filter("stripes IS NULL").isEmpty():
        large = sizes.filter("stripes IS NULL").select("root")
        out = out.unionByName(relaxed(own.join(large, "root", "left_semi"), starts.filter("stripe IS NULL")))
    return out


def in_cells(edges: DataFrame, starts: DataFrame, tested: DataFrame | None) -> DataFrame:
    """(source, node, d) over edges (root, src, dst, weight) from starts (root, node, stripe); or, of the
    ``tested`` edges (root, stripe, src, dst, weight), those that are shorter than all other paths.

    Edges are packed before they go to every stripe of their component.
    """
    kinds = {"src": "i8", "dst": "i8", "weight": "f8"}
    flat = edges.select("root", *[F.col(c).cast("double" if k == "f8" else "long").alias(c) for c, k in kinds.items()])
    chunk = F.pmod(F.xxhash64("src", "dst"), F.ceil(F.col("m") / PACKED)).alias("chunk")
    flat = flat.join(flat.groupBy("root").agg(F.count("*").alias("m")), "root").select("root", chunk, *kinds)

    def pack(table: pa.Table) -> pa.Table:
        columns = [pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in kinds]
        return pa.table({"root": table.column("root")[:1].combine_chunks(), **dict(zip([f"{c}s" for c in kinds], columns, strict=True))})

    root = dict(edges.dtypes)["root"]
    packed = flat.groupBy("root", "chunk").applyInArrow(pack, f"root {root}, srcs binary, dsts binary, weights binary")
    cells = cut(starts.select("root", "stripe").distinct())
    none = [F.lit(None).cast("binary").alias(f"{c}s") for c in kinds]
    rows = [packed.join(cells, "root").select("root", "stripe", *[F.lit(None).cast("long" if k == "i8" else "double").alias(c) for c, k in kinds.items()], *[f"{c}s" for c in kinds])]
    rows.append(starts.select("root", "stripe", F.col("node").cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("weight"), *none))
    if tested is not None:
        rows.append(tested.select("root", "stripe", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"), *none))
    gives_edges = tested is not None

    def search(table: pa.Table) -> pa.Table:
        binary = [table.column(f"{c}s").drop_null() for c in kinds]
        src, dst, weight = (np.concatenate([np.zeros(0, k), *[np.frombuffer(x.as_buffer(), k) for x in column]]) for column, k in zip(binary, kinds.values(), strict=True))
        plain = table.select(["src", "dst", "weight"]).filter(table.column("src").is_valid())
        asked = plain.column("src").filter(plain.column("dst").is_null()).to_numpy()
        names, place = np.unique(np.concatenate([asked, src, dst]), return_inverse=True)
        at, u, v = place[: len(asked)], place[len(asked) : len(asked) + len(src)], place[len(asked) + len(src) :]
        found = distances_in_cell(at, len(names), np.concatenate([u, v]), np.concatenate([v, u]), np.tile(1 / weight, 2))
        if not gives_edges:
            return pa.table({"source": np.tile(names[at], len(names)), "node": np.repeat(names, len(at)), "d": found.ravel()})
        column = np.full(len(names), -1)
        column[at] = np.arange(len(at))
        plain = plain.filter(plain.column("dst").is_valid())
        a, b = (np.searchsorted(names, plain.column(c).to_numpy()) for c in ("src", "dst"))
        far = np.where(column[a] >= 0, found[b, column[a]], found[a, column[b]])
        kept = plain.filter(pa.array(1 / plain.column("weight").to_numpy() < far))
        return kept.append_column("root", pa.repeat(table.column("root")[0], kept.num_rows))

    schema = f"src long, dst long, weight double, root {root}" if gives_edges else "source long, node long, d double"
    count = max(1, min(2000, 4 * cells.count()))
    return functools.reduce(DataFrame.unionByName, rows).repartition(count, "root", "stripe").groupBy("root", "stripe").applyInArrow(search, schema)


def thinned(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The edges that shortest paths need: those nearest to their ends, and those shorter than the paths
    over these.  Edges between two nodes that are no starts all stay."""
    ends = both_ways(edges).select("src", "dst", "weight")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    close = ends.withColumn("k", rank).filter(F.col("k") <= NEAR).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    close = cut(edges.join(close, ["src", "dst"]).select("root", "src", "dst", "weight"))
    of = starts.select("node", "stripe")
    met = edges.join(of.withColumnsRenamed({"node": "src", "stripe": "a"}), "src", "left").join(of.withColumnsRenamed({"node": "dst", "stripe": "b"}), "dst", "left")
    met = met.select("root", F.coalesce("a", "b").alias("stripe"), "src", "dst", "weight")
    other = met.filter("stripe IS NULL").join(close, ["src", "dst"], "left_anti").select("root", "src", "dst", "weight")
    needed = in_cells(close, starts, met.filter("stripe IS NOT NULL")).select("root", "src", "dst", "weight")
    return cut(close.unionByName(other).unionByName(needed))


def relaxed(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Shortest paths by rounds: distances relax along all edges at once until none becomes shorter;
    a round sends on only what did, and its table is checkpointed, so the plan does not grow."""
    e = cut(both_ways(edges)).select("src", "dst", (1 / F.col("weight")).alias("length"))
    best = sources.select(F.col("node").alias("source"), F.col("node"), F.lit(0.0).alias("d"), F.lit(True).alias("new"))
    while not best.filter("new").isEmpty():
        step = best.filter("new").join(e, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("d") + F.col("length")).alias("d"))
        step = step.groupBy("source", "node").agg(F.min("d").alias("nd"))
        joined = best.select("source", "node", "d").join(step, ["source", "node"], "full")
        shorter = F.col("nd").isNotNull() & (F.col("d").isNull() | (F.col("nd") < F.col("d") - 1e-12))
        best = cut(joined.select("source", "node", F.when(shorter, F.col("nd")).otherwise(F.col("d")).alias("d"), shorter.alias("new")))
    return best.select("source", "node", "d")


def minimum_spanning_tree(edges: DataFrame) -> DataFrame:
    """Borůvka's rounds on length 1 / weight; ties go to the smaller edge.  Edges come with both.

    After a round only the best edge between two parts goes on, since no other of them can be taken,
    so the rounds after the first meet few rows.
    """
    e = cut(edges.select("src", "dst", "weight", F.col("src").alias("cs"), F.col("dst").alias("cd")).filter("cs <> cd"))
    tree = None
    order = F.struct((1 / F.col("weight")).alias("length"), "src", "dst", "weight", "cs", "cd").alias("o")
    while not e.isEmpty():
        ends = e.select(F.explode(F.array("cs", "cd")).alias("c"), order)
        picks = cut(ends.groupBy("c").agg(F.min("o").alias("o")).select("o.*").distinct())
        taken = picks.select("src", "dst", "weight")
        tree = taken if tree is None else tree.unionByName(taken)
        label = merged(picks.select(F.col("cs").alias("src"), F.col("cd").alias("dst")))
        for c in ("cs", "cd"):
            e = e.join(label.withColumnsRenamed({"node": c, "root": "to"}), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        e = e.filter("cs <> cd").groupBy(F.least("cs", "cd").alias("p"), F.greatest("cs", "cd").alias("q"))
        e = cut(e.agg(F.min(order).alias("o")).select("o.src", "o.dst", "o.weight", F.col("p").alias("cs"), F.col("q").alias("cd")))
    tree = tree if tree is not None else e.select("src", "dst", "weight")
    return tree.withColumn("length", 1 / F.col("weight"))


def merged(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over (src, dst), by minimum labels and jumps."""
    two = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = two.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        near = two.join(label.withColumnsRenamed({"node": "dst", "root": "r"}), "dst").groupBy(F.col("src").alias("node")).agg(F.min("r").alias("r"))
        new = label.join(near, "node", "left").select("node", "root", F.least("root", "r").alias("to"))
        jump = new.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new = cut(new.join(jump, "to", "left").select("node", F.coalesce("far", "to").alias("next"), "root"))
        label = new.select("node", F.col("next").alias("root"))
        if new.filter("next <> root").isEmpty():
            return label


def power_law_alpha(values: DataFrame, xmin: float) -> DataFrame:
    """Continuous maximum-likelihood exponent 1 + n / sum ln(x / xmin) over x >= xmin."""
    v = values.filter(F.col("value") >= xmin)
    return v.agg((1 + F.count("*") / F.sum(F.log(F.col("value") / xmin))).alias("alpha"), F.count("*").alias("n"))


def ring_lattice(spark, n: int, k: int) -> DataFrame:
    """Nodes 0..n-1, each joined with the k next around the ring."""
    node = spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("s"))
    b = (F.col("a") + F.col("s")) % n
    return node.select(F.least("a", b).alias("src"), F.greatest("a", b).alias("dst"), F.lit(1.0).alias("weight")).filter("src <> dst").distinct()


def threshold_at_strength(edges: DataFrame, k: float, steps: int = 1000) -> DataFrame:
    """The least of the thresholds 0, max / steps, ... at which the mean strength of the nodes is at
    most ``k``, with that strength; a ``k`` above the mean strength of all edges is an error."""
    one = edges.filter("src <> dst AND weight > 0")
    n, top = degree(edges).count(), one.agg(F.max("weight")).first()[0]
    step = (top or 0.0) / steps
    # An edge counts at thresholds j * step below its weight: all j up to ceil(weight / step) - 1.
    last = F.least(F.ceil(F.col("weight") / (step or 1.0)) - 1, F.lit(steps)).cast("int")
    sums = one.groupBy(last.alias("j")).agg((2 * F.sum("weight") / n).alias("s"))
    every = edges.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("j"))
    after = Window.orderBy("j").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # ``steps`` rows
    means = every.join(F.broadcast(sums), "j", "left").select("j", F.sum(F.coalesce("s", F.lit(0.0))).over(after).alias("mean"))
    if (means.filter("j = 0").first()["mean"] or 0.0) < k:
        raise ValueError("the mean strength of all edges is below k")
    best = F.min(F.struct("j", "mean"))
    return means.filter(F.col("mean") <= k).agg(best.alias("b")).select((F.col("b.j") * step).alias("threshold"), "b.mean")


def standardised(measure: DataFrame, column: str) -> DataFrame:
    """Adds z: deviations of a node measure from its mean in population deviations, 0 if constant."""
    stats = measure.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))  # one row
    z = F.when(F.col("s") > 0, (F.col(column) - F.col("m")) / F.col("s")).otherwise(0.0)
    return measure.crossJoin(F.broadcast(stats)).withColumn("z", z).drop("m", "s")


def node_strengths(edges: DataFrame, nodes: DataFrame, upper: bool = False) -> DataFrame:
    """degree and strength of every node, 0 for isolated ones; ``upper`` counts edges at src only."""
    one = edges.select("src", "dst", "weight") if upper else both_ways(edges)
    sums = one.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    return nodes.select("node").distinct().join(sums, "node", "left").na.fill({"degree": 0, "strength": 0.0})


def harmonic_path_length(paths: DataFrame) -> DataFrame:
    """Mean of the inverse distances of all pairs, and its inverse."""
    own = paths.groupBy("source").agg(F.sum(F.when(F.col("source") != F.col("node"), 1 / F.col("d"))).alias("s"))  # one reading of the paths
    inverse = F.sum("s") / F.greatest(F.lit(1.0), F.count("*").cast("double") * (F.count("*") - 1))
    return own.agg(inverse.alias("efficiency"), (1 / inverse).alias("length"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Shares of shortest paths that pass through each node, over unordered pairs (length 1 / weight).

    Shortest paths from all sources make one table of steps; counts of paths run along it, and
    dependencies against it, in as many rounds as a path has edges.  Nothing is gathered.
    """
    nodes = degree(edges).select("node")
    d = cut(shortest_paths(edges, sources if sources is not None else nodes))
    e = both_ways(edges).select("src", "dst", (1 / F.col("weight")).alias("length"))
    near = d.join(e, F.col("node") == F.col("src")).select("source", F.col("node").alias("v"), F.col("dst").alias("w"), (F.col("d") + F.col("length")).alias("far"))
    steps = near.join(d.select("source", F.col("node").alias("w"), "d"), ["source", "w"]).filter(F.abs(F.col("far") - F.col("d")) <= tolerance * F.col("d"))
    steps = cut(steps.select("source", "v", "w"))

    def summed(start: DataFrame, at: str, to: str) -> DataFrame:
        """Sum of what reaches each (source, node) from ``start`` along the steps, over all lengths."""
        front, total = start, start
        while not front.isEmpty():
            moved = front.withColumnRenamed("node", at).join(steps, ["source", at])
            front = cut(moved.groupBy("source", F.col(to).alias("node")).agg(F.sum("x").alias("x")))
            total = cut(total.unionByName(front).groupBy("source", "node").agg(F.sum("x").alias("x")))
        return total

    first = d.filter("source = node").select("source", "node", F.lit(1.0).alias("x"))
    paths = summed(first, "v", "w").withColumnRenamed("x", "sigma")
    inverse = paths.select("source", F.col("node").alias("w"), (1 / F.col("sigma")).alias("x"))
    back = inverse.join(steps, ["source", "w"]).groupBy("source", F.col("v").alias("node")).agg(F.sum("x").alias("x"))
    y = summed(cut(back), "w", "v")
    through = y.join(paths, ["source", "node"]).filter("source <> node").groupBy("node").agg((F.sum(F.col("x") * F.col("sigma")) / 2).alias("b"))
    return nodes.join(through, "node", "left").select("node", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def central_point_dominance(measure: DataFrame) -> DataFrame:
    """Mean difference of the largest relative betweenness from the others."""
    n = F.count("*")
    relative = 2 / ((n - 1) * (n - 2))
    top = F.max("betweenness")
    return measure.agg((relative * (n * top - F.sum("betweenness")) / (n - 1)).alias("dominance"))


def permuted(entries: DataFrame, seed: int = 1) -> DataFrame:
    """A matrix with its values off the diagonal dealt out anew at random; the diagonal stays.

    Places and values are numbered in blocks by two hashes, and equal numbers meet.
    """
    off = entries.filter("i <> j")
    numbered = lambda df, *key: row_numbers(df.withColumn("h", F.xxhash64("i", "j", F.lit(seed), *key)), "h", ["i", "j"])
    places = numbered(off).select("n", "i", "j")
    values = numbered(off, F.lit("value")).select("n", "value")
    return places.join(values, "n").select("i", "j", "value").unionByName(entries.filter("i = j").select("i", "j", "value"))


def row_numbers(df: DataFrame, order: str, ties: list[str], blocks: int = 4096) -> DataFrame:
    """Adds n from 0 by a 64-bit hash ``order``: ranks inside blocks of it, shifted by earlier blocks."""
    block = F.shiftrightunsigned(order, 64 - 12)
    with_block = df.withColumn("block", block)
    sizes = with_block.groupBy("block").agg(F.count("*").alias("size"))  # ``blocks`` rows at most
    before = F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("block").orderBy(order, *ties)) - 1
    return with_block.join(F.broadcast(sizes.select("block", before.alias("start"))), "block").withColumn("n", F.col("start") + inner).drop("block", "start")


def rewired(edges: DataFrame, rounds: int = 10, seed: int = 1) -> DataFrame:
    """Random graph of the same degrees: pairs of edges swap their ends, synchronously.

    In a round edges meet in pairs by a hash; (a, b), (c, d) become (a, d), (c, b) unless that makes
    a loop or an edge that exists or that another pair makes.  Negative weights become 0.
    """
    e = cut(edges.filter("src <> dst").select("src", "dst", F.greatest("weight", F.lit(0.0)).alias("weight")))
    for r in range(rounds):
        flip = F.xxhash64("src", "dst", F.lit(seed), F.lit(-r)) % 2 == 0
        h = row_numbers(e.withColumn("h", F.xxhash64("src", "dst", F.lit(seed), F.lit(r))), "h", ["src", "dst"])
        h = h.select((F.floor(F.col("n") / 2)).alias("pair"), (F.col("n") % 2).alias("side"), F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("b"), "weight")
        one = h.filter("side = 0").drop("side")
        two = h.filter("side = 1").select("pair", F.col("a").alias("c"), F.col("b").alias("d"), F.col("weight").alias("w2"))
        both = cut(one.join(two, "pair", "left"))
        new = both.filter("a <> d AND c <> b").select("pair", F.explode(F.array(F.struct(F.least("a", "d").alias("src"), F.greatest("a", "d").alias("dst")), F.struct(F.least("b", "c").alias("src"), F.greatest("b", "c").alias("dst")))).alias("e")).select("pair", "e.*")
        taken = new.join(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), ["src", "dst"], "left_semi").select("pair")
        double = new.join(new.groupBy("src", "dst").agg(F.count("*").alias("k")).filter("k > 1"), ["src", "dst"]).select("pair")
        good = new.select("pair").distinct().join(taken.unionByName(double).distinct(), "pair", "left_anti").withColumn("good", F.lit(True))
        done = both.join(good, "pair", "left").withColumn("good", F.coalesce("good", F.lit(False)))
        edge = lambda x, y, w: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"), F.col(w).alias("weight"))
        swapped = F.array(edge("a", "d", "weight"), edge("c", "b", "w2"))
        kept = F.when(F.col("c").isNull(), F.array(edge("a", "b", "weight"))).otherwise(F.array(edge("a", "b", "weight"), edge("c", "d", "w2")))
        e = cut(done.select(F.explode(F.when(F.col("good"), swapped).otherwise(kept)).alias("e")).select("e.*"))
    return e
