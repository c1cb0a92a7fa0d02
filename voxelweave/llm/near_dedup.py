"""Near duplicates by fast similarity sketches, bands, and verification on full shingle sets.

A sketch has T coordinates.  In round i each element of a set goes to one hashed bin with a
hashed value, and the least value of the first round that reaches a bin fills it; after T
rounds, round T + j sends every element to bin j, so every coordinate is filled.  Equal
coordinates estimate the Jaccard similarity as independent MinHashes would, with concentration
bounds, at the cost of one or two rounds for all but short texts.  B bands of R coordinates
make buckets: sets of similarity 0.8 share none with a probability below 1e-7.

Texts of one shingle set are one class.  Within a bucket, not all pairs are tried: pivots are
compared with all members that are not yet of their component, over as many rounds as shrink
what is left, and only pairs of different components that then remain are enumerated.  So a
large group of copies costs a few comparisons per member, and no link that could join two
components is left out.  Members whose shingles are too often theirs alone can link with
nothing and leave the buckets first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import LOWER, list_array, slices, text_buffer, words_of
from .components import connected_components
from .scratch import Scratch, ensure_columns, read_table

T, B, R = 128, 32, 4
SHINGLE = 5
PERCENT = 80
VALUE_BITS = 43
MOST_DOCS = 1 << 14
MOST_ROUNDS = 24
#: Members of a bucket that all others are compared with, in each round but the first.
PIVOTS = 4
#: Buckets with more pairs of different components than FEW are compared in blocks.
FEW, COLUMNS = 1000, 8192
#: Members, and shingles of all of them, that a block holds about.
BLOCK, BLOCK_SHINGLES = 512, 400_000
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and where each text's begin."""
    words = words_of(LOWER[data], offsets)
    codes, distinct = words.encoded()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    counts = np.diff(words.docs)
    n = max(0, len(own) - size + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = mixed(h * M3 + own[k : k + n])
        parts = []
        for d in range(len(counts)):
            a, c = words.docs[d], counts[d]
            if c >= size:
                parts.append(np.unique(h[a : a + c - size + 1]))
            elif c:
                x = np.array([c], np.uint64)
                for w in own[a : a + c]:
                    x = mixed(x * M3 + w)
                parts.append(x)
            else:
                parts.append(own[:0])
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else own[:0]), at


def sketches(elements: np.ndarray, at: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketch of each set, one row of ``t`` coordinates; an empty set gives zeros."""
    n = len(at) - 1
    out = np.zeros(n * t, np.uint64)
    filled = np.zeros(n * t, dtype=bool)
    sizes = np.diff(at)
    parent = np.repeat(np.arange(n), sizes)
    bits = np.uint64(t.bit_length() - 1)
    live_e, live_p = elements, parent
    for i in range(2 * t):
        if not len(live_e):
            break
        with np.errstate(over="ignore"):
            x = mixed(live_e + np.uint64(i + 1) * M3)
        bins = (x >> (np.uint64(64) - bits)).astype(np.int64) if i < t else np.full(len(x), i - t)
        value = (x << bits) >> np.uint64(64 - VALUE_BITS)
        packed = np.sort(((live_p * t + bins).astype(np.uint64) << np.uint64(VALUE_BITS)) | value)
        key = (packed >> np.uint64(VALUE_BITS)).astype(np.int64)
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        key, best = key[first], packed[first] & np.uint64((1 << VALUE_BITS) - 1)
        new = ~filled[key]
        out[key[new]] = best[new] | (np.uint64(i) << np.uint64(VALUE_BITS))
        filled[key[new]] = True
        if len(key):
            done = filled.reshape(n, t).all(axis=1)
            keep = ~done[live_p]
            live_e, live_p = live_e[keep], live_p[keep]
    return out.reshape(n, t)


def band_hashes(sketch: np.ndarray, b: int = B, r: int = R) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, b + 1, dtype=np.uint64) * M3, (len(sketch), b))
        for k in range(r):
            h = mixed(h * M3 + sketch[:, k : b * r : r])
    return h


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        for a in range(0, batch.num_rows, MOST_DOCS):
            yield batch.slice(a, MOST_DOCS)


def sketch_batches(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            data, offsets = text_buffer(batch.column(1))
            elements, at = shingle_sets(data, offsets, size)
            n = np.diff(at)
            bands = band_hashes(sketches(elements, at)).astype(np.int64)[n > 0].ravel()
            digests = [xxhash.xxh3_128_intdigest(elements[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            half = lambda x: x - (1 << 63)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "th": batch.column(2),
                    "n_shingles": pa.array(n, pa.int64()),
                    "k1": pa.array([half(x >> 64) for x in digests], pa.int64()),
                    "k2": pa.array([half(x & ((1 << 64) - 1)) for x in digests], pa.int64()),
                    "bands": list_array(np.concatenate([[0], np.cumsum(np.where(n > 0, B, 0))]), pa.array(bands)),
                }
            )

    return run


def set_batches(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            elements, at = shingle_sets(*text_buffer(batch.column(1)), size)
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "s": list_array(at, pa.array(elements.astype(np.int64)))})

    return run


def able(percent: int) -> str:
    """Whether a member and a pivot ``p`` can reach the similarity, by sizes n and supports s.

    The intersection has no shingle that only one of the two holds, so it is at most the
    smaller support.
    """
    return f"100 * least(n, p.n) >= {percent} * greatest(n, p.n) AND 100 * least(s, p.s) >= {percent} * (n + p.n - least(s, p.s))"


def supported(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Adds the support s, the shingles that another member holds too, and drops memberships
    that no partner of the bucket's sizes could bring to the similarity."""
    once = sets.select("node", F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    single = once.groupBy("node").agg(F.count("*").alias("u"))
    counted = members.join(single, "node", "left").select("b", "node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("s"), "comp")
    least = members.groupBy("b").agg(F.min("n").alias("least"))
    return counted.join(least, "b").filter(f"100 * s >= {percent} * (n + greatest(least, s) - s)").drop("least")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Component pairs (ca, cb) of node pairs (a, b) with 100 * intersection >= percent * union."""
    left = pairs.join(sets.withColumnsRenamed({"node": "a", "s": "sa"}), "a")
    both = left.join(sets.withColumnsRenamed({"node": "b", "s": "sb"}), "b")
    both = both.select("ca", "cb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
    return both.filter(F.expr(f"100 * i >= {percent} * (n - i)")).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Component pairs that links join within crowded buckets, found in blocks.

    A bucket's members are dealt into parts of about BLOCK members and BLOCK_SHINGLES shingles,
    whichever gives more parts, so long texts bound a part too; two parts meet in one task,
    which counts intersections by products of incidence matrices and returns links only.
    """
    weights = members.groupBy("b").agg(F.sum("n").alias("weight"))
    members = members.join(weights, "b")
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("own", own).join(sets.withColumnRenamed("s", "set"), "node")
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))))
    dealt = dealt.select("b", "own", "comp", "set", meet.alias("m")).select("b", "m.i", "m.j", "own", "comp", "set")

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        comps, own = rows["comp"].to_numpy(), rows["own"].to_numpy()
        left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
        out: set[tuple[int, int]] = set()
        if len(left) and len(right):
            values, counts = np.unique(comps, return_counts=True)
            main = values[counts.argmax()]
            rest = lambda x: x[comps[x] != main]
            plans = [(rest(left), right)] + ([(left[comps[left] == main], rest(right))] if key[1] != key[2] else [])
            sizes = rows["set"].map(len).to_numpy()
            flat = np.unique(np.concatenate(rows["set"].to_list()), return_inverse=True)[1].astype(np.int64)
            owner = np.repeat(np.arange(len(rows)), sizes)
            for x, y in plans:
                if not len(x) or not len(y):
                    continue
                inter = np.zeros((len(x), len(y)), np.float32)
                for start in range(0, int(flat.max()) + 1, COLUMNS):
                    take = (flat >= start) & (flat < start + COLUMNS)
                    m = np.zeros((len(rows), COLUMNS), np.float32)
                    m[owner[take], flat[take] - start] = 1
                    inter += m[x] @ m[y].T
                union = sizes[x][:, None] + sizes[y][None, :] - inter
                hit = (100 * inter >= percent * union) & (comps[x][:, None] != comps[y][None, :])
                out |= {(min(a, b), max(a, b)) for a, b in zip(comps[x[np.nonzero(hit)[0]]].tolist(), comps[y[np.nonzero(hit)[1]]].tolist(), strict=True)}
        return pd.DataFrame(sorted(out), columns=["a", "b"]).astype("int64")

    return dealt.groupBy("b", "i", "j").applyInPandas(links, "a long, b long")


def linked_classes(classes: DataFrame, docs: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame | None:
    """(node, root) of the classes that share a bucket with another; None if there are none."""
    spread = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("b"))
    shared = spread.groupBy("b").agg(F.count("*").alias("m")).filter("m > 1").select("b")
    members = scratch.put(spread.join(shared, "b").withColumn("comp", F.col("node")), "members")
    total = members.count()
    if not total:
        return None
    labels = scratch.put(members.select("node").distinct().withColumn("root", F.col("node")), "labels")
    wanted = labels.select("node").join(classes.select("node", "doc_id", "th"), "node")
    there = docs.select(F.col("doc_id").alias("d"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    texts = there.join(wanted, (F.col("h") == F.col("th")) & F.col("d").eqNullSafe(F.col("doc_id")))
    sets = texts.select("node", "text").mapInArrow(set_batches(size), "node long, s array<long>")
    sets = scratch.put(sets.groupBy("node").agg(F.first("s").alias("s")), "sets")
    members = scratch.put(supported(members, sets, percent), "members")
    before = 0
    for i in range(MOST_ROUNDS + 1):
        # The member with the fewest shingles of its own is the likeliest centre; others are random.
        hashed = [F.xxhash64("node", F.lit(i), F.lit(j)).alias("x") for j in range(1 if i == 0 else PIVOTS)]
        order = [(F.col("n") - F.col("s")).alias("own"), F.lit(0).alias("own")]
        pivots = [F.min(F.struct(order[j > 0], x, "node", "n", "s", "comp")).alias(f"p{j}") for j, x in enumerate(hashed)]
        names = [f"p{j}" for j in range(len(pivots))]
        per = members.groupBy("b", "comp").agg(F.count("*").alias("m"), *pivots)
        squares = F.sum(F.col("m") * F.col("m"))
        per = per.groupBy("b").agg(F.sum("m").alias("size"), ((F.sum("m") * F.sum("m") - squares) / 2).alias("cross"), F.count("*").alias("c"), *[F.min(x).alias(x) for x in names])
        taken = F.array(*[F.struct(*[F.col(f"{x}.{c}").cast("long").alias(c) for c in ("node", "n", "s", "comp")]) for x in names])
        open_ = scratch.put(per.filter("c > 1").select("b", "size", "cross", F.array_distinct(taken).alias("pivots")), "open")
        cross, n_open = open_.agg(F.coalesce(F.sum("cross"), F.lit(0)), F.count("*")).first()
        if not n_open:
            break
        # Pivots go on while they help; members that stay apart are then compared in pairs.
        last = cross <= total + 10_000 or (i > 1 and cross > 0.7 * before) or i == MOST_ROUNDS
        before = cross
        if last:
            one = members.join(open_.filter(f"cross <= {FEW}").select("b"), "b")
            other = one.select("b", F.struct("node", "n", "s", "comp").alias("p"))
            pairs = one.join(other, (one["b"] == other["b"]) & F.expr("comp < p.comp") & F.expr(able(percent)))
        else:
            members = scratch.put(members.join(open_.select("b", "pivots"), "b"), "members")
            pairs = members.select("node", "n", "s", "comp", F.explode("pivots").alias("p")).filter("comp <> p.comp").filter(able(percent))
            members = members.drop("pivots")
        pairs = pairs.select(
            F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"), F.least("comp", "p.comp").alias("ca"), F.greatest("comp", "p.comp").alias("cb")
        )
        edges = verified(pairs.distinct(), sets, percent)
        if last:
            edges = edges.unionByName(block_links(members.join(open_.filter(f"cross > {FEW}").select("b", "size"), "b"), sets, percent))
        roots = scratch.put(connected_components(edges, scratch).withColumnsRenamed({"node": "comp", "root": "to"}), "roots")
        labels = labels.withColumnRenamed("root", "comp").join(roots, "comp", "left").select("node", F.coalesce("to", "comp").alias("root"))
        labels = scratch.put(labels, "labels")
        if last:
            break
        members = members.join(roots, "comp", "left").select("b", "node", "n", "s", F.coalesce("to", "comp").alias("comp"))
        members = scratch.put(members, "members")
    return labels


def near_groups(docs: DataFrame, scratch: Scratch, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Every row with n_shingles, component_id and keep_row, the one row of its group that stays."""
    docs = ensure_columns(docs, doc_id="long", text="string")
    source = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows = source.mapInArrow(sketch_batches(size), "doc_id long, th long, n_shingles long, k1 long, k2 long, bands array<long>")
    rows = scratch.put(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "th")
    classes = rows.filter("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min(order).alias("rep"), F.first("bands").alias("bands"))
    classes = scratch.put(classes.select("k1", "k2", "n_shingles", F.col("rep.row").alias("node"), F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"), "bands"), "classes")
    roots = linked_classes(classes, docs, scratch, size, percent)
    named = classes.select("k1", "k2", "n_shingles", "node", F.col("doc_id").alias("class_id"))
    if roots is None:
        named = named.select("k1", "k2", "n_shingles", F.col("class_id").alias("component_id"), F.col("node").alias("keep_row"))
    else:
        known = roots.join(named.select("node", "class_id"), "node")
        first = known.groupBy("root").agg(F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "node")).alias("first"))
        linked = known.select("node", "root").join(first, "root").select("node", "first")
        named = named.join(linked, "node", "left").select(
            "k1", "k2", "n_shingles",
            F.when(F.col("first").isNull(), F.col("class_id")).otherwise(F.col("first.class_id")).alias("component_id"),
            F.coalesce("first.node", "node").alias("keep_row"),
        )
    named = scratch.put(named, "components")
    alone = F.col("n_shingles") == 0
    out = rows.drop("bands").join(named, ["k1", "k2", "n_shingles"], "left")
    return out.select(
        "doc_id", "th", "row", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("row")).otherwise(F.col("keep_row")).alias("keep_row"),
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Every row with its shingle count and the smallest doc_id reachable over links.

    Sets hold 64-bit hashes of shingles: two different shingles of a set of n count as one with
    a chance of about n * n / 2 ** 65, 1e-9 for a text of 200,000 words.
    Texts are compared after lower-casing A-Z; a text with fewer words than a shingle is one
    shingle of all its words; texts without words, and null ones, have the size 0 and are
    linked with nothing.  kept means doc_id = component_id; a null doc_id is never the smallest
    unless all of its group are null.  Repeated rows belong to one class; further columns are
    ignored; an empty table gives no rows.
    """
    out = near_groups(docs, Scratch(docs.sparkSession, "near"), size, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with the columns of documents.

    Rows without words stay, each by itself; a null doc_id stays only if all of its group are
    null; of repeated rows one stays.  Columns that documents lack become null, and an empty
    table gives no rows.
    """
    carry = {"lang": "string", "source": "string", "n_chars": "long"}
    docs = ensure_columns(docs, doc_id="long", text="string", **carry)
    scratch = scratch or Scratch(docs.sparkSession, "near")
    groups = near_groups(docs, scratch, size, percent)
    rows = scratch.put(groups.select("doc_id", "th", (F.col("row") == F.col("keep_row")).alias("stays")), "rows-kept")
    gone = rows.filter("NOT stays").select("doc_id", "th").distinct()
    # Repeated rows of one doc_id and text, of which one stays.
    again = gone.intersect(rows.filter("stays").select("doc_id", "th"))
    texts = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = lambda other: texts["doc_id"].eqNullSafe(other["doc_id"]) & (texts["th"] == other["th"])
    single = texts.join(gone, same(gone), "left_anti")
    repeated = texts.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "th"])
    return single.unionByName(repeated).select("doc_id", "text", "lang", "source", "n_chars")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` over four-word shingles; texts without words and null ones have
    no shingles and no links, repeated rows share a component, an empty table gives no rows."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=4)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT a AS doc_id, a AS c FROM both_ways
  UNION
  SELECT b, r.c FROM r JOIN both_ways ON both_ways.a = r.doc_id WHERE r.c < b
), m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
