"""Benchmark decontamination by winnowing.

Every text is cut into k-grams of words, and of each W successive k-grams the one with the least
hash is its fingerprint (of equal hashes the last).  The choice depends on those words alone, so
two texts that share K + W - 1 words in a row share a fingerprint there.  Fingerprints of documents
and items meet in a join; each meeting is extended word by word on both sides, as far as a shared
window can reach, and counts if a whole window is shared.

Items shorter than a window are one window of their own length; of such lengths documents give
every gram, which is winnowing with one gram in a sliding window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from .arrow_text import LOWER, runs_of, slices, text_buffer
from .near_dedup import M3, mixed
from .scratch import Scratch, ensure_columns, read_table

#: Words of an item that must follow each other in a document.
WINDOW = 10
#: Words of a k-gram; a guard then looks at WINDOW - K + 1 of them.
K = 5
#: log2 of the bits of the filter that documents meet before the join; at most 2 MB go to a task.
FILTER_BITS = 24
SALTS = 16
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

FOUND = "row long, doc_id long, n_words long, pos int, h long, context binary"


def gram_hashes(own: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(own) - size + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, size, np.uint64) * M3
        for k in range(size):
            h = mixed(h * M3 + own[k : k + n])
    return h


def starts_within(docs: np.ndarray, size: int, n: int) -> np.ndarray:
    """True where a gram of ``size`` words that begins there ends in the same text."""
    counts = np.diff(docs)
    position = np.arange(docs[-1]) - np.repeat(docs[:-1], counts)
    return (position + size <= np.repeat(counts, counts))[:n]


def fingerprints(own: np.ndarray, docs: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that winnowing keeps."""
    h = gram_hashes(own, k)
    w = window - k + 1
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), h[:0]
    best, least = np.zeros(n, np.int64), h[:n].copy()
    for d in range(1, w):
        other = h[d : d + n]
        take = other <= least
        best[take] = d
        np.minimum(least, other, out=least)
    whole = starts_within(docs, window, n)
    at = np.unique((np.arange(n) + best)[whole])
    return at, h[at]


def contexts(own: np.ndarray, docs: np.ndarray, at: np.ndarray, doc: np.ndarray, before: int, after: int) -> np.ndarray:
    """Word hashes around each place, zero beyond the text."""
    places = at[:, None] + np.arange(-before, after)
    good = (places >= docs[doc][:, None]) & (places < docs[doc + 1][:, None])
    return np.where(good, own[np.clip(places, 0, max(0, len(own) - 1))], np.uint64(0)) if len(own) else np.zeros(places.shape, np.uint64)


def found_in(own: np.ndarray, docs: np.ndarray, window: int, k: int, short: list[int], known: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Text, place in it, hash and context of all fingerprints, or of those the filter may know."""
    width = window - k
    out = []
    for size in [0, *short]:
        if size:
            h = gram_hashes(own, size)
            at = np.flatnonzero(starts_within(docs, size, len(h)))
            h = h[at]
        else:
            at, h = fingerprints(own, docs, window, k)
        if known is not None and len(h):
            slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            keep = (known[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
            at, h = at[keep], h[keep]
        doc = np.searchsorted(docs, at, side="right") - 1
        around = contexts(own, docs, at, doc, 0 if size else width, size or window)
        padded = np.zeros((len(at), window + width), np.uint64)
        padded[:, : around.shape[1]] = around
        out.append((doc, at - docs[doc], h, padded))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def finder(window: int, k: int, short: list[int], known=None, every_text: bool = True) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value if known is not None else None
        for batch in slices(batches, "text"):
            data, offsets = text_buffer(batch.column(2))
            data = LOWER[data]
            words = runs_of(data, WORD[data], offsets)
            codes, distinct = words.encoded()
            own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
            counts = np.diff(words.docs)
            wanted = short if every_text else []
            doc, pos, h, around = found_in(own, words.docs, window, k, wanted, bits)
            if not every_text:  # an item of fewer words is one window
                for size in np.unique(counts[(counts > 0) & (counts < window)]).tolist():
                    more = found_in(own, words.docs, window, k, [size], None)
                    only = np.isin(more[0], np.flatnonzero(counts == size))
                    doc, pos, h, around = (np.concatenate([x, y[only]]) for x, y in zip((doc, pos, h, around), more, strict=True))
            rows, ids = batch.column(0), batch.column(1)
            ends = np.arange(len(pos) + 1, dtype=np.int32) * (around.shape[1] * 8)
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(pos), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(around))])
            of = pa.array(doc)
            hits = [rows.take(of), ids.take(of), pa.array(counts[doc], pa.int64()), pa.array(pos, pa.int32()), pa.array(h.astype(np.int64)), binary]
            names = ["row", "doc_id", "n_words", "pos", "h", "context"]
            if every_text:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([rows, ids, pa.array(counts, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
            yield pa.RecordBatch.from_arrays(hits, names)

    return run


def extender(window: int, k: int) -> Callable:
    """Spans [lo, hi) of document words around a shared fingerprint that hold a shared window."""
    width = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size = batch.column("n_item").to_numpy()
            pos = batch.column("pos").to_numpy().astype(np.int64)
            if n:
                ours, theirs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(n, -1) for c in ("context", "theirs"))
                same = ours == theirs
                real = (ours != 0) & (theirs != 0)
                shared = same & real
                left = np.cumprod(shared[:, :width][:, ::-1], axis=1).sum(axis=1)
                right = np.cumprod(shared[:, width + k :], axis=1).sum(axis=1)
                middle = shared[:, width : width + k].all(axis=1)
                long = size >= window
                good = np.where(long, middle & (left + k + right >= window), same.all(axis=1))
                lo = np.where(long, pos - left, pos)
                hi = np.where(long, pos + k + right, pos + size)
            else:
                good, lo, hi = np.zeros(0, bool), pos, pos
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").filter(pa.array(good)), pa.array(lo[good]), pa.array(hi[good]), batch.column("class").filter(pa.array(good))], ["row", "lo", "hi", "class"]
            )

    return run


def hit_spans(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (row, doc_id, n_words); spans (row, lo, hi, class) of shared windows; (class, item)."""
    spark = docs.sparkSession
    docs = ensure_columns(docs, doc_id="long", text="string")
    items = ensure_columns(items, item_id="string", text="string")
    prints = items.select(F.lit(0).cast("long").alias("row"), F.coalesce("item_id", F.lit("")).alias("doc_id"), "text")
    prints = prints.mapInArrow(finder(window, k, [], every_text=False), FOUND.replace("doc_id long", "doc_id string"))
    prints = prints.select(F.col("doc_id").alias("item"), F.least("n_words", F.lit(window)).cast("int").alias("n_item"), "h", F.col("context").alias("theirs"))
    prints = scratch.put(prints.distinct(), "prints")
    # Equal surroundings are compared once, whatever the number of items that hold them.
    classes = prints.groupBy("h", "n_item", "theirs").agg(F.min("item").alias("item"))
    classes = scratch.put(classes.select("h", "n_item", "theirs", F.monotonically_increasing_id().alias("class")), "classes")
    holders = classes.join(prints, ["h", "n_item", "theirs"]).select("class", "item")

    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    bits = classes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits"))
    known = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for word, value in bits.collect():  # at most 2 ** (FILTER_BITS - 6) rows
        known[word] = value & ((1 << 64) - 1)
    short = sorted(r[0] for r in classes.filter(f"n_item < {window}").select("n_item").distinct().collect())

    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = scratch.put(source.mapInArrow(finder(window, k, short, spark.sparkContext.broadcast(known)), FOUND), "found")
    salted = found.filter("pos IS NOT NULL").withColumn("salt", F.pmod("row", F.lit(SALTS)))
    theirs = classes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = salted.join(theirs, ["h", "salt"]).select("row", "pos", "context", "theirs", "class", "n_item")
    spans = scratch.put(met.mapInArrow(extender(window, k), "row long, lo long, hi long, class long").distinct(), "spans")
    return found.filter("pos IS NULL").select("row", "doc_id", "n_words"), spans, holders


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Every row of ``docs`` with its words, the words that a benchmark window covers, and the items.

    Words are runs of 0-9, letters and other characters beyond ASCII after lower-casing A-Z.  Null
    and empty texts have none: such a document has no hit, such an item no window.  Repeated rows of
    documents count each; rows of one item_id are one item, and a null item_id is an item with an
    empty id.  Words meet as 64-bit hashes.  Other columns are ignored; empty tables give no hits.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    texts, spans, holders = hit_spans(docs, items, scratch, window, k)
    by_row = Over.partitionBy("row").orderBy("lo", "hi")
    reach = F.coalesce(F.max("hi").over(by_row.rowsBetween(Over.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), reach))
    hits = spans.select("row", "lo", "hi").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    named = spans.select("row", "class").distinct().withColumn("salt", F.pmod("row", F.lit(SALTS))).join(holders.withColumn("salt", salt), ["class", "salt"])
    lists = named.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = texts.join(hits, "row", "left").join(lists, "row", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        names.alias("items"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` that windows of ``benchmark`` cover; nulls, repeats and empty tables
    as in ``contaminated``."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), met AS (SELECT DISTINCT r, i, g.size, item FROM grams g JOIN windows x ON g.s = x.s AND g.size = x.size),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, size)) AS k FROM met) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""
