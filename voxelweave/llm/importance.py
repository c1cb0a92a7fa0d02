"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Both models are counts of hashed words and word pairs in BUCKETS buckets: the raw model counts
every text, the target model all labelled good texts.  A text's importance
is the logarithm of its probability under the target model over that under the raw model, the
sum over its n-grams.  Adding Gumbel noise and taking the k largest samples k texts without
replacement in proportion to importance.  k is the number of texts at least as important as all
but LIGHTEST of the target texts, so it follows the corpus; the k-th largest is found by
narrowing a histogram, without sorting the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import LOWER, slices, text_buffer, words_of
from .scratch import Scratch, ensure_columns, read_table

BUCKETS = 1 << 14
LIGHTEST = 0.002
SMOOTH = 1.0
BINS = 4096
#: log2 of the bits of the filter that texts meet before they are shuffled to the target ids.
FILTER_BITS = 24
M3 = np.uint64(0x9E3779B97F4A7C15)


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word and pair of neighbouring words."""
    data, offsets = text_buffer(column)
    words = words_of(LOWER[data], offsets)
    codes, distinct = words.encoded()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    parent = words.parents()
    same = np.flatnonzero(parent[1:] == parent[:-1])
    with np.errstate(over="ignore"):
        pairs = (own[same] * M3) ^ (own[same + 1] + M3)
        pairs = (pairs ^ (pairs >> np.uint64(29))) * M3
    both = np.concatenate([own, pairs])
    return ((both >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64), np.concatenate([parent, parent[same]])


def count_batches(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(features(batch.column(0), buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts of the buckets: a fixed number of sums, whatever the number of texts."""
    found = texts.select("text").mapInArrow(count_batches(buckets), "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets)
    for i, n in found.collect():
        out[i] = n
    return out


def score_batches(ratio, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at, parent = features(batch.column(batch.schema.get_field_index("text")), buckets)
            weight = np.bincount(parent, weights=ratio.value[at], minlength=batch.num_rows)
            arrays = [*batch.columns, pa.array(weight)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "log_weight"])

    return run


def target_ids(labels: DataFrame) -> DataFrame:
    """The doc_id of every labelled good text."""
    return ensure_columns(labels, doc_id="long", quality="int").filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def target_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids``, which are distinct.

    A bit filter of fixed size is broadcast first, so few other texts are shuffled; the ids of a
    partition are hashed and texts pass by them, unsorted.  The plan is the same at every size.  A semi join would be put before the filter.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    words = ids.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))  # 2 ** (FILTER_BITS - 6) rows at most
    near = docs.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(words), "word").filter(F.col("bits").bitwiseAND(bit) != 0)
    return near.select(*docs.columns).join(ids.hint("shuffle_hash"), "doc_id")


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    share = lambda x: (x + SMOOTH) / (x.sum() + SMOOTH * len(x))
    return np.log(share(target)) - np.log(share(raw))


def gumbel(*key: str) -> Column:
    """Gumbel noise fixed by the key, so a lost task gives the same noise again."""
    uniform = (F.shiftrightunsigned(F.xxhash64(*key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(scores: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, by counting ever narrower bins; None if there are fewer rows."""
    low, high, n = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k or k < 1:
        return None
    above = 0
    while low < high:
        width = (high - low) / BINS
        if width == 0 or low + width == low:
            break
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        inside = scores.filter(F.col(column).between(low, high)).groupBy(at.alias("b"))
        bins = inside.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()  # BINS rows at most
        for r in sorted(bins, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return high


def quantile(scores: DataFrame, column: str, share: float) -> float | None:
    """The exact percentile, between its two neighbours in proportion, without a table of all values."""
    n = scores.filter(F.col(column).isNotNull()).count()
    if not n:
        return None
    place = share * (n - 1)
    below = kth_largest(scores, column, n - math.floor(place))
    above = kth_largest(scores, column, n - math.ceil(place))
    return below + (place - math.floor(place)) * (above - below)


def resampled(docs: DataFrame, labels: DataFrame, scratch: Scratch, carry: dict[str, str] | None = None, k: int | None = None) -> DataFrame:
    """Every row with log_weight, key (log_weight with Gumbel noise) and kept.

    The noise follows doc_id and text alone, so neither file layout nor a lost task changes it.
    """
    docs = ensure_columns(docs, doc_id="long", text="string", **(carry or {})).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    ids = scratch.put(target_ids(labels), "target")
    ratio = log_ratio(bucket_counts(target_texts(docs, ids), BUCKETS), bucket_counts(docs, BUCKETS))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    names = ", ".join(f"{c} {t}" for c, t in docs.dtypes)
    scored = docs.mapInArrow(score_batches(shared, BUCKETS), f"{names}, log_weight double")
    scored = scratch.put(scored if carry else scored.drop("text"), "scored")
    scored = scored.withColumn("key", F.col("log_weight") + gumbel("doc_id", "th"))
    if k is None:
        good = scratch.put(scored.select("doc_id", "log_weight").join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select("log_weight"), "good")
        cut = quantile(good, "log_weight", LIGHTEST)
        k = scored.count() if cut is None else scored.filter(F.col("log_weight") >= cut).count()
    least = kth_largest(scored, "key", k)
    kept = F.lit(k > 0) if least is None else F.col("key") >= least
    return scored.withColumn("kept", kept)


def importance(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, key and kept of every row.

    A text without words, or null, has weight 0; a null doc_id is never a target; rows that
    repeat doc_id and text share their noise, so they stay or go together; rows that tie with the
    k-th are all kept; further columns are ignored.
    Without labelled good texts all are kept; an empty table gives no rows.
    """
    out = resampled(docs, labels, Scratch(docs.sparkSession, "importance"), None, k)
    return out.select("doc_id", "log_weight", "key", "kept")


def important_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows that importance resampling keeps, with doc_id, text, lang, source and n_chars.

    Values are as they came, nulls included, and columns that documents lack become null; repeated
    rows stay or go together; an empty table gives no rows.
    """
    carry = {"lang": "string", "source": "string", "n_chars": "long"}
    out = resampled(docs, labels, scratch or Scratch(docs.sparkSession, "importance"), carry)
    return out.filter("kept").select("doc_id", "text", "lang", "source", "n_chars")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, key and verdict of every row of ``documents``, towards the good texts of ``labels``;
    null and empty texts weigh 0, and an empty table gives no rows."""
    return importance(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
