"""Best-fit packing of token pieces into sequences of fixed capacity, in synchronous rounds.

A round takes one class of lengths, longest first.  Its documents and all gaps that can hold
one are put in order of size; a sweep from large to small gives each document the tightest
gap that is still free (its successor), which is the matching of brackets with gaps as opening
and documents as closing ones.  The sweep is distributed: prefix sums over the at most
``capacity`` sizes give each row its depth, and rows of one depth alternate, so a window over
the depth finds the partner.  Rank resolves conflicts: the k-th document of a size meets the
k-th free gap.  Documents without a gap fill new sequences one after another, longest first, by
their rank among those; the gaps are updated, and the next class meets them.  In a class whose
longest documents are twice as long as its shortest, a gap can take more than the sweep gave it:
there, documents without a gap meet the updated gaps again as long as that places any of them.

Every table of a round is keyed by sequence or by depth, so none has a hot key, and sizes that
many rows share are ranked in salted parts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_text import slices, sums_by, text_buffer, words_of
from .scratch import Scratch, ensure_columns

CAPACITY = 4096
END_ID = 1
SALTS = 16
#: Lower ends of the classes of lengths, as shares of the capacity: 1/2, 1/3, ...
STEPS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 28, 40, 64, 128, 400)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_encoder(tokenizer_path: str, capacity: int, end_id: int, with_ids: bool) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from .bpe_words import WordEndBpe

        bpe = WordEndBpe(tokenizer_path)
        for batch in slices(batches, "text"):
            data, offsets = text_buffer(batch.column(1))
            words = words_of(data, offsets)
            ids, counts = bpe.encode_words(words)
            per_doc = sums_by(words.docs, counts)
            out = np.full(len(ids) + batch.num_rows, end_id, dtype="<u4")
            bounds = np.concatenate([[0], np.cumsum(per_doc + 1)])
            inner = np.ones(len(out), dtype=bool)
            inner[bounds[1:] - 1] = False
            out[inner] = ids
            n_pieces = -(-(per_doc + 1) // capacity)
            doc = np.repeat(np.arange(batch.num_rows), n_pieces)
            first = np.concatenate([[0], np.cumsum(n_pieces)])[:-1]
            piece = np.arange(len(doc)) - first[doc]
            start = piece * capacity
            length = np.minimum(per_doc[doc] + 1 - start, capacity)
            begin = bounds[doc] + start
            crc = [zlib.crc32(out[a : a + n].tobytes()) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = {
                "doc_id": batch.column(0).take(pa.array(doc)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(at), pa.array(out.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    return encode


def encode_pieces(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Token pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32[, ids]."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    path = tokenizer_path or vocabulary("word_bpe_49k.json")
    return ensure_columns(docs, doc_id="long", text="string").mapInArrow(
        piece_encoder(path, capacity, end_id, with_ids), schema + ", ids array<int>" * with_ids
    )


def classes(histogram: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """Ranges (low, high) of lengths that occur, longest first.

    A sequence holds exactly j documents of the class (capacity / (j + 1), capacity / j], so
    long documents are classed by that rule and short ones, which fill gaps, more coarsely.
    """
    out, high = [], capacity
    for step in (*STEPS, capacity + 1):
        low = max(1, capacity // step + 1)
        present = [s for s in histogram if low <= s <= high]
        if present:
            out.append((low, max(present)))
        high = low - 1
    return out


class Sweep:
    """What a sweep will do, from the counts of its (size, kind, gap, salt) parts.

    There are at most 2 * capacity * SALTS parts, whatever the number of rows.  A document that
    brings the depth below all before it finds no gap, and -depth is its rank among those.
    """

    def __init__(self, parts: list[tuple], high: int, capacity: int):
        self.slots = self.wanted = self.lowest = 0
        depth, rows, alone = 0, [], {}
        for v, kind, gap, salt, n in sorted(parts, key=lambda x: (-x[0], x[1], -x[2], x[3])):
            rows.append((v, kind, gap, salt, depth))
            depth += -n if kind else n
            if kind:
                self.wanted += n
                alone.setdefault(v, [-self.lowest, 0])[1] += max(0, self.lowest - depth)
                self.lowest = min(self.lowest, depth)
            elif v == high:
                self.slots += n
        fills, last, room = {}, -1, 0
        for v, (begin, n) in alone.items():  # lengths from long to short
            more = min(n, room // v)
            per = capacity // v
            fills[v] = (begin, more, last, last + 1, per)
            room -= more * v
            if n > more:
                last += -(-(n - more) // per)
                room = capacity - ((n - more - 1) % per + 1) * v
        names = ("v", "kind", "gap", "salt", "depth", "begin", "more", "started", "next", "per")
        types = (pa.int64(), pa.int32(), *[pa.int64()] * 8)
        columns = zip(*[(*r, *(fills[r[0]] if r[1] else [None] * 5)) for r in rows], strict=True)
        self.table = pa.table({k: pa.array(c, t) for k, c, t in zip(names, columns, types, strict=True)})

    @property
    def without_gap(self) -> int:
        return -self.lowest


def sweep(docs: DataFrame, gaps: DataFrame, low: int, high: int, capacity: int, round_no: int) -> tuple[DataFrame, Sweep]:
    """Documents of one class with the sequence that each goes to; ``opened`` marks new ones."""
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    payload = [c for c in docs.columns if c != "item_id"]
    closing = docs.select(
        F.col("length").alias("v"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("gap"),
        salt("item_id").alias("salt"), F.lit(1).cast("long").alias("k"), F.col("item_id").alias("id"),
        F.struct(*payload).alias("doc"),
    )
    opening = gaps.filter(F.col("gap") >= low).select(
        F.least("gap", F.lit(high)).cast("long").alias("v"), F.lit(0).alias("kind"), "gap",
        salt("sequence_id").alias("salt"),
        F.when(F.col("gap") >= high, F.floor(F.col("gap") / high)).otherwise(1).cast("long").alias("k"),
        F.col("sequence_id").alias("id"), F.lit(None).cast(closing.schema["doc"].dataType).alias("doc"),
    )
    events = opening.unionByName(closing)
    part = ["v", "kind", "gap", "salt"]
    counted = events.groupBy(*part).agg(F.sum("k").alias("n")).collect()
    plan = Sweep([tuple(r) for r in counted], high, capacity)
    rank = Window.partitionBy(*part).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The rows lie by part already; a broadcast would keep a page of the driver's memory in every round.
    begins = docs.sparkSession.createDataFrame(plan.table).hint("shuffle_hash")
    ranked = events.withColumn("rank", F.sum("k").over(rank)).join(begins, part)
    top = F.col("depth") + F.col("rank")
    alone = F.col("rank") - F.col("depth") - 1 - F.col("begin")  # rank among those of its length without a gap
    fill = F.when(alone < F.col("more"), F.col("started")).otherwise(
        F.col("next") + F.floor((alone - F.col("more")) / F.col("per"))
    )
    columns = ["level", "v", "kind", "id", "doc", "fill"]
    slots = (
        ranked.filter("kind = 0")
        .filter((F.col("v") < high) | (top > plan.slots - plan.wanted))  # deeper ones stay free
        .withColumn("level", F.explode(F.sequence(top - F.col("k") + 1, top)))
        .withColumn("fill", F.lit(None).cast("long"))
        .select(columns)
    )
    levels = slots.unionByName(
        ranked.filter("kind = 1").withColumn("level", F.col("depth") - F.col("rank") + 1).withColumn("fill", fill).select(columns)
    )
    by_level = Window.partitionBy("level").orderBy(F.desc("v"), "kind")
    found = levels.select(
        "kind", "id", "doc", "fill",
        F.lag("kind").over(by_level).alias("before_kind"), F.lag("id").over(by_level).alias("gap_of"),
    ).filter("kind = 1")
    matched = F.coalesce(F.col("before_kind") == 0, F.lit(False))
    new_id = F.lit(round_no).cast("long") * F.lit(1 << 44) + F.col("fill")
    return found.select(
        F.col("id").alias("item_id"), "doc.*",
        F.when(matched, F.col("gap_of")).otherwise(new_id).cast("long").alias("sequence_id"),
        (~matched).alias("opened"),
    ), plan


def no_gaps(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("gap"))


def best_fit(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``.

    Pieces of a sequence stand by offset from 0 without gaps.  An empty table stays empty;
    equal rows are separate pieces.
    """
    spark = pieces.sparkSession
    items = scratch.put(pieces.withColumn("item_id", F.monotonically_increasing_id()), "pieces")
    histogram = dict(items.groupBy("length").count().collect())  # at most ``capacity`` lengths
    if histogram and (min(histogram) < 1 or max(histogram) > capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    gaps: DataFrame | None = None
    placed: list[str] = []
    number = 0
    for low, high in classes(histogram, capacity):
        docs: DataFrame | None = items.filter(F.col("length").between(low, high))
        while docs is not None:
            number += 1
            again = False
            if gaps is None and 2 * low > capacity:  # no two of them go together; other ids are positive
                found = docs.withColumn("sequence_id", -1 - F.col("item_id")).withColumn("opened", F.lit(True))
            else:
                found, plan = sweep(docs, no_gaps(spark) if gaps is None else gaps, low, high, capacity, number)
                again = 2 * low <= high and 0 < plan.without_gap < plan.wanted
            found = found.withColumn("stays", ~F.col("opened") if again else F.lit(True))
            found = scratch.put(found, f"placed-{high}")
            placed.append(found._scratch_path)
            docs = None
            if again:
                docs = found.filter("opened").drop("sequence_id", "opened", "stays")
                found = found.filter("stays")
            if docs is None and low <= min(histogram):
                break  # nothing is left that could meet the gaps
            used = found.select("sequence_id", (-F.col("length")).alias("gap"), "opened")
            old, every = gaps, used
            if old is not None:
                every = old.withColumn("opened", F.lit(False)).unionByName(used)
            left = F.sum("gap") + F.when(F.max("opened"), capacity).otherwise(0)
            gaps = every.groupBy("sequence_id").agg(left.alias("gap")).filter(F.col("gap") >= min(histogram))
            gaps = scratch.put(gaps, f"gaps-{number}")
            scratch.drop(old)
    if not placed:
        return items.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("item_id")
    # One scan of all rounds' tables: a union would give the driver a plan, and code, for each.
    every = spark.read.schema(found.schema).parquet(*placed).filter("stays")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "item_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offset: Column = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return every.select(*pieces.columns, "sequence_id", offset)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Packs whole documents into as few sequences as best fit finds.

    A document's ids end with ``end_id``; only longer ones are cut, into pieces of
    ``capacity``.  A null text counts as empty and gives the piece [end_id]; a null doc_id
    stays null; repeated rows are packed separately; further columns are ignored; an empty table
    gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    return best_fit(encode_pieces(docs, tokenizer_path, capacity, end_id, with_ids), scratch, capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all ``documents``, whole texts, with their places in sequences of 4096 tokens;
    null and empty texts are the piece [1], repeated rows are pieces each, an empty table gives none."""
    from .scratch import read_table

    return pack_documents(read_table(spark, sf_dir, "documents"))
