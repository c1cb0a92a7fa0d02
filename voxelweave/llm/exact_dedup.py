"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

Rows are written once with the hash of their normalised text.  The directory over the top bits
of that hash starts at a depth that fits the number of keys and doubles while any bucket holds
more keys than its capacity: only overfull buckets split, the others keep their local depth.
Equal keys cannot be split; they chain within their bucket.  Buckets are dealt to owner tasks
by ranges of the hash, and a chain's texts are compared byte by byte, so two texts of one hash
stay apart.  Copies are pre-aggregated in salted parts, so a text that a third of the rows
share does not meet in one task before it has become a few rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, ensure_columns, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that a bucket of the index holds before it splits.
CAPACITY = 4096
SALTS = 16
MAX_DEPTH = 48


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as empty; ASCII texts take the faster function of equal result."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def prefix(h: Column, depth: int) -> Column:
    """The top ``depth`` bits of a hash; 0 for depth 0."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Adds local_depth and bucket (the range start of the hash prefix) to distinct keys.

    Each round works on the keys of overfull buckets only, so the rounds shrink quickly; the
    driver sees two counts a round.
    """
    total = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, total / (0.75 * capacity)))))
    placed: list[DataFrame] = []
    pending = keys
    while True:
        at = pending.withColumn("p", prefix(F.col("h"), depth))
        over = at.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") > capacity)
        over = scratch.put(over.select("p"), f"overfull-{depth}") if depth < MAX_DEPTH else None
        full = over is not None and not over.isEmpty()
        settled = at.join(over, "p", "left_anti") if full else at
        placed.append(settled.select(*keys.columns, F.lit(depth).alias("local_depth"), (F.shiftleft("p", 64 - depth) if depth else F.lit(0).cast("long")).alias("bucket")))
        if not full:
            break
        pending = scratch.put(at.join(over, "p", "left_semi").select(*keys.columns), f"split-{depth}")
        depth += 1
    out = placed[0]
    for one in placed[1:]:
        out = out.unionByName(one)
    return out


def index_documents(docs: DataFrame, scratch: Scratch, carry: dict[str, str] | None = None, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): every row with its hash, and for each text with copies the row that stays.

    groups has h, text_sha256, keep_id, keep_row and group_size for texts of two rows or more.
    """
    source = ensure_columns(docs, doc_id="long", text="string", **(carry or {}))
    rows = source.withColumn("norm", normalised(F.col("text")))
    rows = rows.withColumn("h", F.xxhash64("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    rows = rows.drop("norm" if carry else "text").withColumn("row", F.monotonically_increasing_id())
    rows = scratch.put(rows, "rows")
    keys = scratch.put(rows.groupBy("h").agg(F.count("*").alias("n")), "keys")
    directory = build_directory(keys, scratch, capacity)
    chained = scratch.put(directory.filter("n > 1").select("h", "bucket"), "chains")
    newest = F.max(F.struct("doc_id", "row"))
    norm = normalised(F.col("text")).alias("norm") if carry else F.col("norm")
    copies = rows.select("h", norm, "text_sha256", "doc_id", "row").join(chained, "h")
    text = ["bucket", "h", "norm", "text_sha256"]
    parts = copies.groupBy(*text, F.pmod(F.col("row"), F.lit(SALTS)).alias("salt")).agg(newest.alias("last"), F.count("*").alias("n"))
    parts = scratch.put(parts, "parts")
    owned = parts.repartitionByRange("bucket", "h")  # owner tasks: ranges of the directory
    groups = owned.groupBy(*text).agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    groups = groups.filter("n > 1").select(
        "h", "text_sha256", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row"), F.col("n").alias("group_size")
    )
    return rows, scratch.put(groups, "groups")


def joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, ["h", "text_sha256"], "left")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every row with the doc_id that stays for its text, the group's size and its digest.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  The row with
    the largest doc_id stays, a null doc_id being the smallest; of repeated rows with that id
    one stays.  Further columns are ignored; an empty table gives no rows.
    """
    rows, groups = index_documents(docs, Scratch(docs.sparkSession, "dedup"), None, capacity)
    single = F.col("group_size").isNull()
    return joined(rows.select("doc_id", "row", "h", "text_sha256"), groups).select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def distinct_documents(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows that stay, with doc_id, text, lang, source and n_chars as they came.

    A null text counts as empty, and of all empty texts one row stays; of repeated rows one stays;
    columns that documents lack become null; an empty table gives no rows.
    """
    carry = {"lang": "string", "source": "string", "n_chars": "long"}
    rows, groups = index_documents(docs, scratch or Scratch(docs.sparkSession, "dedup"), carry)
    # The rows that go are few beside the texts, so Spark can often send them to the texts.
    gone = joined(rows.select("row", "h", "text_sha256"), groups).filter("row <> keep_row").select("row")
    return rows.join(gone, "row", "left_anti").select("doc_id", "text", "lang", "source", "n_chars")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text; null counts as empty, repeated
    rows form a group, and an empty table gives no rows."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
