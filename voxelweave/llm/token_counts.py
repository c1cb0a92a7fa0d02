"""Exact length histogram: how many documents have each encoded length, and what follows from it.

Suffix sums over the histogram answer, for every context limit, how many documents and tokens
a corpus has, how many tokens remain if documents are truncated there, and any quantile.  The
histogram has a row for each length that occurs; sums over blocks of lengths let the suffix
sums run in parallel, so no task holds more than one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import encode
from .scratch import Scratch, read_table

BLOCK = 512
QUANTILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Documents of each ``n_tokens``; rows with a null length are left out."""
    return lengths.filter("n_tokens IS NOT NULL").groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L, as a context limit: documents and tokens at or above and below it.

    docs_at_most and tokens_at_most count documents of length <= L; docs_over those that a
    limit of L cuts; truncated_tokens what the corpus has under that limit; total_docs and
    total_tokens everything.  An empty histogram gives no rows.
    """
    tokens = F.col("length") * F.col("n_docs")
    h = histogram.withColumn("tokens", tokens).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    # The upper level has a row for each BLOCK lengths, so its one window stays small.
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(upto), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("b_tokens").over(upto), F.lit(0)).alias("tokens_before"),
        F.sum("b_docs").over(every).alias("total_docs"),
        F.sum("b_tokens").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs_upto = F.col("docs_before") + F.sum("n_docs").over(inside)
    tokens_upto = F.col("tokens_before") + F.sum("tokens").over(inside)
    out = h.join(blocks, "block").select(
        "length", "n_docs", docs_upto.alias("docs_at_most"), tokens_upto.alias("tokens_at_most"), "total_docs", "total_tokens"
    )
    over = F.col("total_docs") - F.col("docs_at_most")
    return out.select(
        "length", "n_docs", "docs_at_most", "tokens_at_most", over.alias("docs_over"),
        (F.col("tokens_at_most") + F.col("length") * over).alias("truncated_tokens"), "total_docs", "total_tokens",
    )


def truncated_total(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens and cut documents of the corpus under each of any limits, from the suffix sums."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    below = sums.crossJoin(F.broadcast(asked)).filter(F.col("length") <= F.col("context_limit"))
    best = below.groupBy("context_limit").agg(F.max(F.struct("length", "docs_at_most", "tokens_at_most")).alias("x"))
    total = sums.agg(F.max("total_docs").alias("n"))
    over = F.col("n") - F.coalesce("x.docs_at_most", F.lit(0))
    return asked.join(best, "context_limit", "left").crossJoin(total).select(
        "context_limit", over.alias("docs_over"),
        (F.coalesce("x.tokens_at_most", F.lit(0)) + F.col("context_limit") * over).alias("truncated_tokens"),
    )


def length_quantiles(sums: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Smallest length that at least the share q of documents does not exceed."""
    picks = [F.min(F.when(F.col("docs_at_most") >= F.ceil(F.lit(q) * F.col("total_docs")), F.col("length"))).alias(f"q{q}") for q in quantiles]
    one = sums.agg(*picks)
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"`q{q}`").alias("length")) for q in quantiles])
    return one.select(F.inline(pairs))


def token_counts(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Suffix sums over the encoded lengths of whole texts; a null text has length 0.

    The histogram is written first, so the corpus is encoded once.  Repeated rows count each; an
    empty table gives no rows; further columns are ignored.
    """
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    histogram = Scratch(docs.sparkSession, "lengths").put(length_histogram(encode(docs, "counts", path)), "histogram")
    return with_suffix_sums(histogram)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums of ``documents``: a row for each length that occurs; null texts have length 0,
    repeated rows count each, and an empty table gives no rows."""
    return token_counts(read_table(spark, sf_dir, "documents"))
