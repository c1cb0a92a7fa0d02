"""Quality rules: cross-document line frequency within a host, and counts within a document.

One pass over the texts counts words, symbols, repeated lines and repeated five-word windows,
and hashes each document's normalised lines.  A second step counts, for every host and line,
the documents that hold it, each once; lines above the limits are boilerplate and are removed,
and documents that keep too little are rejected.  A line that only copies of a few documents hold
is their text, not the host's, and stays: deduplication is a later step.  Only hashes are shuffled, each line once per
document, and sums are taken before the shuffle, so neither a hot host nor a common line meets
in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import IS_SPACE, Words, code_points, list_array, slices, sums_by, text_buffer, words_of
from .scratch import Scratch, ensure_columns, read_table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A line is boilerplate in a host if over MIN_DOCS documents and over SHARE of the host's have it,
#: and at least MIN_TEXTS of these differ.
MIN_DOCS = 20
SHARE = 0.01
MIN_TEXTS = 5
#: A document is depleted if fewer words than MIN_WORDS, or less than KEEP of its words, remain.
KEEP = 0.3
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def normalised(line: bytes) -> bytes:
    """A line without outer white space, runs of it as one space, A-Z in lower case."""
    return b" ".join(line.split()).lower()


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(normalised(line)) - (1 << 63)


def repeated_words(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Words of each document that lie in a WINDOW found twice or more in that document.

    Windows are put in order of a hash; neighbours of equal hash are compared word by word,
    and a hash that different windows of one document share sends it to the plain count.
    """
    n_docs, n = len(docs) - 1, len(codes)
    out = np.zeros(n_docs, np.int64)
    m = n - WINDOW + 1
    if m < 2:
        return out
    parent = np.repeat(np.arange(n_docs), np.diff(docs))
    at = np.flatnonzero(parent[:m] == parent[WINDOW - 1 :])
    wide = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        h = parent[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for k in range(WINDOW):
            x = wide[at + k] * MIX[k]
            h = (h ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = hs[1:] == hs[:-1]
    a, b = at[order[1:][same]], at[order[:-1][same]]
    equal = parent[a] == parent[b]
    for k in range(WINDOW):
        equal &= codes[a + k] == codes[b + k]
    marked = np.zeros(n + 1, np.int64)
    starts = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(marked, starts, 1)
    np.add.at(marked, starts + WINDOW, -1)
    out = sums_by(docs, np.cumsum(marked)[:n] > 0)
    for d in set(parent[a[~equal]].tolist()) | set(parent[b[~equal]].tolist()):
        own, seen = codes[docs[d] : docs[d + 1]].tolist(), {}
        for i in range(len(own) - WINDOW + 1):
            seen.setdefault(tuple(own[i : i + WINDOW]), []).append(i)
        out[d] = len({i + k for x in seen.values() if len(x) > 1 for i in x for k in range(WINDOW)})
    return out


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Lines between line feeds; an empty document has none."""
    ends = np.flatnonzero(data == 10)
    first = offsets[:-1][np.diff(offsets) > 0]
    starts = np.unique(np.concatenate([first, ends + 1]))
    starts = starts[starts < len(data)]
    own = offsets[np.searchsorted(offsets, starts, side="right")]
    lasts = np.minimum(np.append(ends, len(data))[np.searchsorted(ends, starts)], own)
    inside = data != 10
    return Words(data[inside], starts, lasts, offsets)


def count_batches(with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_buffer(batch.column(2))
            words = words_of(data, offsets)
            codes, _ = words.encoded()
            n_words = np.diff(words.docs)
            inside = ~IS_SPACE[data]
            lines = lines_of(data, offsets)
            line_codes, distinct = lines.encoded()
            hashes = np.fromiter((line_hash(x) for x in distinct.to_pylist()), np.int64, len(distinct))
            in_line = np.searchsorted(words.starts, np.append(lines.starts, len(data)))
            n_in = np.diff(in_line) if len(lines) else np.zeros(0, np.int64)
            parent = lines.parents()
            worded = n_in > 0
            key = parent[worded] * max(len(distinct), 1) + line_codes[worded]
            distinct_lines = np.bincount(np.unique(key) // max(len(distinct), 1), minlength=batch.num_rows)
            dup = np.bincount(parent[worded], minlength=batch.num_rows) - distinct_lines
            # Each normalised line once per document, with the words that it holds there.
            h, w, d = hashes[line_codes[worded]], n_in[worded], parent[worded]
            order = np.lexsort((h, d))
            h, w, d = h[order], w[order], d[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            begin = np.flatnonzero(new)
            sums = np.add.reduceat(w, begin) if len(begin) else w
            pairs = pa.StructArray.from_arrays([pa.array(h[begin]), pa.array(sums.astype(np.int64))], ["h", "words"])
            at = np.concatenate([[0], np.cumsum(np.bincount(d[begin], minlength=batch.num_rows))])
            columns = {
                "doc_id": batch.column(0),
                "host": batch.column(1),
                "n_words": pa.array(n_words, pa.int64()),
                "word_chars": pa.array(sums_by(offsets, inside & code_points(data)), pa.int64()),
                "n_symbols": pa.array(sums_by(offsets, SYMBOLS[data]), pa.int64()),
                "n_dup_lines": pa.array(dup, pa.int64()),
                "n_repeat_words": pa.array(repeated_words(codes, words.docs), pa.int64()),
                "content": pa.array([content_hash(h[begin[a:b]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                "lines": list_array(at, pairs),
            }
            if with_text:
                columns |= {c: batch.column(batch.schema.get_field_index(c)) for c in ("text", "lang", "n_chars")}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def content_hash(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(hashes)) - (1 << 63)


COUNTS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<struct<h:long,words:long>>"


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def frequent_lines(counts: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """host, h, n_docs of the lines above the limits.

    A row is a document and counts once for a line; documents of equal lines are summed up
    before the shuffle by line, so a hot host or a large group of copies is few rows there.
    """
    docs = counts.select("host", "content", "lines").filter(F.size("lines") > 0)
    per_host = docs.groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = docs.select("host", "content", F.explode("lines.h").alias("h")).groupBy("host", "h", "content").agg(F.count("*").alias("n"))
    common = lines.groupBy("host", "h").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_texts"))
    common = common.filter((F.col("n_docs") > min_docs) & (F.col("n_texts") >= MIN_TEXTS))
    limits = common.join(per_host, "host")
    return limits.filter(F.col("n_docs") > share * F.col("host_docs")).select("host", "h", "n_docs")


def judged(docs: DataFrame, scratch: Scratch, with_text: bool = False, min_docs: int = MIN_DOCS, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """Counts of each document with removed_words, removed (its removed line hashes) and kept."""
    source = ensure_columns(docs, doc_id="long", source="string", text="string", **({"lang": "string", "n_chars": "long"} if with_text else {}))
    schema = COUNTS + ", text string, lang string, n_chars long" * with_text
    counts = source.mapInArrow(count_batches(with_text), schema)
    named = [F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_source")]
    counts = scratch.put(counts.select("*", F.monotonically_increasing_id().alias("row"), named[1]).withColumn("host", named[0]), "counts")
    frequent = scratch.put(frequent_lines(counts, min_docs, share), "frequent")
    held = counts.select("row", "host", F.inline("lines")).join(frequent.select("host", "h"), ["host", "h"])
    removed = held.groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_set("h").alias("removed"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    depleted = (left < MIN_WORDS) | (left < keep * F.col("n_words"))
    return counts.drop("lines", "content").join(removed, "row", "left").withColumn("kept", ~base_failed() & ~depleted)


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """Counts and verdict of every document; hosts are the values of ``source``.

    A null text has no words and fails; rows without a source, or with an empty one, are one host;
    repeated rows count and are judged each; further columns are ignored; an empty table gives no
    rows.
    """
    out = judged(docs, Scratch(docs.sparkSession, "rules"), False, min_docs, share, keep)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        "kept", F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
    )


def strip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, hashes = batch.column(2).to_pylist(), batch.column(5).to_pylist()
        for i, drop in enumerate(hashes):
            if drop:
                gone = set(drop)
                texts[i] = "\n".join(x for x in texts[i].split("\n") if line_hash(x.encode()) not in gone)
        chars = batch.column(4).to_pylist()
        chars = [len(t) if h else n for t, h, n in zip(texts, hashes, chars, strict=True)]
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column(0), "text": pa.array(texts, pa.string()), "lang": batch.column(1), "source": batch.column(3), "n_chars": pa.array(chars, pa.int64())}
        )


def clean_documents(
    docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, keep: float = KEEP, scratch: Scratch | None = None
) -> DataFrame:
    """The documents that the rules keep, without their boilerplate lines.

    Rejected documents go, null and empty texts among them; the other rows keep doc_id, lang and
    source, null where they were, and n_chars follows the text where lines went.  Repeated rows
    stay repeated; columns that documents lack become null; an empty table gives no rows.
    """
    out = judged(docs, scratch or Scratch(docs.sparkSession, "rules"), True, min_docs, share, keep).filter("kept")
    source = F.when(~F.col("no_source"), F.col("host")).alias("source")
    rows = out.select("doc_id", "lang", "text", source, "n_chars", "removed")
    return rows.mapInArrow(strip_batches, "doc_id long, text string, lang string, source string, n_chars long")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every row of ``documents``; null and empty texts have no words and fail,
    repeated rows are judged each, and an empty table gives no rows."""
    return quality_rules(read_table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         string_split(t, chr(10)) AS ls FROM d
), b AS (
  SELECT doc_id, host, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         ws FROM w
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], chr(10)) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, i, unnest(range({WINDOW})) AS k
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
  ) GROUP BY doc_id
), l0 AS (
  SELECT doc_id, host, unnest(ls) AS line FROM w
), l1 AS (
  SELECT doc_id, host,
         translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l0
), l AS (
  SELECT doc_id, host, h, sum(n) AS n FROM l1 WHERE h <> '' GROUP BY ALL
), c AS (
  SELECT doc_id, host, string_agg(h, chr(10) ORDER BY h) AS content FROM l GROUP BY ALL
), f AS (
  SELECT host, h FROM (SELECT l.host, h, count(*) AS n, count(DISTINCT content) AS texts FROM l JOIN c USING (doc_id) GROUP BY l.host, h)
  JOIN (SELECT host, count(*) AS total FROM c GROUP BY host) USING (host)
  WHERE n > {MIN_DOCS} AND texts >= {MIN_TEXTS} AND n > {SHARE}::DOUBLE * total
), x AS (
  SELECT doc_id, sum(n) AS removed FROM l JOIN f USING (host, h) GROUP BY doc_id
), v AS (
  SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words,
         n_words < {MIN_WORDS} OR 100 * coalesce(r.n, 0) > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM b LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= {MIN_WORDS} AND n_words - removed_words >= {KEEP}::DOUBLE * n_words AS kept,
       removed_words
FROM v
"""
