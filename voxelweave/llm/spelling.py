"""Spelling variants: words one edit apart, from a positional q-gram index with a count filter.

Words are padded and cut into grams of Q characters with their places.  One edit touches at most Q
grams and moves the others by one place at most, so two words one edit apart share at least
(longer length - 1) grams within one place.  Hence the Q + 1 rarest grams of both must share one:
only those go to the index.  Postings of a gram meet in a task, where they lie sorted by length and
place; each posting is merged with the ranges of its own and the next length within one place.
Pairs that share fewer grams than the bound are dropped, and the rest is verified letter by letter.

Words are kept in Latin-1, one byte a character, which is the order of their code points too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import LOWER, runs_of, slices, text_buffer
from .near_dedup import M3, mixed
from .scratch import Scratch, ensure_columns, read_table

Q = 4
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: Of the occurrences of a run, one in this many loses a letter in the query.
TYPO_EVERY = 199
#: Grams are counted in this many hashed slots (log2): the counts fit any task.
SLOT_BITS = 16
#: Postings of a gram that meet in one part, and those of a task.
PART, TASK = 4096, 60_000
#: Pairs looked at in one step.
CHUNK = 1 << 19
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True


def latin(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of A-Z and U+00C0-U+00FF as one byte each, anything else as 0."""
    lead = data == 0xC3
    after = np.zeros(len(data), dtype=bool)
    after[1:] = lead[:-1]
    out = np.where(LETTER[data], LOWER[data], np.uint8(0))
    out[after] = data[after] + np.uint8(0x40)
    at = np.concatenate([[0], np.cumsum(~lead)])[offsets]
    return out[~lead], at


def counter(least: int, typo_every: int | None) -> Callable:
    """(word, occurrences) of each slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, at = latin(*text_buffer(batch.column(1)))
            words = runs_of(flat, flat > 0, at)
            codes, distinct = words.encoded()
            keep = np.flatnonzero(words.lengths >= least)
            codes = codes[keep]
            changed: Counter[bytes] = Counter()
            if typo_every:
                plain = distinct.to_pylist()
                utf8 = [w.decode("latin-1").encode() for w in plain]
                heads = [crc32(f"{'' if d is None else d}:".encode()) for d in batch.column(0).to_pylist()]
                docs = words.parents()[keep].tolist()
                h = np.fromiter(map(crc32, map(utf8.__getitem__, codes.tolist()), map(heads.__getitem__, docs)), np.int64, len(codes))
                hit = h % typo_every == 0
                for c, x in zip(codes[hit].tolist(), h[hit].tolist(), strict=True):
                    k = x % len(plain[c])
                    changed[plain[c][:k] + plain[c][k + 1 :]] += 1
                codes = codes[~hit]
            n = np.bincount(codes, minlength=len(distinct))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"w": distinct.take(pa.array(some)).cast(pa.binary()), "n": pa.array(n[some], pa.int64())})
            altered = [(w, k) for w, k in changed.items() if len(w) >= least]
            yield pa.RecordBatch.from_pydict({"w": pa.array([w for w, _ in altered], pa.binary()), "n": pa.array([k for _, k in altered], pa.int64())})

    return run


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, typo_every: int | None = None) -> DataFrame:
    """Words w (Latin-1) of at least ``least_chars`` characters and their n >= ``least_count`` occurrences."""
    docs = ensure_columns(docs, doc_id="long", text="string")
    counts = docs.mapInArrow(counter(least_chars, typo_every), "w binary, n long")
    return counts.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def flat_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def padded_grams(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the grams of padded words, and where each word's begin."""
    pad, n = Q - 1, len(at) - 1
    start = at + 2 * pad * np.arange(n + 1)
    body = np.ones(start[-1] if n else 0, np.uint8)
    body[np.arange(len(flat)) + np.repeat(2 * pad * np.arange(n) + pad, np.diff(at))] = flat
    for k in range(1, pad + 1):
        body[start[1:] - k] = 2
    codes = np.zeros(max(0, len(body) - pad), np.uint32)
    for k in range(Q):
        codes = (codes << np.uint32(8)) | body[k : len(body) - pad + k]
    keep = np.ones(len(body), dtype=bool)
    for k in range(1, pad + 1):
        keep[start[1:] - k] = False
    return codes[keep[: len(codes)]], at + pad * np.arange(n + 1)


def slots(codes: np.ndarray) -> np.ndarray:
    return (mixed(codes.astype(np.uint64) * M3) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.bincount(slots(padded_grams(*flat_words(batch.column(0)))[0]), minlength=1 << SLOT_BITS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())})


def collected(counts: DataFrame) -> np.ndarray:
    """Counts by slot; at most 2 ** SLOT_BITS rows come to the driver."""
    out = np.zeros(1 << SLOT_BITS, np.int64)
    for slot, n in counts.groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out


def posting_batches(frequency) -> Callable:  # noqa: ANN001
    """(w, n, gram, pos, slot) of the Q + 1 rarest grams of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at = padded_grams(*flat_words(batch.column(0)))
            sizes = np.diff(at)
            word = np.repeat(np.arange(batch.num_rows), sizes)
            pos = np.arange(len(codes)) - np.repeat(at[:-1], sizes)
            slot = slots(codes)
            order = np.lexsort((pos, codes, frequency.value[slot], word))
            first = order[np.arange(len(order)) - np.repeat(at[:-1], sizes) <= Q]
            of = pa.array(word[first])
            yield pa.RecordBatch.from_pydict(
                {"w": batch.column(0).take(of), "n": batch.column(1).take(of), "gram": pa.array(codes[first].astype(np.int64)), "pos": pa.array(pos[first], pa.int32()), "slot": pa.array(slot[first], pa.int32())}
            )

    return run


def dealer(parts_of, buckets: int) -> Callable:  # noqa: ANN001
    """Postings by cell: a gram, or two parts of a gram that many words have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, pos, slot = (batch.column(c).to_numpy() for c in ("gram", "pos", "slot"))
            own = np.fromiter((crc32(w) for w in batch.column("w").to_pylist()), np.int64, batch.num_rows)
            parts = parts_of.value[slot]
            own %= parts
            row = np.repeat(np.arange(len(parts)), parts)
            other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            i, j = np.minimum(own[row], other), np.maximum(own[row], other)
            with np.errstate(over="ignore"):
                cell = mixed(mixed(gram[row].astype(np.uint64) * M3 + i.astype(np.uint64)) * M3 + j.astype(np.uint64)) >> np.uint64(1)
            side = np.where(i == j, -1, (own[row] == j).astype(np.int64))
            of = pa.array(row)
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array((cell % np.uint64(buckets)).astype(np.int64)), "cell": pa.array(cell.astype(np.int64)), "side": pa.array(side, pa.int32()), "pos": pa.array(pos[row], pa.int32()), "w": batch.column("w").take(of), "n": batch.column("n").take(of)}
            )

    return run


def ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, place) of each row's range of places, about CHUNK at a time."""
    counts = np.maximum(high - low, 0)
    total = np.cumsum(counts)
    start = 0
    while start < len(counts):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + CHUNK, side="right")))
        c = counts[start:stop]
        left = np.repeat(np.arange(start, stop), c)
        yield left, np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c) + low[left]
        start = stop


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Grams of ``a`` that ``b`` has within one place; b is as wide as a or one wider."""
    n = a.shape[1]
    same = a == b[:, :n]
    same[:, 1:] |= a[:, 1:] == b[:, : n - 1]
    last = b.shape[1] - 1
    same[:, :last] |= a[:, :last] == b[:, 1 : 1 + n]
    return same.sum(axis=1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter, or one that b has more."""
    n = a.shape[1]
    if n == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


class Length:
    """Postings of the words of one length, sorted by cell and place."""

    def __init__(self, rows: np.ndarray, key: np.ndarray, flat: np.ndarray, at: np.ndarray, size: int):
        self.rows = rows[np.argsort(key[rows], kind="stable")]
        self.key = key[self.rows]
        self.letters = flat[at[self.rows][:, None] + np.arange(size)]
        self.grams = padded_grams(self.letters.ravel(), size * np.arange(len(rows) + 1))[0].reshape(len(rows), -1)


def near_in_cells(table: pa.Table) -> pa.Table:
    """Pairs of words one edit apart whose postings meet in a cell, the shorter or smaller first."""
    words = table.column("w").combine_chunks()
    flat, at = flat_words(words)
    sizes = np.diff(at)
    pos, side = (table.column(c).to_numpy() for c in ("pos", "side"))
    cell = np.unique(table.column("cell").to_numpy(), return_inverse=True)[1].astype(np.int64)
    key = cell * (int(sizes.max()) + 2 * Q) + pos + 1
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    before: Length | None = None
    for size in range(int(sizes.min()), int(sizes.max()) + 1):
        rows = np.flatnonzero(sizes == size)
        if not len(rows):
            before = None
            continue
        now = Length(rows, key, flat, at, size)
        plans = [(now, np.arange(len(rows)) + 1, np.searchsorted(now.key, now.key + 1, side="right"))]
        if before is not None:
            plans.append((before, np.searchsorted(now.key, before.key - 1), np.searchsorted(now.key, before.key + 1, side="right")))
        for one, low, high in plans:
            for a, b in ranges(low, high):
                sa, sb = side[one.rows[a]], side[now.rows[b]]
                met = (sa < 0) | (sa != sb)
                a, b = a[met], b[met]
                enough = overlaps(one.grams[a], now.grams[b]) >= size - 1
                a, b = a[enough], b[enough]
                good = one_edit(one.letters[a], now.letters[b])
                left.append(one.rows[a[good]])
                right.append(now.rows[b[good]])
        before = now
    a, b = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
    n = table.column("n").combine_chunks()
    return pa.table({"a": words.take(a), "na": n.take(a), "b": words.take(b), "nb": n.take(b)})


def near_words(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """(w, n, near, near_n): words one edit apart, each pair in both directions."""
    broadcast = vocabulary.sparkSession.sparkContext.broadcast
    frequency = collected(vocabulary.mapInArrow(slot_counts, "slot int, n long"))
    postings = vocabulary.mapInArrow(posting_batches(broadcast(frequency)), "w binary, n long, gram long, pos int, slot int")
    postings = scratch.put(postings, "postings")
    held = collected(postings.select("slot", F.lit(1).cast("long").alias("n")))
    parts = np.maximum(1, -(-held // PART))
    buckets = max(1, math.ceil(int((held * parts).sum()) / TASK))
    cells = postings.mapInArrow(dealer(broadcast(parts), buckets), "bucket long, cell long, side int, pos int, w binary, n long")
    pairs = cells.groupBy("bucket").applyInArrow(near_in_cells, "a binary, na long, b binary, nb long").distinct()
    pairs = scratch.put(pairs, "pairs")
    # Two words of one length can meet in either order.
    forth = pairs.selectExpr("a AS w", "na AS n", "b AS near", "nb AS near_n")
    back = pairs.selectExpr("b AS w", "nb AS n", "a AS near", "na AS near_n")
    return forth.union(back).distinct()


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(w, root): links (w, form) followed to their ends by doubling; n grows along them, so they end."""
    now = scratch.put(links.select("w", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("w").alias("root"), F.col("root").alias("to"))
        after = scratch.put(now.join(further, "root", "left").select("w", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        done = after.filter("moved").isEmpty()
        scratch.drop(now)
        now = after.drop("moved")
        now._scratch_path = after._scratch_path
        if done:
            return now


def spelling_groups(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, typo_every: int | None = None) -> DataFrame:
    """Words of ``docs`` with their count, near words, form and root.

    A word is a run of letters A-Z and U+00C0 to U+00FF, A-Z lower-cased.  Its form is the near
    word of largest n, if that is at least ``ratio`` times its own; of equal n the first in
    code-point order.  Null and empty texts have no words, a null doc_id is an empty one, repeated
    rows count each, other columns are ignored, and an empty table gives no rows.  With
    ``typo_every`` about one occurrence in so many loses a letter, chosen by doc_id and word.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    vocabulary = scratch.put(word_counts(docs, least_chars, least_count, typo_every), "words")
    near = near_words(vocabulary, scratch)
    best = near.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("w"))).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    rows = vocabulary.join(best, "w", "left").select(
        "w", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    rows = scratch.put(rows, "forms")
    ends = roots(rows.filter("form IS NOT NULL"), scratch)
    text = lambda c: F.decode(c, "ISO-8859-1")
    out = rows.join(ends, "w", "left")
    return out.select(
        text(F.col("w")).alias("word"), "n", "n_near", text(F.col("form")).alias("form"), "form_n", text(F.coalesce("root", "w")).alias("root")
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants over all ``documents``, with letters lost at one occurrence in 199; nulls,
    repeats and empty tables as in ``spelling_groups``."""
    return spelling_groups(read_table(spark, sf_dir, "documents"), typo_every=TYPO_EVERY)


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT doc_id, run, n, list_transform(range(len(x) // 2), lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS b
  FROM (SELECT *, hex(encode(concat(doc_id, ':', run))) AS x FROM runs)
), hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc
), words AS (
  SELECT word AS w, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT w, n, i, concat(left(w, i - 1), substr(w, i + 1)) AS s FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)
), near AS (
  SELECT x.w, x.n, y.w AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.s = y.s AND x.w <> y.w
  UNION SELECT cut.w, cut.n, words.w, words.n FROM cut JOIN words ON s = words.w
  UNION SELECT words.w, words.n, cut.w, cut.n FROM cut JOIN words ON s = words.w
), best AS (
  SELECT w, n, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY w, n
), forms AS (SELECT w, near AS form, near_n AS form_n FROM best WHERE near_n >= 5 * n),
chains AS (
  SELECT w, form AS final FROM forms
  UNION ALL SELECT c.w, f.form FROM chains c JOIN forms f ON c.final = f.w
), ends AS (SELECT w, final AS root FROM chains WHERE final NOT IN (SELECT w FROM forms))
SELECT w AS word, words.n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, w) AS root
FROM words LEFT JOIN best USING (w) LEFT JOIN forms USING (w) LEFT JOIN ends USING (w)
"""
