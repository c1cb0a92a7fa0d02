"""Hidden Markov language model: Baum-Welch across partitions, exact forward scores.

Word counts of the training texts come from one shuffle.  The most frequent words have a symbol
each, and so has the end of a text.  All other words, however rare, emit in two steps: a class by
the word's ending, with a probability of its own in every state, and within the class the word's
share (c + 1) / Z of add-one counts, where one more place is for words that no training text has.
So each word counts, the tables that go to the tasks are bounded, and the probabilities of all
words sum to 1 in every state.  Texts are written once as symbols.

Each iteration of Baum-Welch sends the parameters to all partitions, gathers expected transition,
start and emission counts in one row per symbol and task, and sums them.  Some iterations on a
sample give the start; then all training texts are gone through until the log10 likelihood of a
token grows by less than TOLERANCE.  Texts train in runs of RUN tokens with WARM tokens of the
text on both sides, whose counts belong to the neighbours: they carry the state across the border,
and what they leave out shrinks by the chain's mixing at each of them.  Scores are the scaled
forward recursion over whole, uncut texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import LOWER, list_array, slices, text_buffer, words_of
from .scratch import Scratch, ensure_columns, read_table

STATES = 8
#: Most words with a symbol of their own.
VOCABULARY = 65_536
#: Classes of the words without a symbol of their own, by their last ENDING bytes.
CLASSES = 4096
ENDING = 3
#: Training texts that the starting iterations see, about; those that count see all.
SAMPLE_TEXTS = 4_000
SAMPLE_ROUNDS = 12
#: Growth of the log10 likelihood of a token below which the iterations end.
TOLERANCE = 0.002
#: Tokens of a training run, and tokens of the text around it that a run looks at.
RUN, WARM = 128, 16
#: Runs of a training step together, which bounds its memory.
RUNS = 2048
PRIOR = 50.0
#: Share of the word counts' own distribution in every state.
BACK_OFF = 0.03
#: Fewer occurrences than this leave a word to its class.
LEAST = 3
FIXED_SEED = 7


def word_codes(column: pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the lower-cased words of a batch, where each document's begin, and for each code
    the hash and the class of its word."""
    data, offsets = text_buffer(column)
    words = words_of(LOWER[data], offsets)
    codes, distinct = words.encoded()
    names = distinct.to_pylist()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    ending = np.fromiter((xxhash.xxh3_64_intdigest(w[-ENDING:]) for w in names), np.uint64, len(names))
    return codes, words.docs, own.view(np.int64), (ending % np.uint64(classes)).astype(np.int32)


def count_batches(classes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes, _, hashes, kinds = word_codes(batch.column(0), classes)
            n = np.bincount(codes, minlength=len(hashes)) if len(codes) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"h": pa.array(hashes), "k": pa.array(kinds), "n": pa.array(n, pa.int64())})

    return run


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of at most ``most`` words: all that occur often enough."""
    counts = counts.filter(F.col("c") >= LEAST)
    level = F.floor(F.log2("c") * 32).cast("int")
    steps = dict(counts.groupBy(level.alias("l")).count().collect())  # at most 32 * 64 levels
    least, n = None, 0
    for step in sorted(steps, reverse=True):
        if n + steps[step] > most:
            break
        least, n = step, n + steps[step]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = counts.filter(level >= least).select("h", "c").toArrow().sort_by("h")  # ``most`` rows at most
    return table.column("h").to_numpy(), table.column("c").to_numpy()


def encode_batches(frequent, classes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = frequent.value
        other = len(words)
        for batch in slices(batches, "text"):
            codes, docs, own, kinds = word_codes(batch.column(2), classes)
            at = np.minimum(np.searchsorted(words, own), max(other - 1, 0))
            found = words[at] == own if other else np.zeros(len(own), dtype=bool)
            symbols = np.where(found, at, other + kinds).astype(np.int32)[codes]
            known, hashes = found[codes], own[codes]
            ends = docs + np.arange(len(docs))
            out = np.full(len(symbols) + batch.num_rows, other + classes, np.int32)
            inner = np.ones(len(out), dtype=bool)
            inner[ends[1:] - 1] = False
            out[inner] = symbols
            parent = np.repeat(np.arange(batch.num_rows), np.diff(docs))[~known]
            rare = hashes[~known]
            order = np.lexsort((rare, parent))
            rare, parent = rare[order], parent[order]
            new = np.ones(len(rare), dtype=bool)
            new[1:] = (rare[1:] != rare[:-1]) | (parent[1:] != parent[:-1])
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(rare)))
            pairs = pa.StructArray.from_arrays([pa.array(rare[begin]), pa.array(times.astype(np.int32))], ["h", "n"])
            rare_at = np.concatenate([[0], np.cumsum(np.bincount(parent[begin], minlength=batch.num_rows))])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "held_out": batch.column(1),
                    "th": batch.column(3),
                    "symbols": list_array(ends, pa.array(out)),
                    "rare": list_array(rare_at, pairs),
                }
            )

    return run


def lists_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def runs_of(at: np.ndarray, run: int | None = None, warm: int | None = None) -> np.ndarray:
    """A row for each run that texts are cut into: begin and length with the tokens around it, the
    place of its first own token in that, the end of its own, and whether the text begins there."""
    run, warm = run or RUN, WARM if warm is None else warm
    n_runs = -(-np.diff(at) // run)
    first = np.concatenate([[0], np.cumsum(n_runs)])[:-1]
    low, high = np.repeat(at[:-1], n_runs), np.repeat(at[1:], n_runs)
    own = low + (np.arange(n_runs.sum()) - np.repeat(first, n_runs)) * run
    end = np.minimum(own + run, high)
    begin = np.maximum(own - warm, low)
    return np.stack([begin, np.minimum(end + warm, high) - begin, own - begin, end - begin, own == low], axis=1)


def expected_counts(symbols: np.ndarray, runs: np.ndarray, model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of some runs' own tokens (scaled forward-backward),
    and the log10 probability of these."""
    start, move, emit = model
    k = len(start)
    begin, size, own, end, fresh = runs[np.argsort(-runs[:, 1], kind="stable")].T
    # A run inside a text starts where the chain is at rest, which WARM tokens then correct.
    rest = at_rest(move)
    alphas, emits, places = [], [], []
    a, total = None, 0.0
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))  # runs longer than t
        place = symbols[begin[:n] + t]
        e = emit[place]
        a = (np.where((fresh == 1)[:n, None], start, rest) if t == 0 else a[:n] @ move) * e
        scale = a.sum(axis=1, keepdims=True)
        a /= scale
        total += float(np.log10(scale[(t >= own[:n]) & (t < end[:n])]).sum())
        alphas.append(a)
        emits.append(e)
        places.append(place)
    starts, moves, out = np.zeros(k), np.zeros((k, k)), np.zeros((len(emit), k))
    gammas, kept = [], []
    b = np.ones((0, k))
    for t in range(len(alphas) - 1, -1, -1):
        a = alphas[t]
        if t + 1 < len(alphas):
            eb = emits[t + 1] * b
            back = eb @ move.T
            m = len(b)
            scale = (a[:m] * back).sum(axis=1, keepdims=True)
            mine = (t + 1 >= own[:m]) & (t + 1 < end[:m])
            moves += (a[:m] / scale)[mine].T @ eb[mine]
            b = np.concatenate([back / scale, np.ones((len(a) - m, k))])
        else:
            b = np.ones((len(a), k))
        mine = (t >= own[: len(a)]) & (t < end[: len(a)])
        gammas.append((a * b)[mine])
        kept.append(places[t][mine])
        if t == 0:
            starts = (a * b)[fresh == 1].sum(axis=0)
    if gammas:
        gamma, place = np.concatenate(gammas), np.concatenate(kept)
        for j in range(k):
            out[:, j] = np.bincount(place, weights=gamma[:, j], minlength=len(emit))
    return starts, moves * move, out, total


def at_rest(move: np.ndarray) -> np.ndarray:
    """The distribution of states that the transitions leave as it is."""
    k = len(move)
    return np.linalg.lstsq(np.vstack([move.T - np.eye(k), np.ones(k)]), np.append(np.zeros(k), 1.0), rcond=None)[0].clip(1e-12)


def forward_scores(symbols: np.ndarray, at: np.ndarray, model) -> np.ndarray:
    """log10 probability of each whole sequence."""
    start, move, emit = model
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    begin, size = at[:-1][order], lengths[order]
    total = np.zeros(len(order))
    a, n = None, int(np.searchsorted(-size, 0, side="left"))
    for t in range(int(size[0]) if len(size) else 0):
        while n and size[n - 1] <= t:
            n -= 1
        e = emit[symbols[begin[:n] + t]]
        a = (start if t == 0 else a[:n] @ move) * e
        s = a.sum(axis=1)
        a /= s[:, None]
        total[:n] += np.log10(s)
    out = np.zeros(len(order))
    out[order] = total
    return out


def expect_batches(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = model.value
        k, n = len(values[0]), len(values[2])
        total = np.zeros((n + 2 + k, k))
        any_row = False
        for batch in batches:
            any_row = True
            symbols, at = lists_of(batch, "symbols")
            symbols, runs = np.ascontiguousarray(symbols), runs_of(at)
            for a in range(0, len(runs), RUNS):
                starts, moves, emits, log = expected_counts(symbols, runs[a : a + RUNS], values)
                total[:n] += emits
                total[n] += starts
                total[n + 1 : n + 1 + k] += moves
                total[n + 1 + k, 0] += log
        if any_row:
            used = np.flatnonzero(total.any(axis=1))
            flat = pa.array(total[used].ravel())
            yield pa.RecordBatch.from_pydict({"i": pa.array(used.astype(np.int32)), "v": list_array(np.arange(len(used) + 1) * k, flat)})

    return run


def score_batches(model, logs, classes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, (log_counts, log_rest) = model.value, logs.value
        other = len(log_counts) - 1 - classes
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                symbols, at = lists_of(part, "symbols")
                rare = (symbols >= other) & (symbols < other + classes)
                is_rare = np.concatenate([[0], np.cumsum(rare)])
                # Sums of a text's own terms, not differences of long running sums.
                of = lambda x: np.add.reduceat(x, at[:-1]) if len(x) else np.zeros(part.num_rows)
                base = of(log_counts[symbols])
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": part.column(0),
                        "n_tokens": pa.array(np.diff(at), pa.int64()),
                        "n_rare": pa.array(is_rare[at[1:]] - is_rare[at[:-1]], pa.int64()),
                        "log_counts": pa.array(base),
                        "log_rest": pa.array(of(log_rest[symbols])),
                        "forward": pa.array(forward_scores(symbols, at, values)),
                    }
                )

    return run


def first_model(base: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(FIXED_SEED)
    emit = base[:, None] * (0.5 + rng.random((len(base), states)))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return np.full(states, 1 / states), move, emit / emit.sum(axis=0)


def maximised(total: np.ndarray, base: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(base)
    start = total[n] + 1
    move = total[n + 1 : n + 1 + states] + 0.1
    emit = total[:n] + PRIOR * base[:, None]
    emit = (1 - BACK_OFF) * emit / emit.sum(axis=0) + BACK_OFF * base[:, None]
    return start / start.sum(), move / move.sum(axis=1, keepdims=True), emit


def iterate(texts: DataFrame, model, base: np.ndarray, states: int, tolerance: float, rounds: int | None = None):
    """Baum-Welch until a token's log10 likelihood grows by less than ``tolerance``, or for ``rounds``."""
    context = texts.sparkSession.sparkContext
    n = len(base)
    before, done = -np.inf, 0
    while rounds is None or done < rounds:
        shared = context.broadcast(model)
        found = texts.select("symbols").mapInArrow(expect_batches(shared), "i int, v array<double>")
        sums = found.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(states)])
        total = np.zeros((n + 2 + states, states))
        for r in sums.collect():  # at most VOCABULARY + CLASSES + 3 + states rows
            total[r[0]] = r[1:]
        shared.destroy()
        tokens = total[:n].sum()
        if not tokens:
            break
        model, done = maximised(total, base, states), done + 1
        level = total[n + 1 + states, 0] / tokens
        if level - before < tolerance:
            break
        before = level
    return model


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2


def hmm_scores(docs: DataFrame, states: int = STATES, vocabulary: int = VOCABULARY, classes: int = CLASSES, tolerance: float = TOLERANCE) -> DataFrame:
    """base_score and score of every whole text, learned from the rows that are not held out.

    A null text is empty and has only its end; a null doc_id counts as the text '' for holding
    out and stays null; repeated rows count and are scored each; further columns are ignored.
    Without training rows every token is unknown and all states are alike; an empty table gives
    no rows.  The order of rows and the layout of files change scores by rounding only.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm")
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    source = ensure_columns(docs, doc_id="long", text="string").select("doc_id", held_out().alias("held_out"), "text", th.alias("th"))
    found = source.filter("NOT held_out").select("text").mapInArrow(count_batches(classes), "h long, k int, n long")
    counts = scratch.put(found.groupBy("h", "k").agg(F.sum("n").alias("c")), "counts")
    n_train = source.filter("NOT held_out").count()
    n_words, v_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n_words + n_train, v_words + (n_train > 0)
    words, c = frequent_words(counts, vocabulary)
    frequent = spark.sparkContext.broadcast((words, c))
    schema = "doc_id long, held_out boolean, th long, symbols array<int>, rare array<struct<h:long,n:int>>"
    texts = source.mapInArrow(encode_batches(frequent, classes), schema).withColumn("row", F.monotonically_increasing_id())
    texts = scratch.put(texts, "symbols")
    # The share of a class: its words' counts and one each, and one for words that none has.
    rest = np.ones(classes)
    frequent_counts = spark.createDataFrame(pa.table({"h": words}))  # ``vocabulary`` rows at most
    for k, total in counts.join(F.broadcast(frequent_counts), "h", "left_anti").groupBy("k").agg(F.sum(F.col("c") + 1)).collect():  # ``classes`` rows at most
        rest[k] += total
    shares = np.concatenate([c + 1.0, rest, [n_train + 1.0]])
    base = shares / shares.sum()
    train = texts.filter("NOT held_out")
    every = max(1, n_train // SAMPLE_TEXTS)
    sample = scratch.put(train.filter(F.pmod(F.xxhash64("doc_id", "th"), F.lit(every)) == 0).select("symbols"), "sample")
    model = first_model(base, states)
    model = iterate(sample, model, base, states, tolerance, SAMPLE_ROUNDS)
    model = iterate(train, model, base, states, tolerance)
    logs = np.log10(np.concatenate([c + 1.0, np.ones(classes), [n_train + 1.0]]))
    log_rest = np.concatenate([np.zeros(len(c)), np.log10(rest), [0.0]])
    shared = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast((logs, log_rest))
    schema = "row long, n_tokens long, n_rare long, log_counts double, log_rest double, forward double"
    scored = texts.select("row", "symbols").mapInArrow(score_batches(*shared, classes), schema)
    scored = scratch.put(scored, "forward")
    asked = texts.select("row", F.inline("rare")).join(counts, "h")
    rare = asked.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("n").cast("long").alias("rare_known"))
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    end_unknown = 0 if n_train else 1
    out = texts.select("row", "doc_id", "held_out").join(scored, "row").join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_tokens") - F.col("n_rare") + rare_known - end_unknown).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") + rare_log - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("forward") + rare_log - F.col("log_rest")).alias("score"),
    )


def op6_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every row of ``documents``; null and empty texts have only their
    end, repeated rows count and are scored each, and an empty table gives no rows."""
    return hmm_scores(read_table(spark, sf_dir, "documents"))
