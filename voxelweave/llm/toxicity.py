"""Toxicity: a gapped subsequence string kernel, Nyström landmarks and a linear machine on sentences.

Two spans of text are alike in so far as they share ordered triples of characters, each weighted by
DECAY to the power of its length with gaps, up to SPAN; so an insult keeps most of its likeness when
characters are put in, endings change, or letters and halves are set apart.  The kernel of a sentence
with a landmark is that of the span most alike to it, over the sentence's words, joined letters and
pairs of neighbouring words; it is raised to POWER, and chance likeness below FLOOR counts as none.

The landmarks are spans of labelled sentences, words or pairs of words, some of them harmless ones
that resemble insults.  A support vector machine with squared hinge loss separates the sentences that
make texts toxic, in each toxic text the one of highest score, from sentences of other texts, in the
space that the landmarks span.  A text's score is that of its worst sentence, mapped to 0..1 by a
logistic curve.

Only the training sees a sample: at most SAMPLE labelled texts of each class, chosen by a hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import LOWER, slices, text_buffer, words_of
from .scratch import Scratch, ensure_columns, read_table

SPAN = 5
DECAY = 0.8
POWER = 2
FLOOR = 0.25
#: Letters of two neighbouring words that always count as a span together.
SHORT = 7
#: Labelled texts of each class that the training sees at most.
SAMPLE = {1: 3000, 0: 6000}
LANDMARKS = 72
#: Spans of most votes that also train with a character put in.
GAPPED = 40
ROUNDS = 2
#: Sentences of highest score, and others, that a harmless text of the sample gives to the training.
TOP, OTHERS = 2, 3
PENALTY = 1e-4
FIXED_SEED = 11
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
STOP = np.zeros(256, dtype=bool)
STOP[list(b".!?")] = True


class Spans:
    """The words of some texts with their sentences, and the letters that stand apart, joined.

    Words are lower-cased and lose ASCII characters other than letters and digits.  A sentence ends
    with a word that ends in a full stop, exclamation or question mark, with a line, or with the
    text.  A run of three or more words of one letter also counts as a word of its first sentence.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        words = words_of(low, offsets)
        keep = LETTER[low]
        total = np.concatenate([[0], np.cumsum(keep)])
        lengths = total[words.starts + words.lengths] - total[words.starts]
        at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        bare = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(low[keep]))])
        both = bare.dictionary_encode()
        self.names = both.dictionary.to_pylist() if len(lengths) else []
        self.codes = both.indices.to_numpy().astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        self.lengths, parent = lengths, words.parents()
        lines = np.concatenate([[0], np.cumsum(low == 10)])[words.starts]
        stop = STOP[low[words.starts + words.lengths - 1]] if len(lengths) else np.zeros(0, dtype=bool)
        first = np.ones(len(lengths), dtype=bool)
        first[1:] = (parent[1:] != parent[:-1]) | stop[:-1] | (lines[1:] != lines[:-1])
        self.sentence = np.cumsum(first) - 1
        #: Where each text's sentences begin.
        self.texts = np.searchsorted(parent[first], np.arange(len(offsets)))
        single = (lengths == 1) | ((lengths == 2) & (words.lengths == 2) & (low[words.starts] >= 0xC2)) if len(lengths) else lengths > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        self.joined: list[tuple[bytes, int]] = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= 3:
                cuts = [a, *(i for i in range(a + 1, b) if parent[i] != parent[i - 1]), b]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if y - x >= 3:
                        self.joined.append((b"".join(self.names[self.codes[i]] for i in range(x, y)), int(self.sentence[x])))


def triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, value): the kernel's coordinates of each word, scaled to length 1.

    A word's ends are characters too, so that endings and beginnings differ from middles.
    """
    words = [b"^%b$" % w if w else w for w in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    body = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    keys, values = [], []
    for span in range(2, SPAN):
        ok = np.flatnonzero(np.arange(len(body)) + span < ends)
        for middle in range(1, span):
            keys.append((owner[ok] << 24) | (body[ok] << 16) | (body[ok + middle] << 8) | body[ok + span])
            values.append(np.full(len(ok), DECAY ** (span + 1)))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, value = key[order], np.concatenate(values)[order]
    if not len(key):
        return key, key, value
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    value, key = np.add.reduceat(value, begin), key[begin]
    owner, code = key >> 24, key & 0xFFFFFF
    norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=len(words)))
    return owner, code, value / norm[owner]


class Marks:
    """Likeness of spans to the landmarks: the kernel scaled to 1 for equal spans."""

    def __init__(self, spans: list[bytes]):
        owner, code, value = triples(spans)
        self.codes, place = np.unique(code, return_inverse=True)
        self.table = np.zeros((len(self.codes), len(spans)), np.float32)
        self.table[place, owner] = value
        self.place = np.full(1 << 24, -1, np.int32)
        self.place[self.codes] = np.arange(len(self.codes))

    def likeness(self, spans: list[bytes]) -> np.ndarray:
        out = np.zeros((len(spans), self.table.shape[1]), np.float32)
        for a in range(0, len(spans), 1000):
            part = spans[a : a + 1000]
            owner, code, value = triples(part)
            at = self.place[code]
            hit = at >= 0
            owner, at, value = owner[hit], at[hit], value[hit].astype(np.float32)
            if len(owner):
                begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[a + owner[begin]] = np.add.reduceat(self.table[at] * value[:, None], begin)
        return out

    def kernel(self, spans: list[bytes]) -> np.ndarray:
        """Likeness from FLOOR up, to the POWER; chance likeness counts as none."""
        out = self.likeness(spans)
        out[out < FLOOR] = 0
        return out**POWER


class Likeness:
    """Kernel values of the spans seen so far by this worker; row 0 is of all that resemble nothing."""

    def __init__(self, marks: list[bytes], paired: list[bool], most: int = 500_000):
        self.marks, self.paired, self.most = Marks(marks), np.array(paired, dtype=bool), most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1, self.marks.table.shape[1]), np.float32)
        #: Whether a row resembles a landmark that is a pair of words.
        self.half = np.zeros(1, dtype=bool)

    def rows(self, spans: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(spans) if w not in self.known]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            own = self.marks.kernel(part)
            some = own.any(axis=1)
            rows = np.where(some, len(self.table) + np.cumsum(some) - 1, 0)
            self.table = np.concatenate([self.table, own[some]])
            self.half = np.concatenate([self.half, own[some][:, self.paired].any(axis=1)])
            self.known.update(zip(part, rows.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, spans), np.int64, len(spans))


def sentence_features(like: Likeness, spans: Spans) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Kernel values of sentences: for each landmark that of the span most alike to it.

    Spans are words, letters joined, and pairs of neighbouring words of a sentence joined, so gaps
    and inserted characters count within words and across a space.  A pair counts if it is short, if
    both words are alike to one landmark, or if one is alike to a landmark that is a pair; others
    are taken to be no more alike than their words.  Only sentences with some likeness get a row.  Returned are their numbers and values, and the spans
    that gave them: names, sentences and rows of the likeness table.
    """
    if len(like.known) > like.most:
        like.clear()
    row = like.rows(spans.names)[spans.codes] if len(spans.codes) else spans.codes
    same = spans.sentence[1:] == spans.sentence[:-1]
    left, right = row[:-1], row[1:]
    short = spans.lengths[:-1] + spans.lengths[1:] <= SHORT
    both = np.flatnonzero(same & ~short & (left > 0) & (right > 0))
    both = both[((like.table[left[both]] > 0) & (like.table[right[both]] > 0)).any(axis=1)]
    taken = same & (short | like.half[left] | like.half[right])
    taken[both] = True
    pair = np.flatnonzero(taken)
    n = max(len(spans.names), 1)
    keys, back = np.unique(spans.codes[pair] * n + spans.codes[pair + 1], return_inverse=True)
    names = [*spans.names, *(spans.names[k // n] + spans.names[k % n] for k in keys.tolist()), *(x for x, _ in spans.joined)]
    more = like.rows(names[len(spans.names) :])
    of_pair, of_joined = more[: len(keys)][back], more[len(keys) :]
    rows = np.concatenate([row, of_pair, of_joined])
    name = np.concatenate([spans.codes, len(spans.names) + back, len(spans.names) + len(keys) + np.arange(len(spans.joined))])
    sentence = np.concatenate([spans.sentence, spans.sentence[pair], np.array([x for _, x in spans.joined], np.int64)])
    hit = np.flatnonzero(rows)
    hit = hit[np.argsort(sentence[hit], kind="stable")]
    rows, sentence, name = rows[hit], sentence[hit], name[hit]
    begin = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(hit) else hit
    values = np.zeros((len(begin), like.table.shape[1]), np.float32)
    for a in range(0, len(begin), 20_000):
        end = begin[a + 20_000] if a + 20_000 < len(begin) else len(hit)
        values[a : a + 20_000] = np.maximum.reduceat(like.table[rows[begin[a] : end]], begin[a : a + 20_000] - begin[a])
    return sentence[begin], values, [names[i] for i in name.tolist()], sentence, rows


def worst(number: np.ndarray, scores: np.ndarray, texts: np.ndarray, bias: float) -> np.ndarray:
    """Largest sentence score of each text; a sentence without a row scores the bias, and so does a
    text without sentences."""
    at = np.searchsorted(number, texts)
    out = np.full(len(texts) - 1, bias)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        top = np.maximum.reduceat(scores, at[some])
        every = np.diff(at)[some] == np.diff(texts)[some]
        out[some] = np.where(every, top, np.maximum(top, bias))
    return out


def pick_batches(model, score: dict[bytes, float]) -> Callable:
    """For each sample text the values and spans of sentences to train on.

    A toxic text gives the sentence of its strongest seed in the first pass, when there are no
    weights, and that of its highest score later; another text gives its TOP sentences and OTHERS
    more.  ``best`` is the text's score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, paired, weights, bias = model.value
        like = Likeness(marks, paired)
        for batch in slices(batches, "text"):
            spans = Spans(*text_buffer(batch.column(2)))
            number, values, names, sentence, rows = sentence_features(like, spans)
            scores = values @ weights.astype(np.float32) + bias
            own = like.table[rows] @ weights.astype(np.float32)
            strength = np.array([score.get(x, 0.0) for x in names])
            best = worst(number, scores, spans.texts, bias)
            out: dict[str, list] = {"toxic": [], "best": [], "values": [], "span": [], "strength": []}
            for d, (doc, toxic) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                a, b = np.searchsorted(number, spans.texts[d : d + 2])
                order = a + np.argsort(-scores[a:b], kind="stable")
                if toxic == 1:
                    i, j = np.searchsorted(sentence, [spans.texts[d], spans.texts[d + 1]])
                    strongest = i + int(np.argmax(strength[i:j])) if j > i else -1
                    if score:
                        order = np.flatnonzero(number == sentence[strongest]) if j > i and strength[strongest] > 0 else order[:0]
                    order = order[:1]
                else:
                    rng = np.random.default_rng([FIXED_SEED, (doc or 0) & 0x7FFFFFFF])
                    order = np.concatenate([order[:TOP], rng.permutation(order[TOP:])[:OTHERS]])
                for k in order.tolist():
                    i, j = np.searchsorted(sentence, [number[k], number[k] + 1])
                    top = i + int(np.argmax(strength[i:j] if score and toxic == 1 else own[i:j]))
                    for c, x in (("toxic", toxic), ("best", float(best[d])), ("values", values[k]), ("span", names[top]), ("strength", float(strength[top]))):
                        out[c].append(x)
                if not len(order):
                    for c, x in (("toxic", toxic), ("best", float(best[d])), ("values", None), ("span", None), ("strength", 0.0)):
                        out[c].append(x)
            types = {"toxic": pa.int32(), "best": pa.float64(), "values": pa.list_(pa.float32()), "span": pa.binary(), "strength": pa.float64()}
            yield pa.RecordBatch.from_pydict({c: pa.array(x, types[c]) for c, x in out.items()})

    return run


def score_batches(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, paired, weights, bias, slope, shift = model.value
        like = Likeness(marks, paired)
        for batch in slices(batches, "text"):
            spans = Spans(*text_buffer(batch.column(2)))
            number, values, *_ = sentence_features(like, spans)
            top = worst(number, values @ weights.astype(np.float32) + bias, spans.texts, bias)
            score = 1 / (1 + np.exp(-np.clip(slope * top + shift, -40, 40)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return run


def associations(sample: DataFrame) -> tuple[dict[bytes, float], set[bytes]]:
    """Words, letters joined, and pairs of words of the bounded sample that toxic texts hold far more
    often, with a G-like score; pairs only where neither word is so by itself; and which are pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            spans = Spans(*text_buffer(batch.column(2)))
            n_words, n = len(spans.names), max(len(spans.names), 1)
            text = np.repeat(np.arange(len(spans.texts) - 1), np.diff(spans.texts))
            pair = np.flatnonzero(spans.sentence[1:] == spans.sentence[:-1])
            keys, back = np.unique(spans.codes[pair] * n + spans.codes[pair + 1], return_inverse=True)
            first = [*spans.names, *(spans.names[k // n] for k in keys.tolist()), *(x for x, _ in spans.joined)]
            second = [None] * n_words + [spans.names[k % n] for k in keys.tolist()] + [None] * len(spans.joined)
            code = np.concatenate([spans.codes, n_words + back, n_words + len(keys) + np.arange(len(spans.joined))])
            doc = text[np.concatenate([spans.sentence, spans.sentence[pair], np.array([x for _, x in spans.joined], np.int64)]).astype(np.int64)]
            both = np.unique(doc * max(len(first), 1) + code)
            code, toxic = both % max(len(first), 1), batch.column(1).to_numpy()[both // max(len(first), 1)] == 1
            pos, every = np.bincount(code, weights=toxic, minlength=len(first)).astype(np.int64), np.bincount(code, minlength=len(first))
            binary = pa.binary()
            yield pa.RecordBatch.from_pydict({"a": pa.array(first, binary), "b": pa.array(second, binary), "p": pa.array(pos), "n": pa.array(every - pos, pa.int64())})

    spans = sample.mapInArrow(run, "a binary, b binary, p long, n long").groupBy("a", "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    totals = dict(sample.groupBy("toxic").count().collect())
    n_pos, n_neg = max(1, totals.get(1, 0)), max(1, totals.get(0, 0))
    share = n_pos / (n_pos + n_neg)
    g = 2 * F.col("p") * F.log(F.col("p") / ((F.col("p") + F.col("n") + 0.01) * share))
    # Pairs are many, so chance needs a higher bar.
    strong = spans.filter("p >= 3 AND p >= 9 * n").withColumn("g", g).filter("g > CASE WHEN b IS NULL THEN 12 ELSE 30 END")
    words = {bytes(r["a"]): r["g"] for r in strong.filter("b IS NULL").orderBy(F.desc("g"), "a").limit(2000).collect()}  # 2,000 at most
    pairs = strong.filter("b IS NOT NULL").orderBy(F.desc("g"), "a", "b").limit(2000).collect()  # 2,000 at most
    free = {bytes(r["a"]) + bytes(r["b"]): r["g"] for r in pairs if bytes(r["a"]) not in words and bytes(r["b"]) not in words}
    return dict(sorted((free | words).items(), key=lambda x: (-x[1], x[0]))), set(free) - set(words)


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Primal Newton steps for the machine with squared hinge loss; the bias is not penalised."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.full(z.shape[1], penalty * weight.sum())
    ridge[-1] = 1e-9
    w = np.zeros(z.shape[1])
    for _ in range(20):
        active = y * (z @ w) < 1
        za, wa = z[active], weight[active]
        new = np.linalg.solve((za * wa[:, None]).T @ za + np.diag(ridge), za.T @ (wa * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def train(positive: np.ndarray, negative: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, float]:
    """The landmarks' weights and the bias, from kernel values of labelled sentences (Nyström features)."""
    values, vectors = np.linalg.eigh(Marks(marks).kernel(marks).astype(np.float64))
    good = values > 1e-4
    project = vectors[:, good] / np.sqrt(values[good])
    x = np.concatenate([positive, negative]).astype(np.float64) @ project
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    weight = np.where(y > 0, len(y) / (2 * max(1, len(positive))), len(y) / (2 * max(1, len(negative))))
    w, bias = squared_hinge(x, y, weight, PENALTY)
    return project @ w, bias


def logistic_curve(top: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of texts' worst words, by damped Newton steps."""
    z = np.stack([top, np.ones(len(top))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (toxic - p) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def varied(words: list[bytes], most: int, alike: float = 0.5) -> list[bytes]:
    """The first spans that are not too alike to one taken before, ``most`` of them."""
    out: list[bytes] = []
    for a in range(0, len(words), 256):
        if len(out) >= most:
            break
        part = words[a : a + 256]
        k = Marks(part).kernel(part)
        free = (Marks(out).kernel(part) < alike).all(axis=1) if out else np.ones(len(part), dtype=bool)
        for i in range(len(part)):
            if free[i] and len(out) < most:
                out.append(part[i])
                free &= k[i] < alike
    return out


def gapped(words: list[bytes], rng) -> list[bytes]:
    """Each word with one character put in at every inner place, as insults are often disguised."""
    out = []
    for w in words:
        for i in range(1, len(w)):
            if w[i] < 128:
                c = bytes([rng.integers(97, 123)]) if rng.random() < 0.7 else w[i - 1 : i]
                out.append(w[:i] + (c if c < b"\x80" else b"x") + w[i:])
    return out


def landmarks_of(picked: pa.Table, score: dict[bytes, float]) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Landmarks, and spans of toxic and of other texts, from the first pass.

    Three quarters of the landmarks are spans of toxic texts, by votes, and one quarter the spans
    of other texts that a seed resembles most often.
    """
    rows = picked.select(["toxic", "span", "strength"]).to_pylist()
    votes = Counter(r["span"] for r in rows if r["toxic"] == 1 and r["strength"] > 0)
    bad = [w for w, _ in sorted(votes.items(), key=lambda x: (-x[1], x[0]))]
    rest = Counter(r["span"] for r in rows if r["toxic"] == 0 and r["span"] is not None and r["span"] not in score)
    good = [w for w, _ in sorted(rest.items(), key=lambda x: (-x[1], x[0]))]
    marks = varied(bad, LANDMARKS * 3 // 4)
    return marks + [w for w in varied(good, LANDMARKS) if w not in marks][: LANDMARKS - len(marks)], bad, good


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: dict[int, int] | None = None):
    """(marks, paired, weights, bias, slope, shift) from a bounded sample of the labelled training rows."""
    spark = docs.sparkSession
    limits = sample or SAMPLE
    labels = ensure_columns(labels, doc_id="long", toxic="int").filter("doc_id IS NOT NULL").filter(~held_out())
    of = lambda t: labels.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limits[t])
    chosen = scratch.put(of(1).unionByName(of(0)).dropDuplicates(["doc_id"]), "chosen")
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # at most the sample's ids
    texts = scratch.put(texts.dropDuplicates(["doc_id"]).repartition(16), "texts")
    score, pairs = associations(texts)
    if not score:
        return [b""], [False], np.zeros(1), 0.0, 1.0, -3.0

    def picks(model, seeds: dict[bytes, float]) -> pa.Table:
        shared = spark.sparkContext.broadcast(model)
        schema = "toxic int, best double, values array<float>, span binary, strength double"
        found = texts.mapInArrow(pick_batches(shared, seeds), schema).toArrow()  # a few rows a sample text
        shared.destroy()
        return found

    # The first pass finds the sentences of the seeds; their spans give the landmarks.
    marks = varied(list(score), LANDMARKS)
    found = picks((marks, [m in pairs for m in marks], np.ones(len(marks)), 0.0), score)
    marks, bad, good = landmarks_of(found, score)
    paired = [m in pairs for m in marks]
    kernel, rng = Marks(marks).kernel, np.random.default_rng(FIXED_SEED)
    disguised = kernel(gapped(bad[:GAPPED], rng))
    nothing = np.zeros((1, len(marks)), np.float32)
    model = train(np.concatenate([kernel(bad), disguised]), np.concatenate([kernel(good), nothing]), marks)
    for _ in range(ROUNDS):
        picked = picks((marks, paired, *model), {})
        picked = picked.filter(pa.compute.is_valid(picked.column("values"))).combine_chunks()
        values = np.zeros((0, len(marks)), np.float32)
        if len(picked):
            values = picked.column("values").combine_chunks().flatten().to_numpy().reshape(-1, len(marks))
        toxic, best = picked.column("toxic").to_numpy() == 1, picked.column("best").to_numpy()
        positive, negative = values[toxic & (best > 0)], values[~toxic]
        if len(positive):
            model = train(np.concatenate([positive, disguised]), np.concatenate([negative, nothing]), marks)
    shared = spark.sparkContext.broadcast((marks, paired, *model, 1.0, 0.0))
    scored = texts.select("doc_id", (F.col("toxic") == 1).alias("is_toxic"), "text").mapInArrow(score_batches(shared), "doc_id long, is_toxic boolean, score double, predicted int")
    table = scored.toArrow()  # a row a sample text
    p = np.clip(table.column("score").to_numpy(), 1e-15, 1 - 1e-15)
    return (marks, paired, *model, *logistic_curve(np.log(p / (1 - p)), table.column("is_toxic").to_numpy().astype(float)))


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def toxicity(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> DataFrame:
    """score (0 to 1) and predicted of every whole text.

    A null text is empty, and has the score of a text without words; a null doc_id counts as
    the text '' for holding out and is never trained on; repeated rows are scored each, and one of
    them trains; further columns are ignored.  Without labelled toxic texts every score is the same and low; an
    empty table gives no rows.
    """
    docs = ensure_columns(docs, doc_id="long", text="string")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, Scratch(docs.sparkSession, "toxicity"), sample))
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        score_batches(model), "doc_id long, held_out boolean, score double, predicted int"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every row of ``documents``, learned from ``labels``; null and empty texts
    have the score of no words, repeated rows are scored each, and an empty table gives no rows."""
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
