import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voxelweave.llm import hmm_lm, html_text, queries, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)) + [None]


def test_forward_and_counts_against_enumeration():
    rng = np.random.default_rng(0)
    start, move, emit = rng.random(2), rng.random((2, 2)), rng.random((3, 2))
    model = start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
    seqs = [[0, 1, 2, 2], [1], [2, 0]]
    flat, at = np.array(sum(seqs, [])), np.cumsum([0, 4, 1, 2])
    starts, moves, out = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    logs = []
    for s in seqs:
        paths = {}
        for code in range(2 ** len(s)):
            z = [(code >> i) & 1 for i in range(len(s))]
            p = model[0][z[0]] * model[2][s[0]][z[0]]
            for i in range(1, len(s)):
                p *= model[1][z[i - 1], z[i]] * model[2][s[i]][z[i]]
            paths[tuple(z)] = p
        total = sum(paths.values())
        logs.append(math.log10(total))
        for z, p in paths.items():
            starts[z[0]] += p / total
            for i, x in enumerate(s):
                out[x, z[i]] += p / total
                if i:
                    moves[z[i - 1], z[i]] += p / total
    assert np.allclose(hmm_lm.forward_scores(flat, at, model), logs)
    got = hmm_lm.expected_counts(flat, hmm_lm.runs_of(at), model)
    assert np.allclose(got[0], starts) and np.allclose(got[1], moves) and np.allclose(got[2], out)
    assert got[3] == pytest.approx(sum(logs))


def test_runs_carry_the_state_across_their_borders():
    rng = np.random.default_rng(1)
    move = np.full((3, 3), 0.05) + 0.85 * np.eye(3)
    emit = rng.dirichlet(np.full(40, 0.3), 3).T
    model = np.array([0.6, 0.3, 0.1]), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
    at = np.cumsum([0, 700, 5, 333, 1])
    flat = rng.integers(0, 40, at[-1])
    whole = hmm_lm.expected_counts(flat, hmm_lm.runs_of(at, run=10_000), model)
    cut = hmm_lm.expected_counts(flat, hmm_lm.runs_of(at, run=64, warm=24), model)
    apart = hmm_lm.expected_counts(flat, hmm_lm.runs_of(at, run=64, warm=0), model)
    assert whole[2].sum() == pytest.approx(len(flat)) and cut[1].sum() == pytest.approx(len(flat) - 4)
    for x, y, z in zip(whole[:3], cut[:3], apart[:3], strict=True):
        assert np.allclose(x, y, atol=0.01) and np.abs(x - y).max() <= np.abs(x - z).max() + 1e-12
    assert whole[3] == pytest.approx(cut[3], abs=0.01) and whole[3] == pytest.approx(hmm_lm.forward_scores(flat, at, model).sum())


def check_base(rows, texts):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t in texts if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in texts:
        x = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)
        want[(d, held(d), len(x), sum(c[w] > 0 for w in x), n, round(base, 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want


def test_language_model(spark, sf, odd, brute_texts, empty):
    check_base(hmm_lm.hmm_scores(odd, vocabulary=8, tolerance=0.5).collect(), brute_texts)
    assert hmm_lm.hmm_scores(empty).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = hmm_lm.hmm_scores(docs).collect()
    check_base(rows, [(r["doc_id"], r["text"] or "") for r in docs.collect()])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_by_brute_force_and_under_two_layouts(spark, tmp_path):
    """The whole of it again by loops: classes, start, rounds, likelihood, scores; and sums to 1."""
    import xxhash

    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in "klmnop" for b in ("an", "en", "on", "us")]
    texts = [(i, " ".join(rng.choice(vocabulary[: 12 + i % 12], rng.integers(0, 12)))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = []
    for n in (1, 5):
        docs.repartition(n, "text").write.parquet(str(tmp_path / str(n)))
        rows = hmm_lm.hmm_scores(spark.read.parquet(str(tmp_path / str(n))), states=2, vocabulary=10, classes=5, tolerance=0.01).collect()
        found.append({r["doc_id"]: (r["held_out"], r["score"]) for r in rows})
    assert all(found[0][i][1] == pytest.approx(found[1][i][1], abs=1e-9) for i, _ in texts)

    train = [tokens(t) for i, t in texts if not found[0][i][0]]
    c = Counter(w for t in train for w in t)
    n_train = c.pop(None)
    steps = Counter(math.floor(math.log2(x) * 32) for x in c.values() if x >= hmm_lm.LEAST)
    taken, least = 0, math.inf
    for s in sorted(steps, reverse=True):
        if taken + steps[s] > 10:
            break
        taken, least = taken + steps[s], s
    kind = lambda w: xxhash.xxh3_64_intdigest(w.encode()[-3:]) % 5
    signed = lambda w: (xxhash.xxh3_64_intdigest(w.encode()) + (1 << 63)) % (1 << 64) - (1 << 63)
    own = sorted((w for w in c if c[w] >= hmm_lm.LEAST and math.floor(math.log2(c[w]) * 32) >= least), key=signed)
    rest = [1.0 + sum(c[w] + 1 for w in c if w not in own and kind(w) == k) for k in range(5)]
    shares = np.array([c[w] + 1.0 for w in own] + rest + [n_train + 1.0])
    base = shares / shares.sum()
    symbol = lambda w: len(base) - 1 if w is None else own.index(w) if w in own else len(own) + kind(w)

    def forward_backward(s, model):
        start, move, emit = model
        a, b = [start * emit[s[0]]], [np.ones(2)]
        for x in s[1:]:
            a.append(a[-1] @ move * emit[x])
        for x in s[:0:-1]:
            b.insert(0, move @ (emit[x] * b[0]))
        return a, b, a[-1].sum()

    model, levels, sample = hmm_lm.first_model(base, 2), [-math.inf], 0
    while True:
        start, move, emit, log = np.ones(2), np.full((2, 2), 0.1), hmm_lm.PRIOR * base[:, None] + np.zeros(2), 0.0
        for t in train:
            s = [symbol(w) for w in t]
            a, b, total = forward_backward(s, model)
            log += math.log10(total)
            start = start + a[0] * b[0] / total
            for j, x in enumerate(s):
                emit[x] += a[j] * b[j] / total
                if j:
                    move = move + np.outer(a[j - 1], model[2][x] * b[j]) * model[1] / total
        emit = (1 - hmm_lm.BACK_OFF) * emit / emit.sum(axis=0) + hmm_lm.BACK_OFF * base[:, None]
        model = start / start.sum(), move / move.sum(axis=1, keepdims=True), emit
        levels.append(log / sum(map(len, train)))
        sample += 1
        # The sample is the whole table here: first its rounds, then those over all, each to the tolerance.
        if levels[-1] - levels[-2] < 0.01 or sample == hmm_lm.SAMPLE_ROUNDS:
            if levels[0] is None:
                break
            levels, sample = [None, -math.inf], -10_000
    for i, t in texts:
        s = [symbol(w) for w in tokens(t)]
        shared = sum(math.log10((c[w] + 1) / rest[kind(w)]) for w in tokens(t) if w is not None and w not in own)
        assert found[0][i][1] == pytest.approx(math.log10(forward_backward(s, model)[2]) + shared, abs=1e-6)
    words = sum(model[2][symbol(w)] * (1 if w in own else (c[w] + 1) / rest[kind(w)]) for w in c)
    unknown = sum(model[2][len(own) + k] / rest[k] for k in range(5))
    assert np.allclose(words + unknown + model[2][-1], 1)


def test_alignment_is_longest():
    rng = random.Random(1)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for bits in (1 << 27, 16):
        html_text.MOST_BITS = bits
        for _ in range(300):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
            got = html_text.aligned(a, b)
            rest = iter(b)
            assert all(a[i] in rest for i in sorted(got)) and len(got) == length(a, b)
    html_text.MOST_BITS = 1 << 27


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><a href="/">Home</a></nav><div class="cookie-notice"><p>We use cookies</p></div><article><h1>Head&nbsp;line</h1>
<p>One <b>bold</b>word &amp; more<br>after<p>Two<!-- gone --></p><aside>Side</aside><form>Sign up<input name=x></form>
<section id="comments"><p>first!</p></section><ul><li>a<li>b</ul></article><footer>&copy; x</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(html_text.lines_of(PAGE), []) == "Head line One boldword & more after Two a b"
    cut = PAGE[: PAGE.index("Two") + 2]
    assert html_text.main_text(html_text.lines_of(cut), []) == "Head line One boldword & more after Tw"


def test_names_that_only_look_like_furniture():
    text = lambda page: html_text.main_text(html_text.lines_of(page), [])
    assert text('<div class="layout has-sidebar"><article><header><h1>Title</h1></header><p>Body <math>x</math></p></article></div>') == "Title Body x"
    for name in ("article-header", "entry-header", "widget-text", "social-history", "share-price"):
        assert text(f'<div class="{name}">words</div>') == "words"
    for name in ("ad-slot", "sidebarLeft", "cookie-consent", "comments-area", "site-header", "related-posts"):
        assert text(f'<div class="x {name}">words</div>') == ""
    assert text('<div class="content sidebar-right"><main><p>kept</p></main></div>') == "kept"


def test_differencing_decides(spark):
    box = "<article><p>Subscribe to our letter for the best stories of every week</p></article>"
    page = lambda i: f"<body><div>Site name</div>{box}<article><h1>Story {i}</h1><p>Both have this</p><p>Own words {i} of some length</p></article></body>"
    lines = [html_text.lines_of(page(i)) for i in range(3)]
    off, one, both = (html_text.main_text(lines[1], x) for x in ([], lines[:1], lines[::2]))
    assert off == "Site name Subscribe to our letter for the best stories of every week Story 1 Both have this Own words 1 of some length"
    assert one == off.removeprefix("Site name ") and both == "Story 1 Both have this Own words 1 of some length"
    rows = [(i, f"http://h.example/{i}", page(i), i, "x") for i in range(5)] * 2 + [(9, "http://h.example/9", page("long " * 60_000), 1, None)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = [(r["page_id"], r["text"]) for r in got.collect()]
    assert len(texts) == 11 and Counter(texts)[(2, "Story 2 Both have this Own words 2 of some length")] == 2
    assert all("Site name" not in t for _, t in texts) and max(len(t) for _, t in texts) > 500_000
    # The first and the last page of a host have one neighbour, which alone can't condemn an article.
    assert {i for i, t in texts if "Subscribe" in t} == {0, 9}


def test_furniture_without_markup_goes_by_differencing(spark):
    page = lambda i: f"<body><div>Site name</div><div>Story {i} has words</div><p>End {i}</p><div>All rights</div></body>"
    rows = [(i, f"http://h.example/{i // 3}/{i}", page(i)) for i in range(9)] + [(20, None, None), (21, "http://alone.example/x", page(21)), (22, "http://h.example/0/0", page(0))]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        want = f"Story {i} has words End {i}"
        assert got[i] == (want, len(want))
    assert got[22] == got[0] and got[20] == ("", 0) and got[21][0] == "Site name Story 21 has words End 21 All rights"
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_alignment_decides_beside_an_article(spark):
    page = lambda i: f"<body><div>Site name</div><article>Teaser {i}</article><div>Body {i} has words</div><article>Both</article><div>All rights</div></body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Teaser {i} Body {i} has words" + " Both" * (i in (0, 3)) for i in range(4)}


def test_texts_do_not_depend_on_the_partitions(spark):
    page = lambda i: f"<body><div>Site name</div><div>Part {i % 3}</div><div>Story {i} has words</div><div>All rights</div></body>"
    rows = [(i, f"http://h{i // 25}.example/{i // 3:03}/{i:03}", page(i if i % 25 < 18 else 500)) for i in range(100)]
    rows += [(200 + i, f"http://pair{i // 2}.example/{i}", page(i)) for i in range(20)] + [(None, None, None)] * 2 + rows[:3]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for n in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found.append(Counter(tuple(r) for r in html_text.extract_text(df).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0].total() == len(rows) and found[0] == found[1] == found[2]
    assert not any("Site name" in r[2] for r in found[0])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<head><title>T</title><body><p>Body text", "Body text"),
        ("<head><meta charset=x><p>Body text", "Body text"),
        ("<html><head><title>T</title>Loose words<p>Body", "Loose words Body"),
        ('<article><p class="advert">Buy now<p>Real text', "Real text"),
        ('<ul><li class="ad">Buy<li>Real item</ul>', "Real item"),
        ('<dl><dt class="ad">Buy<dd>Real item</dl>', "Real item"),
        ('<table><tr class="ad"><td>Buy<tr><td class="promo">Buy<td>Real cell</table>', "Real cell"),
        ('<ul><li class="ad">Buy<ul><li>Inner</ul>More<li>Real</ul>', "Real"),
        ('<form id="aspnetForm"><article>The article</article><input></form>', "The article"),
        ('<div class="widget-area"><article>The article</article></div>', "The article"),
        ('<div class="page sidebar-left"><article>The article</article></div>', "The article"),
        ('<div class="sidebar"><article>Teaser</article></div><article>The whole article</article>', "The whole article"),
        ('<article>Text<article class="comment">First!</article></article>', "Text"),
        ('<article>Text<div class="post-comments"><p>First!</div></article>', "Text"),
        ('<article>Text<div class="comment-body">First!</div><div id="user-comments">Second</div></article>', "Text"),
        ('<article>Text<div itemscope itemtype="https://schema.org/Comment">First!</div></article>', "Text"),
        ('<article class="post comments-open">Text</article>', "Text"),
        ("<aside><article>Teaser</article></aside>", ""),
    ],
)
def test_page_by_page(page, want):
    assert html_text.main_text(html_text.lines_of(page), []) == want


def test_the_only_article_stays_whatever_neighbours_share(spark):
    rows = [(i, f"http://h.example/{i}", f"<nav>Home</nav><article><p>One story in three editions</p><p>{'It ends.' if i else 'It begins.'}</p></article>") for i in range(3)]
    rows.append((3, "http://h.example/3", "<article>One story in three editions</article>" + "<p>open words</p>" * 3))
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "One story in three editions It ends." and got[0].endswith("It begins.") and got[3].startswith("One story")


@pytest.mark.parametrize("folder", ["", "/root/testdata/sf0.1"])
def test_pages_of_the_table(spark, sf, folder):
    import html
    import os

    sf = folder or sf
    if not os.path.isdir(sf):
        pytest.skip("no such table")
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op7_html_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)
        text = re.sub(r"<[^>]*(?:>|$)", lambda t: "" if re.match(r"</?b>", t[0]) else " ", body[1] if body else "")
        assert got[r["page_id"]] == " ".join(html.unescape(text).split())


def test_kernel_tolerates_gaps():
    k = toxicity.Marks([b"idiot"]).kernel([b"idiot", b"idixot", b"table"])[:, 0]
    assert k[0] == pytest.approx(1) and k[0] > k[1] > 0.15 > k[2]
    spans = toxicity.Spans(*toxicity.text_buffer(toxicity.pa.array(["An I d i o t here. Two", None, "x, i.d.i.o.t!\nend"])))
    assert spans.joined == [(b"idiot", 0)] and spans.texts.tolist() == [0, 2, 2, 4] and b"idiot" in spans.names


def kernel_by_loops(a, b):
    """The span kernel from its definition: weighted ordered triples of characters, ends included."""
    from itertools import combinations

    def triples(w):
        w, out = f"^{w}$", Counter()
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = triples(a), triples(b)
    norm = lambda v: math.sqrt(sum(n * n for n in v.values()))
    k = sum(n * y[t] for t, n in x.items()) / (norm(x) * norm(y))
    return k**toxicity.POWER if k >= toxicity.FLOOR else 0.0


def test_sentence_features_by_brute_force():
    texts = ["You idiot. Nice day", "An id iot, and a mo ron! rotten apple egg", None, "rotten egg here\nthe rotten, egg i d i o t", "x"]
    marks = ["idiot", "moron", "rottenegg"]
    spans = toxicity.Spans(*toxicity.text_buffer(toxicity.pa.array(texts)))
    number, values, *_ = toxicity.sentence_features(toxicity.Likeness([m.encode() for m in marks], [False, False, True]), spans)
    got = dict(zip(number.tolist(), values.tolist(), strict=True))
    sentences = [s for t in texts for line in (t or "").split("\n") for s in re.split(r"(?<=[.!?])\s+", line) if s.strip()]
    for i, s in enumerate(sentences):
        w = [re.sub(r"[^a-z0-9]", "", x.lower()) for x in s.split()]
        pairs = [a + b for a, b in zip(w, w[1:]) if len(a + b) <= toxicity.SHORT or any(kernel_by_loops(a, m) and kernel_by_loops(b, m) for m in marks) or kernel_by_loops(a, marks[2]) or kernel_by_loops(b, marks[2])]
        runs = [x.replace(" ", "") for x in re.findall(r"(?:\b\w\b ?){3,}", " ".join(w))]
        want = [max(kernel_by_loops(x, m) for x in [*w, *pairs, *runs]) for m in marks]
        assert got.get(i, [0, 0, 0]) == pytest.approx(want, abs=1e-5), (s, got.get(i), want)
    assert len(sentences) == spans.texts[-1]


def test_insults_in_disguise_and_their_harmless_parts(spark):
    rng = np.random.default_rng(5)
    syllables = ["ka", "lo", "mi", "ren", "tas", "vu", "pol", "shi", "den", "gra"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    text = lambda *put: " ".join([word() for _ in range(9)] + list(put) + [word() for _ in range(9)]) + "."
    rows = []
    for i in range(900):
        kind = i % 6
        put = ("idiot",) if kind == 0 else ("rotten", "egg") if kind == 1 else ("rotten", word()) if kind == 2 else (word(), "egg") if kind == 3 else (word(),)
        rows.append((i, text(*put), int(kind < 2)))
    asked = {
        "idixot": 1, "id iot": 1, "i d i o t": 1, "i.d.i.o.t": 1, "IDIOT!": 1, "rotten egg": 1, "Rotten, egg": 1, "rottten egg": 1,
        "rotten apple": 0, "boiled egg": 0, "rotten wood near an egg": 0, "idle riot": 0, "id card": 0,
    }
    held = (i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 5 == 0)
    asked = {next(held): (text(*x.split()), y, x) for x, y in asked.items()}
    docs = spark.createDataFrame([r[:2] for r in rows] + [(i, t) for i, (t, _, _) in asked.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    wrong = [(x, got[i]["score"]) for i, (_, y, x) in asked.items() if got[i]["predicted"] != y]
    assert not wrong


def test_toxicity_learns_and_keeps_to_its_inputs(spark, odd, empty):
    rng = np.random.default_rng(4)
    syllables = ["ka", "lo", "mi", "ren", "tas", "vu", "pol", "shi", "den", "gra"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, marks = [], []
    for i in range(600):
        w = [word() for _ in range(30)]
        if i % 4 == 0:
            w[int(rng.integers(30))] = str(rng.choice(["idiot", "moron", "scumbag"]))
        rows.append((i, " ".join(w), "l", "s"))
        marks.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert right / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.toxicity(odd, labels).count() == odd.count() and toxicity.toxicity(empty, labels).count() == 0
