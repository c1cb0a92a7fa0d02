import hashlib
import re

import numpy as np
import pytest

from voxelweave.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
ITEM = "item_id long, text string, h int, row string"


def brute(docs, items, window=dc.WINDOW):
    cut = lambda t: WORD.findall((t or "").translate(LOWER))
    known = {}
    for item, text in items:
        w = cut(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            known.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in known}
    for doc, text in docs:
        w, hit, names = cut(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := known.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= found
        yield doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def order(rows):
    return sorted((tuple(r)[:6] for r in rows), key=str)


@pytest.mark.parametrize(("window", "k"), [(10, 5), (6, 2), (4, 4)])
def test_random_texts_against_all_windows(spark, window, k):
    rng = np.random.default_rng(window)
    text = lambda n: " ".join("abé"[x] if x < 3 else f"W{x}" for x in rng.integers(0, 4, n))
    items = [(int(i % 50), text(rng.integers(0, 26))) for i in range(60)] + [(None, text(12))]
    docs = [(i, text(rng.integers(0, 90))) for i in range(150)]
    docs += [(200 + i, f"{text(20)}, {items[i][1].upper()}; {text(9)}") for i in range(50)]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, 1, "x") for x in items], ITEM), window, k)
    assert order(got.collect()) == order(brute(docs, items, window))


def test_shared_span_has_a_shared_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(100):
        span = rng.integers(0, 1 << 63, 10).astype(np.uint64)
        one, two = (np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 9)).astype(np.uint64), span, rng.integers(0, 1 << 63, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(2))
        a, b = (set(dc.fingerprints(x, np.array([0, len(x)]), 10, 5)[1].tolist()) for x in (one, two))
        assert a & b


def test_odd_rows(spark, odd, empty, brute_texts):
    items = [(1, "Quick brown fox, jumps over the lazy dog while seven wizards"), (2, None), (3, ""), (3, "one two"), (None, "wizards quietly boxed"), (5, "ünïcødé")]
    items += items[:1]
    bench = spark.createDataFrame([(*x, 7, "y") for x in items], ITEM)
    got = dc.contaminated(odd, bench).collect()
    assert order(got) == order(brute(brute_texts, items))
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in got}[9] == (2, ["3"])
    assert dc.contaminated(empty, bench).count() == 0
    none = dc.contaminated(odd, bench.limit(0)).collect()
    assert len(none) == odd.count() and not any(r["contaminated"] for r in none)
