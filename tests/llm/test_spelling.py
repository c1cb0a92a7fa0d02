import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from voxelweave.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, least_chars=6, least_count=5, ratio=5, typo_every=None):
    n = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = crc32(f"{'' if doc is None else doc}:{w}".encode())
            if typo_every and h % typo_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least_chars
    n = {w: c for w, c in n.items() if c >= least_count}
    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, c in n.items():
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * c else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, n[w], len(others[w]), form[w], n.get(form[w]), root


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


@pytest.mark.parametrize(("part", "task"), [(4096, 60_000), (8, 500)])
def test_random_words_against_all_pairs(spark, monkeypatch, part, task):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "TASK", task)
    rng = np.random.default_rng(part)
    letters = np.array(list("aabbcé÷Z"))
    stems = ["".join(rng.choice(letters, rng.integers(2, 6))) for _ in range(12)]
    words = ["".join(rng.choice(stems, 2)) for _ in range(150)] + ["a" * k for k in (6, 7, 8, 300, 301)]
    docs = [(i, " ".join(rng.choice(words, 25) if i % 3 else [words[i % 7]] * 60)) for i in range(200)]
    docs += [(None, "wordé word é aaaaaa-aaaaaaa \U0001f600abcdefğhijklm"), (900, None), (901, "")]
    df = spark.createDataFrame([(*x, "row") for x in docs], "doc_id long, text string, w string").repartition(3)
    for chars, count, ratio, every in ((6, 5, 5, None), (4, 1, 2, 3)):
        want = sorted(brute(docs, chars, count, ratio, every), key=str)
        assert rows(spelling.spelling_groups(df, chars, count, ratio, every)) == want
        assert any(r[3] for r in want)


def test_chain_of_forms_ends_at_its_last(spark):
    counts = {"abcdef": 5, "abcdefg": 25, "abcdefgh": 125, "abcdefghi": 700}
    docs = spark.createDataFrame([(1, " ".join(" ".join([w] * c) for w, c in counts.items()))], "doc_id long, text string")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_groups(docs).collect()}
    assert got["abcdef"] == ("abcdefg", "abcdefghi") and got["abcdefghi"] == (None, "abcdefghi")


def test_odd_rows(odd, empty, brute_texts):
    assert rows(spelling.spelling_groups(odd, typo_every=7)) == sorted(brute(brute_texts, typo_every=7), key=str)
    assert spelling.spelling_groups(empty).count() == 0
    assert spelling.spelling_groups(odd.filter("doc_id = 9")).count() == 0
