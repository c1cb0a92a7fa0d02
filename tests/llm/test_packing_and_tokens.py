import hashlib
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxelweave.llm import byte_bpe, packing, token_counts


def word_ids(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]


def test_words_that_hold_added_tokens():
    import pyarrow as pa
    import public_tokenizers as P

    from voxelweave.llm.arrow_text import text_buffer, words_of
    from voxelweave.llm.bpe_words import WordEndBpe

    texts = ["a <|endoftext|> b", "x<|startoftext|>y<|endoftext|>", "<|ENDOFTEXT|> <|end oftext|>", "Ä<|endoftext|>ß <| |>", "<|endoftext|"]
    bpe = WordEndBpe(P.path("word_bpe_49k.json"))
    for text in texts:
        ids, _ = bpe.encode_words(words_of(*text_buffer(pa.array([text]))))
        assert [*ids.tolist(), 1] == word_ids([text])[0]
    assert 49407 in word_ids(texts)[0]


def test_packing_of_odd_rows(odd, brute_texts):
    got = packing.pack_documents(odd).collect()
    want = Counter()
    for (doc, _), ids in zip(brute_texts, word_ids([t for _, t in brute_texts]), strict=True):
        a = np.array(ids, "<u4")
        want.update((doc, p // 4096, p, len(a[p : p + 4096]), zlib.crc32(a[p : p + 4096].tobytes())) for p in range(0, len(a), 4096))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


@pytest.mark.parametrize("seed", [0, 1])
def test_best_fit_is_as_good_as_the_serial_one(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 101, 400), np.full(150, 34), np.full(60, 67), rng.integers(1, 5, 200)])
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "doc_id long, length long")
    from voxelweave.llm.scratch import Scratch

    rows = packing.best_fit(df, Scratch(spark, "t"), capacity=100).collect()
    assert len(rows) == len(lengths)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 100
    gaps, n = [], 0
    for x in sorted(lengths.tolist(), reverse=True):
        k = bisect_left(gaps, x)
        gap = gaps.pop(k) if k < len(gaps) else 100
        n += gap == 100
        insort(gaps, gap - x)
    assert len(by) <= n * 1.02 + 1


@pytest.mark.parametrize("hot", [False, True])
def test_short_documents_fill_sequences(spark, hot):
    from voxelweave.llm.scratch import Scratch

    lengths = np.random.default_rng(3).integers(11, 33, 12_000)
    if hot:
        lengths[:8_000] = 12
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "doc_id long, length long")
    rows = packing.best_fit(df, Scratch(spark, "t")).collect()
    assert Counter(r["length"] for r in rows) == Counter(lengths.tolist())
    sums = Counter()
    for r in rows:
        sums[r["sequence_id"]] += r["length"]
    least = -(-int(lengths.sum()) // 4096)
    assert max(sums.values()) <= 4096 and len(sums) <= 1.05 * least + 1, (len(sums), least)


def test_short_documents_meet_the_same_gaps_again(spark):
    from voxelweave.llm.scratch import Scratch

    lengths = [4050] * 200 + [20] * 390 + [32] * 5 + [11] * 40  # a gap of 46 holds two of them or four
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    sums = Counter()
    for r in packing.best_fit(df, Scratch(spark, "t")).collect():
        sums[r["sequence_id"]] += r["length"]
    assert sum(sums.values()) == sum(lengths) and max(sums.values()) <= 4096
    assert len(sums) == 201


def test_the_driver_holds_one_scan_and_no_broadcast(spark, monkeypatch):
    """Of all rounds' tables together, and of the depths that a sweep begins with."""
    from voxelweave.llm.scratch import Scratch

    plans, put = [], Scratch.put
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Scratch, "put", lambda self, df, label: plans.append(plan_of(df)) or put(self, df, label))
    df = spark.createDataFrame(list(enumerate([4050] * 20 + [1000] * 9 + [20] * 390 + [11] * 40)), "doc_id long, length long")
    found = packing.best_fit(df, Scratch(spark, "t"))
    assert found.count() == 459 and plan_of(found).count("FileScan") == 1
    assert len(plans) >= 6 and not any("Broadcast" in p for p in plans)


def test_ranks_without_a_gap_fill_sequences():
    lengths = sorted(np.random.default_rng(5).integers(3, 40, 5000).tolist(), reverse=True)
    counts = Counter((x, 1, 0, k % 3) for k, x in enumerate(lengths))
    plan = packing.Sweep([(*k, n) for k, n in counts.items()], 39, 100)
    rows = {(r["v"], r["salt"]): r for r in plan.table.to_pylist()}
    at, sums = {}, Counter()
    for v, _, _, salt in sorted(counts, key=lambda k: (-k[0], k[3])):
        r = rows[v, salt]
        for rank in range(1, counts[v, 1, 0, salt] + 1):
            k = rank - r["depth"] - 1 - r["begin"]
            s = r["started"] if k < r["more"] else r["next"] + (k - r["more"]) // r["per"]
            at[len(at)] = s
            sums[s] += v
    want, number, room = {}, -1, 0
    for k, v in enumerate(lengths):
        if room < v:
            number, room = number + 1, 100
        room -= v
        want[k] = number
    assert at == want and max(sums.values()) <= 100 and plan.without_gap == len(lengths)


def test_empty_tables(empty):
    assert packing.pack_documents(empty).count() == 0
    assert byte_bpe.encode(empty).count() == 0
    assert token_counts.token_counts(empty).count() == 0


def reference_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_ids_equal_those_of_the_ranks(odd, brute_texts):
    enc, ranks = reference_encoding()
    length = {r: len(b) for b, r in ranks.items()}
    got = Counter((r["doc_id"], tuple(r["ids"]), tuple(r["starts"]), r["n_tokens"]) for r in byte_bpe.encode(odd).collect())
    want = Counter()
    for doc, t in brute_texts:
        ids = enc.encode_ordinary(t)
        starts = np.concatenate([[0], np.cumsum([length[i] for i in ids])])[:-1].astype(int)
        want[(doc, tuple(ids), tuple(starts.tolist()), len(ids))] += 1
    assert got == want


def test_digests_and_round_trip(odd, brute_texts):
    got = Counter((r["doc_id"], r["decoded_sha256"]) for r in byte_bpe.encode(odd, "digests").collect())
    assert got == Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in brute_texts)
    texts = Counter((r["doc_id"], r["text"]) for r in byte_bpe.decode(byte_bpe.encode(odd)).collect())
    assert texts == Counter(brute_texts)


def test_split_characters_decode_to_replacements():
    path, pattern = byte_bpe.defaults(None, None)
    bpe = byte_bpe.ByteBpe(path, pattern)
    single = [r for b, r in byte_bpe.read_ranks(path).items() if b == b"\xe2"]
    assert bpe.decode_text(np.array(single)) == "�"


def test_suffix_sums(spark, odd):
    lengths = [r["n_tokens"] for r in byte_bpe.encode(odd, "counts", byte_bpe.defaults(None, None, "byte_bpe_50k.tiktoken")[0]).collect()]
    sums = token_counts.token_counts(odd)
    rows = {r["length"]: r for r in sums.collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        assert r["truncated_tokens"] == sum(min(x, limit) for x in lengths)
        assert r["docs_over"] == sum(x > limit for x in lengths)
        assert r["tokens_at_most"] == sum(x for x in lengths if x <= limit)
    asked = {r["context_limit"]: r["truncated_tokens"] for r in token_counts.truncated_total(sums, [1, 5, 100, 10**6]).collect()}
    assert asked == {k: sum(min(x, k) for x in lengths) for k in (1, 5, 100, 10**6)}
    quantiles = {r["q"]: r["length"] for r in token_counts.length_quantiles(sums).collect()}
    assert quantiles[0.5] == sorted(lengths)[-(-len(lengths) // 2) - 1]
