from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from voxelweave.llm import exact_dedup, importance, near_dedup, quality_rules, queries
from voxelweave.llm.components import connected_components
from voxelweave.llm.scratch import Scratch


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf, name):
    order = lambda df: df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True)
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_rules_of_odd_rows(odd):
    got = Counter((r["doc_id"], r["n_words"], r["n_dup_lines"], r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(odd).collect())
    assert got[(3, 0, 0, True, False)] == got[(4, 0, 0, True, False)] == got[(5, 0, 0, True, False)] == 1
    assert got[(7, 16, 0, False, True)] == 2 and got[(None, 16, 0, False, True)] == 1
    assert got[(10, 9, 1, True, False)] == 1
    assert sum(got.values()) == odd.count()


def test_boilerplate_goes_and_depleted_documents_too(spark):
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(12))
    menu = "Home About Contact and many more things to see here today friends"
    rows = [(i, f"{menu}\n{own(i)}", "en", "h", 1) for i in range(40)] + [(100 + i, f"  {menu.upper()}\nshort {i}", "en", "h", 1) for i in range(5)]
    rows += [(200 + i, f"{menu}\n{own(200 + i)}", "en", "g", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    verdict = {r["doc_id"]: (r["kept"], r["removed_words"]) for r in quality_rules.quality_rules(docs).collect()}
    assert all(verdict[i] == (True, 12) for i in range(40)) and all(not verdict[100 + i][0] for i in range(5))
    assert all(verdict[200 + i] == (True, 0) for i in range(3))
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in quality_rules.clean_documents(docs).collect()}
    assert texts[0] == (own(0), len(own(0))) and 100 not in texts and texts[200][0].startswith(menu)


def test_boilerplate_of_a_hot_host_is_a_small_share(spark):
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(12))
    ad = "Buy these fine things here today"
    rows = [(i, f"{ad}\n{own(i)}" if i % 50 == 0 else own(i), "en", "hot", 1) for i in range(3000)]
    rows += [(5000 + i, f"{own(9000)}\n{own(9001)}", "en", None, 1) for i in range(40)] + [(6000, own(6000), None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = quality_rules.clean_documents(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(texts[i] == own(i) for i in range(0, 3000, 50))
    # Copies of one document share its lines, which are not boilerplate; a null source stays null.
    assert all(texts[5000 + i] == f"{own(9000)}\n{own(9001)}" for i in range(40)) and {r["source"] for r in got} == {"hot", None}


def test_repeated_words_against_windows():
    rng = np.random.default_rng(0)
    for _ in range(200):
        parts = [rng.integers(0, 3, rng.integers(0, 25)) for _ in range(3)]
        codes, docs = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        want = []
        for p in parts:
            seen = defaultdict(list)
            for i in range(len(p) - 4):
                seen[tuple(p[i : i + 5])].append(i)
            want.append(len({i + k for x in seen.values() if len(x) > 1 for i in x for k in range(5)}))
        assert quality_rules.repeated_words(codes, docs).tolist() == want


def test_exact_dedup_of_odd_rows(spark, odd, empty):
    for capacity in (4096, 1):
        rows = exact_dedup.exact_dedup(odd, capacity).collect()
        group = [r for r in rows if r["group_size"] == 5]
        assert sorted((r["doc_id"] or -1, r["keep_id"]) for r in group) == [(-1, 7), (1, 7), (2, 7), (7, 7), (7, 7)]
        assert sum(r["kept"] for r in group) == 1
        assert {r["doc_id"]: r["keep_id"] for r in rows if r["doc_id"] in (3, 4)} == {3: 4, 4: 4}
    assert exact_dedup.distinct_documents(odd).count() == odd.count() - 5
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS h", "1L AS n")
    placed = exact_dedup.build_directory(keys, Scratch(spark, "t"), capacity=64)
    sizes = placed.groupBy("bucket", "local_depth").count().collect()
    assert sum(r["count"] for r in sizes) == 5000 and max(r["count"] for r in sizes) <= 64


def jaccard_components(texts, size, percent):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    out = {}
    for x in groups.values():
        least = min((texts[i][0] for i in x if texts[i][0] is not None), default=None)
        out.update({i: least for i in x})
    return sets, out


def test_near_duplicates_of_odd_rows(odd, brute_texts, empty):
    sets, want = jaccard_components(brute_texts, 4, 80)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(odd, size=4).collect())
    assert got == Counter((d, len(sets[i]), want[i]) for i, (d, _) in enumerate(brute_texts))
    groups = {want[i] if sets[i] else ("alone", i) for i in range(len(brute_texts))}
    kept = near_dedup.distinct_groups(odd, size=4)
    assert kept.count() == len(groups) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.distinct_groups(empty).count() == 0


def test_large_near_group_needs_no_pairs_and_loses_no_link(spark):
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(words)
        for k in rng.choice(60, rng.integers(0, 3), replace=False):
            w[k] = f"u{i}x{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, want = jaccard_components(rows, 5, 80)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want
    assert near_dedup.distinct_groups(docs).count() == len(set(want.values()))


def test_crowded_buckets_in_blocks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(3):
        words = [f"g{g}v{i}" for i in range(40)]
        for i in range(60):
            w = list(words)
            for k in rng.choice(40, rng.integers(1, 4), replace=False):
                w[k] = f"g{g}u{rng.integers(3)}x{k}"
            rows.append((len(rows), " ".join(w) + " tail" * (i % 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, want = jaccard_components(rows, 5, 80)
    monkeypatch.setattr(near_dedup, "MOST_ROUNDS", 0)
    for few, block, shingles in ((1, 16, 10**6), (1, 512, 300), (10**9, 512, 10**6)):
        monkeypatch.setattr(near_dedup, "FEW", few)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == want


def test_sketch_estimates_similarity_and_fills_every_coordinate():
    rng = np.random.default_rng(2)
    both = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    a, b, tiny = np.unique(both[:600]), np.unique(both[300:]), both[:1]
    s = near_dedup.sketches(np.concatenate([a, b, tiny]), np.cumsum([0, len(a), len(b), 1]))
    assert abs((s[0] == s[1]).mean() - 300 / 900) < 0.15 and (s != 0).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def brute_weights(texts, target):
    """Log ratio of add-one bucket models of words and word pairs, by a loop."""
    import math

    import xxhash

    wrap, m3 = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def buckets(t):
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in t.lower().split()]
        pairs = []
        for a, b in zip(h, h[1:]):
            x = ((a * m3) & wrap) ^ ((b + m3) & wrap)
            pairs.append(((x ^ (x >> 29)) * m3) & wrap)
        return [(x >> 17) % importance.BUCKETS for x in h + pairs]

    own = [buckets(t) for t in texts]
    raw, good = Counter(x for b in own for x in b), Counter(x for i in target for x in own[i])
    n_raw, n_good = sum(raw.values()) + importance.BUCKETS, sum(good.values()) + importance.BUCKETS
    return [sum(math.log((good[x] + 1) / n_good) - math.log((raw[x] + 1) / n_raw) for x in b) for b in own]


def test_importance_of_the_table_by_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = [(i, t) for i, t in docs if t.translate(low) == t.lower() and not any(c.isspace() and c not in " \t\n\v\f\r" for c in t)]
    assert len(plain) == len(docs) or plain
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_importance_resampling"](spark, sf).collect()}
    assert len(got) == len(docs)
    if len(plain) == len(docs):
        want = brute_weights([t for _, t in docs], [i for i, (d, _) in enumerate(docs) if d in good])
        assert all(got[d]["log_weight"] == pytest.approx(w, abs=1e-6) for (d, _), w in zip(docs, want, strict=True))
    # k rows of the largest keys stay, and k is the number of weights at or above the target's low end.
    kept = [r["key"] for r in got.values() if r["kept"]]
    cut = np.quantile([r["log_weight"] for d, r in got.items() if d in good], importance.LIGHTEST)
    assert len(kept) == sum(r["log_weight"] >= cut for r in got.values())
    assert min(kept) >= max([r["key"] for r in got.values() if not r["kept"]], default=-np.inf)


def test_importance_does_not_follow_the_files(spark, sf, tmp_path):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = []
    for n in (1, 7):
        docs.repartition(n, "text").write.parquet(str(tmp_path / str(n)))
        found.append({r["doc_id"]: (round(r["key"], 6), r["kept"]) for r in importance.importance(spark.read.parquet(str(tmp_path / str(n))), labels).collect()})
    assert found[0] == found[1]


def test_importance_prefers_target_words(spark, odd, empty):
    rows = [(i, " ".join(["good", "fine", f"g{i % 7}"] * 10)) for i in range(60)] + [(100 + i, " ".join(["junk", "spam", f"j{i % 5}"] * 10)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in importance.importance(docs, labels).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[100 + i]["kept"] for i in range(40))
    weight = brute_weights([t for _, t in rows], range(30))
    assert all(got[d]["log_weight"] == pytest.approx(weight[i]) for i, (d, _) in enumerate(rows))
    kept = importance.importance(docs, labels, k=25).filter("kept").collect()
    ranked = sorted((r["key"] for r in importance.importance(docs, labels, k=25).collect()), reverse=True)
    assert len(kept) == 25 and min(r["key"] for r in kept) == pytest.approx(ranked[24])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.importance(odd, none).filter("kept").count() == odd.count()
    assert importance.importance(empty, labels).count() == 0
