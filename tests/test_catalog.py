"""Every query against its SQL, and closed-form cases for the queries that SQL cannot express."""

import numpy as np
import pandas as pd
import pytest

from voxelweave.operators import aggregate, cluster, connectivity, fits, graph, signal
from voxelweave.plans import catalog


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf, name):
    got = ordered(catalog.QUERIES[name](spark, sf).toPandas())
    want = ordered(duck.sql(catalog.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)


@pytest.mark.parametrize("discrete", [False, True])
def test_quantiles_equal_sorted_lists(spark, discrete):
    r = np.random.default_rng(5)
    data = [("hot", float(v)) for v in r.integers(0, 40, 4000)] + [("real", float(v)) for v in r.normal(size=777)]
    data += [("tie", 2.5)] * 301 + [("one", -1.0), (None, 1.0), (None, 4.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(data, "k string, value double")
    fractions = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {x["k"]: x for x in aggregate.exact_quantiles(df, ["k"], fractions, discrete).collect()}
    assert set(got) == {"hot", "real", "tie", "one", None, "none"}
    assert all(got["none"][n] is None for n in fractions)
    for k in set(got) - {"none"}:
        values = [v for g, v in data if g == k and v is not None]
        for n, q in fractions.items():
            assert got[k][n] == pytest.approx(np.quantile(values, q, method="inverted_cdf" if discrete else "linear"))


def test_statistics_of_no_values(spark):
    none = spark.createDataFrame([], "k string, value double")
    assert aggregate.vector_stats(none).first().asDict() == {"n": 0, "mean": None, "sd": None, "median": None, "low": None, "high": None}
    assert aggregate.iqr_bounds(none, ["k"]).count() == 0 and aggregate.median_deviation(none, ["k"]).count() == 0
    assert aggregate.median_normalised(none).count() == 0
    own = spark.createDataFrame([(None, 1.0), (None, 4.0), (None, 5.0)], "k string, value double")
    assert aggregate.median_deviation(own, ["k"]).first().asDict() == {"k": None, "median": 4.0, "mad": 1.0}


def rows(spark, series):
    return spark.createDataFrame([(i, [float(v) for v in s]) for i, s in enumerate(series)], "voxel_id long, series array<double>")


def test_bandpass_keeps_the_band(spark):
    t = np.arange(256)
    slow, fast = np.sin(2 * np.pi * 13 / 256 * t), np.sin(2 * np.pi * 77 / 256 * t)
    out = signal.bandpass(rows(spark, [slow + fast]), 0.01, 0.1, 1.0).first()["series"]
    assert np.allclose(out, slow, atol=1e-6)


def test_phase_measures(spark):
    t = np.arange(128)
    a, b = np.sin(2 * np.pi * 4 * t / 128), np.cos(2 * np.pi * 4 * t / 128)
    phases = signal.analytic_phase(rows(spark, [a, b]))
    assert connectivity.phase_coherence(phases).first()["value"] == pytest.approx(1)
    assert connectivity.phase_lag_index(phases).first()["value"] == pytest.approx(1)


def test_decay_fits(spark):
    t = np.arange(1, 9) * 0.01
    got = fits.t2_nonlinear(rows(spark, [1000 * np.exp(-t / 0.05)]), t.tolist()).first()
    assert got["t2"] == pytest.approx(0.05, rel=1e-6) and got["a"] == pytest.approx(1000, rel=1e-6)
    t = np.arange(1, 65) * 0.05
    got = fits.t1_inversion(rows(spark, [500 * (1 - 2 * np.exp(-t / 0.8))]), t.tolist()).first()
    assert got["t1"] == pytest.approx(0.8, rel=1e-5)
    got = fits.t1_inversion(rows(spark, [np.abs(500 * (1 - 1.9 * np.exp(-t / 0.8)))]), t.tolist(), factor=None, absolute=True).first()
    assert got["t1"] == pytest.approx(0.8, rel=0.05)


def test_isotropic_tensor(spark):
    g = [(0.0, 0.0, 0.0, 0.0)] + [(1000.0, *v) for v in np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [0, 1, 1], [1, 0, 1], [1, -1, 0]]) / np.sqrt([[1], [1], [1], [2], [2], [2], [2]])]
    d = 7e-4
    signal_ = [800 * np.exp(-b * d * (x * x + y * y + z * z)) for b, x, y, z in g]
    got = fits.tensor_fit(rows(spark, [signal_]), g).first()
    assert got["trace"] == pytest.approx(3 * d, rel=1e-6) and got["fa"] == pytest.approx(0, abs=1e-6)


def test_deconvolution_recovers_flow(spark):
    n, dt, mtt, cbf = 128, 1.0, 6.0, 0.02
    aif = np.exp(-((np.arange(n) - 10) ** 2) / 8.0)
    tissue = dt * np.convolve(aif, cbf * np.exp(-np.arange(n) / mtt))[:n]
    got = fits.deconvolution(rows(spark, [tissue]), aif.tolist(), dt, tol=1e-6).first()
    assert got["cbf"] == pytest.approx(cbf, rel=0.05)


def edge_table(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, weight double")


def test_shortest_path_and_tree(spark):
    edges = edge_table(spark, [(0, 1, 1.0), (1, 4, 5.0), (3, 4, 1 / 0.3), (0, 2, 1.0), (2, 3, 1.0)])
    start = spark.createDataFrame([(0,)], "node long")
    d = {r["node"]: r["d"] for r in graph.shortest_paths(edges, start).collect()}
    assert d[3] == pytest.approx(1.5) and d[4] == pytest.approx(1.2) and d[0] == 0
    tree = {(r["src"], r["dst"]) for r in graph.minimum_spanning_tree(edges).collect()}
    assert len(tree) == 4 and (1, 4) in tree and (3, 4) in tree


def test_one_cluster_has_modularity_zero(spark):
    edges = graph.ring_lattice(spark, 12, 2)
    one = spark.range(12).selectExpr("id AS node", "0 AS cluster")
    assert graph.modularity(edges, one).first()["q"] == pytest.approx(0)


def test_kmeans_separates(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (40, 3)), rng.normal(5, 0.1, (40, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = {r["id"]: r["cluster"] for r in cluster.kmeans(df, 2, seed=3)[0].collect()}
    assert len({got[i] for i in range(40)}) == 1 and got[0] != got[79]


def test_logistic_glm(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y.astype(float)}))
    got = {r["term"]: r["beta"] for r in fits.logistic_glm(df, ["x"], "y").collect()}
    assert got["x"] == pytest.approx(1.5, abs=0.2) and got["intercept"] == pytest.approx(0.5, abs=0.2)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_give_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).limit(1).count() == 1


def test_parts_and_fusion(spark):
    from voxelweave.operators import geometry

    v = spark.createDataFrame([(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (9, 5, 5, 5)], "voxel_id long, x int, y int, z int")
    assert {r["voxel_id"]: r["size"] for r in geometry.remove_isolated(v, 2).collect()} == {0: 3, 1: 3, 2: 3}
    rng = np.random.default_rng(0)
    truth = rng.random(400) < 0.5
    votes = [(i, r, int(t if rng.random() < q else not t)) for i, t in enumerate(truth) for r, q in enumerate((0.95, 0.9, 0.6))]
    w, quality = geometry.staple(spark.createDataFrame(votes, "voxel_id long, rater int, v int"))
    right = np.mean([(r["w"] > 0.5) == truth[r["voxel_id"]] for r in w.collect()])
    assert right > 0.93 and quality[0][0] > quality[2][0]


def test_tree_spans_the_whole_edge_table(spark):
    d = "/root/testdata/sf0.1"
    suppliers = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert catalog.QUERIES["minimum_spanning_tree"](spark, d).count() == suppliers - 1


def test_shortest_paths_follow_long_chains(spark):
    start = spark.createDataFrame([(0,)], "node long")
    d = {r["node"]: r["d"] for r in graph.shortest_paths(edge_table(spark, [(i, i + 1, 2.0) for i in range(70)]), start).collect()}
    assert d == {i: pytest.approx(i / 2) for i in range(71)}
    with pytest.raises(ValueError):
        graph.shortest_paths(edge_table(spark, [(0, 1, -1.0)]), start)


def test_shortest_paths_of_all_pairs(spark, sf):
    from voxelweave.plans import tables

    edges = [tuple(r) for r in tables.edges(spark, sf).collect()]
    nodes = {x for e in edges for x in e[:2]}
    want = {(a, b): 0.0 if a == b else np.inf for a in nodes for b in nodes}
    want |= {p: 1 / w for a, b, w in edges for p in ((a, b), (b, a))}
    for k in nodes:
        want |= {(a, b): min(want[a, b], want[a, k] + want[k, b]) for a in nodes for b in nodes}
    got = {(r["source"], r["node"]): r["d"] for r in catalog.QUERIES["shortest_paths"](spark, sf).collect()}
    assert got == {p: pytest.approx(d, abs=2e-6) for p, d in want.items() if d < np.inf}


def test_fusion_of_all_volumes(spark, sf):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    v = np.array(x["embedding"].tolist()) > 0
    p = q = np.full(v.shape[1], 0.9)
    for n in range(31):
        a, b = np.clip(p, 1e-6, 1 - 1e-6), np.clip(q, 1e-6, 1 - 1e-6)
        w = 1 / (1 + np.exp(np.where(v, np.log(1 - b), np.log(b)).sum(1) - np.where(v, np.log(a), np.log(1 - a)).sum(1)))
        if n == 30:
            break
        before, p, q = (p, q), w @ v / w.sum(), (1 - w) @ ~v / (1 - w).sum()
        if max(np.abs(p - before[0]).max(), np.abs(q - before[1]).max()) < 1e-7:
            break
    got = {r["voxel_id"]: r["w"] for r in catalog.QUERIES["label_fusion"](spark, sf).collect()}
    assert got == {i: pytest.approx(y, abs=1e-4) for i, y in zip(x["vec_id"], w, strict=True)}


def test_the_supplier_graph_is_not_empty_at_any_scale(spark):
    for sf in ("sf0.001", "sf0.1"):
        e = catalog._graph(spark, f"/root/testdata/{sf}")
        found, every = e.count(), catalog.tb.edges(spark, f"/root/testdata/{sf}").count()
        assert 0 < found < every


def test_classify_and_mask(spark):
    near = spark.createDataFrame([(1, 3), (1, 3), (1, 2), (2, 5), (2, 4)], "id long, label int")
    assert {r["id"]: (r["label"], round(r["share"], 3)) for r in cluster.classify(near).collect()} == {1: (3, 0.667), 2: (4, 0.5)}
    from voxelweave.operators import aggregate

    series = spark.createDataFrame([(v, t, 1.0) for v in range(3) for t in range(2)], "voxel_id long, t int, value double")
    mask = spark.createDataFrame([(0, 0), (1, 1), (2, 5)], "voxel_id long, m int")
    assert {r["voxel_id"] for r in aggregate.apply_mask(series, mask).collect()} == {1, 2}
