"""Shortest paths in cells against the rounds of joins."""

import numpy as np
import pytest

from voxelweave.operators import graph


@pytest.fixture(scope="module")
def edges(spark):
    """Three components (dense, sparse, a pair), loops, and a double edge."""
    rng = np.random.default_rng(2)
    dense = [(a, b, float(rng.integers(1, 9))) for a in range(40) for b in range(a + 1, 40)]
    sparse = [(int(a), int(b), float(rng.random() + 0.1)) for a, b in zip(range(100, 160), rng.integers(100, 160, 60))]
    return spark.createDataFrame([*dense, *sparse, (500, 501, 2.0), (500, 501, 4.0), (600, 600, 1.0)], "src long, dst long, weight double")


@pytest.mark.parametrize(("stripe", "most"), [(1 << 22, 1 << 23), (200, 1 << 23), (1 << 22, 100)])
def test_cells_equal_rounds(spark, edges, monkeypatch, stripe, most):
    monkeypatch.setattr(graph, "STRIPE", stripe)  # small: many stripes a component
    monkeypatch.setattr(graph, "EDGES", most)  # small: the dense component goes by rounds
    start = graph.degree(edges).select("node").filter("node % 3 <> 1").unionByName(spark.range(900, 901).toDF("node"))
    rows = graph.shortest_paths(edges, start).collect()
    got = {(r["source"], r["node"]): r["d"] for r in rows}
    want = {(r["source"], r["node"]): r["d"] for r in graph.relaxed(edges, start).collect()}
    assert len(rows) == len(got) and got == {k: pytest.approx(d, abs=1e-9) for k, d in want.items()}


def test_dense_components_take_no_row_a_path_and_arc(spark, edges, monkeypatch):
    monkeypatch.setattr(graph, "relaxed", None)  # not called
    assert graph.shortest_paths(edges, graph.degree(edges).select("node")).filter("source < 40").count() == 1600


@pytest.mark.parametrize("step", [1, 3])
def test_dense_component_sends_few_edges_to_its_stripes(spark, monkeypatch, step):
    """Every edge of a component went to each of its stripes; ``step`` 3: two nodes in three are no starts."""
    monkeypatch.setattr(graph, "STRIPE", 1600)
    monkeypatch.setattr(graph, "NEAR", 8)
    rng = np.random.default_rng(5)
    m = np.triu(rng.integers(1, 30, (160, 160)).astype(float), 1)
    length = np.where(m + m.T > 0, 1 / np.maximum(m + m.T, 1), 0)
    for k in range(160):
        length = np.minimum(length, length[:, k, None] + length[k])
    edges = graph.cut(spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(*np.nonzero(m), strict=True)], "src long, dst long, weight double"))
    sent, plain = [], graph.in_cells
    monkeypatch.setattr(graph, "in_cells", lambda own, *rest: sent.append(own.count()) or plain(own, *rest))
    start = spark.range(0, 160, step).toDF("node")
    got = {(r["source"], r["node"]): r["d"] for r in graph.shortest_paths(edges, start).collect()}
    assert got == {(a, b): pytest.approx(length[a, b], abs=1e-12) for a in range(0, 160, step) for b in range(160)}
    assert sent[0] <= 8 * 160 and (step > 1 or sent[1] < 12_720 * 2 / 3), sent
