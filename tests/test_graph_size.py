"""Graph operators on graphs large for the test session: work and memory follow the edges."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import graph
from voxelweave.plans import tables


def complete(spark, n, copies=1):
    rows = [(a + n * c, b + n * c, float(1 + (a * 7 + b * 13 + c) % 5)) for c in range(copies) for a, b in itertools.combinations(range(n), 2)]
    return spark.createDataFrame(rows, "src long, dst long, weight double"), rows


def shuffled(spark, run):
    """Bytes that a call writes to shuffles."""
    context = spark.sparkContext._jsc.sc()

    def total():
        time.sleep(1)  # the status store follows a little later
        found = context.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    run()
    return total() - before


def test_edges_use_more_partitions_for_more_rows(spark, sf):
    df = spark.range(1000)
    assert tables.parts(df, 100) == 10 and tables.parts(df, 100_000) < 10
    # Orders and edges were counted in as many tasks as the session has shuffle partitions, or fewer.
    asked = {r["n"] for r in tables.edges(spark, sf).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()}
    assert asked and tables.edges(spark, sf).rdd.getNumPartitions() == tables.parts(tables.table(spark, sf, "lineitem"))


def test_triangles_shuffle_edges_and_not_pairs_of_edges(spark):
    edges, rows = complete(spark, 160)
    edges = graph.cut(edges)
    found = {}
    moved = shuffled(spark, lambda: found.update({r["node"]: r["clustering"] for r in graph.clustering_binary(edges).collect()}))
    assert found == {n: 1.0 for n in range(160)}
    assert moved < 40 * len(rows)  # one pair of edges a triangle would be 669,920 rows for 12,720 edges


def test_edges_are_shuffled_once_whatever_the_blocks(spark, monkeypatch):
    """An edge of a connected graph went to as many cells as there are groups of nodes."""
    edges, rows = complete(spark, 160)
    edges, moved = graph.cut(edges), []
    for cell in (200_000, 2500):
        monkeypatch.setattr(graph, "CELL", cell)
        found = {}
        moved.append(shuffled(spark, lambda: found.update({r["node"]: r["links"] for r in graph.corners(edges).collect()})))  # noqa: B023
        assert found == {n: 159 * 158 // 2 for n in range(160)}
    assert moved[1] < 2 * moved[0], moved


def test_long_and_short_lists_of_neighbours_give_the_same_corners(spark, monkeypatch):
    """A hub of many neighbours, and edges looked up one by one or many at a time."""
    rng = np.random.default_rng(8)
    m = np.triu(np.where(rng.random((70, 70)) < 0.2, rng.random((70, 70)), 0), 1)
    m[0, 1:] = 1.5
    full, one = m + m.T, ((m + m.T) > 0).astype(float)
    i, j = np.nonzero(m)
    df = spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)], "src long, dst long, weight double")
    want = np.diag(one @ one @ one) / 2, np.diag(full @ full @ full) / 2
    for least in (0, 12, 1000):
        monkeypatch.setattr(graph, "LONG", least)
        got = {r["node"]: (r["links"], r["closed"]) for r in graph.corners(df).collect()}
        assert got == {k: (want[0][k], pytest.approx(want[1][k])) for k in range(70) if want[0][k]}


@pytest.mark.parametrize("cell", [50, 400, 100_000])
def test_corners_of_triangles_in_any_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(graph, "CELL", cell)
    monkeypatch.setattr(graph, "PAIRS", 500)
    rng = np.random.default_rng(cell)
    m = np.triu(np.where(rng.random((60, 60)) < 0.3, rng.integers(1, 9, (60, 60)), 0), 1).astype(float)
    m[:20, 40:] = 0  # groups that have no edge in common
    i, j = np.nonzero(m)
    turned = rng.random(len(i)) < 0.5
    rows = [(int(b) * 5, int(a) * 5, float(m[a, b])) if t else (int(a) * 5, int(b) * 5, float(m[a, b])) for a, b, t in zip(i, j, turned, strict=True)]
    got = {r["node"]: (r["links"], r["closed"]) for r in graph.corners(spark.createDataFrame(rows, "src long, dst long, weight double")).collect()}
    full, one = m + m.T, ((m + m.T) > 0).astype(float)
    links, closed = np.diag(one @ one @ one) / 2, np.diag(full @ full @ full) / 2
    assert got == {k * 5: (links[k], pytest.approx(closed[k])) for k in range(60) if links[k]}


def test_tree_rounds_take_only_the_best_edge_between_parts(spark):
    edges, rows = complete(spark, 120, copies=3)
    edges = graph.cut(edges)
    tree = []
    moved = shuffled(spark, lambda: tree.extend(graph.minimum_spanning_tree(edges).collect()))
    part, want = {n: n for n in range(360)}, set()

    def root(n):
        while part[n] != n:
            n = part[n]
        return n

    for a, b, w in sorted(rows, key=lambda r: (1 / r[2], r[0], r[1])):
        if root(a) != root(b):
            part[root(a)] = root(b)
            want.add((a, b, w))
    assert {(r["src"], r["dst"], r["weight"]) for r in tree} == want
    print("moved", moved, moved / len(rows))
    assert moved < 60 * len(rows)
