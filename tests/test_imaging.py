"""Closed forms and brute force for the operators that SQL cannot express."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from voxelweave.operators import aggregate, cluster, connectivity, diffusion, filters, fits, graph, kspace, perfusion, power_law, sampling, signal
from voxelweave.sources import formats


def packed(spark, series):
    return spark.createDataFrame([(i, [float(v) for v in s]) for i, s in enumerate(series)], "voxel_id long, series array<double>")


def edges_of(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")


def grid(spark, v):
    rows = [(int(x), int(y), int(z), float(v[x, y, z])) for x, y, z in np.ndindex(v.shape)]
    return spark.createDataFrame(rows, "x int, y int, z int, value double")


def cube(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] = r[3]
    return out


# k-space


def traces_of(spark, k):
    rows = [("f", b, t, k[b, t].real.tolist(), k[b, t].imag.tolist()) for b in range(k.shape[0]) for t in range(k.shape[1])]
    return spark.createDataFrame(rows, kspace.TRACE)


def forward(image):
    return np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(image)))


def phantom(n, m, k):
    v = np.zeros((n, m))
    v[n // 4 : n // 2, m // 3 : m // 2 + k] = 5 + k
    return v


def images_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["z"], r["part"]), {})[(r["y"], r["x"])] = r["value"]
    return {k: np.array([[v[y, x] for x in range(max(c for _, c in v) + 1)] for y in range(max(c for c, _ in v) + 1)]) for k, v in out.items()}


def test_programs_recover_phantoms(spark):
    n, m, slices = 8, 12, 3
    k = {s: forward(phantom(n, m, s)) for s in range(slices)}
    positions = [0.2, 0.0, 0.1]
    gems = np.stack([k[s][line] for line in range(n) for s in range(slices)])[None]
    got = images_of(kspace.gradient_echo(traces_of(spark, np.concatenate([gems, 2 * gems])), slices, positions))
    assert len(got) == 6
    for z, s in enumerate((1, 2, 0)):
        assert np.allclose(got[z, 0], phantom(n, m, s), atol=1e-4) and np.allclose(got[z, 1], 2 * phantom(n, m, s), atol=1e-4)
    order = [4, 0, 6, 2, 5, 1, 7, 3]
    train = 4
    shots = [order[a : a + train] for a in range(0, n, train)]
    fse = np.stack([k[s][line] for shot in shots for s in range(slices) for line in shot])[None]
    got = images_of(kspace.spin_echo(traces_of(spark, fse), slices, train, [x + 3 for x in order], positions))
    assert all(np.allclose(got[z, 0], phantom(n, m, s), atol=1e-4) for z, s in enumerate((1, 2, 0)))
    decay = [1.0, 0.5, 0.25]
    me = np.stack([k[s][line] * e for line in range(n) for s in range(slices) for e in decay])[None]
    got = kspace.multi_echo(traces_of(spark, me), slices, 3, [0.0, 0.1, 0.2])
    images = images_of(got)
    assert all(np.allclose(images[s, e], phantom(n, m, s) * w, atol=1e-4) for s in range(slices) for e, w in enumerate(decay))
    t2 = fits.t2_linear(kspace.packed_voxels(got, m, n).select("voxel_id", (F_pos("series"))).select("voxel_id", "t", "value"), 100.0).collect()
    inside = [r["t2"] for r in t2 if r["a"] > 1]
    assert np.allclose(inside, 0.01 / math.log(2), rtol=1e-3) and kspace.echo_times(0.01, 3) == [0.01, 0.02, 0.03]


def F_pos(c):
    from pyspark.sql import functions as F

    return F.inline(F.transform(c, lambda v, i: F.struct(((i + 1) * 0.01).alias("t"), v.alias("value"))))


def test_volume_zero_fill_and_raw_files(spark, tmp_path):
    v = np.random.default_rng(0).random((4, 6, 8))  # partition, line, sample
    k = np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(v)))
    (tmp_path / "raw").write_bytes(kspace.encode_traces(np.concatenate([k.reshape(1, 24, 8), np.zeros((1, 24, 8))])))
    read = kspace.read_traces(spark, str(tmp_path / "raw"))
    assert read.count() == 24
    got = {(r["z"], r["y"], r["x"]): r["value"] for r in kspace.volume(read, 6).collect()}
    assert all(got[i] == pytest.approx(v[i], abs=1e-4) for i in np.ndindex(v.shape))
    assert np.allclose(kspace.centred_inverse(forward(np.ones((4, 4))), (0, 1), (4, 4)), 1)
    assert kspace.fitted(np.arange(6), 4, 0).tolist() == [1, 2, 3, 4] and kspace.fitted(np.arange(2), 5, 0).tolist() == [0, 0, 1, 0, 0][:1] + [0, 1, 0, 0]
    assert kspace.slice_order([0.3, 0.1, 0.1, 0.0]) == [3, 2, 0] and kspace.slice_spacing([0.0, 0.2, 0.1]) == pytest.approx(0.1)
    assert kspace.spacings({"lro": ["2"], "lpe": ["4"], "pss": ["0", "0.1"]}, (8, 4)) == pytest.approx((5, 5, 1))


def test_echo_planar_phase_maps_remove_a_shift(spark):
    n, m = 8, 16
    image = phantom(n, m, 1)
    u = np.linspace(-1, 1, m)
    wrong = np.exp(1j * (0.4 + 0.9 * u))
    k = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(image, axes=0), axis=0), axes=0)  # lines x readout space
    reference = np.tile(np.full(m, 3.0), (n, 1)) * np.where(np.arange(n) % 2, 1, 0)[:, None] * wrong + np.where(np.arange(n) % 2, 0, 1)[:, None] * 3.0
    scan = np.where((np.arange(n) % 2)[:, None] == 1, k * wrong, k)
    to_k = lambda lines: np.fft.fftshift(np.fft.fft(np.fft.ifftshift(lines, axes=1), axis=1), axes=1)
    rows = lambda v: spark.createDataFrame([(0, 0, i, v[i].real.tolist(), v[i].imag.tolist()) for i in range(n)], "image int, part int, line int, re array<float>, im array<float>")
    got = kspace.echo_planar(rows(to_k(scan)), kspace.phase_maps(rows(to_k(reference))))
    out = np.zeros((n, m))
    for r in got.collect():
        out[r["y"], r["x"]] = r["value"]
    assert np.allclose(out, image, atol=1e-3)
    plain = kspace.reconstruct(rows(to_k(scan)))
    assert max(abs(r["value"] - image[r["y"], r["x"]]) for r in plain.collect()) > 0.5
    assert kspace.shot_lines(2, 6) == [[0, 2, 4], [1, 3, 5]] and kspace.shot_lines(1, 5, centric=True) == [[2, 1, 3, 0, 4]]
    k2 = forward(image)
    shots = [np.concatenate([k2[i] for i in line]) for line in kspace.shot_lines(2, n)]
    lines = kspace.multi_shot(traces_of(spark, np.stack(shots)[None]), 2, n, m, 1)
    got = {(r["y"], r["x"]): r["value"] for r in kspace.reconstruct(lines).collect()}
    assert all(got[i] == pytest.approx(image[i], abs=1e-3) for i in np.ndindex(image.shape))


# Relaxometry


@pytest.mark.parametrize("model", sorted(fits.T1_MODELS))
def test_t1_models(spark, model):
    t = np.arange(1, 41) * 0.08
    absolute, free, b, form = fits.T1_MODELS[model]
    b = 1.7 if free else b
    if form == "hybrid":
        y, want = 500 * (b - np.exp(-t / 0.8)), 0.8
    elif form == "apparent":
        y, want = 500 - 850 * np.exp(-(850 / 500 - 1) * t / 0.8), 0.8
    else:
        y, want = 500 * (1 - b * np.exp(-t / 0.8)), 0.8 * (b - 1 if form == "look_locker" else 1)
    later = np.abs(y) if absolute else y.copy()
    cut = later.copy()
    cut[30] = 0
    cut[31:] = 7
    rows = fits.t1_fit(packed(spark, [later, cut, np.concatenate([[3.0], np.zeros(39)])]), t.tolist(), model).orderBy("voxel_id").collect()
    # The sign of the smallest magnitude itself is a guess, which costs the absolute models a little.
    assert rows[0]["t1"] == pytest.approx(want, rel=0.02 if absolute else 1e-3) and rows[0]["r2"] == pytest.approx(1, abs=1e-3 if absolute else 1e-6)
    assert rows[1]["t1"] == pytest.approx(want, rel=0.05 if absolute else 1e-2) and (rows[2]["t1"], rows[2]["a"]) == (0, 0)


def test_t2_stops_at_the_first_sample_that_is_not_positive(spark):
    t = np.arange(1, 9) * 0.01
    y = 1000 * np.exp(-t / 0.05)
    y[5:] = [0.0, 500.0, 900.0]
    long = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(t, y)] + [(1, 0.01, -1.0), (1, 0.02, 5.0)], "voxel_id long, t double, value double")
    got = {r["voxel_id"]: r for r in fits.t2_linear(long, 10.0).collect()}
    assert got[0]["t2"] == pytest.approx(0.05) and got[0]["r2"] == pytest.approx(1) and (got[1]["t2"], got[1]["a"]) == (0, 0)
    got = fits.t2_nonlinear(packed(spark, [y, [1.0, 0.0, *[2.0] * 6], 900 * np.exp(-t / 0.02) + 30]), t.tolist(), constant=True).orderBy("voxel_id").collect()
    assert got[0]["t2"] == pytest.approx(0.05, rel=1e-2) and got[1]["t2"] == 0
    assert got[2]["t2"] == pytest.approx(0.02, rel=1e-4) and got[2]["c"] == pytest.approx(30, rel=1e-3)


# Quadratic programs and diffusion


def test_quadratic_programs():
    h, f = np.array([[4.0, -2], [-2, 4]]), np.array([6.0, 0])
    equal, at_least = ([[1, 1]], [3]), ([[1, 0], [0, 1], [1, 1]], [0, 0, 2])
    for x, value in (diffusion.quadratic_program(h, f, equal, at_least), diffusion.interior_point(h, f, at_least, equal)):
        assert np.allclose(x, [1, 2], atol=1e-6) and value == pytest.approx(12)
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = rng.integers(2, 6)
        a = rng.normal(size=(n + 2, n))
        g, c = a.T @ a + 0.1 * np.eye(n), rng.normal(size=n)
        rules = rng.normal(size=(6, n))
        bounds = rules @ rng.normal(size=n) - rng.random(6)
        one, two = diffusion.quadratic_program(g, c, None, (rules, bounds)), diffusion.interior_point(g, c, (rules, bounds))
        assert np.allclose(one[0], two[0], atol=1e-5) and (rules @ one[0] >= bounds - 1e-8).all()
    with pytest.raises(ValueError):
        diffusion.quadratic_program(np.eye(1), np.zeros(1), None, ([[1.0], [-1.0]], [1.0, 1.0]))


def gradients(n=30):
    return [(0.0, 0.0, 0.0, 0.0)] * 2 + [(b, *v) for b in (1000.0, 2000.0) for v in diffusion.directions(n).tolist()]


def test_constrained_tensors_have_no_negative_eigenvalue(spark):
    g = gradients()
    d = np.diag([1.5e-3, 3e-4, 3e-4])
    good = [800 * math.exp(-b * (v @ d @ v)) for b, *v in ((b, *map(np.float64, x)) for b, *x in g) for v in [np.array(v)]]
    d = np.diag([1.5e-3, 3e-4, -2e-4])
    bad = [800 * math.exp(-b * (np.array(v) @ d @ np.array(v))) for b, *v in g]
    for nonlinear in (False, True):
        rows = diffusion.constrained_tensor(packed(spark, [good, bad]), g, nonlinear).orderBy("voxel_id").collect()
        assert rows[0]["l1"] == pytest.approx(1.5e-3, rel=1e-3) and rows[0]["s0"] == pytest.approx(800, rel=1e-3)
        assert rows[0]["fa"] == pytest.approx(0.7698, abs=2e-3) and abs(rows[0]["v1x"]) == pytest.approx(1, abs=1e-3) and rows[0]["red"] == pytest.approx(rows[0]["fa"], abs=1e-3)
        assert rows[1]["l3"] >= -1e-9 and rows[1]["l1"] == pytest.approx(1.5e-3, rel=0.2)
    turned = diffusion.resampled_tensors(diffusion.constrained_tensor(packed(spark, [good]), g), [[0, -1, 0], [1, 0, 0], [0, 0, 1]]).first()
    assert turned["dyy"] == pytest.approx(1.5e-3, rel=1e-3) and turned["dxx"] == pytest.approx(3e-4, rel=1e-3)


def test_kurtosis_is_recovered(spark):
    g = gradients()
    d, k = 1e-3, 0.9  # isotropic: ln S/S0 = -b d + b^2 d^2 k / 6
    clean = [1000 * math.exp(-b * d + b * b * d * d * k / 6) for b, *_ in g]
    spoilt = list(clean)
    spoilt[7] *= 3
    for method in ("linear", "constrained", "restore"):
        r = diffusion.kurtosis_fit(packed(spark, [clean]), g, method).first()
        assert r["mean_k"] == pytest.approx(k, rel=1e-3) and r["trace"] == pytest.approx(3 * d, rel=1e-3) and r["axial_k"] == pytest.approx(k, rel=1e-2) and r["radial_k"] == pytest.approx(k, rel=1e-2)
    linear, robust = (diffusion.kurtosis_fit(packed(spark, [spoilt]), g, m).first()["mean_k"] for m in ("linear", "restore"))
    assert abs(robust - k) < 1e-2 < abs(linear - k)
    negative = [1000 * math.exp(-b * d - b * b * d * d * 0.5 / 6) for b, *_ in g]
    assert diffusion.kurtosis_fit(packed(spark, [negative]), g).first()["mean_k"] < -0.4
    assert diffusion.kurtosis_fit(packed(spark, [negative]), g, "constrained").first()["mean_k"] == pytest.approx(0, abs=1e-4)
    post = diffusion.bayesian_tensor(packed(spark, [[v * (1 + 0.01 * math.sin(i)) for i, v in enumerate(clean[:32])]]), g[:32]).first()
    assert post["trace_mean"] == pytest.approx(3 * d * (1 - 1000 * d * k / 6), rel=0.05) and post["accepted"] == 1


def test_gradient_table():
    (b, x, y, z), (b2, x2, *_) = diffusion.gradient_table([(0, 3, 4)], 2.0, 0.004, 0.02, mirrored=True)
    assert (x, y, z) == (0, 0.6, 0.8) and (b2, x2) == (b, 0) and b == pytest.approx((2 / math.pi) ** 2 * 0.004**2 * 100 * (0.02 - 0.001) * 26751.98775**2 * 0.01)


# Graphs


def floyd(nodes, edges):
    d = {(a, b): 0.0 if a == b else math.inf for a in nodes for b in nodes}
    for a, b, w in edges:
        d[a, b] = d[b, a] = min(d[a, b], 1 / w)
    for k, a, b in itertools.product(nodes, nodes, nodes):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


def test_betweenness_by_brute_force(spark):
    five = [(0, 1, 1.0), (1, 4, 5.0), (3, 4, 1 / 0.3), (0, 2, 1.0), (2, 3, 1.0)]
    rng = np.random.default_rng(2)
    other = [(int(a), int(b), float(rng.integers(1, 3))) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.35]
    for edges in (five, other):
        nodes = sorted({x for e in edges for x in e[:2]})
        d = floyd(nodes, edges)
        near = {v: [] for v in nodes}
        for a, b, w in edges:
            near[a].append((b, 1 / w))
            near[b].append((a, 1 / w))

        def paths(s, t, d=d, near=near):
            if s == t:
                return [[t]]
            return [[s, *p] for v, w in near[s] if abs(d[s, t] - w - d[v, t]) < 1e-9 and d[s, t] < math.inf for p in paths(v, t)]

        want = dict.fromkeys(nodes, 0.0)
        for s, t in itertools.combinations(nodes, 2):
            found = paths(s, t)
            for p in found:
                for v in p[1:-1]:
                    want[v] += 1 / len(found)
        got = {r["node"]: r["betweenness"] for r in graph.betweenness(edges_of(spark, edges)).collect()}
        assert got == {v: pytest.approx(b) for v, b in want.items()}
    star = edges_of(spark, [(0, i, 1.0) for i in range(1, 6)])
    assert graph.central_point_dominance(graph.betweenness(star)).first()["dominance"] == pytest.approx(1)


def test_null_models(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), 1.0) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.3]
    new = [tuple(r) for r in graph.rewired(edges_of(spark, edges), rounds=4).collect()]
    degree = lambda e: np.bincount([x for a, b, _ in e for x in (a, b)], minlength=14).tolist()
    pairs = {(a, b) for a, b, _ in new}
    assert degree(new) == degree(edges) and len(pairs) == len(edges) and all(a < b for a, b in pairs) and pairs != {e[:2] for e in edges}
    m = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(6) for j in range(6)], "i long, j long, value double")
    out = {(r["i"], r["j"]): r["value"] for r in graph.permuted(m).collect()}
    assert len(out) == 36 and all(out[i, i] == 11 * i for i in range(6)) and sorted(out.values()) == sorted(10.0 * i + j for i in range(6) for j in range(6)) and out[0, 1] != 1 or out[1, 0] != 10


def test_threshold_at_strength_and_directed_clustering(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(rng.random())) for a, b in itertools.combinations(range(12), 2)]
    top = max(w for *_, w in edges)
    mean = lambda t: 2 * sum(w for *_, w in edges if w > t) / 12
    want = next(j * top / 1000 for j in range(1001) if mean(j * top / 1000) <= 3)
    got = graph.threshold_at_strength(edges_of(spark, edges), 3.0).first()
    assert got["threshold"] == pytest.approx(want) and got["mean"] == pytest.approx(mean(want))
    with pytest.raises(ValueError):
        graph.threshold_at_strength(edges_of(spark, edges), 1e9)
    arcs = [(a, b, w) for a in range(7) for b in range(7) if a != b and (w := float(rng.random())) > 0.4]
    s = np.zeros((7, 7))
    adjacency = np.zeros((7, 7))
    for a, b, w in arcs:
        s[a, b], adjacency[a, b] = np.cbrt(w), 1
    both = s + s.T
    k = adjacency.sum(0) + adjacency.sum(1)
    c = np.diag(np.linalg.matrix_power(both, 3)) / 2 / (k * (k - 1) - 2 * np.diag(adjacency @ adjacency))
    got = {r["node"]: r["clustering"] for r in graph.clustering_directed(edges_of(spark, arcs)).collect()}
    assert got == {i: pytest.approx(x) for i, x in enumerate(c)}


def test_power_law_recovers_its_exponent(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([3 * (1 - rng.random(1500)) ** (-1 / 1.5), rng.random(400) * 3])
    got = power_law.power_law(spark.createDataFrame([(float(v),) for v in x], "value double")).first()
    assert got["alpha"] == pytest.approx(2.5, abs=0.15)
    best = min(((max(np.abs(np.concatenate([np.arange(len(y)) / len(y), np.arange(1, len(y) + 1) / len(y)]) - np.tile(1 - (y / m) ** (1 - a), 2))), m) for m in np.unique(x)[:-1] for y in [np.sort(x[x >= m])] for a in [1 + len(y) / np.log(y / m).sum()]))
    assert (got["ks"], got["xmin"]) == pytest.approx(best)


# Clusters


def blobs(spark, centres, n, sd=0.1):
    rng = np.random.default_rng(6)
    rows = [(k * n + i, (np.array(c) + rng.normal(0, sd, len(c))).tolist()) for k, c in enumerate(centres) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>")


def test_seeds_and_isodata_find_the_blobs(spark):
    rows = blobs(spark, [(0, 0), (5, 0), (0, 5), (5, 5)], 30)
    for found in (cluster.kmeans(rows, 4)[0], cluster.isodata(rows, 3, split=1.0, lump=1.0, rounds=8)[0], cluster.isodata(rows, 7, split=1.0, lump=1.5, pairs=4, rounds=9)[0]):
        got = {r["id"]: r["cluster"] for r in found.collect()}
        assert [len({got[30 * k + i] for i in range(30)}) for k in range(4)] == [1] * 4 and len(set(got.values())) == 4
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "id long, features array<double>")
    assert {r["cluster"] for r in cluster.kmeans(same, 3)[0].collect()} == {0} and cluster.kmeans(same.limit(0), 3)[0].count() == 0


def test_affinity_propagation_and_spectral_clusters(spark):
    x = [0.0, 0.2, 0.1, 5.0, 5.2, 5.1]
    s = spark.createDataFrame([(i, j, -((x[i] - x[j]) ** 2)) for i in range(6) for j in range(6) if i != j], "i long, k long, s double")
    got = {r["node"]: r["exemplar"] for r in cluster.affinity_propagation(s, preference=-5.0, rounds=25).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 5, 4: 5, 5: 5}
    two = [(a, b, 1.0) for g in (0, 5) for a, b in itertools.combinations(range(g, g + 5), 2)] + [(0, 5, 0.1)]
    got = {r["node"]: r["cluster"] for r in cluster.spectral(edges_of(spark, two), 2, sweeps=25).collect()}
    assert len({got[i] for i in range(5)}) == len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[5]


def test_relabelled(spark):
    rows = lambda of: spark.createDataFrame([(i, i, 0, 0, of[i // 3]) for i in range(9)], "voxel_id long, x int, y int, z int, label int")
    got = {r["voxel_id"]: r["label"] for r in cluster.relabelled(rows([7, 8, 0]), rows([1, 2, 3])).collect()}
    assert [got[i] for i in range(9)] == [1] * 3 + [2] * 3 + [0] * 3


# Signals and connectivity


def test_signal_kernels(spark):
    t = np.arange(60)
    a, b = np.sin(2 * np.pi * 3 * t / 60), np.cos(2 * np.pi * 15 * t / 60)
    out = signal.exact_bandpass(packed(spark, [a + b + 2]), 0.03, 0.1, 1.0).first()["series"]
    assert np.allclose(out, a + 2)
    line = 0.5 * np.arange(64) + 3
    assert np.allclose(signal.bandpass(packed(spark, [line]), 0.05, 0.2, 1.0, retrend=True).first()["series"], line)
    lag = signal.lagged_correlation(packed(spark, [np.roll(np.eye(1, 40, 8)[0], 5)]), np.eye(1, 40, 8)[0].tolist()).first()
    assert lag["lag"] == 5 and lag["correlation"] > 0.9
    phase = signal.phase_unwrapped(spark.createDataFrame([(0, k, float(np.angle(np.exp(1j * 0.9 * k)))) for k in range(20)], "voxel_id long, t int, value double"))
    assert [r["value"] for r in phase.orderBy("t").collect()] == pytest.approx([0.9 * k for k in range(20)])
    noise = np.random.default_rng(7).normal(size=(2, 2048))
    alpha = [r["alpha"] for r in signal.dfa(packed(spark, [noise[0], np.cumsum(noise[1])])).orderBy("voxel_id").collect()]
    assert alpha[0] == pytest.approx(0.5, abs=0.1) and alpha[1] == pytest.approx(1.5, abs=0.15)
    g = 3 + 20 * np.exp(4 * np.log(t + 1e-3) - (t + 1e-3) / 2.0 - 5)
    r = signal.gamma_response(packed(spark, [g]), 1.0).first()
    assert r["time_to_peak"] == pytest.approx(8, rel=0.02) and r["alpha"] == pytest.approx(5, rel=0.03)


def test_measures_of_a_response(spark):
    t = np.arange(40) + 1e-3
    curve = 20 + 300 * t**3 * np.exp(-t / 2) / (6 * 2**4)  # alpha 4, beta 2
    noise = 3 * np.sin(np.arange(40) * 2.3)
    noise[0] = 0
    clean, rough = signal.gamma_response(packed(spark, [curve, curve + noise]), 1.0).orderBy("voxel_id").collect()
    assert clean["converged"] and clean["alpha"] == pytest.approx(4, rel=1e-3) and clean["p"] == pytest.approx(1) and clean["chi2"] < 1e-6
    x = t[-1] / 2
    assert clean["area"] == pytest.approx(300 * (1 - math.exp(-x) * (1 + x + x * x / 2 + x**3 / 6)), rel=1e-3)
    assert clean["relative_top"] == pytest.approx((curve.max() - 20) / 20, rel=1e-3)
    assert 0 < rough["chi2"] <= ((curve + noise - curve) ** 2 / curve).sum() * 1.05 and 0.5 < rough["p"] < 1


def test_components_and_coherency(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=24)
    x = np.outer(rng.normal(size=30), base) + 0.01 * rng.normal(size=(30, 24))
    eigen, parts, maps = connectivity.series_components(packed(spark, x), share=0.9)
    c = np.cov(x.T, bias=True)
    assert [r["eigenvalue"] for r in eigen.orderBy("component").collect()][:3] == pytest.approx(np.linalg.eigvalsh(c)[::-1][:3].tolist(), abs=1e-9)
    first = [r["value"] for r in parts.filter("component = 0").orderBy("t").collect()]
    assert abs(np.corrcoef(first, base)[0, 1]) > 0.99 and parts.count() == 24 and maps.count() == 30
    long = spark.createDataFrame([(i, t, float(x[i, t])) for i in range(30) for t in range(24)], "voxel_id long, t int, value double")
    labels = spark.createDataFrame([(i, 1 + i % 2) for i in range(30)], "voxel_id long, label int")
    got = connectivity.principal_signal(long, labels).filter("label = 1").orderBy("t").collect()
    assert abs(np.corrcoef([r["value"] for r in got], base)[0, 1]) > 0.99
    t = np.arange(64)
    p = packed(spark, [np.sin(2 * np.pi * 4 * t / 64), 3 * np.cos(2 * np.pi * 4 * t / 64)])
    assert connectivity.coherency(p).first()["value"] == pytest.approx(1) and abs(connectivity.coherency(p, imaginary=True).first()["value"]) == pytest.approx(1)
    d = connectivity.similarity_matrix(p, 10.0).first()["value"]
    assert d == pytest.approx(math.exp(-((np.sin(2 * np.pi * 4 * t / 64) - 3 * np.cos(2 * np.pi * 4 * t / 64)) ** 2).sum() / 100))


def test_prewhitened_glm_and_p_values(spark):
    rng = np.random.default_rng(9)
    x = np.stack([np.ones(200), np.sin(np.arange(200) / 7)], axis=1)
    noise = np.zeros(200)
    for i in range(1, 200):
        noise[i] = 0.6 * noise[i - 1] + rng.normal()
    r = fits.prewhitened_glm(packed(spark, [x @ [2.0, 3.0] + noise]), x.tolist()).first()
    assert r["beta"] == pytest.approx([2.0, 3.0], abs=0.6)
    ols = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * noise.var())
    assert r["se"][0] > 1.3 * ols[0]
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=3000), "y": (rng.random(3000) < 0.5).astype(float)}))
    got = fits.logistic_glm(df, ["x"], "y").filter("term = 'x'").first()
    assert got["p"] == pytest.approx(math.erfc(abs(got["z"]) / math.sqrt(2)))


# Filters


def test_smoothing_diffusion_and_holes(spark):
    v = np.zeros((9, 9, 9))
    v[4, 4, 4] = 1
    got = cube(filters.gaussian(grid(spark, v), 2.0, (1.0, 1.0, 2.0)).select("x", "y", "z", "value"), v.shape)
    s = 2.0 / math.sqrt(8 * math.log(2))
    assert got[5, 4, 4] / got[4, 4, 4] == pytest.approx(math.exp(-1 / (2 * s * s)), rel=0.02) and got[4, 4, 5] / got[4, 4, 4] == pytest.approx(math.exp(-4 / (2 * s * s)), rel=0.02) and got.sum() == pytest.approx(1, abs=0.02)
    step = np.zeros((6, 4, 4))
    step[3:] = 10
    noisy = step + np.random.default_rng(0).normal(0, 0.2, step.shape)
    out = cube(filters.anisotropic(grid(spark, noisy), 4, conductance=0.7).select("x", "y", "z", "value"), step.shape)
    assert np.std(out[:2]) < np.std(noisy[:2]) and out[3:].mean() - out[:3].mean() > 9.5 and out.sum() == pytest.approx(noisy.sum())
    bowl = np.full((5, 5, 1), 5.0)
    bowl[1:4, 1:4, 0] = 1
    bowl[2, 0, 0] = 3
    want = np.full((5, 5, 1), 5.0)
    want[1:4, 1:4, 0] = 3
    want[2, 0, 0] = 3
    assert np.array_equal(cube(filters.filled(grid(spark, bowl)).select("x", "y", "z", "value"), bowl.shape), want)


def test_transforms(spark):
    v = np.random.default_rng(1).random((5, 4, 3))
    g = grid(spark, v)
    shift = filters.Affine(np.eye(3), (1, 0, 0))
    got = cube(filters.resampled(g, g, shift, nearest=True, outside=-1), v.shape)
    assert np.allclose(got[:4], v[1:]) and (got[4] == -1).all()
    turn = filters.Affine.similarity(1.0, (0, 0, 1), math.pi / 2)
    assert np.allclose(turn.matrix @ [1, 0, 0], [0, 1, 0]) and turn.determinant() == pytest.approx(1)
    assert np.allclose(turn.after(turn.inverse()).matrix, np.eye(3)) and np.allclose(filters.composed([shift, turn]).offset, [0, 1, 0]) and np.allclose(filters.composed([shift, shift], add=True).offset, [2, 0, 0])
    entries = filters.transform_parameters('// made\n(Transform "AffineTransform")\n(TransformParameters 1 0 0 0 1 0 0 0 1 2 3 4)\n(CenterOfRotationPoint 1 1 1)\n')
    assert np.allclose(filters.transform_of(entries).offset, [2, 3, 4])


def test_samples(spark):
    rows = spark.createDataFrame([(i, 1 + (i % 7 == 0)) for i in range(700)], "voxel_id long, label int")
    got = [tuple(r) for r in sampling.balanced(rows, "voxel_id").groupBy("label").count().orderBy("label").collect()]
    assert got == [(1, 100), (2, 100)]
    assert 40 < sampling.subset(rows, 10, "voxel_id").count() < 105 and sampling.with_replacement(rows, 200).count() > 1000
    series = spark.createDataFrame([(v, t, float(100 * v + t)) for v in range(2) for t in range(20)], "voxel_id long, t int, value double")
    out = sampling.block_bootstrap(series, 3).toPandas()
    assert len(out) == 120 and (out.groupby(["sample", "voxel_id"])["t"].nunique() == 20).all()
    a, b = (out[out.voxel_id == v].sort_values(["sample", "t"])["value"].to_numpy() for v in (0, 1))
    assert np.array_equal(b - a, np.full(60, 100.0))
    one, two = (spark.createDataFrame([(x,) for x in v], "label int") for v in ([1, 2, 3], [2, 3, 4]))
    assert {r[0] for r in sampling.shared_labels(one, two).collect()} == {2, 3} and {r[0] for r in sampling.labels_only_in(one, two).collect()} == {1}
    flags = spark.createDataFrame([(t, t in (3, 4)) for t in range(20)], "t int, outlier boolean")
    assert sampling.without_volumes(series, flags).count() == 36
    with pytest.raises(ValueError):
        perfusion.checked_range(1, 3, 2, 4, 0.5)
    assert perfusion.both_fits(spark.createDataFrame([(1, 1.0, 2.0)], "voxel_id long, k double, v double"), spark.createDataFrame([(1, 3.0, 4.0)], "voxel_id long, k double, v double")).first()["k"] == 2


def test_image_histograms_and_crops(spark):
    images = spark.createDataFrame([("a", 0.1), ("a", 0.9), ("b", 0.1), ("b", 0.15), ("b", 2.0)], "image_id string, value double")
    got = {r["bin"]: (r["mean"], r["sd"]) for r in aggregate.image_histograms(images, 2).collect()}
    assert got == {0: pytest.approx((0.75, 0.25)), 1: pytest.approx((0.25, 0.25))}
    rows = spark.createDataFrame([(n, x, 0, 0, float(x == k)) for n, k in (("a", 2), ("b", 0)) for x in range(4)], "image_id string, x int, y int, z int, value double")
    from pyspark.sql import functions as F

    assert {(r["image_id"], r["x"]) for r in aggregate.multi_crop(rows, "a", F.col("value") > 0).collect()} == {("a", 0), ("b", 0)}


# Formats


def test_formats(spark, tmp_path):
    v = np.arange(6, dtype=">f4").reshape(2, 3)
    (tmp_path / "slice002image001echo001.fdf").write_bytes(b"#!/fdf\nfloat bits = 32;\nfloat matrix[] = {3, 2};\nint bigendian = 1;\n\0" + v.tobytes())
    got = {(r["x"], r["y"], r["z"]): r["value"] for r in formats.read_fdf(spark, str(tmp_path / "slice002image001echo001.fdf")).collect()}
    assert got == {(x, y, 1): float(3 * y + x) for x in range(3) for y in range(2)}
    (tmp_path / "blk").mkdir()
    (tmp_path / "blk" / "m.hdr").write_text("2 3 2\n")
    (tmp_path / "blk" / "m.bfloat").write_bytes(np.arange(12).astype(">f4").tobytes())
    rows = formats.read_blocks(spark, str(tmp_path / "blk"))
    assert {(r["x"], r["y"], r["t"]): r["value"] for r in rows.collect()} == {(x, y, t): float(6 * t + 3 * y + x) for x in range(3) for y in range(2) for t in range(2)}
    assert {r["t"]: bytes(r["content"]) for r in formats.encode_blocks(rows).collect()}[1] == np.arange(6, 12).astype(">f4").tobytes()
    (tmp_path / "png").mkdir()
    for z in range(2):
        (tmp_path / "png" / f"{z}.png").write_bytes(formats.png_bytes(np.arange(6).reshape(2, 3) + 10 * z))
    assert {(r["x"], r["y"], r["z"]): r["value"] for r in formats.read_pictures(spark, str(tmp_path / "png")).collect()} == {(x, y, z): float(3 * y + x + 10 * z) for x in range(3) for y in range(2) for z in range(2)}
    assert formats.png_pixels(formats.stacked_pictures([np.ones((2, 3)), np.zeros((1, 3))])).tolist() == [[1] * 3, [1] * 3, [0] * 3]
    (tmp_path / "s.sva").write_text("# c\nDimensions:4,3,2\n0,1,1,7.5\n")
    assert {(r["x"], r["y"], r["z"], r["value"]) for r in formats.read_sparse(spark, str(tmp_path / "s.sva")).collect()} == {(0, 1, 0, 7.5), (0, 1, 3, 7.5)}
    (tmp_path / "e.txt").write_text("head 1,5\ndata: 1,5 2 3 4,25 5 6 7 8")
    rec = formats.read_recording(spark, str(tmp_path / "e.txt"), 2, 2)
    assert {r["block"]: r["line"] for r in formats.recording_lines(rec, 0, 0, 1).collect()} == {0: "1.5,3.0", 1: "5.0,7.0"}
    (tmp_path / "m.txt").write_text("1 2\n3 nan\n")
    m = formats.read_matrix(spark, str(tmp_path / "m.txt"))
    assert {r["i"]: r["line"] for r in formats.matrix_lines(m, ["a", "b"]).collect()} == {-1: "a,b", 0: "1.0,2.0", 1: "3.0,"}
    image = formats.matrix_voxels(m.filter("i = 0"))
    assert image.count() == 2 and {r["line"] for r in formats.index_lines(image.withColumn("voxel_id", image["y"])).collect()} == {"0,0,0", "0,1,0"}
    names = spark.createDataFrame([(1, "left side"), (2, None)], "label int, name string")
    assert [r[0] for r in names.select(formats.label_file("r", "nii")).collect()] == ["left_side.nii", "r_2.nii"]
    assert formats.table_lines(spark.createDataFrame([(1, [1.0, 2.0], 3)], "id long, features array<double>, label int")).first()["line"] == "1.0\t2.0\t3"
    values = spark.createDataFrame([(0, 5.0), (1, 6.0)], "i long, value double")
    mask = spark.createDataFrame([(0, 0.0), (1, 2.0), (2, 3.0)], "voxel_id long, value double")
    assert {r["voxel_id"]: r["value"] for r in formats.list_to_mask(values, mask).collect()} == {1: 5, 2: 6}
    nodes = spark.createDataFrame([(0, "a"), (1, "b")], "node long, name string")
    e = edges_of(spark, [(0, 1, 0.5)])
    assert [r["line"] for r in formats.graph_markup(e, nodes).orderBy("part", "place").collect()] == ["graph [", 'node [ id 0 label "a" ]', 'node [ id 1 label "b" ]', "edge [ source 0 target 1 value 0.5 ]", "]"]
    assert {r["line"] for r in formats.similarity_lines(e, nodes).collect()} == {"0 1 0.5", "1 0 0.5", "0 0 1.0", "1 1 1.0"}
    raw = formats.meta_image(np.arange(4.0).reshape(2, 2, 1))
    assert raw.endswith(np.array([0, 2, 1, 3], ">f4").tobytes()) and b"DimSize = 2 2 1" in raw
    from voxelweave.sources import files

    (tmp_path / "a.nii").write_bytes(files.encode_nifti(np.ones((2, 2, 2))))
    assert bytes(formats.converted(spark, str(tmp_path / "a.nii")).first()["content"]) == files.encode_nifti(np.ones((2, 2, 2)))
    lines = files.graph_lines(e, nodes).orderBy("part", "place").collect()
    assert [r["line"] for r in lines] == ["*Vertices 2", '1 "a"', '2 "b"', "*Edges", "1 2 0.5"]
    files.write_vector(values, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["5.0", "6.0"]
