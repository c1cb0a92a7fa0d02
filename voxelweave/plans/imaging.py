"""More queries of the library: reconstruction, diffusion, perfusion, filters, null models, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import functions as fx
from ..operators import aggregate, cluster, connectivity, diffusion, filters, fits, graph, kspace, neighbours, perfusion, power_law, pyramid, sampling, signal
from . import tables as tb
from .catalog import PARTS, _graph, query

PARTS |= {
    "v0": "v0 AS (SELECT voxel_id, voxel_id % 8 AS x, (voxel_id // 8) % 8 AS y, voxel_id // 64 AS z, value FROM s WHERE t = 0)",
    "m": "m AS (SELECT voxel_id, avg(value) AS v FROM s GROUP BY voxel_id)",
}


def volume(s, d):
    return tb.voxels(s, d).filter("t = 0").drop("t")


@query("label_set", "lab", "SELECT DISTINCT label FROM lab WHERE label >= 1")
def _(s, d):
    return aggregate.distinct_labels(tb.labels(s, d))


@query("unique_values", "", "SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL", "value")
def _(s, d):
    return aggregate.unique_values(tb.table(s, d, "lineitem").select(F.col("l_quantity").alias("value")))


@query("off_diagonal_peak", "e0 e", "SELECT src AS i, dst AS j, weight AS value FROM e ORDER BY weight DESC, src, dst LIMIT 1", "value")
def _(s, d):
    return aggregate.off_diagonal_peak(tb.edges(s, d).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("value")))


@query("extreme_rows", "s m", "SELECT (SELECT voxel_id FROM m ORDER BY v, voxel_id LIMIT 1) AS argmin, (SELECT min(v) FROM m) AS low, (SELECT voxel_id FROM m ORDER BY v DESC, voxel_id LIMIT 1) AS argmax, (SELECT max(v) FROM m) AS high", "low high")
def _(s, d):
    return aggregate.extreme_rows(tb.packed(s, d).select(F.col("voxel_id").alias("i"), F.col("series").alias("values")))


@query("list_histogram", "", "SELECT CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS density FROM (SELECT range - 1 AS bin FROM range(12)) b LEFT JOIN (SELECT CASE WHEN value < 10 THEN -1 WHEN value >= 60 THEN 10 ELSE floor((value - 10) / 5) END AS bin, count(*) AS n FROM events GROUP BY ALL) USING (bin)", "density")
def _(s, d):
    return aggregate.list_histogram(tb.table(s, d, "events").select("value"), 10, 10.0, 60.0)


def _scored(s, d):
    ref = (F.col("event_type") == "purchase").cast("int").alias("ref")
    return tb.table(s, d, "events").filter(F.col("value").between(0, 100)).select(ref, (F.col("value") / 100).alias("prob"))


@query("probabilistic_similarity", "", "SELECT 2 * sum(CASE WHEN event_type = 'purchase' THEN value / 100 ELSE 0 END) / (sum(value / 100) + count(*) FILTER (event_type = 'purchase')) AS similarity FROM events WHERE value BETWEEN 0 AND 100", "similarity")
def _(s, d):
    return aggregate.probabilistic_similarity(_scored(s, d))


@query("area_under_curve")
def _(s, d):
    return aggregate.area_under(aggregate.roc(_scored(s, d)))


@query("auto_cropped", "s v0", "SELECT voxel_id, x - lx AS x, y - ly AS y, z - lz AS z, value FROM v0, (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM v0 WHERE value > 0.25) WHERE x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz", "value")
def _(s, d):
    return aggregate.auto_crop(volume(s, d), 0.25)


@query("label_axes", "s v0 lab", "SELECT label, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM v0 JOIN lab USING (voxel_id) WHERE label >= 1 GROUP BY label", "xx xy xz yy yz zz")
def _(s, d):
    return aggregate.label_axes(volume(s, d).join(tb.labels(s, d), "voxel_id"))


@query("correlation_p_values", "s lab")
def _(s, d):
    r = connectivity.roi_correlation(tb.series(s, d), tb.labels(s, d))
    return r.select("i", "j", fx.correlation_p(fx.fisher_z(F.col("r")), 64).alias("p"))


# Signal


@query("regressed", "s", "SELECT voxel_id, t, value - m - a * (t - 31.5) AS value FROM s JOIN (SELECT voxel_id, avg(value) AS m, regr_slope(value, t) AS a FROM s GROUP BY voxel_id) USING (voxel_id)", "value")
def _(s, d):
    return signal.unpacked(signal.regressed(tb.packed(s, d), [[1.0, float(t)] for t in range(64)]).select("voxel_id", "series"))


@query("exact_bandpass")
def _(s, d):
    return signal.unpacked(signal.exact_bandpass(tb.packed(s, d), 0.05, 0.2, 1.0))


@query("resting_state")
def _(s, d):
    shifted = tb.series(s, d).withColumn("value", F.col("value") + 10)
    return signal.resting_state(shifted)


@query("cross_correlated", "s", "SELECT voxel_id, corr(value, w) AS r FROM s JOIN (SELECT t, value AS w FROM s WHERE voxel_id = 0) USING (t) GROUP BY voxel_id", "r")
def _(s, d):
    p = tb.packed(s, d)
    return signal.cross_correlation(p, p.filter("voxel_id = 0").first()["series"])


@query("circular_correlated", "s", "SELECT a.voxel_id, CAST(k AS INT) AS t, sum(a.value * b.value) AS value FROM s a, (SELECT t, value FROM s WHERE voxel_id = 0) b, (SELECT range AS k FROM range(64)) WHERE a.t = (b.t + k) % 64 GROUP BY ALL", "value")
def _(s, d):
    p = tb.packed(s, d)
    return signal.unpacked(signal.circular_correlation(p, p.filter("voxel_id = 0").first()["series"]))


@query("welch_tapered", "s", "SELECT voxel_id, t, value * (1 - pow(2 * t / 63 - 1, 2)) AS value FROM s", "value")
def _(s, d):
    return signal.unpacked(signal.tapered(tb.packed(s, d)))


@query("gamma_response")
def _(s, d):
    t = [k + 1e-3 for k in range(64)]
    shape = F.transform(F.array(*[F.lit(x) for x in t]), lambda x: 100 * F.exp(5 * F.log(x) - x / (1 + F.col("voxel_id") % 5 / 10) - 12))
    return signal.gamma_response(tb.packed(s, d).select("voxel_id", shape.alias("series")), 1.0).select("voxel_id", "time_to_peak", "top")


# Connectivity


@query("strong_correlations", "s", "SELECT * FROM (SELECT a.voxel_id AS i, b.voxel_id AS j, corr(a.value, b.value) AS value FROM s a JOIN s b ON a.t = b.t AND a.voxel_id < b.voxel_id GROUP BY ALL) WHERE abs(value) >= 0.35", "value")
def _(s, d):
    return connectivity.correlation_matrix(tb.packed(s, d), 0.35)


@query("inverse_correlation", "s lab", "SELECT i, j, CASE WHEN r >= 0 THEN 1 - r ELSE 1 END AS value FROM (SELECT a.label AS i, b.label AS j, corr(a.v, b.v) AS r FROM (SELECT label, t, avg(value) AS v FROM s JOIN lab USING (voxel_id) WHERE label >= 1 GROUP BY ALL) a JOIN (SELECT label, t, avg(value) AS v FROM s JOIN lab USING (voxel_id) WHERE label >= 1 GROUP BY ALL) b ON a.t = b.t AND a.label < b.label GROUP BY ALL)", "value")
def _(s, d):
    means = aggregate.roi_series(tb.series(s, d), tb.labels(s, d)).select(F.col("label").alias("voxel_id"), "t", F.col("mean").alias("value"))
    return connectivity.inverse_correlation(signal.packed(means))


@query("label_agreement", "s lab", "SELECT a.label AS i, b.label AS j, avg(CASE WHEN a.v = b.v THEN 1.0 ELSE 0.0 END) AS value FROM (SELECT label, t, CAST(avg(value) > 0 AS INT) AS v FROM s JOIN lab USING (voxel_id) GROUP BY ALL) a JOIN (SELECT label, t, CAST(avg(value) > 0 AS INT) AS v FROM s JOIN lab USING (voxel_id) GROUP BY ALL) b ON a.t = b.t AND a.label < b.label GROUP BY ALL", "value")
def _(s, d):
    signs = tb.series(s, d).join(tb.labels(s, d), "voxel_id").groupBy(F.col("label").alias("voxel_id"), "t").agg((F.avg("value") > 0).cast("double").alias("value"))
    return connectivity.label_agreement(signal.packed(signs))


@query("seed_maps", "s lab", "SELECT label, voxel_id, corr(seed, value) AS r FROM s JOIN (SELECT label, t, avg(value) AS seed FROM s JOIN lab USING (voxel_id) WHERE label >= 1 GROUP BY ALL) USING (t) GROUP BY ALL", "r")
def _(s, d):
    means = aggregate.roi_series(tb.series(s, d), tb.labels(s, d)).select(F.col("label").alias("voxel_id"), "t", F.col("mean").alias("value"))
    return connectivity.seed_maps(tb.packed(s, d), signal.packed(means).withColumnRenamed("voxel_id", "label"))


@query("principal_signals")
def _(s, d):
    return connectivity.principal_signal(tb.series(s, d), tb.labels(s, d))


@query("series_eigenvalues")
def _(s, d):
    return connectivity.series_components(tb.packed(s, d), share=0.5)[0]


@query("visibility_by_label")
def _(s, d):
    return connectivity.visibility_by_label(tb.series(s, d), tb.labels(s, d))


@query("coherency_of_labels")
def _(s, d):
    means = aggregate.roi_series(tb.series(s, d), tb.labels(s, d)).select(F.col("label").alias("voxel_id"), "t", F.col("mean").alias("value"))
    return connectivity.coherency(signal.packed(means))


# Graphs


@query("normalised_laplacian", "e0 e all", "SELECT a.src AS i, a.dst AS j, -a.weight / sqrt(x.s * y.s) AS value FROM two a JOIN (SELECT src, sum(weight) AS s FROM two GROUP BY src) x ON x.src = a.src JOIN (SELECT src, sum(weight) AS s FROM two GROUP BY src) y ON y.src = a.dst UNION ALL SELECT DISTINCT src, src, 1.0 FROM two", "value")
def _(s, d):
    return graph.laplacian(tb.edges(s, d), normalised=True)


@query("strength_z_scores", "e0 e all", "SELECT node, degree, strength, CASE WHEN sd > 0 THEN (strength - m) / sd ELSE 0 END AS z FROM (SELECT *, avg(strength) OVER () AS m, stddev_pop(strength) OVER () AS sd FROM (SELECT s_suppkey AS node, coalesce(degree, 0) AS degree, coalesce(strength, 0) AS strength FROM supplier LEFT JOIN (SELECT src, count(*) AS degree, sum(weight) AS strength FROM two GROUP BY src) ON src = s_suppkey))", "strength z")
def _(s, d):
    nodes = tb.table(s, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return graph.standardised(graph.node_strengths(tb.edges(s, d), nodes), "strength")


@query("clustering_directed", "e0 e g two", "SELECT node, CASE WHEN coalesce(t, 0) = 0 THEN 0 ELSE t / (k * (k - 1)) END AS clustering FROM (SELECT src AS node, count(*) AS k FROM two GROUP BY ALL) LEFT JOIN (SELECT a.src AS node, sum(cbrt(a.weight) * cbrt(b.weight) * cbrt(g.weight)) AS t FROM two a JOIN two b ON a.src = b.src AND a.dst < b.dst JOIN g ON g.src = a.dst AND g.dst = b.dst GROUP BY ALL) USING (node)", "clustering")
def _(s, d):
    return graph.clustering_directed(_graph(s, d))


@query("strength_threshold")
def _(s, d):
    e = graph.cut(tb.edges(s, d))
    mean = graph.degree(e).agg(F.avg("strength")).first()[0]
    return graph.threshold_at_strength(e, mean / 2)


@query("path_efficiency")
def _(s, d):
    e = graph.cut(tb.edges(s, d))
    return graph.harmonic_path_length(graph.shortest_paths(e, graph.degree(e).select("node")))


@query("power_law_fit")
def _(s, d):
    return power_law.power_law(tb.table(s, d, "lineitem").select(F.col("l_quantity").alias("value")))


@query("power_law_prices")
def _(s, d):
    return power_law.power_law(tb.table(s, d, "orders").select(F.col("o_totalprice").alias("value")))


@query("power_law_bootstrap")
def _(s, d):
    return power_law.power_law_bootstrap(tb.table(s, d, "lineitem").select(F.col("l_quantity").alias("value")))


# Clusters


@query("voxel_classes", "", "SELECT id, min_by(label, (-n, label)) AS label FROM (SELECT id, label, count(*) AS n FROM (SELECT a.vec_id AS id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))), b.vec_id) AS k FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE k <= 7 GROUP BY ALL) GROUP BY id")
def _(s, d):
    f = tb.features(s, d)
    return cluster.classify(neighbours.knn(f, f.filter("id % 100 = 0"), 7)).select("id", "label")


@query("within_radius", "", "SELECT a.vec_id AS id, b.vec_id AS near FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))) <= 0.81")
def _(s, d):
    f = tb.features(s, d)
    return neighbours.within_radius(f, f.filter("id % 100 = 0"), 0.9).select("id", "near")


@query("isodata_clusters")
def _(s, d):
    return cluster.isodata(tb.features(s, d), 6, split=0.2, lump=0.2, rounds=6)[0]


@query("training_table", "s vox lab", "SELECT voxel_id AS id, label, count(*) AS n FROM vox JOIN lab USING (voxel_id) WHERE t < 3 GROUP BY ALL")
def _(s, d):
    images = tb.voxels(s, d).filter("t < 3").withColumnRenamed("t", "image_id")
    return cluster.train_table(images, tb.labels(s, d), geometry=False).select("id", "label", F.size("features").cast("long").alias("n"))


# Samples and sets


@query("balanced_labels", "lab", "SELECT label, (SELECT min(n) FROM (SELECT count(*) AS n FROM lab GROUP BY label)) AS n FROM lab GROUP BY label")
def _(s, d):
    return sampling.balanced(tb.labels(s, d), "voxel_id").groupBy("label").agg(F.count("*").alias("n"))


@query("concatenated_series", "s", "SELECT voxel_id, t, value FROM s UNION ALL SELECT voxel_id, t + 64, value FROM s", "value")
def _(s, d):
    v = tb.series(s, d)
    return sampling.concatenated([v, v])


@query("block_bootstrap")
def _(s, d):
    return sampling.block_bootstrap(tb.series(s, d), 2).groupBy("sample", "voxel_id").agg(F.count("*").alias("n"))


# Perfusion


@query("concentration", "s", "SELECT voxel_id, t - 1 AS t, (value - r0) / 4.5 AS value FROM s JOIN (SELECT voxel_id, value AS r0 FROM s WHERE t = 0) USING (voxel_id) WHERE t > 0", "value")
def _(s, d):
    return perfusion.concentration(tb.series(s, d), 4.5)


@query("vascular_input", "s lab", "SELECT t, avg(value) / 0.6 AS cp FROM s JOIN lab USING (voxel_id) WHERE label = 3 GROUP BY t", "cp")
def _(s, d):
    return perfusion.vascular_input(tb.series(s, d), tb.labels(s, d).select("voxel_id", (F.col("label") == 3).cast("int").alias("m")), 0.4)


ICHISE = """SELECT voxel_id, det / (vc * ii - ic * iv) AS k, -(ic * vv - vc * iv) / (vc * ii - ic * iv) AS v FROM (SELECT *, ii * vv - iv * iv AS det FROM (SELECT voxel_id, sum(i * i) AS ii, sum(i * v) AS iv, sum(v * v) AS vv, sum(i * cp) AS ic, sum(v * cp) AS vc
FROM (SELECT voxel_id, t, value + 2 AS v FROM s) JOIN (SELECT t, cp, 1.5 * coalesce(sum(cp) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM (SELECT t, avg(value) + 1 AS cp FROM s GROUP BY t)) USING (t) GROUP BY voxel_id))"""


@query("ichise_fit", "s", ICHISE, "k v")
def _(s, d):
    v = tb.series(s, d)
    cp = v.groupBy("t").agg((F.avg("value") + 1).alias("cp"))
    return perfusion.ichise(v.withColumn("value", F.col("value") + 2), cp, 1.5)


@query("relative_volume", "s", "SELECT voxel_id, t, greatest(ln((value + 2) / s0) / ln(s0 / pre) * 100 + 100, 0) AS value FROM s JOIN (SELECT voxel_id, avg(value + 2) FILTER (t BETWEEN 0 AND 7) AS pre, avg(value + 2) FILTER (t BETWEEN 8 AND 15) AS s0 FROM s GROUP BY voxel_id) USING (voxel_id)", "value")
def _(s, d):
    v = tb.series(s, d).withColumn("value", F.col("value") + 2)
    return perfusion.relative_volume(v, (0, 7), (8, 15))


# Relaxometry on stored values, with a level added


@query("t2_of_stored_values")
def _(s, d):
    noisy = F.transform("series", lambda v, i: 100 * F.exp(-0.02 * i * (1 + F.col("voxel_id") % 7)) + v)
    return fits.t2_nonlinear(tb.packed(s, d).select("voxel_id", noisy.alias("series")), [0.01 * k for k in range(64)], constant=True)


@query("look_locker_fit")
def _(s, d):
    made = F.transform("series", lambda v, i: 100 * (1 - 1.8 * F.exp(-(i + 1) * 0.05 * (1 + F.col("voxel_id") % 5))) + v)
    return fits.t1_fit(tb.packed(s, d).select("voxel_id", made.alias("series")), [0.05 * k for k in range(1, 65)], "look_locker")


@query("look_locker_times", "", "SELECT CAST(s AS INT) AS slice, CAST(k AS INT) AS k, 0.1 + (p + k * 4) * 0.02 AS t FROM (VALUES (0, 0), (1, 2), (2, 1), (3, 3)) v(s, p), (SELECT range AS k FROM range(8))", "t")
def _(s, d):
    return fits.look_locker_times(s, 0.1, 0.02, 4, 8, [0, 2, 1, 3])


# Diffusion


def gradients(n: int = 30) -> list[tuple[float, float, float, float]]:
    at = diffusion.directions(n)
    return [(0.0, 0.0, 0.0, 0.0)] * 2 + [(b, *v) for b in (1000.0, 2000.0) for v in at.tolist()]


def diffused(s, d):
    """Signals of a tensor along an axis that turns with the voxel, with a little of the stored values."""
    g = gradients()
    turn = F.col("voxel_id") % 12 * 0.5
    along = [F.cos(turn) * x + F.sin(turn) * y for _, x, y, _ in g]
    rate = [b * (3e-4 + 1.2e-3 * c * c) for (b, *_), c in zip(g, along, strict=True)]
    noise = [1 + 0.01 * F.element_at("series", k % 64 + 1) for k in range(len(g))]
    return tb.packed(s, d).select("voxel_id", F.array(*[1000 * F.exp(-r) * n for r, n in zip(rate, noise, strict=True)]).alias("series"))


@query("tensor_maps")
def _(s, d):
    return fits.tensor_fit(diffused(s, d), gradients())


@query("constrained_tensor")
def _(s, d):
    return diffusion.constrained_tensor(diffused(s, d), gradients()).select("voxel_id", "fa", "trace", "l3")


@query("kurtosis_maps")
def _(s, d):
    return diffusion.kurtosis_fit(diffused(s, d), gradients()).select("voxel_id", *diffusion.KURTOSIS)


# Filters


@query("smoothed_volume")
def _(s, d):
    return filters.gaussian(volume(s, d), 3.0)


@query("distance_to_centre", "s v0", "SELECT x, y, z, sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow((z - cz) * 2, 2)) AS distance FROM v0, (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM v0 WHERE value > 0) WHERE value > 0", "distance")
def _(s, d):
    mask = volume(s, d).withColumn("value", (F.col("value") > 0).cast("int"))
    return filters.distance_to_centre(mask, (1.0, 1.0, 2.0))


@query("distance_map", "s v0", "SELECT a.x, a.y, a.z, CASE WHEN a.value > 0.1 THEN -1 ELSE 1 END * sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS distance FROM v0 a JOIN v0 b ON (a.value > 0.1) <> (b.value > 0.1) GROUP BY a.x, a.y, a.z, a.value", "distance")
def _(s, d):
    return filters.distance_map(volume(s, d).withColumn("value", (F.col("value") > 0.1).cast("int")))


@query("border_sweep")
def _(s, d):
    v = volume(s, d)
    return filters.border_distance(v.withColumn("value", (F.col("value") > 0.1).cast("int")), v.withColumn("value", F.least(F.greatest(F.col("value") * 2 + 0.4, F.lit(0.0)), F.lit(0.999))))


@query("halved_volume")
def _(s, d):
    return pyramid.halved(volume(s, d))


@query("resampled_volume", "s v0", "SELECT g.x, g.y, g.z, coalesce((a.value + b.value) / 2, 0) AS value FROM v0 g LEFT JOIN v0 a ON a.x = g.x AND a.y = g.y AND a.z = g.z LEFT JOIN v0 b ON b.x = g.x + 1 AND b.y = g.y AND b.z = g.z", "value")
def _(s, d):
    v = volume(s, d)
    return filters.resampled(v, v, filters.Affine(np.eye(3), (0.5, 0.0, 0.0)))


@query("deformation_field", "s v0", "SELECT x, y, z, 1.1 * x + 2 AS mx, 0.9 * y - 1 AS my, z * 1.0 AS mz, 0.1 * x + 2 AS dx, -0.1 * y - 1 AS dy, 0.0 * z AS dz, 1.1 * 0.9 AS jacobian FROM v0", "mx my mz dx dy dz jacobian")
def _(s, d):
    return filters.deformation(volume(s, d), filters.Affine(np.diag([1.1, 0.9, 1.0]), (2.0, -1.0, 0.0)))


# Reconstruction of traces made from the stored series: a voxel is a trace of 32 complex samples


def traces(s, d):
    odd = lambda k: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.element_at("series", (2 * i + 1 + k).cast("int")).cast("float"))
    return tb.packed(s, d).select(
        F.lit("made").alias("file"), F.floor(F.col("voxel_id") / 64).cast("int").alias("block"), (F.col("voxel_id") % 64).cast("int").alias("trace"), odd(0).alias("re"), odd(1).alias("im")
    )


@query("gradient_echo")
def _(s, d):
    return kspace.gradient_echo(traces(s, d), 4, [0.3, 0.1, 0.2, 0.0])


@query("spin_echo")
def _(s, d):
    return kspace.spin_echo(traces(s, d), 4, 4, [k * 4 + e for e in range(4) for k in range(4)], [0.3, 0.1, 0.2, 0.0])


@query("multi_echo")
def _(s, d):
    return kspace.multi_echo(traces(s, d), 4, 2, [0.0, 0.1, 0.2, 0.3])


@query("look_locker_maps")
def _(s, d):
    return fits.look_locker_maps(kspace.look_locker(traces(s, d), 4, 4, [0.3, 0.1, 0.2, 0.0]), 4, 0.05, 0.1)


@query("echo_planar")
def _(s, d):
    lines = kspace.lines_of(traces(s, d), F.col("block"), F.col("trace"))
    return kspace.echo_planar(lines, kspace.phase_maps(lines.filter("image = 0")))
