"""All queries of the library by name, with SQL of equal results where SQL can express them.

Floating-point results are rounded to DIGITS on both sides, because sums depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fx
from ..operators import aggregate, cluster, connectivity, fits, geometry, graph, neighbours, signal
from . import tables as tb

DIGITS = 6
FLAGSHIP = "roi_series"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PARTS = {
    "s": "s AS (SELECT vec_id AS voxel_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INT) AS t, unnest(embedding)::DOUBLE AS value FROM embeddings)",
    "lab": "lab AS (SELECT vec_id AS voxel_id, label FROM embeddings)",
    "vox": "vox AS (SELECT voxel_id, voxel_id % 8 AS x, (voxel_id // 8) % 8 AS y, voxel_id // 64 AS z, t, value FROM s)",
    "e0": "e0 AS (SELECT DISTINCT l_orderkey, l_suppkey AS src FROM lineitem)",
    "e": "e AS (SELECT a.src, b.src AS dst, count(*)::DOUBLE AS weight FROM e0 a JOIN e0 b USING (l_orderkey) WHERE a.src < b.src GROUP BY ALL)",
    "g": "g AS (SELECT * FROM e WHERE weight >= (SELECT quantile_disc(weight, 0.75) FROM e))",
    "two": "two AS (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g)",
    "all": "two AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)",
    "decay": "decay AS (SELECT l_orderkey AS voxel_id, l_linenumber::DOUBLE AS t, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)",
}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, DIGITS) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, parts: str = "", sql: str | None = None, doubles: str = "") -> Callable:
    """Registers a query; ``parts`` names shared subqueries and ``doubles`` the columns to round."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql is not None:
            head = ", ".join(PARTS[p] for p in parts.split())
            replaced = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            body = f"SELECT * {f'REPLACE ({replaced})' if replaced else ''} FROM ({sql})"
            ORACLE_SQL[name] = (f"WITH {head} " if head else "") + body
        return f

    return add


@query("voxel_count", "", "SELECT count(*) AS n, sum(l_quantity) AS total, avg(l_quantity) AS mean FROM lineitem WHERE l_quantity >= 10", "total mean")
def _(s, d):
    return aggregate.voxel_count(tb.table(s, d, "lineitem").select(F.col("l_quantity").alias("value")), 10.0)


@query("masked_mean", "s lab", "SELECT count(*) AS n, avg(value) AS mean FROM s JOIN lab USING (voxel_id) WHERE label > 0 AND value BETWEEN -0.2 AND 0.2", "mean")
def _(s, d):
    mask = tb.labels(s, d).select("voxel_id", (F.col("label") > 0).cast("int").alias("m"))
    return aggregate.masked_mean(tb.series(s, d), mask, -0.2, 0.2)


ROI = "SELECT label, t, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM s JOIN lab USING (voxel_id) WHERE label >= 1 GROUP BY ALL"


@query("roi_series", "s lab", ROI, "mean sd")
def _(s, d):
    return aggregate.roi_series(tb.series(s, d), tb.labels(s, d))


@query("global_signal", "s", "SELECT t, avg(value) AS mean FROM s GROUP BY t", "mean")
def _(s, d):
    return aggregate.global_signal(tb.series(s, d))


@query("vector_stats", "", "SELECT count(*) AS n, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS sd, median(o_totalprice) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders", "mean sd median low high")
def _(s, d):
    return aggregate.vector_stats(tb.table(s, d, "orders").select(F.col("o_totalprice").alias("value")))


@query("peak_per_volume", "s", "SELECT t, voxel_id, value FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY value DESC, voxel_id) AS k FROM s) WHERE k = 1", "value")
def _(s, d):
    return aggregate.peak_per_volume(tb.series(s, d)).select("t", "voxel_id", "value")


@query("centre_of_gravity", "s vox", "SELECT t, sum(value * value * x) / sum(value * value) AS cx, sum(value * value * y) / sum(value * value) AS cy, sum(value * value * z) / sum(value * value) AS cz FROM vox GROUP BY t", "cx cy cz")
def _(s, d):
    return aggregate.centre_of_gravity(tb.voxels(s, d).withColumn("value", F.col("value") * F.col("value")), ["t"])


@query("motion_outliers")
def _(s, d):
    return aggregate.motion_outliers(aggregate.centre_of_gravity(tb.voxels(s, d).withColumn("value", F.col("value") * F.col("value")), ["t"]))


def _votes(s, d):
    kinds = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    return tb.table(s, d, "events").select("user_id", kinds.alias("label"))


KINDS = "SELECT user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS label FROM events"


@query("majority_vote", "", f"SELECT user_id, coalesce(max(label) FILTER (k = 1), 0) AS label FROM (SELECT user_id, label, row_number() OVER (PARTITION BY user_id ORDER BY label = 0, n DESC, label) AS k FROM (SELECT user_id, label, count(*) AS n FROM ({KINDS}) GROUP BY ALL)) GROUP BY user_id")
def _(s, d):
    return aggregate.majority_vote(_votes(s, d), ["user_id"])


@query("label_entropy", "", f"SELECT user_id, coalesce(-sum(CASE WHEN label >= 1 THEN n / total * ln(n / total) END), 0) AS entropy FROM (SELECT user_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total FROM ({KINDS}) GROUP BY user_id, label) GROUP BY user_id", "entropy")
def _(s, d):
    return aggregate.entropy(_votes(s, d), ["user_id"])


@query("value_histogram", "", "SELECT bin, bin * 1.0 AS lower, n, n / sum(n) OVER () AS share, sum(n) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(n) OVER () AS survival FROM (SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT CAST(range AS INT) AS bin FROM range(100)) b LEFT JOIN (SELECT least(floor(value), 99)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL) USING (bin))", "lower share survival")
def _(s, d):
    return aggregate.histogram(tb.table(s, d, "events").select("value"), 100, 0.0, 100.0)


@query("median_normalised", "", "SELECT o_orderkey, o_totalprice * 1000 / (SELECT quantile_disc(o_totalprice, 0.5) FROM orders) AS value FROM orders", "value")
def _(s, d):
    return aggregate.median_normalised(tb.table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value")))


@query("iqr_bounds", "", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) - 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS low, quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS high FROM lineitem GROUP BY ALL", "low high")
def _(s, d):
    return aggregate.iqr_bounds(tb.table(s, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("value")), ["l_returnflag"])


@query("median_deviation", "", "SELECT c_mktsegment, median(c_acctbal) AS median, mad(c_acctbal) AS mad FROM customer GROUP BY ALL", "median mad")
def _(s, d):
    return aggregate.median_deviation(tb.table(s, d, "customer").select("c_mktsegment", F.col("c_acctbal").alias("value")), ["c_mktsegment"])


@query("segmentation_overlap", "", "SELECT tp, tn, fp, fn, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity, 2 * tp / (2 * tp + fp + fn) AS dice FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels)", "sensitivity specificity dice")
def _(s, d):
    return aggregate.overlap(tb.outcomes(s, d))


@query("roc_sweep", "", "SELECT k / 100 AS threshold, count(*) FILTER (r = 1 AND b >= k) / count(*) FILTER (r = 1) AS tpr, count(*) FILTER (r = 0 AND b >= k) / count(*) FILTER (r = 0) AS fpr, 2 * count(*) FILTER (r = 1 AND b >= k) / (count(*) FILTER (b >= k) + count(*) FILTER (r = 1)) AS dice FROM (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS r, least(floor(value / 100 * 100 + 1e-9), 99) AS b FROM events WHERE value BETWEEN 0 AND 100), (SELECT range AS k FROM range(100)) GROUP BY k", "threshold tpr fpr dice")
def _(s, d):
    ref = (F.col("event_type") == "purchase").cast("int").alias("ref")
    return aggregate.roc(tb.table(s, d, "events").filter(F.col("value").between(0, 100)).select(ref, (F.col("value") / 100).alias("prob")))


@query("label_geometry", "s vox lab", "SELECT label, count(*) AS volume, avg(x) AS mean_x, min(x) AS min_x, max(x) AS max_x, avg(y) AS mean_y, min(y) AS min_y, max(y) AS max_y, avg(z) AS mean_z, min(z) AS min_z, max(z) AS max_z FROM vox JOIN lab USING (voxel_id) WHERE t = 0 AND label >= 1 GROUP BY label", "mean_x mean_y mean_z")
def _(s, d):
    return aggregate.label_geometry(tb.voxels(s, d).filter("t = 0").join(tb.labels(s, d), "voxel_id"))


@query("bounding_box_crop", "s vox", "SELECT voxel_id, x - lx AS x, y - ly AS y, z - lz AS z, value FROM vox, (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM vox WHERE t = 0 AND value > 0.3) WHERE t = 0 AND x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz", "value")
def _(s, d):
    return aggregate.bounding_box_crop(tb.voxels(s, d).filter("t = 0").drop("t"), F.col("value") > 0.3)


@query("circular_shift", "s vox", "SELECT voxel_id, (x - 3 + 8) % 8 AS x, y, z, value FROM vox WHERE t = 0", "value")
def _(s, d):
    return tb.voxels(s, d).filter("t = 0").select("voxel_id", fx.shifted(F.col("x"), 3, 8).alias("x"), "y", "z", "value")


@query("checkerboard", "s vox", "SELECT a.voxel_id, CASE WHEN (a.x // 2 + a.y // 2) % 2 = 0 THEN a.value ELSE b.value END AS value FROM vox a JOIN vox b USING (voxel_id) WHERE a.t = 0 AND b.t = 1", "value")
def _(s, d):
    v = tb.voxels(s, d)
    other = v.filter("t = 1").select("voxel_id", F.col("value").alias("b"))
    field = fx.chequered(F.col("x"), F.col("y"), 2, 2)
    return v.filter("t = 0").join(other, "voxel_id").select("voxel_id", F.when(field == 0, F.col("value")).otherwise(F.col("b")).alias("value"))


@query("rescaled_intensity", "s", "SELECT voxel_id, t, CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) * 100 END AS value FROM s JOIN (SELECT t, min(value) AS lo, max(value) AS hi FROM s GROUP BY t) USING (t)", "value")
def _(s, d):
    v = tb.series(s, d)
    limits = v.groupBy("t").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return v.join(limits, "t").select("voxel_id", "t", fx.rescaled(F.col("value"), F.col("lo"), F.col("hi")).alias("value"))


@query("detrended", "s", "SELECT voxel_id, t, value - a * t - b AS value FROM s JOIN (SELECT voxel_id, regr_slope(value, t) AS a, regr_intercept(value, t) AS b FROM s GROUP BY voxel_id) USING (voxel_id)", "value")
def _(s, d):
    return signal.detrend(tb.series(s, d))


@query("global_regressed", "s", "SELECT voxel_id, t, value - beta * g AS value FROM s JOIN (SELECT t, avg(value) AS g FROM s GROUP BY t) USING (t) JOIN (SELECT voxel_id, sum(value * g) / sum(g * g) AS beta FROM s JOIN (SELECT t, avg(value) AS g FROM s GROUP BY t) USING (t) GROUP BY voxel_id) USING (voxel_id)", "value")
def _(s, d):
    return signal.global_regress(tb.series(s, d))


@query("global_mean_removed", "s", "SELECT voxel_id, t, value - avg(value) OVER (PARTITION BY t) AS value FROM s", "value")
def _(s, d):
    return signal.remove_global_mean(tb.series(s, d))


@query("cumulative_sum", "s", "SELECT voxel_id, t, sum(value) OVER (PARTITION BY voxel_id ORDER BY t) AS value FROM s", "value")
def _(s, d):
    return signal.cumulative_sum(tb.series(s, d))


@query("suffix_sum", "s", "SELECT voxel_id, t, sum(value) OVER (PARTITION BY voxel_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM s", "value")
def _(s, d):
    return signal.cumulative_sum(tb.series(s, d), suffix=True)


@query("riemann_integral", "s", "SELECT voxel_id, t, 2.5 * coalesce(sum(value) OVER (PARTITION BY voxel_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS value FROM s", "value")
def _(s, d):
    return signal.riemann_integral(tb.series(s, d), 2.5)


@query("three_point_smoothed", "s", "SELECT voxel_id, t, coalesce((lag(value) OVER w + 4 * value + lead(value) OVER w) / 6, value) AS value FROM s WINDOW w AS (PARTITION BY voxel_id ORDER BY t)", "value")
def _(s, d):
    return signal.smooth3(tb.series(s, d))


@query("stimulus_onsets", "s", "SELECT voxel_id, t, CAST(row_number() OVER (PARTITION BY voxel_id ORDER BY t) AS INT) AS block FROM (SELECT *, coalesce(lag(value) OVER (PARTITION BY voxel_id ORDER BY t), 0) AS before FROM s) WHERE value > 0 AND before <= 0")
def _(s, d):
    return signal.onsets(tb.series(s, d))


@query("magnitude_spectrum", "s", "SELECT voxel_id, CAST(k AS INT) AS k, sqrt(pow(sum(value * cos(2 * pi() * k * t / 64)), 2) + pow(sum(value * sin(2 * pi() * k * t / 64)), 2)) AS value FROM s, (SELECT range AS k FROM range(33)) GROUP BY ALL", "value")
def _(s, d):
    return signal.unpacked(signal.spectrum(tb.packed(s, d))).withColumnRenamed("t", "k")


@query("bandpass_filtered")
def _(s, d):
    return signal.unpacked(signal.bandpass(tb.packed(s, d), 0.05, 0.2, 1.0))


@query("fluctuation_exponent")
def _(s, d):
    return signal.dfa(tb.packed(s, d))


CORR = "SELECT a.voxel_id AS i, b.voxel_id AS j, corr(a.value, b.value) AS value FROM s a JOIN s b ON a.t = b.t AND a.voxel_id < b.voxel_id GROUP BY ALL"


@query("correlation_matrix", "s", CORR, "value")
def _(s, d):
    return connectivity.correlation_matrix(tb.packed(s, d))


@query("distance_matrix", "s", "SELECT a.voxel_id AS i, b.voxel_id AS j, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS value FROM s a JOIN s b ON a.t = b.t AND a.voxel_id < b.voxel_id GROUP BY ALL", "value")
def _(s, d):
    return connectivity.distance_matrix(tb.packed(s, d))


@query("seed_map", "s lab", "SELECT label, voxel_id, corr(seed, value) AS r FROM s JOIN (SELECT label, t, avg(value) AS seed FROM s JOIN lab USING (voxel_id) WHERE label >= 1 GROUP BY ALL) USING (t) GROUP BY ALL", "r")
def _(s, d):
    return connectivity.seed_map(tb.series(s, d), tb.labels(s, d))


@query("roi_correlation_z", "s lab", "SELECT i, j, r, 0.5 * ln((1 + r) / (1 - r)) AS z FROM (SELECT a.label AS i, b.label AS j, corr(a.v, b.v) AS r FROM (SELECT label, t, avg(value) AS v FROM s JOIN lab USING (voxel_id) WHERE label >= 1 GROUP BY ALL) a JOIN (SELECT label, t, avg(value) AS v FROM s JOIN lab USING (voxel_id) WHERE label >= 1 GROUP BY ALL) b ON a.t = b.t AND a.label < b.label GROUP BY ALL)", "r z")
def _(s, d):
    return connectivity.roi_correlation(tb.series(s, d), tb.labels(s, d)).withColumn("z", fx.fisher_z(F.col("r")))


@query("phase_coherence")
def _(s, d):
    return connectivity.phase_coherence(signal.analytic_phase(tb.packed(s, d)))


@query("visibility_graph", "s", "SELECT a.voxel_id, a.t AS i, b.t AS j, abs((b.value - a.value) / (b.t - a.t)) AS weight FROM s a JOIN s b ON a.voxel_id = b.voxel_id AND a.t < b.t WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.voxel_id = a.voxel_id AND c.t > a.t AND c.t < b.t AND (c.value - a.value) / (c.t - a.t) >= (b.value - a.value) / (b.t - a.t))", "weight")
def _(s, d):
    return connectivity.visibility_graph(tb.packed(s, d))


def _graph(s, d):
    """The supplier graph's edges from the upper quartile of weights on: a share of it at every scale."""
    e = tb.edges(s, d)
    middle = e.agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY weight)").alias("m"))  # one row
    return e.crossJoin(F.broadcast(middle)).filter("weight >= m").drop("m")


@query("edge_table", "e0 e g", "SELECT src, dst, weight FROM g", "weight")
def _(s, d):
    return _graph(s, d)


@query("node_degree", "e0 e all", "SELECT src AS node, count(*) AS degree, sum(weight) AS strength FROM two GROUP BY ALL", "strength")
def _(s, d):
    return graph.degree(tb.edges(s, d))


CLUSTERING = "SELECT node, 2 * coalesce(links, 0) / (k * (k - 1)) AS clustering FROM (SELECT src AS node, count(*) AS k FROM two GROUP BY ALL HAVING count(*) > 1) LEFT JOIN (SELECT a.src AS node, count(*) AS links FROM two a JOIN two b ON a.src = b.src AND a.dst < b.dst JOIN g ON g.src = a.dst AND g.dst = b.dst GROUP BY ALL) USING (node)"


@query("clustering_coefficient", "e0 e g two", CLUSTERING, "clustering")
def _(s, d):
    return graph.clustering_binary(_graph(s, d))


@query("clustering_weighted", "e0 e g two", "SELECT node, coalesce(c, 0) / p AS clustering FROM (SELECT a.src AS node, sum(a.weight * b.weight) AS p FROM two a JOIN two b ON a.src = b.src AND a.dst < b.dst GROUP BY ALL) LEFT JOIN (SELECT a.src AS node, sum(a.weight * b.weight * g.weight) AS c FROM two a JOIN two b ON a.src = b.src AND a.dst < b.dst JOIN g ON g.src = a.dst AND g.dst = b.dst GROUP BY ALL) USING (node)", "clustering")
def _(s, d):
    return graph.clustering_weighted(_graph(s, d))


@query("graph_laplacian", "e0 e all", "SELECT src AS i, dst AS j, -weight AS value FROM two UNION ALL SELECT src, src, sum(weight) FROM two GROUP BY src", "value")
def _(s, d):
    return graph.laplacian(tb.edges(s, d))


@query("modularity", "e0 e all", "SELECT sum(inner_w) / sum(w) - sum(w * w) / (sum(w) * sum(w)) AS q FROM (SELECT a.s_nationkey, sum(weight) AS w, sum(CASE WHEN a.s_nationkey = b.s_nationkey THEN weight ELSE 0 END) AS inner_w FROM two JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst GROUP BY ALL)", "q")
def _(s, d):
    clusters = tb.table(s, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("cluster"))
    return graph.modularity(tb.edges(s, d), clusters)


@query("hierarchy_slope", "e0 e g two", f"SELECT regr_slope(ln(strength), ln(clustering)) AS beta, count(*) AS n FROM ({CLUSTERING}) JOIN (SELECT src AS node, sum(weight) AS strength FROM two GROUP BY ALL) USING (node) WHERE clustering > 0", "beta")
def _(s, d):
    return graph.hierarchy(_graph(s, d))


@query("power_law_alpha", "", "SELECT 1 + count(*) / sum(ln(o_totalprice / 1000)) AS alpha, count(*) AS n FROM orders WHERE o_totalprice >= 1000", "alpha")
def _(s, d):
    return graph.power_law_alpha(tb.table(s, d, "orders").select(F.col("o_totalprice").alias("value")), 1000.0)


@query("nearest_neighbours", "", "SELECT id, CAST(k AS INT) AS rank, near, label FROM (SELECT a.vec_id AS id, b.vec_id AS near, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))), b.vec_id) AS k FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id) WHERE k <= 5")
def _(s, d):
    f = tb.features(s, d)
    found = neighbours.knn(f, f.filter("id % 100 = 0"), 6).filter("id <> near")
    first = Window.partitionBy("id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(first)).filter("rank <= 5").select("id", "rank", "near", "label")


@query("kmeans_clusters")
def _(s, d):
    return cluster.kmeans(tb.features(s, d), 5)[0]


@query("feature_z_scores", "s", "SELECT voxel_id AS id, t AS k, CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END AS z FROM s JOIN (SELECT t, avg(value) AS m, stddev_pop(value) AS sd FROM s GROUP BY t) USING (t)", "z")
def _(s, d):
    return cluster.z_scored(tb.features(s, d))


T2 = """SELECT voxel_id, CASE WHEN s < 0 THEN i ELSE 0 END AS log_a, CASE WHEN s < 0 THEN least(-1 / s, 100.0) ELSE 0 END AS t2, CASE WHEN s < 0 THEN r2 ELSE 0 END AS r2
FROM (SELECT DISTINCT voxel_id FROM decay) LEFT JOIN (SELECT voxel_id, regr_slope(ln(value), t) AS s, regr_intercept(ln(value), t) AS i, regr_r2(ln(value), t) AS r2
FROM decay LEFT JOIN (SELECT voxel_id, min(t) AS stop FROM decay WHERE value <= 0 GROUP BY voxel_id) USING (voxel_id) WHERE t < coalesce(stop, 1e300) GROUP BY voxel_id HAVING count(DISTINCT t) > 1) USING (voxel_id)"""


@query("t2_linear", "decay", T2, "log_a t2 r2")
def _(s, d):
    fitted = fits.t2_linear(tb.decay(s, d), 100.0)
    return fitted.select("voxel_id", F.when(F.col("a") > 0, F.log("a")).otherwise(0.0).alias("log_a"), "t2", "r2")


@query("t2_nonlinear")
def _(s, d):
    return fits.t2_nonlinear(_decaying(s, d), [0.01 * k for k in range(64)])


@query("t1_inversion")
def _(s, d):
    t = [0.05 * k for k in range(1, 65)]
    t1 = (F.col("voxel_id") % 20 + 5) / 20
    made = F.transform(F.array(*[F.lit(x) for x in t]), lambda x: 1000 * (1 - 2 * F.exp(-x / t1)))
    return fits.t1_inversion(tb.packed(s, d).select("voxel_id", made.alias("series")), t)


def _decaying(s, d):
    """Mono-exponential series with a little of the stored noise."""
    p = tb.packed(s, d)
    rate = (F.col("voxel_id") % 20 + 5) / 1.0
    return p.select("voxel_id", F.transform("series", lambda v, i: 1000 * F.exp(-rate * 0.01 * i) + v).alias("series"))


@query("bolus_deconvolution")
def _(s, d):
    aif = [float((k * 2.718281828 / 5) * 2.718281828 ** (-k / 5)) for k in range(64)]
    return fits.deconvolution(_decaying(s, d), aif, 1.0)


@query("delta_r2star", "s", "SELECT voxel_id, t, -ln((value + 2) / pre) / 0.03 AS value FROM s JOIN (SELECT voxel_id, avg(value + 2) AS pre FROM s WHERE t < 8 GROUP BY ALL) USING (voxel_id)", "value")
def _(s, d):
    v = tb.series(s, d).withColumn("value", F.col("value") + 2)
    before = v.filter("t < 8").groupBy("voxel_id").agg(F.avg("value").alias("pre"))
    return v.join(before, "voxel_id").select("voxel_id", "t", fx.delta_r2star(F.col("value"), F.col("pre"), 0.03).alias("value"))


@query("patlak_fit", "s", "SELECT voxel_id, regr_slope((value + 2) / cp, integral / cp) AS k, regr_intercept((value + 2) / cp, integral / cp) AS v FROM s JOIN (SELECT t, cp, 1.5 * coalesce(sum(cp) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS integral FROM (SELECT t, avg(value) + 1 AS cp FROM s GROUP BY t)) USING (t) WHERE cp > 0 GROUP BY voxel_id", "k v")
def _(s, d):
    v = tb.series(s, d)
    cp = v.groupBy("t").agg((F.avg("value") + 1).alias("cp"))
    return fits.patlak(v.withColumn("value", F.col("value") + 2), cp, 1.5)


@query("logistic_glm")
def _(s, d):
    li = tb.table(s, d, "lineitem").select((F.col("l_quantity") / 50).alias("q"), F.col("l_discount").alias("disc"), (F.col("l_returnflag") == "R").cast("double").alias("returned"))
    return fits.logistic_glm(li, ["q", "disc"], "returned")


@query("minimum_spanning_tree")
def _(s, d):
    return graph.minimum_spanning_tree(tb.edges(s, d))


@query("shortest_paths")
def _(s, d):
    e = graph.cut(tb.edges(s, d))
    return graph.shortest_paths(e, graph.degree(e).select("node"))


@query("extracted_volumes", "s", "SELECT voxel_id, t - 10 AS t, value FROM s WHERE t BETWEEN 10 AND 14", "value")
def _(s, d):
    return geometry.extract_volumes(tb.series(s, d), 10, 5)


@query("skipped_samples", "s", "SELECT voxel_id, t, value FROM s WHERE t >= 5 AND t < 64 - 7", "value")
def _(s, d):
    return geometry.skip_samples(tb.series(s, d), 5, 7)


@query("inserted_volume", "s", "SELECT voxel_id, t, value FROM s WHERE t <> 3 UNION ALL SELECT voxel_id, 3, value FROM s WHERE t = 9", "value")
def _(s, d):
    v = tb.series(s, d)
    return geometry.insert_volume(v, v.filter("t = 9"), 3)


@query("cropped_box", "s vox", "SELECT voxel_id, x - 1 AS x, y - 2 AS y, z AS z, value FROM vox WHERE t = 0 AND x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 6 AND z BETWEEN 0 AND 2", "value")
def _(s, d):
    return geometry.crop(tb.voxels(s, d).filter("t = 0").drop("t"), (1, 2, 0), (4, 5, 3))


@query("cleared_region", "s vox", "SELECT voxel_id, x, y, z, CASE WHEN x BETWEEN 2 AND 4 AND y BETWEEN 2 AND 4 AND z BETWEEN 1 AND 3 THEN 0 ELSE value END AS value FROM vox WHERE t = 0", "value")
def _(s, d):
    return geometry.clear_region(tb.voxels(s, d).filter("t = 0").drop("t"), (2, 2, 1), (3, 3, 3))


@query("reoriented", "s vox", "SELECT voxel_id, y AS x, 7 - x AS y, z AS z, value FROM vox WHERE t = 0", "value")
def _(s, d):
    return geometry.reorient(tb.voxels(s, d).filter("t = 0"), "yXz", (8, 8, 64))


@query("mask_ordinal", "lab", "SELECT voxel_id, row_number() OVER (ORDER BY voxel_id) - 1 AS ordinal FROM lab WHERE label > 0")
def _(s, d):
    return geometry.mask_ordinal(tb.labels(s, d).select("voxel_id", (F.col("label") > 0).cast("int").alias("m")), 64)


@query("relative_coordinates", "s vox lab", "SELECT voxel_id, x - cx AS x, y - cy AS y, z - cz AS z FROM vox, (SELECT x AS cx, y AS cy, z AS cz FROM vox JOIN lab USING (voxel_id) WHERE t = 0 AND label = 3 ORDER BY voxel_id LIMIT 1) WHERE t = 0")
def _(s, d):
    v = tb.voxels(s, d).filter("t = 0")
    return geometry.relative_coordinates(v, v.join(tb.labels(s, d).filter("label = 3"), "voxel_id"))


@query("label_logic", "lab", "SELECT voxel_id, CASE WHEN label > 4 AND NOT label % 2 = 0 THEN 1 ELSE 0 END AS m FROM lab")
def _(s, d):
    m = tb.labels(s, d)
    return geometry.label_logic(m.select("voxel_id", (F.col("label") > 4).cast("int").alias("m")), m.select("voxel_id", (F.col("label") % 2 == 0).cast("int").alias("m")), "minus")


@query("connected_parts")
def _(s, d):
    v = tb.voxels(s, d).filter("t = 0 AND value > 0")
    return geometry.remove_isolated(v, 2)


@query("label_fusion")
def _(s, d):
    votes = tb.series(s, d).select("voxel_id", F.col("t").alias("rater"), (F.col("value") > 0).cast("int").alias("v"))
    return geometry.staple(votes)[0]


from . import imaging, shapes  # noqa: E402, F401  (register their queries here)
