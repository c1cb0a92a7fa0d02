"""Times the headline queries once warm; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINES = (
    "voxel_count", "roi_series", "value_histogram", "detrended", "global_regressed", "magnitude_spectrum", "bandpass_filtered",
    "correlation_matrix", "distance_matrix", "seed_map", "edge_table", "node_degree", "clustering_coefficient", "modularity",
    "nearest_neighbours", "t2_linear", "t2_nonlinear", "bolus_deconvolution", "patlak_fit", "logistic_glm",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from voxelweave.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.local.dir", work)
        .config("spark.checkpoint.dir", f"file://{work}/checkpoints")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times: dict[str, float] = {}
    for name in HEADLINES:
        own = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            own.append(time.perf_counter() - began)
        times[name] = round(median(own[1:]), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total of median warm seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
