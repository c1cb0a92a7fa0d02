import numpy as np
import pytest

from voxelweave.sources import files
from voxelweave.streaming import windowed_roi_series


def test_nifti_round_trip(spark, tmp_path):
    v = np.arange(2 * 3 * 4 * 2, dtype=float).reshape(2, 3, 4, 2)
    (tmp_path / "a.nii").write_bytes(files.encode_nifti(v))
    got = files.read_nifti(spark, str(tmp_path / "a.nii")).toPandas()
    assert len(got) == v.size
    assert all(v[r.x, r.y, r.z, r.t] == r.value for r in got.itertuples())
    again = files.write_nifti(files.read_nifti(spark, str(tmp_path / "a.nii"))).first()
    assert bytes(again["content"]) == files.encode_nifti(v)


def test_text_sources(spark, tmp_path):
    (tmp_path / "v.txt").write_text("1.5 x\n2\n\n3 4\n")
    assert [r["value"] for r in files.read_vector(spark, str(tmp_path / "v.txt")).orderBy("i").collect()] == [1.5, 2, 3]
    (tmp_path / "f.tsv").write_text("1\t2\t0\n3\t4\t1\n")
    assert sorted((tuple(r["features"]), r["label"]) for r in files.read_features(spark, str(tmp_path / "f.tsv")).collect()) == [((1, 2), 0), ((3, 4), 1)]
    (tmp_path / "n.txt").write_text("1 left side\n2 right\n")
    assert {r["label"]: r["name"] for r in files.read_label_names(spark, str(tmp_path / "n.txt")).collect()} == {1: "leftside", 2: "right"}
    (tmp_path / "p").write_text('tr 1 2 3 4 5 6 7 8 9 10\n2 "a b" c\n0\nte 1 2 3 4 5 6 7 8 9 10\n1 0.02\n1 "x"\n')
    assert {r["key"]: r["values"] for r in files.read_parameters(spark, str(tmp_path / "p")).collect()} == {"tr": ["a b", "c"], "te": ["0.02"]}
    (tmp_path / "b").write_text("0\n1000\n")
    (tmp_path / "g").write_text("0 0 0\n1 0 0\n")
    assert [tuple(r) for r in files.read_gradients(spark, str(tmp_path / "b"), str(tmp_path / "g")).orderBy("vol").collect()] == [(0, 0, 0, 0, 0), (1, 1000, 1, 0, 0)]


def test_stream(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(day, 1, 2.0), (day + dt.timedelta(hours=2), 1, 4.0), (day + dt.timedelta(days=5), 2, 1.0)], "ts timestamp, label int, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_roi_series(stream).writeStream.outputMode("complete").format("memory").queryName("roi").start()
    q.processAllAvailable()
    q.stop()
    got = {r["label"]: (r["n"], r["mean"]) for r in spark.table("roi").collect()}
    assert got == {1: (2, pytest.approx(3.0)), 2: (1, pytest.approx(1.0))}
