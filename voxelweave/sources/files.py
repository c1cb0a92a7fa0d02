"""Volumes, vectors, tables and parameter files as DataFrames, and back.

Bytes always come through Spark's readers, so any store that Spark reads will do.
"""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: NIfTI-1 data type codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
VOXEL = "image_id string, voxel_id long, x int, y int, z int, t int, value double"


def nifti_header(raw: bytes) -> dict:
    """Shape, type, spacing and scaling from the 348-byte header of either byte order."""
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", raw[40:56])
    kind, _ = struct.unpack(order + "2h", raw[70:74])
    spacing = struct.unpack(order + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    if kind not in NIFTI_TYPES:
        raise ValueError(f"data type {kind} is not supported")
    shape = [max(1, d) for d in dim[1 : 1 + max(1, dim[0])]] + [1] * (4 - dim[0])
    return {"order": order, "shape": shape[:4], "dtype": order + NIFTI_TYPES[kind], "spacing": spacing[1:5], "offset": int(offset or 352), "slope": slope or 1.0, "inter": inter}


def read_nifti(spark: SparkSession, path: str) -> DataFrame:
    """One row per voxel and volume; voxel_id = x + nx * (y + ny * z)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                h = nifti_header(raw)
                nx, ny, nz, nt = h["shape"]
                n = nx * ny * nz
                i = np.arange(n)
                for t in range(nt):  # a volume at a time
                    v = np.frombuffer(raw, h["dtype"], n, h["offset"] + t * n * np.dtype(h["dtype"]).itemsize)
                    yield pd.DataFrame({"image_id": name, "voxel_id": i, "x": i % nx, "y": i // nx % ny, "z": i // (nx * ny), "t": t, "value": v.astype(float) * h["slope"] + h["inter"]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, VOXEL)


def encode_nifti(volume: np.ndarray, spacing: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)) -> bytes:
    """Bytes of a little-endian file of float32 values from an array in (x, y, z[, t]) order."""
    v = np.asarray(volume, "<f4")
    dims = [v.ndim, *v.shape] + [1] * (7 - v.ndim)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, *dims)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 0.0, 0.0, 0.0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + v.tobytes(order="F")


def write_nifti(voxels: DataFrame) -> DataFrame:
    """(image_id, content) of each image's file; an image must fit one task, as its file does."""

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        size = [int(part[c].max()) + 1 for c in ("x", "y", "z", "t")]
        v = np.zeros(size, np.float32)
        v[part["x"], part["y"], part["z"], part["t"]] = part["value"]
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "content": [encode_nifti(v if size[3] > 1 else v[..., 0])]})

    return voxels.groupBy("image_id").applyInPandas(encode, "image_id string, content binary")


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """First token of each line as a number, with its place in the file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    return lines.filter(F.trim("line") != "").select("i", F.split(F.trim("line"), r"\s+")[0].cast("double").alias("value"))


def write_vector(values: DataFrame, path: str) -> None:
    values.orderBy("i").select(F.col("value").cast("string").alias("value")).write.text(path)


def read_features(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Headerless delimited table whose last column is the class."""
    parts = F.split("value", re.escape(separator))
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda x: x.cast("double")).alias("features"), F.element_at("p", -1).cast("double").alias("label"))


def read_label_names(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    parts = F.split(F.trim("value"), re.escape(separator))
    return spark.read.text(path).filter(F.trim("value") != "").select(parts[0].cast("int").alias("label"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "").alias("name"))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Parameter files as (path, key, values): a line with the key and ten further fields, then
    counted lists of values and of choices, in which quoted strings may hold spaces."""
    token = re.compile(r'"((?:[^"\\]|\\.)*)"|(\S+)')

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch["path"], batch["value"], strict=True):
                tokens = [a if a or not b else b for a, b in token.findall(text)]
                i = 0
                while i + 11 < len(tokens):
                    key, i = tokens[i], i + 11
                    n = int(tokens[i])
                    values, i = tokens[i + 1 : i + 1 + n], i + 1 + n
                    i += 1 + int(tokens[i]) if i < len(tokens) else 0
                    out.append((name, key, values))
            yield pd.DataFrame(out, columns=["path", "key", "values"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(parse, "path string, key string, values array<string>")


def read_gradients(spark: SparkSession, bvals: str, bvecs: str, separator: str = " ") -> DataFrame:
    """(vol, b, gx, gy, gz): one row per volume, in file order."""
    split = lambda path: spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\r?\n")).alias("vol", "line"))
    cells = F.split(F.trim("line"), re.escape(separator) + "+")
    b = split(bvals).select("vol", cells[0].cast("double").alias("b"))
    g = split(bvecs).select("vol", *[cells[k].cast("double").alias(n) for k, n in enumerate(("gx", "gy", "gz"))])
    return b.join(g, "vol")


def graph_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines of a Pajek file as (part, place, line): vertices from 1, then edges."""
    head = nodes.agg(F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("*Vertices "), F.count("*").cast("string")).alias("line"))
    rows = nodes.select(F.lit(1).alias("part"), F.col("node").cast("long").alias("place"), F.concat_ws(" ", F.col("node") + 1, F.concat(F.lit('"'), F.col("name"), F.lit('"'))).alias("line"))
    mid = nodes.sparkSession.range(1).select(F.lit(2).alias("part"), F.col("id").alias("place"), F.lit("*Edges").alias("line"))
    arcs = edges.select(F.lit(3).alias("part"), F.col("src").cast("long").alias("place"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, F.col("weight")).alias("line"))
    return head.unionByName(rows).unionByName(mid).unionByName(arcs)
