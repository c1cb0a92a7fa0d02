"""Further file formats: scanner folders, raw blocks, picture stacks, sparse volumes, matrices, graphs.

Readers decode whole small files (a slice, a volume, a matrix) in the task that Spark gave the file;
writers return lines or one row of bytes a file, for Spark's own writers.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import VOXEL, read_nifti, write_nifti


def decoded(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """Rows that ``decode(path, bytes)`` yields as DataFrames, file by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                yield from decode(name, bytes(raw))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def voxel_rows(name: str, v: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows of an array in (x, y, z, t) order, a volume at a time."""
    nx, ny, nz, nt = v.shape
    i = np.arange(nx * ny * nz)
    for t in range(nt):
        yield pd.DataFrame({"image_id": name, "voxel_id": i, "x": i % nx, "y": i // nx % ny, "z": i // (nx * ny), "t": t, "value": v[..., t].ravel(order="F").astype(float)})


def read_fdf(spark: SparkSession, path: str) -> DataFrame:
    """Files slice###image###echo###.fdf of a folder: a text header, then 4-byte floats.

    z is the slice, t the image; the header says the byte order and the matrix.
    """

    def decode(name: str, raw: bytes):
        at = raw.index(b"\0")
        head = raw[:at].decode("latin-1")
        bits = re.search(r"float\s+bits\s*=\s*(\d+)", head)
        if bits and bits[1] != "32":
            raise ValueError("only 4-byte floats are read")
        nx, ny = (int(float(x)) for x in re.search(r"matrix\[\]\s*=\s*\{\s*([\d.]+)\s*,\s*([\d.]+)", head).groups())
        big = re.search(r"bigendian\s*=\s*(\d)", head)
        v = np.frombuffer(raw[len(raw) - 4 * nx * ny :], ">f4" if big and big[1] == "1" else "<f4").reshape(ny, nx).T
        where = re.search(r"slice(\d+)image(\d+)echo(\d+)", name)
        s, i, e = (int(x) for x in where.groups()) if where else (1, 1, 1)
        for rows in voxel_rows(name, v[:, :, None, None]):
            yield rows.assign(image_id=f"echo{e}", z=s - 1, t=i - 1, voxel_id=rows["voxel_id"] + (s - 1) * nx * ny)

    return decoded(spark, path, decode, VOXEL)


def read_blocks(spark: SparkSession, path: str, kind: str = "bfloat") -> DataFrame:
    """Big-endian blocks (``bfloat`` or ``bshort``) whose sizes, rows, columns and images, stand in a text
    file of the same name ending in .hdr; columns are x."""
    width = {"bfloat": ">f4", "bshort": ">i2"}[kind]
    name = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    files = spark.read.format("binaryFile").load(path).select("path", "content", name.alias("name"))
    heads = files.filter("path LIKE '%.hdr'").select("name", F.split(F.trim(F.col("content").cast("string")), r"\s+").alias("dims"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, raw, dims in zip(batch["name"], batch["content"], batch["dims"], strict=True):
                ny, nx, nt = (int(d) for d in dims[:3])
                yield from voxel_rows(own, np.frombuffer(raw, width).reshape(nt, ny, nx).transpose(2, 1, 0)[:, :, None, :])

    return files.filter("path NOT LIKE '%.hdr'").join(heads, "name").select("name", "content", "dims").mapInPandas(run, VOXEL)


def encode_blocks(voxels: DataFrame, swap: bool = False) -> DataFrame:
    """(image_id, t, content): big-endian floats of each volume, or with ``swap`` of each slice over time."""
    key, rest = ("z", "t") if swap else ("t", "z")

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        order = part.sort_values([rest, "y", "x"])
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "t": [int(part[key].iloc[0])], "content": [order["value"].to_numpy().astype(">f4").tobytes()]})

    return voxels.groupBy("image_id", key).applyInPandas(encode, "image_id string, t int, content binary")


def png_pixels(raw: bytes) -> np.ndarray:
    """Grey values (height, width) of an 8-bit PNG without interlacing; colours give their mean."""
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour == 3:
        raise ValueError("only 8-bit pictures without palette or interlacing are read")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.int32)
    for y in range(height):
        kind, row = lines[y, 0], lines[y, 1:].astype(np.int32)
        up = out[y - 1] if y else np.zeros(width * n, np.int32)
        if kind == 2:
            row = (row + up) & 255
        elif kind:
            for i in range(width * n):
                left, corner = (row[i - n], up[i - n]) if i >= n else (0, 0)
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    p = left + up[i] - corner
                    guess = min((left, up[i], corner), key=lambda v, p=p: abs(p - v))
                row[i] = (row[i] + guess) & 255
        out[y] = row
    shown = 3 if n >= 3 else 1
    return out.reshape(height, width, n)[:, :, :shown].mean(axis=2)


def png_bytes(pixels: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    v = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + row.tobytes() for row in v)
    head = struct.pack(">IIBBBBB", v.shape[1], v.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """A stack of pictures as one volume: z is the place of the file by name."""

    def decode(name: str, raw: bytes):
        for rows in voxel_rows(name, png_pixels(raw).T[:, :, None, None]):
            yield rows

    rows = decoded(spark, path, decode, VOXEL)
    places = rows.select("image_id").distinct().withColumn("place", F.row_number().over(Window.orderBy("image_id")) - 1)  # a row a file
    return rows.join(places, "image_id").withColumn("z", F.col("place")).drop("place")


def stacked_pictures(pictures: list[np.ndarray]) -> bytes:
    """Pictures of one width above each other."""
    return png_bytes(np.concatenate(pictures, axis=0))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """Sparse volumes: a comment, ``Dimensions:x,y,z``, then ``x,y,z,value``; mirrored across x, then the
    axes (z, y, x) with the first two from the other side."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("image_id"), F.split("value", "\r?\n").alias("l"))
    dims = F.split(F.regexp_extract(F.element_at("l", 2), r"Dimensions:\s*(.*)", 1), ",")
    each = lines.select("image_id", *[F.trim(dims[i]).cast("int").alias(f"n{c}") for i, c in enumerate("xyz")], F.explode(F.slice("l", 3, F.size("l"))).alias("line")).filter("line <> ''")
    cell = F.split("line", ",")
    both = each.select("image_id", "nx", "ny", "nz", *[F.trim(cell[i]).cast("int").alias(f"p{c}") for i, c in enumerate("xyz")], F.trim(cell[3]).cast("double").alias("value"))
    sides = both.unionByName(both.withColumn("px", F.col("nx") - 1 - F.col("px"))).dropDuplicates(["image_id", "px", "py", "pz"])
    return sides.select("image_id", (F.col("nz") - 1 - F.col("pz")).alias("x"), (F.col("ny") - 1 - F.col("py")).alias("y"), F.col("px").alias("z"), "value")


def read_recording(spark: SparkSession, path: str, channels: int, samples: int) -> DataFrame:
    """Ascii recordings: after a line ``data:``, numbers with a decimal comma, as channel x block x time."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)data:\s*(.*)", 1).alias("body"))
    values = text.select(F.posexplode(F.split(F.trim(F.regexp_replace("body", ",", ".")), r"\s+")).alias("i", "v")).filter("v <> ''")
    at = F.col("i")
    return values.select((at % channels).cast("int").alias("channel"), F.floor(at / (channels * samples)).cast("int").alias("block"), (F.floor(at / channels) % samples).cast("int").alias("t"), F.col("v").cast("double").alias("value"))


def recording_lines(recording: DataFrame, channel: int, first: int, last: int) -> DataFrame:
    """(block, line): a channel's samples from first to last of each block, with commas."""
    part = recording.filter((F.col("channel") == channel) & F.col("t").between(first, last))
    values = F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda s: s["value"].cast("string"))
    return part.groupBy("block").agg(F.array_join(values, ",").alias("line"))


def read_matrix(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """(i, j, value) of a text matrix; blank cells are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("i", "line"))
    cells = rows.select("i", F.posexplode(F.split(F.trim("line"), separator)).alias("j", "v"))
    return cells.filter("trim(v) <> ''").select("i", "j", F.col("v").cast("double").alias("value"))


def matrix_lines(entries: DataFrame, names: list[str] | None = None, columns: int | None = None) -> DataFrame:
    """(i, line) of a comma-separated matrix, NaN and missing cells blank; line -1 has the names."""
    n = columns if columns is not None else (entries.agg(F.max("j")).first()[0] or 0) + 1
    cells = F.map_from_entries(F.collect_list(F.struct("j", F.when(F.isnan("value"), "").otherwise(F.col("value").cast("string")).alias("v"))))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.element_at("cells", j), F.lit(""))), ",")
    rows = entries.select("i", F.col("j").cast("int").alias("j"), "value").groupBy("i").agg(cells.alias("cells")).select(F.col("i").cast("long").alias("i"), line.alias("line"))
    if names is None:
        return rows
    return rows.unionByName(entries.sparkSession.createDataFrame([(-1, ",".join(names))], "i long, line string"))


def matrix_voxels(entries: DataFrame) -> DataFrame:
    """A matrix as an image of one slice: x is the row, y the column."""
    return entries.select(F.lit("matrix").alias("image_id"), F.col("i").cast("int").alias("x"), F.col("j").cast("int").alias("y"), F.lit(0).alias("z"), F.lit(0).alias("t"), "value")


def index_lines(voxels: DataFrame) -> DataFrame:
    """(voxel_id, line): x,y,z of every voxel that is not 0."""
    return voxels.filter("value <> 0").select("voxel_id", F.concat_ws(",", "x", "y", "z").alias("line"))


def label_file(root: str, extension: str) -> Column:
    """File name of a label: its name with spaces as underscores, or root_label where it has none."""
    return F.coalesce(F.concat(F.regexp_replace("name", " ", "_"), F.lit("." + extension)), F.concat(F.lit(root + "_"), F.col("label").cast("string"), F.lit("." + extension)))


def table_lines(rows: DataFrame, separator: str = "\t") -> DataFrame:
    """(id, line) of a feature table, the label last."""
    values = F.transform("features", lambda x: x.cast("string"))
    return rows.select("id", F.array_join(F.concat(values, F.array(F.col("label").cast("string"))), separator).alias("line"))


def list_to_mask(values: DataFrame, image: DataFrame) -> DataFrame:
    """Whole numbers (i, value) put into the voxels of an image that are not 0, in raster order."""
    from ..operators.geometry import list_to_image

    mask = image.select("voxel_id", (F.col("value") != 0).cast("int").alias("m"))
    return list_to_image(values.select("i", F.col("value").cast("int").alias("value")), mask)


def covariate_lines(selection: DataFrame, covariates: list[str]) -> DataFrame:
    """Lines Label,value,covariates of a voxel selection, after a header (place 0)."""
    head = selection.sparkSession.createDataFrame([(0, ",".join(["Label", "value", *covariates]))], "place int, line string")
    body = selection.select(F.lit(1).alias("place"), F.concat_ws(",", *[F.col(c).cast("string") for c in ("label", "value", *covariates)]).alias("line"))
    return head.unionByName(body)


def graph_markup(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, place, line) of a GML file."""
    spark = edges.sparkSession
    ends = spark.createDataFrame([(0, 0, "graph ["), (3, 0, "]")], "part int, place long, line string")
    text = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    rows = nodes.select(F.lit(1).alias("part"), F.col("node").cast("long").alias("place"), text("node [ id ", F.col("node").cast("string"), ' label "', F.col("name"), '" ]').alias("line"))
    arcs = edges.select(F.lit(2).alias("part"), F.col("src").cast("long").alias("place"), text("edge [ source ", F.col("src").cast("string"), " target ", F.col("dst").cast("string"), " value ", F.col("weight").cast("string"), " ]").alias("line"))
    return ends.unionByName(rows).unionByName(arcs)


def similarity_lines(edges: DataFrame, nodes: DataFrame, least: float = 0.0) -> DataFrame:
    """(src, dst, line) of all similarities above a value, both ways, and 1 of each node with itself."""
    kept = edges.filter(F.col("weight") > least)
    both = kept.select("src", "dst", "weight").unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    own = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("weight"))
    return both.unionByName(own).select("src", "dst", F.concat_ws(" ", "src", "dst", "weight").alias("line"))


def meta_image(volume: np.ndarray, spacing: tuple[float, ...] = (1.0, 1.0, 1.0)) -> bytes:
    """A MetaImage file of big-endian floats from an array in (x, y, z) order."""
    v = np.asarray(volume, ">f4")
    head = {
        "ObjectType": "Image", "NDims": v.ndim, "BinaryData": "True", "BinaryDataByteOrderMSB": "True", "ElementSpacing": " ".join(map(str, spacing)),
        "DimSize": " ".join(map(str, v.shape)), "ElementType": "MET_FLOAT", "ElementDataFile": "LOCAL",
    }
    return "".join(f"{k} = {x}\n" for k, x in head.items()).encode() + v.tobytes(order="F")


def converted(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, content): images read and written again as plain single files of floats."""
    return write_nifti(read_nifti(spark, path))
