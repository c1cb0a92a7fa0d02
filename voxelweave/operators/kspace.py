"""k-space reconstruction: traces become images by centred inverse transforms, an image a task.

Raw data are traces (block, trace, samples as real and imaginary arrays).  A program assigns every
trace its image and line; the lines of an image meet in one group, whose size is that of the image
and not of the scan, and one transform of it gives voxels.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACE = "file string, block int, trace int, re array<float>, im array<float>"
IMAGE = "image int, part int, x int, y int, value double, re double, im double"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of big-endian raw files: a 32-byte header, then blocks with a 28-byte header each.

    Samples are pairs of 16-bit integers or 32-bit floats; blocks of zeros alone are dropped.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                n_blocks, n_traces, points, size, _, block_size = struct.unpack(">6i", raw[:24])
                status, headers = struct.unpack(">hi", raw[26:32])
                kind = ">i2" if size == 2 else ">f4" if status & 8 or size == 4 else ">i4"
                for b in range(n_blocks):
                    at = 32 + b * block_size + 28 * max(1, headers)
                    values = np.frombuffer(raw, kind, n_traces * points, at).astype(np.float32).reshape(n_traces, points)
                    if values.any():
                        yield pd.DataFrame({"file": name, "block": b, "trace": range(n_traces), "re": list(values[:, ::2]), "im": list(values[:, 1::2])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, TRACE)


def encode_traces(blocks: np.ndarray) -> bytes:
    """Bytes of such a file from complex values (block, trace, sample), as 32-bit floats."""
    n, traces, points = blocks.shape
    flat = np.stack([blocks.real, blocks.imag], axis=-1).astype(">f4").reshape(n, -1)
    head = struct.pack(">6i2hi", n, traces, 2 * points, 4, 4 * 2 * points, 28 + flat.shape[1] * 4, 0, 8, 1)
    return head + b"".join(bytes(28) + row.tobytes() for row in flat)


def fitted(v: np.ndarray, size: int, axis: int) -> np.ndarray:
    """``size`` samples along an axis: zeros at both ends if there are fewer, the middle if more."""
    n = v.shape[axis]
    if n > size:
        start = (n - size) // 2
        return np.take(v, range(start, start + size), axis=axis)
    pad = [(0, 0)] * v.ndim
    pad[axis] = ((size - n) // 2, size - n - (size - n) // 2)
    return np.pad(v, pad)


def centred_inverse(v: np.ndarray, axes: tuple[int, ...], sizes: tuple[int, ...] | None = None) -> np.ndarray:
    """Inverse transform with the zero frequency in the middle of both sides."""
    for axis, size in zip(axes, sizes or (), strict=False):
        v = fitted(v, size, axis)
    return np.fft.fftshift(np.fft.ifftn(np.fft.ifftshift(v, axes=axes), axes=axes), axes=axes)


def lines_of(traces: DataFrame, image: Column, line: Column, part: Column | None = None) -> DataFrame:
    return traces.select(image.cast("int").alias("image"), (F.lit(0) if part is None else part).cast("int").alias("part"), line.cast("int").alias("line"), "re", "im", "block", "trace")


def reconstruct(lines: DataFrame, size: tuple[int, int] | None = None, prepare: Callable | None = None) -> DataFrame:
    """Magnitude, real and imaginary part of each (image, part): x along readout, y along lines.

    ``prepare`` maps the matrix of lines by samples, and their numbers, to one that is transformed
    over both axes.  Lines that are missing are zeros.  Of lines given twice that of the last block
    and trace counts; without these columns, or with equal ones, they raise.
    """
    order = [c for c in ("block", "trace") if c in lines.columns]

    def image(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if rows.duplicated(["line", *order]).any():
            raise ValueError(f"image {key[0]}, part {key[1]} has a line twice")
        rows = rows.sort_values(order) if order else rows
        k = np.zeros((int(rows["line"].max()) + 1, len(rows["re"].iloc[0])), complex)
        k[rows["line"]] = np.stack(rows["re"].to_list()) + 1j * np.stack(rows["im"].to_list())
        v = centred_inverse(k if prepare is None else prepare(k), (0, 1), size)
        y, x = np.indices(v.shape)
        out = {"image": key[0], "part": key[1], "x": x.ravel(), "y": y.ravel(), "value": np.abs(v).ravel(), "re": v.real.ravel(), "im": v.imag.ravel()}
        return pd.DataFrame(out)

    return lines.groupBy("image", "part").applyInPandas(image, IMAGE)


def slice_order(positions: list[float]) -> list[int]:
    """Place of each slice by position; slices at one position collapse to the last given."""
    kept = {p: i for i, p in enumerate(positions)}
    return [kept[p] for p in sorted(kept)]


def slice_spacing(positions: list[float]) -> float:
    p = sorted(set(positions))
    return float(np.diff(p).mean()) if len(p) > 1 else 0.0


def spacings(parameters: dict[str, list[str]], shape: tuple[int, int]) -> tuple[float, float, float]:
    """Millimetres a pixel along readout and lines, and between slices, from lengths in centimetres."""
    lro, lpe = float(parameters["lro"][0]), float(parameters["lpe"][0])
    return lro / shape[1] * 10, lpe / shape[0] * 10, slice_spacing([float(x) for x in parameters["pss"]]) * 10


def reordered(images: DataFrame, order: list[int], slices: Column, name: str = "z") -> DataFrame:
    """Adds the place of an image's slice by position; slices that collapse into another go."""
    table = images.sparkSession.createDataFrame([(s, i) for i, s in enumerate(order)], f"slice_no int, {name} int")
    return images.withColumn("slice_no", slices.cast("int")).join(F.broadcast(table), "slice_no").drop("slice_no")  # a row a slice


def gradient_echo(traces: DataFrame, slices: int, positions: list[float], size: tuple[int, int] | None = None) -> DataFrame:
    """Multi-slice gradient echo: traces run over slices, then lines; a block is a time point (``part``)."""
    lines = lines_of(traces, F.col("trace") % slices, F.floor(F.col("trace") / slices), F.col("block"))
    return reordered(reconstruct(lines, size), slice_order(positions), F.col("image"))


def spin_echo(traces: DataFrame, slices: int, train: int, line_order: list[int], positions: list[float], size: tuple[int, int] | None = None) -> DataFrame:
    """Fast spin echo: traces run over the echoes of a train, then slices, then shots.

    ``line_order`` gives for each acquired line its number; the least one becomes line 0.
    """
    low = min(line_order)
    table = F.array(*[F.lit(x - low) for x in line_order])
    echo, rest = F.col("trace") % train, F.floor(F.col("trace") / train)
    acquired = F.floor(rest / slices) * train + echo
    lines = lines_of(traces, rest % slices, F.element_at(table, (acquired + 1).cast("int")), F.col("block"))
    return reordered(reconstruct(lines, size), slice_order(positions), F.col("image"))


def multi_echo(traces: DataFrame, slices: int, echoes: int, positions: list[float], size: tuple[int, int] | None = None) -> DataFrame:
    """Multi-echo, multi-slice: traces run over echoes, then slices, then lines; ``part`` is the echo."""
    rest = F.floor(F.col("trace") / echoes)
    lines = lines_of(traces, rest % slices, F.floor(rest / slices), F.col("trace") % echoes)
    return reordered(reconstruct(lines, size), slice_order(positions), F.col("image"))


def look_locker(traces: DataFrame, slices: int, echoes: int, positions: list[float], size: tuple[int, int] | None = None) -> DataFrame:
    """Look-Locker: traces run over slices, then samples of the recovery (``part``), then lines.

    A block is a scan of its own: ``image`` is block * slices + slice.  ``fits.look_locker_maps`` fits T1.
    """
    rest = F.floor(F.col("trace") / slices)
    lines = lines_of(traces, F.col("block") * slices + F.col("trace") % slices, F.floor(rest / echoes), rest % echoes)
    return reordered(reconstruct(lines, size), slice_order(positions), F.col("image") % slices)


def echo_times(first: float, echoes: int) -> list[float]:
    return [first * (i + 1) for i in range(echoes)]


def packed_voxels(images: DataFrame, width: int, height: int) -> DataFrame:
    """(voxel_id, series over part) of reconstructed images, for the fits of ``operators.fits``."""
    voxel = F.col("x") + width * (F.col("y") + height * F.col("z"))
    series = F.transform(F.array_sort(F.collect_list(F.struct("part", "value"))), lambda s: s["value"])
    return images.groupBy(voxel.cast("long").alias("voxel_id")).agg(series.alias("series"))


def volume(traces: DataFrame, lines: int, size: tuple[int, int] | None = None) -> DataFrame:
    """3-D acquisition: a 2-D transform of each partition, then one along the second phase axis.

    Traces run over lines, then partitions; (z, x, y, value, re, im).
    """
    flat = reconstruct(lines_of(traces, F.floor(F.col("trace") / lines), F.col("trace") % lines), size)

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for _, one in part.groupby(part["column"].map(len)):
                v = np.array([[complex(c["re"], c["im"]) for c in column] for column in one["column"]])
                v = centred_inverse(v, (1,))
                n, m = v.shape
                yield pd.DataFrame({"x": np.repeat(one["x"].to_numpy(), m), "y": np.repeat(one["y"].to_numpy(), m), "z": np.tile(np.arange(m), n), "value": np.abs(v).ravel(), "re": v.real.ravel(), "im": v.imag.ravel()})

    # A column has as many values as there are partitions.
    column = F.transform(F.array_sort(F.collect_list(F.struct("image", "re", "im"))), lambda s: F.struct(s["re"].alias("re"), s["im"].alias("im")))
    return flat.groupBy("x", "y").agg(column.alias("column")).mapInPandas(along, "x int, y int, z int, value double, re double, im double")


def phase_maps(lines: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(image, line, re, im): conjugate phase of each line of a reference scan, fitted along readout.

    The phase of a line's transform is unwrapped and fitted by a quadratic, weighted by magnitude,
    where that is above 1 - ``threshold`` of the line's largest; the map is exp(-i fit).
    """

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            re, im = [], []
            for a, b in zip(part["re"], part["im"], strict=True):
                v = centred_inverse(np.asarray(a) + 1j * np.asarray(b), (0,))
                size = np.abs(v)
                w = np.where(size >= (1 - threshold) * size.max(), size, 0.0)
                u = np.linspace(-1, 1, len(v))
                design = np.stack([np.ones_like(u), u, u * u], axis=1)
                beta = np.linalg.lstsq(design * w[:, None], np.unwrap(np.angle(v)) * w, rcond=None)[0]
                m = np.exp(-1j * (design @ beta))
                re.append(m.real)
                im.append(m.imag)
            yield pd.DataFrame({"image": part["image"], "line": part["line"], "re": re, "im": im})

    return lines.select("image", "line", "re", "im").mapInPandas(maps, "image int, line int, re array<double>, im array<double>")


def echo_planar(lines: DataFrame, maps: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """Echo-planar images: each line is transformed along readout and multiplied by its phase map,
    then the lines of an image are transformed; a line without a map keeps its phase."""
    with_maps = lines.join(maps.select("image", "line", F.col("re").alias("mr"), F.col("im").alias("mi")), ["image", "line"], "left")

    def correct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            re, im = [], []
            for a, b, mr, mi in zip(part["re"], part["im"], part["mr"], part["mi"], strict=True):
                v = centred_inverse(np.asarray(a) + 1j * np.asarray(b), (0,))
                if mr is not None:
                    v = v * (np.asarray(mr) + 1j * np.asarray(mi))
                v = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(v)))  # back, so one program ends all images
                re.append(v.real.astype(np.float32))
                im.append(v.imag.astype(np.float32))
            yield pd.DataFrame({"image": part["image"], "part": part["part"], "line": part["line"], "re": re, "im": im})

    corrected = with_maps.mapInPandas(correct, "image int, part int, line int, re array<float>, im array<float>")
    return reconstruct(corrected, size)


def ordered_lines(traces: DataFrame, table: list[list[int]], image: Column, part: Column | None = None) -> DataFrame:
    """Lines of echo-planar traces, each a whole shot, cut up by an ordering table.

    Row n of ``table`` lists, from 0, the samples of the trace that make line n; so reversed lines
    and those of several shots come in their order.
    """
    places = traces.sparkSession.createDataFrame([(n, row) for n, row in enumerate(table)], "line int, places array<int>")
    joined = traces.crossJoin(F.broadcast(places))  # a row a line of the table
    gathered = [F.transform("places", lambda p, c=c: F.element_at(F.col(c), p + 1)).alias(c) for c in ("re", "im")]
    return joined.select(image.cast("int").alias("image"), (F.lit(0) if part is None else part).cast("int").alias("part"), "line", *gathered)


def shot_lines(shots: int, lines: int, centric: bool = False) -> list[list[int]]:
    """Line numbers of each shot: interleaved from the first line, or from the middle outwards."""
    order = list(range(lines))
    if centric:
        order.sort(key=lambda k: (abs(k - lines // 2), k))
    return [order[s::shots] for s in range(shots)]


def multi_shot(traces: DataFrame, shots: int, lines: int, points: int, slices: int, centric: bool = False) -> DataFrame:
    """Lines of multi-shot echo-planar traces: a trace is a shot of lines / shots lines of ``points``
    samples, traces run over slices and then shots, and a block is a time point."""
    numbers = F.array(*[F.array(*[F.lit(k) for k in row]) for row in shot_lines(shots, lines, centric)])
    shot = F.floor(F.col("trace") / slices).cast("int")
    cut_up = F.posexplode(F.element_at(numbers, shot + 1)).alias("place", "line")
    each = traces.select("block", "trace", "re", "im", cut_up)
    piece = lambda c: F.slice(c, (F.col("place") * points + 1).cast("int"), F.lit(points)).alias(c)
    return each.select((F.col("trace") % slices).cast("int").alias("image"), F.col("block").alias("part"), "line", piece("re"), piece("im"))


def zero_filled(images: DataFrame, factor: int) -> tuple[int, int]:
    """Size of the images with each side ``factor`` times as long, for ``size`` of the programs."""
    n = images.agg(F.max("y"), F.max("x")).first()
    return (n[0] + 1) * factor, (n[1] + 1) * factor


def coronal(images: DataFrame) -> DataFrame:
    """Axes (x, y, z) of a coronal scan put into (x, z, y) with y from the other side."""
    top = images.agg(F.max("y").alias("top"))  # one row
    return images.crossJoin(F.broadcast(top)).select("*", (F.col("top") - F.col("y")).alias("ny")).drop("top", "y").withColumnsRenamed({"z": "y", "ny": "z"})


def brightest(images: DataFrame) -> DataFrame:
    """The brightest pixel of each image and part, the first in raster order."""
    w = Window.partitionBy("image", "part").orderBy(F.desc("value"), "y", "x")
    return images.withColumn("k", F.row_number().over(w)).filter("k = 1").select("image", "part", "x", "y", "value")
