"""Watershed segmentation of colour slices: pixels (z, x, y, channels...), one image a z.

Neighbours meet by sending each pixel to the places around it, so no task holds a slice.  Pixels
point to their lowest neighbour, pointers are followed by doubling, and basins merge in rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, merged

PLACE = ["z", "x", "y"]
#: A pixel itself, then its neighbours at lower x, higher x, lower y and higher y.
AROUND = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
#: Coordinates are packed in 21 bits each and lie within +-OFFSET.
BITS, OFFSET = 21, 1 << 20


def gathered(pixels: DataFrame, value: Column, around: tuple = AROUND) -> DataFrame:
    """(z, x, y, v0, v1...): ``value`` of each pixel and of those at the offsets, null beyond the slice."""
    seats = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(around)])
    sent = pixels.select(*PLACE, value.alias("v")).select("*", F.explode(seats).alias("o"))
    sent = sent.select("z", (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), "v", F.col("o.k").alias("k"))
    met = sent.groupBy(*PLACE).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(len(around))])
    return met.filter("v0 IS NOT NULL")


def slopes(channels: int, at: str = "v") -> list[list[Column]]:
    """Central differences of each channel along x and y; beyond the border the pixel's own value counts."""
    near = lambda k, c: F.coalesce(F.col(f"{at}{k}"), F.col(f"{at}0"))[c]
    return [[(near(2, c) - near(1, c)) / 2 for c in range(channels)], [(near(4, c) - near(3, c)) / 2 for c in range(channels)]]


def vector_diffusion(pixels: DataFrame, channels: list[str], rounds: int = 1, step: float = 0.125, conductance: float = 1.0) -> DataFrame:
    """Edge-preserving diffusion of all channels with one conductance, exp(-g^2 / (2 (conductance * m)^2)).

    g^2 at the middle of two pixels is the squared difference of all channels along their axis and
    the squared mean slope across it; m^2 is the mean squared slope of the slices at that round.
    """
    n = len(channels)
    now = cut(pixels.select(*PLACE, F.array(*[F.col(c).cast("double") for c in channels]).alias("v")))
    for _ in range(rounds):
        along = slopes(n)
        flat = gathered(now, F.col("v")).select(*PLACE, F.col("v0").alias("v"), F.array(*along[0]).alias("gx"), F.array(*along[1]).alias("gy"))
        flat = cut(flat)
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
        scale = flat.agg(F.avg(total(F.col("gx")) + total(F.col("gy"))).alias("m"))  # one row
        met = gathered(flat, F.struct("v", "gx", "gy")).crossJoin(F.broadcast(scale))
        flow: list[Column] = [F.lit(0.0)] * n
        for k, across in ((1, "gy"), (2, "gy"), (3, "gx"), (4, "gx")):
            own, near = F.col("v0"), F.col(f"v{k}")
            d = [near["v"][c] - own["v"][c] for c in range(n)]
            side = [(near[across][c] + own[across][c]) / 2 for c in range(n)]
            g2 = sum((x * x for x in (*d, *side)), F.lit(0.0))
            share = F.when(near.isNull() | (F.col("m") <= 0), 0.0).otherwise(F.exp(-g2 / (2 * conductance * conductance * F.col("m"))))
            flow = [f + F.coalesce(share * x, F.lit(0.0)) for f, x in zip(flow, d, strict=True)]
        now = cut(met.select(*PLACE, F.array(*[F.col("v0.v")[c] + step * flow[c] for c in range(n)]).alias("v")))
    return now.select(*PLACE, *[F.col("v")[c].alias(name) for c, name in enumerate(channels)])


def colour_gradient(pixels: DataFrame, channels: list[str], principal: bool = True) -> DataFrame:
    """Gradient magnitude (z, x, y, value) of all channels together.

    With ``principal`` the root of the difference of the two eigenvalues of the sum of the channels'
    gradient products, else the root of the sum of squares.
    """
    n = len(channels)
    x, y = slopes(n)
    dot = lambda a, b: sum((p * q for p, q in zip(a, b, strict=True)), F.lit(0.0))
    a, b, c = dot(x, x), dot(x, y), dot(y, y)
    value = F.pow((a - c) * (a - c) + 4 * b * b, 0.25) if principal else F.sqrt(a + c)
    met = gathered(pixels, F.array(*[F.col(c).cast("double") for c in channels]))
    return met.select(*PLACE, value.alias("value"))


def packed_place() -> Column:
    high = F.shiftleft((F.col("z") + OFFSET).cast("long"), 2 * BITS)
    return high + F.shiftleft((F.col("y") + OFFSET).cast("long"), BITS) + F.col("x") + OFFSET


def followed(pointers: DataFrame) -> DataFrame:
    """(id, root) of pointers (id, to), whose ends point to themselves.

    Doubling: those that have not arrived take their target's target.  Who has arrived no longer
    takes part, so the many pixels of a large basin do not meet at its lowest one.
    """
    now = cut(pointers.select("id", "to", (F.col("id") == F.col("to")).alias("done")))
    while not now.filter("NOT done").isEmpty():
        step = now.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("done").alias("there"))
        moved = now.filter("NOT done").select("id", "to").join(step, "to").select("id", F.col("far").alias("to"), F.col("there").alias("done"))
        now = cut(now.filter("done").unionByName(moved))
    return now.select("id", F.col("to").alias("root"))


def watershed(heights: DataFrame, level: float = 0.0, threshold: float = 0.0) -> DataFrame:
    """(z, x, y, label): catchment basins of the heights (z, x, y, value) of each slice.

    Heights below ``threshold`` of a slice's range are raised to it.  A pixel belongs to the basin at
    the end of its steepest descent over the four neighbours; equal heights are ordered by y, then x.
    Basins whose depth below their saddle, the least height of the way to an older basin, is at most
    ``level`` of the slice's range merge there, as in a flood that rises from the lowest pixels; of
    equal saddles the one between the smaller basins comes first.  With level 0 only basins without
    depth merge, so a plateau is one basin.  The label is that of a basin's lowest pixel, a number of
    its place.  Pixels with a null value or place are left out; repeated ones count once, with their
    largest value; an empty table gives no rows.
    """
    if not 0 <= level <= 1 or not 0 <= threshold <= 1:
        raise ValueError("level and threshold are shares from 0 to 1")
    h = heights.select(*PLACE, F.col("value").cast("double").alias("value")).na.drop().groupBy(*PLACE).agg(F.max("value").alias("value"))
    h = cut(h)
    ranges = h.groupBy("z").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    h = h.join(ranges, "z").select(*PLACE, F.greatest("value", F.col("lo") + threshold * (F.col("hi") - F.col("lo"))).alias("h"), (level * (F.col("hi") - F.col("lo"))).alias("depth"))
    met = gathered(h, F.struct("h", packed_place().alias("id"), "depth"))
    lowest = F.least(*[F.struct(F.coalesce(F.col(f"v{k}.h"), F.lit(float("inf"))).alias("h"), F.coalesce(F.col(f"v{k}.id"), F.lit(0)).alias("id")) for k in range(len(AROUND))])
    pixels = cut(met.select(*PLACE, F.col("v0.id").alias("id"), F.col("v0.h").alias("h"), F.col("v0.depth").alias("depth"), lowest["id"].alias("to")))
    rooted = cut(pixels.join(followed(pixels), "id"))

    sides = gathered(rooted, F.struct("root", "h"), ((0, 0), (1, 0), (0, 1)))
    pairs = sides.select("v0", F.explode(F.array("v1", "v2")).alias("n")).filter("n IS NOT NULL AND v0.root <> n.root")
    a, b = F.least("v0.root", "n.root").alias("a"), F.greatest("v0.root", "n.root").alias("b")
    edges = pairs.groupBy(a, b).agg(F.min(F.greatest("v0.h", "n.h")).alias("s"))
    edges = cut(edges.select("a", "b", F.struct("s", F.col("a").alias("one"), F.col("b").alias("two")).alias("e")))
    basins = cut(rooted.filter("id = root").select(F.col("id").alias("basin"), F.struct("h", "id").alias("low"), "depth"))
    names = basins.select(F.col("basin").alias("root"), "basin")
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("basin"), F.col("b").alias("other")), F.struct(F.col("b").alias("basin"), F.col("a").alias("other")))).alias("x"), "e")
        picks = ends.groupBy("x.basin").agg(F.min(F.struct("e", F.col("x.other").alias("other"))).alias("p"))
        picks = cut(picks.join(basins, "basin").filter("p.e.s - low.h <= depth").select(F.col("basin").alias("src"), F.col("p.other").alias("dst")))
        if picks.isEmpty():
            break
        label = cut(merged(picks))
        renamed = lambda df, c: df.join(label.withColumnsRenamed({"node": c, "root": "to"}), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        edges = renamed(renamed(edges, "a"), "b").filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))
        edges = cut(edges)
        basins = cut(renamed(basins, "basin").groupBy("basin").agg(F.min("low").alias("low"), F.max("depth").alias("depth")))
        names = cut(renamed(names, "basin"))
    final = names.join(basins, "basin").select("root", F.col("low.id").alias("label"))
    return rooted.join(final, "root").select(*PLACE, "label")


def watershed_labels(
    pixels: DataFrame, channels: list[str], level: float = 0.0, threshold: float = 0.0, principal: bool = True, rounds: int = 1, step: float = 0.125, conductance: float = 1.0
) -> DataFrame:
    """Basins of colour slices (z, x, y, channels): diffusion, gradient magnitude, watershed.

    Pixels with a null channel are left out, like those beyond the border.
    """
    whole = pixels.select(*PLACE, *channels).na.drop()
    smooth = vector_diffusion(whole, channels, rounds, step, conductance)
    return watershed(colour_gradient(smooth, channels, principal), level, threshold)
