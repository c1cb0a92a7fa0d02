"""Contrast kinetics: concentrations, input functions and two-compartment fits as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checked_range(first: int, pre: int, start: int, end: int, tol: float) -> None:
    """The four volume numbers of a bolus must increase, and the tolerance lie in [0, 1]."""
    if not first < pre < start < end:
        raise ValueError("volume numbers must increase")
    if not 0 <= tol <= 1:
        raise ValueError("the tolerance must be from 0 to 1")


def concentration(r1: DataFrame, relaxivity: float) -> DataFrame:
    """(R1_t - R1_0) / relaxivity of series (voxel_id, t, value), without the first volume."""
    first = r1.filter("t = 0").select("voxel_id", F.col("value").alias("r0"))
    return r1.filter("t > 0").join(first, "voxel_id").select("voxel_id", (F.col("t") - 1).alias("t"), ((F.col("value") - F.col("r0")) / relaxivity).alias("value"))


def vascular_input(c: DataFrame, sinus: DataFrame, hematocrit: float = 0.45) -> DataFrame:
    """(t, cp): mean concentration over a mask divided by the share of plasma."""
    inside = c.join(sinus.filter("m <> 0").select("voxel_id"), "voxel_id", "left_semi")
    return inside.groupBy("t").agg((F.avg("value") / (1 - hematocrit)).alias("cp"))


def integrated(inputs: DataFrame, tr: float) -> DataFrame:
    """(t, cp, integral): the input and its left Riemann sum; a row a time point."""
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return inputs.select("t", "cp", (F.coalesce(F.sum("cp").over(before), F.lit(0.0)) * tr).alias("integral"))


def ichise(c: DataFrame, inputs: DataFrame, tr: float) -> DataFrame:
    """Cp = b1 integral(Cp) + b2 C by least squares; K = 1 / b2 and V = -b1 / b2, null if singular."""
    joined = c.join(integrated(inputs, tr), "t")
    s = {(a, b): F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in (("integral", "integral"), ("integral", "value"), ("value", "value"), ("integral", "cp"), ("value", "cp"))}
    sums = joined.groupBy("voxel_id").agg(*s.values())
    det = F.nullif(F.col("integral_integral") * F.col("value_value") - F.col("integral_value") * F.col("integral_value"), F.lit(0.0))
    b1 = (F.col("integral_cp") * F.col("value_value") - F.col("value_cp") * F.col("integral_value")) / det
    b2 = F.nullif((F.col("value_cp") * F.col("integral_integral") - F.col("integral_cp") * F.col("integral_value")) / det, F.lit(0.0))
    return sums.select("voxel_id", (1 / b2).alias("k"), (-b1 / b2).alias("v"))


def both_fits(one: DataFrame, two: DataFrame) -> DataFrame:
    """Mean of the parameters of two fits, voxel by voxel."""
    other = two.select("voxel_id", F.col("k").alias("k2"), F.col("v").alias("v2"))
    return one.join(other, "voxel_id").select("voxel_id", ((F.col("k") + F.col("k2")) / 2).alias("k"), ((F.col("v") + F.col("v2")) / 2).alias("v"))


def relative_volume(series: DataFrame, before: tuple[int, int], baseline: tuple[int, int]) -> DataFrame:
    """Series of ln(S / S0) / ln(S0 / Spre) * 100 + 100, not below 0, with means over volume ranges."""
    of = lambda r, name: F.avg(F.when(F.col("t").between(*r), F.col("value"))).alias(name)
    means = series.groupBy("voxel_id").agg(of(before, "pre"), of(baseline, "s0"))
    change = F.log(F.col("value") / F.col("s0")) / F.log(F.col("s0") / F.col("pre")) * 100 + 100
    return series.join(means, "voxel_id").select("voxel_id", "t", F.greatest(change, F.lit(0.0)).alias("value"))
