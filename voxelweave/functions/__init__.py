"""Column functions: pure expressions that stay inside whole-stage code generation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fisher_z(r: Column) -> Column:
    """0.5 * ln((1 + r) / (1 - r))."""
    return 0.5 * F.log((1 + r) / (1 - r))


def inverse_fisher_z(z: Column) -> Column:
    return F.tanh(z)


def standardised_z(r: Column, n: int, constant: float = 0.0) -> Column:
    """Fisher z in units of its standard error for n samples."""
    return fisher_z(r) * F.sqrt(F.lit(float(n - 3))) + constant


def rescaled(value: Column, low: Column, high: Column, out_low: float = 0.0, out_high: float = 100.0) -> Column:
    """Linear map of [low, high] to [out_low, out_high]; a constant image becomes out_low."""
    share = F.when(high == low, F.lit(0.0)).otherwise((value - low) / (high - low))
    return share * (out_high - out_low) + out_low


def binarised(value: Column, lower: float, upper: float = 255.0) -> Column:
    return F.when(value.between(lower, upper), F.lit(1)).otherwise(F.lit(0))


def kept_above(value: Column, lower: float) -> Column:
    return F.when(value >= lower, value).otherwise(F.lit(0.0))


def percent_change(signal: Column, baseline: Column, before: Column) -> Column:
    """ln(S / S0) / ln(S0 / Spre) * 100 + 100, not below 0."""
    return F.greatest(F.log(signal / baseline) / F.log(baseline / before) * 100 + 100, F.lit(0.0))


def delta_r2star(signal: Column, before: Column, te: float) -> Column:
    return -F.log(signal / before) / te


def shifted(index: Column, shift: int, size: int) -> Column:
    """Place to which a circular shift takes an index: out[i] = in[(i + shift) mod n]."""
    return F.pmod(index - shift, F.lit(size))


def chequered(x: Column, y: Column, px: int, py: int) -> Column:
    """0 or 1 by the field of a checkerboard."""
    return F.pmod(F.floor(x / px) + F.floor(y / py), F.lit(2))


def phase_difference(a: Column, b: Column) -> Column:
    """a - b wrapped into (-pi, pi]."""
    d = a - b
    return F.atan2(F.sin(d), F.cos(d))


def inverted(label: Column) -> Column:
    """1 where a label is 0, else 0."""
    return F.when(label == 0, F.lit(1)).otherwise(F.lit(0))


def upper_tail(z: Column) -> Column:
    """Two-sided p of a standard normal z, erfc(|z| / sqrt 2) in Arrow batches: Spark has no such function."""
    from .special import incomplete_gamma

    @F.pandas_udf("double")
    def two_sided(values: pd.Series) -> pd.Series:
        z = values.to_numpy(dtype=float)
        return pd.Series(incomplete_gamma(0.5, z * z / 2)[1])

    return two_sided(z)


def correlation_p(z: Column, n: int) -> Column:
    """p of a Fisher z over n samples; fewer than four are an error."""
    if n < 4:
        raise ValueError("four samples are needed")
    return upper_tail(z * F.sqrt(F.lit(float(n - 3))))


def gamma_density(x: Column, alpha: float, beta: float) -> Column:
    log = (alpha - 1) * F.log(x) - x / beta - alpha * math.log(beta) - math.lgamma(alpha)
    return F.when(x > 0, F.exp(log)).otherwise(0.0)


def scaled_header(factor: float) -> dict[str, Column]:
    """Columns of an image table (sx, sy, sz, ox, oy, oz) with spacing and origin multiplied."""
    return {c: F.col(c) * factor for c in ("sx", "sy", "sz", "ox", "oy", "oz")}


def divided_spacing(axis: str, by: float) -> dict[str, Column]:
    if by <= 0:
        raise ValueError("the divisor must be positive")
    return {f"s{axis}": F.col(f"s{axis}") / by}


def with_origin(x: float, y: float, z: float) -> dict[str, Column]:
    return {"ox": F.lit(x), "oy": F.lit(y), "oz": F.lit(z)}


def gradient_colour(value: Column, low: float, high: float, stops: list[tuple[float, float, float]]) -> Column:
    """Red, green and blue of a value on a colour map given by stops from low to high."""
    place = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * (len(stops) - 1)
    i = F.least(F.floor(place), F.lit(len(stops) - 2)).cast("int")
    table = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in stops])
    a, b = F.element_at(table, i + 1), F.element_at(table, i + 2)
    return F.zip_with(a, b, lambda p, q: p + (q - p) * (place - i))


def blended(a: Column, b: Column, alpha: float) -> Column:
    """Alpha blend of two colours."""
    return F.zip_with(a, b, lambda p, q: p * (1 - alpha) + q * alpha)
