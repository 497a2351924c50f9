"""Binning in property space: T/S histograms, density profiles, classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.expr import _c
from strataframe.operators.agg import wavg


def bin_of(value, low, high, n: int, clamp: bool = False) -> Column:
    """Bin 1..n of equal width; the upper edge belongs to the last bin. Outside: null, or the end bins."""
    v = _c(value)
    raw = (F.floor((v - _c(low)) / (_c(high) - _c(low)) * n) + 1).cast("int")
    inside = F.when(v == _c(high), n).otherwise(raw)
    return F.least(F.greatest(inside, F.lit(1)), F.lit(n)) if clamp else F.when((v >= _c(low)) & (v <= _c(high)), inside)


def ts_volume(df: DataFrame, keys: list[str], t: str, s: str, volume: str, t_range: tuple[float, float], s_range: tuple[float, float], n: int, clamp: bool = False) -> DataFrame:
    """(keys, t_bin, s_bin, volume): empty bins have no row."""
    own = df.withColumn("t_bin", bin_of(t, F.lit(t_range[0]), F.lit(t_range[1]), n, clamp)).withColumn("s_bin", bin_of(s, F.lit(s_range[0]), F.lit(s_range[1]), n, clamp))
    return own.where("t_bin IS NOT NULL AND s_bin IS NOT NULL").groupBy(*keys, "t_bin", "s_bin").agg(F.sum(volume).alias("volume"))


def ts_volume_auto(df: DataFrame, t: str, s: str, volume: str, n: int, pad: float = 0.001) -> DataFrame:
    """The same with bounds from the data, padded by a share of their distance; the bounds are one broadcast row."""
    lo, hi = (lambda c: F.min(c)), (lambda c: F.max(c))
    ends = df.agg(*[(f(c) + sign * pad * (hi(c) - lo(c))).alias(f"_{c}{name}") for c in (t, s) for f, sign, name in ((lo, -1, "0"), (hi, 1, "1"))])
    own = df.join(F.broadcast(ends))
    own = own.withColumn("t_bin", bin_of(t, f"_{t}0", f"_{t}1", n)).withColumn("s_bin", bin_of(s, f"_{s}0", f"_{s}1", n))
    return own.groupBy("t_bin", "s_bin").agg(F.sum(volume).alias("volume"))


def density_profile(df: DataFrame, keys: list[str], density: str, values: list[str], volume: str, low: float, high: float, n: int) -> DataFrame:
    """Volume and volume-weighted means by density bin; what lies outside goes to the end bins."""
    own = df.where(F.col(density).isNotNull()).withColumn("bin", bin_of(density, F.lit(low), F.lit(high), n, clamp=True))
    return own.groupBy(*keys, "bin").agg(F.sum(volume).alias("volume"), *[wavg(v, volume).alias(v) for v in values])


def volume_change(df: DataFrame, early: Column, late: Column, bins: list[str], volume: str, n_early: float, n_late: float) -> DataFrame:
    """Mean volume of the late minus the early period by bin; a bin of one period only counts in full."""
    out = df.where(early | late).groupBy(*bins).agg(
        (F.sum(F.when(late, F.col(volume)).otherwise(0.0)) / n_late - F.sum(F.when(early, F.col(volume)).otherwise(0.0)) / n_early).alias("change")
    )
    return out


def mean_by_class(df: DataFrame, classes: DataFrame, value: str, weight: str, by: str) -> DataFrame:
    """Weighted means by class; ``classes`` (class, low, high) is a dimension table, bounds half-open."""
    hit = df.join(classes, (F.col(by) >= F.col("low")) & (F.col(by) < F.col("high")))
    return hit.groupBy("class").agg(wavg(value, weight).alias(value), F.sum(weight).alias("area"))


def normalise(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """``value`` scaled to 0..1 between the extremes of its group (0 where they agree)."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    own = df.join(ends, keys) if keys else df.join(F.broadcast(ends))
    return own.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def upper_bin(value: str | Column, n: int) -> Column:
    """Bin 1..n of a value from 0 to 1, where an edge belongs to the bin below it and 0 to the first; within 1e-9 of an edge is on it."""
    return F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(F.round(_c(value) * n, 9)).cast("int")))


def anomaly_by_bin(df: DataFrame, keys: list[str], anomaly: str, volume: str, t_bin: str, s_bin: str, n: int, cut: Callable[[DataFrame], DataFrame], neighbours: int = 10, sigma: float = 2.0) -> DataFrame:
    """(keys, t_bin, s_bin, anomaly) for all n x n bins: volume-weighted means; empty bins take the inverse-distance mean of the
    ``neighbours`` nearest (ties at the last distance count), then all are smoothed by a Gaussian of ``sigma`` bins with reflecting ends."""
    from strataframe.operators import fill, stencil

    means = df.groupBy(*keys, (F.col(t_bin) - 1).alias("j"), (F.col(s_bin) - 1).alias("i")).agg(wavg(anomaly, volume).alias("v"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bins = means.select(*keys).distinct().withColumn("j", every).withColumn("i", every)
    dense = cut(bins.join(means, [*keys, "j", "i"], "left"))
    filled = fill.nearest_weighted(dense, keys, "v", neighbours, None, cut)
    smooth = stencil.smooth(stencil.smooth(filled, "v", [*keys, "j"], "i", n, sigma), "v", [*keys, "i"], "j", n, sigma)
    return smooth.select(*keys, (F.col("j") + 1).alias("t_bin"), (F.col("i") + 1).alias("s_bin"), F.col("v").alias("anomaly"))
