"""Weighted averages and integrals, extremes, conditional and ensemble aggregates.

All averages are ratios of sums over rows where the value is not null. Spark
aggregates partially before it shuffles, so a group may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions import constants as K
from strataframe.functions.expr import _c


def wavg(x, w) -> Column:
    x, w = _c(x), _c(w)
    return F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))


def wsum(x, w) -> Column:
    return F.sum(_c(x) * _c(w))


def over(df: DataFrame, keys: list[str], value: str, weight: str, option: str = "average", out: str | None = None) -> DataFrame:
    """Weighted ``average`` or ``integral`` of ``value`` by ``keys``."""
    if option not in ("average", "integral"):
        raise ValueError(f"option must be average or integral, not {option}")
    kernel = wavg if option == "average" else wsum
    return df.groupBy(*keys).agg(kernel(value, weight).alias(out or value))


def area_at_least(value, threshold: float, area) -> Column:
    """Area where the value reaches a threshold."""
    return F.sum(F.when(_c(value) >= threshold, _c(area)).otherwise(0.0))


def mass_balance(melt, area, option: str = "loss") -> Column:
    """Gt per year of all, positive (``melting``) or negative (``freezing``) melt rates in m per year."""
    m = _c(melt)
    part = {"loss": m, "melting": F.greatest(m, F.lit(0.0)), "freezing": F.least(m, F.lit(0.0))}[option]
    return F.sum(part * _c(area)) * (K.RHO_ICE / K.KG_PER_GT)


def water_mass_percent(t, s, volume, t_low=None, t_high=None, s_low=None, s_high=None) -> Column:
    """Percent of the volume with both values inside inclusive bounds."""
    ok = F.lit(True)
    for c, low, high in ((t, t_low, t_high), (s, s_low, s_high)):
        ok = ok & (_c(c) >= low if low is not None else F.lit(True)) & (_c(c) <= high if high is not None else F.lit(True))
    return 100.0 * F.sum(F.when(ok, _c(volume)).otherwise(0.0)) / F.sum(_c(volume))


def padded_range(df: DataFrame, keys: list[str], value: str, pad: float = 0.02) -> DataFrame:
    """(keys, low, high): extremes widened by a share of their distance."""
    lo, hi = F.min(value), F.max(value)
    return df.groupBy(*keys).agg((lo - pad * (hi - lo)).alias("low"), (hi + pad * (hi - lo)).alias("high"))


def root_sum_square(a, b) -> Column:
    return F.sqrt(F.sum((_c(a) - _c(b)) * (_c(a) - _c(b))))


def root_mean_square(a, b) -> Column:
    return F.sqrt(F.avg((_c(a) - _c(b)) * (_c(a) - _c(b))))


def block_average(df: DataFrame, keys: list[str], values: list[str], chunk_j: int, chunk_i: int) -> DataFrame:
    """Plain means over blocks of the index plane."""
    return df.groupBy(*keys, F.floor(F.col("j") / chunk_j).cast("int").alias("bj"), F.floor(F.col("i") / chunk_i).cast("int").alias("bi")).agg(
        *[F.avg(v).alias(v) for v in values]
    )


def block_strongest(df: DataFrame, keys: list[str], u: str, v: str, chunk_j: int, chunk_i: int) -> DataFrame:
    """The vector of greatest magnitude of each block (of equals the one with the least j, then i)."""
    order = F.struct(F.hypot(u, v).alias("m"), (-F.col("j")).alias("j"), (-F.col("i")).alias("i"))
    best = F.max_by(F.struct(u, v), order)
    out = df.groupBy(*keys, F.floor(F.col("j") / chunk_j).cast("int").alias("bj"), F.floor(F.col("i") / chunk_i).cast("int").alias("bi")).agg(best.alias("_b"))
    return out.select(*keys, "bj", "bi", F.col(f"_b.{u}").alias(u), F.col(f"_b.{v}").alias(v))


def ensemble(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population standard deviation and number of members."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def by_region_and_total(df: DataFrame, region: str, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted means by region and, with a null region, over all rows, in one pass."""
    sets = [[region, *keys], keys]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], F.col(region), *[F.col(k) for k in keys]).agg(wavg(value, weight).alias(value))


def times_of_extremes(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, t_min, t_max) of a series; of equals the earliest."""
    return df.groupBy(*keys).agg(
        F.min_by(time, F.struct(value, time)).alias("t_min"), F.max_by(time, F.struct(F.col(value), -F.unix_date(time))).alias("t_max")
    )


def positive_integral(x, area) -> Column:
    return F.sum(F.greatest(_c(x), F.lit(0.0)) * _c(area))
