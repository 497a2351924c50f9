"""Ensemble statistics: trends, t-tests, correlations, lags, spectra."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trend(df: DataFrame, keys: list[str], value: str, x: str) -> DataFrame:
    """(keys, slope, intercept, r2, n, t, dof) of least-squares lines; t is null for a perfect or undefined fit."""
    y, x = F.col(value), F.col(x)
    out = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")
    )
    t = F.when((F.col("n") > 2) & (F.col("r2") < 1), F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))))
    return out.withColumn("t", t).withColumn("dof", (F.col("n") - 2).cast("double"))


def one_sample_t(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, t, dof) of a test of the members' values against 0."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_n"))
    t = F.when((F.col("_n") > 1) & (F.col("_s") > 0), F.col("mean") / (F.col("_s") / F.sqrt("_n")))
    return out.select(*keys, "mean", t.alias("t"), (F.col("_n") - 1).cast("double").alias("dof"))


def welch_t(df: DataFrame, keys: list[str], value: str, first: Column, second: Column) -> DataFrame:
    """(keys, difference, t, dof) of Welch's test between the rows of two conditions."""
    side = lambda c, f: f(F.when(c, F.col(value)))
    out = df.groupBy(*keys).agg(
        *[side(c, f).alias(f"_{name}{k}") for k, c in ((1, first), (2, second)) for name, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    )
    a, b = F.col("_v1") / F.col("_n1"), F.col("_v2") / F.col("_n2")
    dof = (a + b) * (a + b) / (a * a / (F.col("_n1") - 1) + b * b / (F.col("_n2") - 1))
    ok = (F.col("_n1") > 1) & (F.col("_n2") > 1) & (a + b > 0)
    return out.select(*keys, (F.col("_m1") - F.col("_m2")).alias("difference"), F.when(ok, (F.col("_m1") - F.col("_m2")) / F.sqrt(a + b)).alias("t"), F.when(ok, dof).alias("dof"))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h *= c * d
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    x = np.clip(x, 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        out = np.where(low, front * _beta_fraction(a, b, x) / a, 1 - front * _beta_fraction(b, a, 1 - x) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(T.DoubleType())
def two_sided_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null where t or the degrees of freedom are missing or not positive."""
    ok = (t.notna() & dof.notna() & (dof > 0)).to_numpy()
    out = np.full(len(t), np.nan)
    if ok.any():
        tv, nu = t.to_numpy(float)[ok], dof.to_numpy(float)[ok]
        out[ok] = incomplete_beta(nu / 2, np.full_like(nu, 0.5), nu / (nu + tv * tv))
    return pd.Series(out).where(pd.Series(ok), None)


def significant_mean(df: DataFrame, keys: list[str], value: str, p: float = 0.05) -> DataFrame:
    """(keys, mean, p): the members' mean, 0 where a t-test does not reject 0."""
    out = one_sample_t(df, keys, value).withColumn("p", two_sided_p("t", "dof"))
    return out.select(*keys, F.when(F.col("p") <= p, F.col("mean")).otherwise(0.0).alias("mean"), "p")


def divergence_time(df: DataFrame, keys: list[str], value: str, year: str, first: Column, second: Column, radius: int, z: float = 1.96) -> DataFrame:
    """The year after the last window in which the two sides' normal intervals overlap (null if they do to the end).

    Years have their count, sum and squares about the mean of all; a window is
    the difference of two running sums, so no sample is copied for its windows.
    """
    sides = {1: first, 2: second}
    moment = lambda k, f: f(F.when(sides[k], F.col(value)))
    own = df.groupBy(*keys, F.col(year).alias("_y")).agg(*[moment(k, f).alias(f"_{n}{k}") for k in sides for n, f in (("n", F.count), ("s", F.sum), ("v", F.var_pop))])
    whole = Window.partitionBy(*keys)
    centre = F.sum(F.coalesce("_s1", F.lit(0.0)) + F.coalesce("_s2", F.lit(0.0))).over(whole) / F.sum(F.col("_n1") + F.col("_n2")).over(whole)
    own = own.withColumn("_c", centre)
    for k in sides:
        n, mean = F.col(f"_n{k}"), F.col(f"_s{k}") / F.col(f"_n{k}") - F.col("_c")
        own = own.withColumns({f"_a{k}": F.when(n > 0, n * mean).otherwise(0.0), f"_q{k}": F.when(n > 0, n * (F.col(f"_v{k}") + mean * mean)).otherwise(0.0)})
    ends = own.groupBy(*keys).agg(F.min("_y").alias("_first"), F.max("_y").alias("_last"))
    every = ends.withColumn("_y", F.explode(F.sequence("_first", "_last"))).join(own, [*keys, "_y"], "left")
    order = Window.partitionBy(*keys).orderBy("_y")
    upto = lambda c, r: F.coalesce(F.sum(c).over(order.rangeBetween(Window.unboundedPreceding, r)), F.lit(0.0))
    out = every.select(*keys, "_y", "_first", "_last", *[(upto(f"_{n}{k}", radius) - upto(f"_{n}{k}", -radius - 1)).alias(f"_{n}{k}") for k in sides for n in ("n", "a", "q")])
    out = out.where(F.col("_y").between(F.col("_first") + radius, F.col("_last") - radius) & (F.col("_n1") + F.col("_n2") > 0))
    mean = lambda k: F.when(F.col(f"_n{k}") > 0, F.col(f"_a{k}") / F.col(f"_n{k}"))
    std = lambda k: F.sqrt(F.greatest(F.col(f"_q{k}") / F.when(F.col(f"_n{k}") > 0, F.col(f"_n{k}")) - mean(k) * mean(k), F.lit(0.0)))
    out = out.withColumn("_apart", F.abs(mean(1) - mean(2)) > z * (std(1) + std(2)))
    last = out.groupBy(*keys).agg(F.max(F.when(~F.col("_apart"), F.col("_y"))).alias("_same"), F.max("_y").alias("_end"), F.min("_y").alias("_start"))
    year_of = F.when(F.col("_same") == F.col("_end"), None).otherwise(F.coalesce(F.col("_same") + 1, F.col("_start")))
    return last.select(*keys, year_of.cast("int").alias("year"))


def best_lag(df: DataFrame, keys: list[str], step: str, driver: str, response: str, most: int = 24) -> DataFrame:
    """(keys, lag, r): the lag >= 0 by which the driver leads with the greatest correlation; the least of equals.

    The responses of all lags stand beside the driver by one window (exact steps), so no row is copied per lag.
    """
    order, lags = Window.partitionBy(*keys).orderBy(step), range(most + 1)
    own = df.select(*keys, step, driver, *[F.max(response).over(order.rangeBetween(n, n)).alias(f"_r{n}") for n in lags])
    r = own.groupBy(*keys).agg(*[f(F.col(driver), F.col(f"_r{n}")).alias(f"_{name}{n}") for n in lags for name, f in (("c", F.corr), ("n", F.regr_count))])
    each = [F.struct(F.when(F.col(f"_n{n}") > 2, F.col(f"_c{n}")).alias("r"), F.lit(-n).alias("l")) for n in lags]
    best = F.array_max(F.filter(F.array(*each), lambda x: x["r"].isNotNull() & ~F.isnan(x["r"])))
    return r.select(*keys, best.alias("_b")).where("_b IS NOT NULL").select(*keys, (-F.col("_b.l")).alias("lag"), F.col("_b.r").alias("r"))


def standardised_by_month(df: DataFrame, keys: list[str], value: str, time: str = "t") -> DataFrame:
    """``df`` with ``index``: the anomaly from the month's mean over members and years, in its standard deviations."""
    w = Window.partitionBy(*keys, F.month(time))
    s = F.stddev_pop(value).over(w)
    return df.withColumn("index", F.when(s > 0, (F.col(value) - F.avg(value).over(w)) / s))


def trend_by_cutoff(df: DataFrame, keys: list[str], value: str, x: str, cutoffs: list[float]) -> DataFrame:
    """Trends of only the samples above each cutoff: moments of the samples between cutoffs, added up from the greatest cutoff down."""
    cuts = sorted(set(map(float, cutoffs)))
    above = sum((F.when(F.col(value) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    y, t = F.col(value).cast("double"), F.col(x).cast("double")
    own = df.where(F.col(value).isNotNull() & F.col(x).isNotNull()).withColumn("_bin", above).where("_bin > 0").groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(t).alias("_x"), F.avg(y).alias("_y"), F.regr_sxx(y, t).alias("_xx"), F.regr_sxy(y, t).alias("_xy"), F.regr_syy(y, t).alias("_yy")
    )
    whole, down = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("_bin"))
    own = own.withColumns({f"_{c}0": F.sum(F.col(f"_{c}") * F.col("_n")).over(whole) / F.sum("_n").over(whole) for c in "xy"})
    dx, dy = F.col("_x") - F.col("_x0"), F.col("_y") - F.col("_y0")
    # sums about the mean of all, which add up
    own = own.select(
        *keys, "_bin", "_n", "_x0", "_y0", (F.col("_n") * dx).alias("_sx"), (F.col("_n") * dy).alias("_sy"),
        (F.col("_xx") + F.col("_n") * dx * dx).alias("_xx"), (F.col("_xy") + F.col("_n") * dx * dy).alias("_xy"), (F.col("_yy") + F.col("_n") * dy * dy).alias("_yy"),
    )
    # a cutoff whose own bin is empty has the samples of the bins above
    bins = own.groupBy(*keys).agg(F.max("_bin").alias("_top"), F.max("_x0").alias("_x0"), F.max("_y0").alias("_y0")).withColumn("_bin", F.explode(F.sequence(F.lit(1), F.col("_top")))).drop("_top")
    sums = bins.join(own.drop("_x0", "_y0"), [*keys, "_bin"], "left").withColumns({c: F.coalesce(F.sum(c).over(down), F.lit(0)) for c in ("_n", "_sx", "_sy", "_xx", "_xy", "_yy")})
    sums = sums.withColumns({"_sxx": F.col("_xx") - F.col("_sx") ** 2 / F.col("_n"), "_sxy": F.col("_xy") - F.col("_sx") * F.col("_sy") / F.col("_n"), "_syy": F.col("_yy") - F.col("_sy") ** 2 / F.col("_n")})
    some = F.col("_sxx") > 1e-12 * F.greatest(F.abs("_xx"), F.lit(1e-300))
    flat = F.col("_syy") <= 1e-12 * F.greatest(F.abs("_yy"), F.lit(1e-300))
    slope = F.when(some, F.col("_sxy") / F.col("_sxx"))
    out = sums.select(
        *keys, F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("_bin")).alias("cutoff"), slope.alias("slope"),
        (F.col("_y0") + F.col("_sy") / F.col("_n") - slope * (F.col("_x0") + F.col("_sx") / F.col("_n"))).alias("intercept"),
        F.when(some, F.when(flat, 1.0).otherwise(F.col("_sxy") ** 2 / (F.col("_sxx") * F.col("_syy")))).alias("r2"), F.col("_n").cast("long").alias("n"),
    )
    t = F.when((F.col("n") > 2) & (F.col("r2") < 1), F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))))
    return out.withColumn("t", t).withColumn("dof", (F.col("n") - 2).cast("double"))


def trend_outside_events(df: DataFrame, keys: list[str], value: str, step: str, event: Column, delays: list[int]) -> DataFrame:
    """Trends without the samples in an event or up to ``delay`` steps after one."""
    last = F.max(F.when(event, F.col(step))).over(Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    own = df.withColumn("_last", last).withColumn("delay", F.explode(F.array(*[F.lit(d) for d in delays])))
    return trend(own.where(F.col("_last").isNull() | (F.col(step) - F.col("_last") > F.col("delay"))), [*keys, "delay"], value, step)


def segments(df: DataFrame, keys: list[str], step: str, size: int) -> DataFrame:
    """Half-overlapping segments of ``size`` steps (numbered from 0): ``df`` with ``segment`` and ``n`` inside it; short ones are dropped."""
    half = size // 2
    w = Window.partitionBy(*keys).orderBy(step)
    own = df.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    b = F.floor(F.col("_rn") / half).cast("int")
    own = own.withColumn("segment", F.explode(F.array(b - 1, b))).where("segment >= 0")
    own = own.withColumn("n", (F.col("_rn") - F.col("segment") * half).cast("int"))
    return own.where((F.col("segment") * half + size <= F.col("_total")) & F.col("n").between(0, size - 1)).drop("_rn", "_total")


def _transformed(column: pd.Series, size: int) -> pd.Series:
    """Real and imaginary parts, one after the other, of the detrended and Hann-windowed segments; missing samples are left out of the fit and count as 0."""
    m = np.array([np.asarray(v, float) for v in column]).reshape(-1, size)
    ok, n = ~np.isnan(m), np.arange(size)
    count, x = ok.sum(1), np.where(ok, n, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_x, mean_y = x.sum(1) / count, np.where(ok, m, 0).sum(1) / count
        dx = np.where(ok, n - mean_x[:, None], 0)
        slope = (dx * np.where(ok, m, 0)).sum(1) / (dx * dx).sum(1)
    left = np.where(ok, m - mean_y[:, None] - slope[:, None] * (n - mean_x[:, None]), 0) * (0.5 - 0.5 * np.cos(2 * np.pi * n / size))
    f = np.fft.rfft(left, axis=1)
    return pd.Series(list(np.concatenate([f.real, f.imag], axis=1)))


def fourier(df: DataFrame, keys: list[str], values: list[str], step: str, size: int) -> DataFrame:
    """(keys, segment, f, re_*, im_*): Hann-windowed, linearly detrended transforms; a segment is one array, transformed in Arrow batches.

    A segment in which fewer than two samples of a value are there has NaN.
    """
    own = segments(df, keys, step, size)
    rows = F.array_sort(F.collect_list(F.struct("n", *[F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(v) for v in values])))  # ``size`` of them
    own = own.groupBy(*keys, "segment").agg(rows.alias("_s"))
    turn = F.pandas_udf(lambda column: _transformed(column, size), T.ArrayType(T.DoubleType()))
    own = own.select(*keys, "segment", *[turn(F.col(f"_s.{v}")).alias(f"_t_{v}") for v in values])
    half = size // 2 + 1
    parts = [F.slice(F.col(f"_t_{v}"), 1 + k * half, half).alias(f"{name}_{v}") for v in values for k, name in enumerate(("re", "im"))]
    each = own.select(*keys, "segment", F.posexplode(F.arrays_zip(*parts)).alias("f", "_p"))
    return each.select(*keys, "segment", "f", *[F.col(f"_p.{name}_{v}").alias(f"{name}_{v}") for v in values for name in ("re", "im")])


def power_spectrum(df: DataFrame, keys: list[str], value: str, step: str, size: int = 256, rate: float = 1.0) -> DataFrame:
    """(keys, f, power): Welch's one-sided power spectral density; f is the frequency."""
    norm = sum((0.5 - 0.5 * math.cos(2 * math.pi * n / size)) ** 2 for n in range(size))
    own = fourier(df, keys, [value], step, size).withColumn("_p", (F.col(f"re_{value}") ** 2 + F.col(f"im_{value}") ** 2) / (norm * rate))
    twice = F.when((F.col("f") == 0) | (F.col("f") * 2 == size), 1.0).otherwise(2.0)
    return own.groupBy(*keys, "f").agg(F.avg(F.col("_p") * twice).alias("power")).select(*keys, (F.col("f") * (rate / size)).alias("f"), "power")


def coherence(df: DataFrame, keys: list[str], a: str, b: str, step: str, size: int = 256) -> DataFrame:
    """(keys, f, coherence): squared magnitude of the averaged cross spectrum over the product of the spectra."""
    own = fourier(df, keys, [a, b], step, size)
    ra, ia, rb, ib = (F.col(f"{p}_{v}") for v in (a, b) for p in ("re", "im"))
    out = own.groupBy(*keys, "f").agg(
        F.avg(ra * rb + ia * ib).alias("_re"), F.avg(ra * ib - ia * rb).alias("_im"), F.avg(ra**2 + ia**2).alias("_a"), F.avg(rb**2 + ib**2).alias("_b")
    )
    return out.select(*keys, (F.col("f") / size).alias("f"), F.when(F.col("_a") * F.col("_b") > 0, (F.col("_re") ** 2 + F.col("_im") ** 2) / (F.col("_a") * F.col("_b"))).alias("coherence"))
