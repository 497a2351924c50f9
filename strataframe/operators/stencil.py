"""Neighbours, derivatives, integrals along an axis, moving averages.

Neighbours are range frames on the index: a missing row gives null, where lag
and lead would skip the gap. Windows are partitioned by run, time and the other
axes, never over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_offset(value: str, keys: list[str], axis: str, d: int) -> Column:
    """The value at index ``axis + d``, null where that row is missing."""
    return F.first(value).over(Window.partitionBy(*keys).orderBy(axis).rangeBetween(d, d))


def neighbours(df: DataFrame, value: str, keys: list[str], j: str = "j", i: str = "i", bounds: DataFrame | None = None) -> DataFrame:
    """``df`` with ``west, east, south, north`` and ``n_valid``.

    With ``bounds`` (one row of j0, j1, i0, i1) a cell at the edge of the
    domain is its own neighbour across that edge.
    """
    out = df
    for name, axis, other, d in (("west", i, j, -1), ("east", i, j, 1), ("south", j, i, -1), ("north", j, i, 1)):
        out = out.withColumn(name, at_offset(value, [*keys, other], axis, d))
    if bounds is not None:
        out = out.join(F.broadcast(bounds))  # one row
        for name, axis, edge in (("west", i, "i0"), ("east", i, "i1"), ("south", j, "j0"), ("north", j, "j1")):
            out = out.withColumn(name, F.when(F.col(axis) == F.col(edge), F.col(value)).otherwise(F.col(name)))
        out = out.drop(*bounds.columns)
    sides = ("west", "east", "south", "north")
    return out.withColumn("n_valid", sum((F.col(s).isNotNull().cast("int") for s in sides), F.lit(0)))


def forward_difference(df: DataFrame, value: str, axis: str, keys: list[str], spacing: float | str = 1.0, out: str = "d") -> DataFrame:
    """(next - own) / spacing along an axis; the last row of a line repeats the one before."""
    step = F.col(spacing) if isinstance(spacing, str) else F.lit(spacing)
    w = Window.partitionBy(*keys).orderBy(axis)
    own = df.withColumn(out, (at_offset(value, keys, axis, 1) - F.col(value)) / step)
    last = F.col(axis) == F.max(axis).over(Window.partitionBy(*keys))
    return own.withColumn("_lag", F.lag(out).over(w)).withColumn(out, F.when(last, F.col("_lag")).otherwise(F.col(out))).drop("_lag")


def time_derivative(df: DataFrame, value: str, keys: list[str], time: str = "t", out: str = "d") -> DataFrame:
    """Backward difference per second, 0 at the first time."""
    w = Window.partitionBy(*keys).orderBy(time)
    seconds = F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(F.lag(time).over(w).cast("timestamp"))
    return df.withColumn(out, F.coalesce((F.col(value) - F.lag(value).over(w)) / seconds, F.lit(0.0)))


def time_integral(df: DataFrame, value: str, keys: list[str], time: str = "t", out: str = "integral") -> DataFrame:
    """Running sum of value times seconds; a step reaches from midpoint to midpoint, the ends as far as inwards."""
    w = Window.partitionBy(*keys).orderBy(time)
    s = F.unix_timestamp(F.col(time).cast("timestamp"))
    before, after = F.lag(s).over(w), F.lead(s).over(w)
    step = F.when(before.isNull() & after.isNull(), 0).when(before.isNull(), after - s).when(after.isNull(), s - before).otherwise((after - before) / 2)
    running = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_dt", step).withColumn(out, F.sum(F.col(value) * F.col("_dt")).over(running)).drop("_dt")


def running_integral(df: DataFrame, value: str, keys: list[str], axis: str, spacing: float | str = 1.0, out: str = "integral") -> DataFrame:
    step = F.col(spacing) if isinstance(spacing, str) else F.lit(spacing)
    w = Window.partitionBy(*keys).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.col(value) * step).over(w))


def running_total(df: DataFrame, value: str, order: str, block: Column, out: str = "total") -> DataFrame:
    """Running sum over all rows in order of ``order``, in two levels: totals of blocks (ascending with ``order``), then inside each."""
    own = df.withColumn("_block", block)
    blocks = own.groupBy("_block").agg(F.sum(value).alias("_sum"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one small row per block
    before = blocks.select(F.col("_block"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_inside", inside).join(before, "_block").withColumn(out, F.col("_inside") + F.col("_before")).drop("_block", "_inside", "_before")


def moving_average(df: DataFrame, value: str, keys: list[str], order: str, window: int, out: str = "smooth") -> DataFrame:
    """Centred mean over ``window`` rows; rows without a full window are dropped.

    An even window reaches one row further back than ahead, so it is centred
    half a step before its row.
    """
    r = window // 2
    ahead = r if window % 2 else r - 1
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-r, ahead)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(out, F.avg(value).over(w)).where(F.col("_n") == r + ahead + 1).drop("_n")


def moving_average_prefix(df: DataFrame, value: str, keys: list[str], order: str, window: int, out: str = "smooth") -> DataFrame:
    """The same for long odd windows: the difference of two running sums, linear in the rows whatever the window."""
    r = window // 2
    w = Window.partitionBy(*keys).orderBy(order)
    total = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_s", F.sum(value).over(total)).withColumn("_c", F.count(value).over(total)).withColumn("_rn", F.row_number().over(w))
    s = F.lead("_s", r).over(w) - F.coalesce(F.lag("_s", r + 1).over(w), F.lit(0.0))
    c = F.lead("_c", r).over(w) - F.coalesce(F.lag("_c", r + 1).over(w), F.lit(0))
    own = own.withColumn(out, s / c)
    return own.where((F.col("_rn") > r) & F.col(out).isNotNull()).drop("_s", "_c", "_rn")


def moving_average_edges(df: DataFrame, value: str, keys: list[str], order: str, radius: int, out: str = "smooth") -> DataFrame:
    """Centred mean whose radius shrinks towards both ends, so no row is dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("_last", F.count(F.lit(1)).over(Window.partitionBy(*keys)) - 1)
    own = own.withColumn("_r", F.least(F.lit(radius), F.col("_n"), F.col("_last") - F.col("_n")).cast("int"))
    near = F.collect_list(value).over(w.rowsBetween(-radius, radius))
    first = F.least(F.col("_n"), F.lit(radius)).cast("int")  # where the row itself stands in the frame
    part = F.slice(near, first - F.col("_r") + 1, 2 * F.col("_r") + 1)
    mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / (2 * F.col("_r") + 1)
    return own.withColumn(out, mean).drop("_n", "_last", "_r")


def rolling_signal(df: DataFrame, value: str, keys: list[str], order: str, radius: int) -> DataFrame:
    """``df`` with ``mean``, ``std`` and ``ratio`` of the frame [-radius, radius)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius - 1)
    own = df.withColumn("mean", F.avg(value).over(w)).withColumn("std", F.stddev_pop(value).over(w))
    return own.withColumn("ratio", F.when(F.col("std") > 0, F.col("mean") / F.col("std")))


def rolling_trend(df: DataFrame, value: str, x: str, keys: list[str], order: str, window: int) -> DataFrame:
    """``df`` with the regression slope over the ``window`` rows before each row (null without a full window)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    slope = F.regr_slope(F.col(value), F.col(x)).over(w)
    return df.withColumn("slope", F.when(F.count(F.lit(1)).over(w) == window, slope))


def flux_divergence(df: DataFrame, u: str, v: str, keys: list[str], out: str = "divergence") -> DataFrame:
    """u[i] - u[i+1] + v[j] - v[j+1]; 0 where the far face is missing."""
    own = df.withColumn("_e", at_offset(u, [*keys, "j"], "i", 1)).withColumn("_n", at_offset(v, [*keys, "i"], "j", 1))
    whole = F.col("_e").isNotNull() & F.col("_n").isNotNull()
    return own.withColumn(out, F.when(whole, F.col(u) - F.col("_e") + F.col(v) - F.col("_n")).otherwise(0.0)).drop("_e", "_n")


def to_face(df: DataFrame, value: str, keys: list[str], axis: str, n: int | None = None, out: str = "face") -> DataFrame:
    """Midpoint of a cell and the one before it; the first is copied, or with ``n`` (periodic) meets the last."""
    before = at_offset(value, keys, axis, -1)
    if n is not None:
        last = F.max_by(value, axis).over(Window.partitionBy(*keys))
        has_last = F.max(axis).over(Window.partitionBy(*keys)) == n - 1
        before = F.when((F.col(axis) == 0) & has_last, last).otherwise(before)
    return df.withColumn(out, F.when(before.isNull(), F.col(value)).otherwise((F.col(value) + before) / 2))


def smooth(df: DataFrame, value: str, keys: list[str], axis: str, n: int, sigma: float = 2.0, truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing along one index axis of length ``n``, reflecting at the ends; missing cells do not count.

    The sources of a cell, and those that the ends reflect to it, lie within
    the kernel's reach of it: one window over a range of the axis, no row is copied.
    """
    import math

    r = int(truncate * sigma + 0.5)
    whole = sum(math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1))
    gauss = lambda d: F.when(F.abs(d) <= r, F.exp(-0.5 * (d / sigma) * (d / sigma)) / whole).otherwise(0.0)
    turns = range(-((r + 2 * n) // (2 * n)), (r + 2 * n) // (2 * n) + 1)  # reflected: d c b a | a b c d | d c b a

    def weight(source):
        here = [source + 2 * n * m - F.col(axis) for m in turns] + [2 * n * m - 1 - source - F.col(axis) for m in turns]
        return sum((gauss(d) for d in here[1:]), gauss(here[0]))

    def add(acc, x):
        g = weight(x["at"])
        return F.struct((acc["a"] + x["v"] * g).alias("a"), (acc["b"] + g).alias("b"))

    near = Window.partitionBy(*keys).orderBy(axis).rangeBetween(-r, r)
    own = df.where(F.col(value).isNotNull()).withColumn("_near", F.collect_list(F.struct(F.col(axis).alias("at"), F.col(value).cast("double").alias("v"))).over(near))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    return own.select(*keys, axis, F.aggregate("_near", start, add, lambda acc: acc["a"] / acc["b"]).alias(value))


def wrap_columns(df: DataFrame, n: int, axis: str = "i", lon: str | None = None) -> DataFrame:
    """One more column each side of a periodic axis, with longitudes shifted by a turn."""
    shift = lambda rows, d: rows.withColumns({axis: F.col(axis) + F.lit(d)} | ({lon: F.col(lon) + (360.0 if d > 0 else -360.0)} if lon else {}))
    left, right = df.where(F.col(axis) == n - 1), df.where(F.col(axis) == 0)
    return df.unionByName(shift(left, -n)).unionByName(shift(right, n))


def split_axis(df: DataFrame, split: int, n: int, axis: str = "i") -> DataFrame:
    """Indices reordered so that ``split`` comes first."""
    return df.withColumn(axis, F.pmod(F.col(axis) - split, F.lit(n)).cast("int"))
