"""Calendar aggregation: annual means, climatologies, daily to monthly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.expr import days_in_month
from strataframe.operators.agg import wavg


def month_days(time: str = "t", leap: bool = True) -> Column:
    return days_in_month(F.year(time), F.month(time), leap)


def annual(df: DataFrame, keys: list[str], values: list[str], time: str = "t", leap: bool = True, complete: bool = True) -> DataFrame:
    """Day-weighted annual means of monthly rows; years without 12 months are dropped if ``complete``."""
    own = df.withColumn("_w", month_days(time, leap)).groupBy(*keys, F.year(time).alias("year"))
    out = own.agg(*[wavg(v, "_w").alias(v) for v in values], F.count_distinct(F.month(time)).alias("_n"))
    return (out.where("_n = 12") if complete else out).drop("_n")


def annual_blocks(df: DataFrame, keys: list[str], value: str, time: str = "t", size: int = 12) -> DataFrame:
    """Plain means of consecutive blocks of ``size`` rows (360-day years), stamped with the 7th; a short last block is dropped."""
    w = Window.partitionBy(*keys).orderBy(time)
    own = df.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_rn") / size).cast("int"))
    out = own.groupBy(*keys, "_b").agg(F.avg(value).alias(value), F.max_by(time, F.col("_rn") % size == 6).alias(time), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == size).select(*keys, time, value)


def to_month(df: DataFrame, keys: list[str], value: str, time: str = "t") -> DataFrame:
    return df.groupBy(*keys, F.trunc(F.col(time).cast("date"), "MM").alias("month")).agg(F.avg(value).alias(value))


def climatology(df: DataFrame, keys: list[str], values: list[str], time: str = "t", first: int | None = None, last: int | None = None) -> DataFrame:
    """Means by calendar month over years."""
    own = df if first is None else df.where(F.year(time).between(first, last))
    return own.groupBy(*keys, F.month(time).alias("month")).agg(*[F.avg(v).alias(v) for v in values])


def daily_climatology(df: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """Means by day of a year without leap day; 29 February is dropped."""
    leap_day = (F.month(time) == 2) & (F.dayofmonth(time) == 29)
    after = (F.month(time) > 2) & (F.dayofyear(F.make_date(F.year(time), F.lit(12), F.lit(31))) == 366)
    return df.where(~leap_day).groupBy(*keys, (F.dayofyear(time) - after.cast("int")).alias("day")).agg(F.avg(value).alias(value))


def long_term_mean(df: DataFrame, keys: list[str], values: list[str], first: int, last: int, time: str = "t", weighted: bool = True, leap: bool = True) -> DataFrame:
    own = df.where(F.year(time).between(first, last)).withColumn("_w", month_days(time, leap) if weighted else F.lit(1))
    return own.groupBy(*keys).agg(*[wavg(v, "_w").alias(v) for v in values])


def anomalies(df: DataFrame, keys: list[str], value: str, time: str = "t") -> DataFrame:
    """``df`` with ``anomaly``: the value minus its calendar-month mean."""
    return df.withColumn("anomaly", F.col(value) - F.avg(value).over(Window.partitionBy(*keys, F.month(time))))
