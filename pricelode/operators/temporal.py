"""Validity states, winners over time, calendars, streaks and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("current", "upcoming", "expired", "unknown")


def _base() -> Column:
    return F.col("valid_from").isNotNull() & F.col("valid_until").isNotNull()


def _app() -> Column:
    """The app's window counts only together with an app price."""
    return F.col("app_cents").isNotNull() & F.col("app_from").isNotNull() & F.col("app_until").isNotNull()


def base_current(day: Column) -> Column:
    return _base() & day.between(F.col("valid_from"), F.col("valid_until"))


def app_current(day: Column) -> Column:
    return _app() & day.between(F.col("app_from"), F.col("app_until"))


def state(day: Column) -> Column:
    """current, upcoming, expired or unknown; the first that holds.  Expired needs every complete window to be over."""
    no = F.lit(False)
    upcoming = F.coalesce(_base() & (F.col("valid_from") > day), no) | F.coalesce(_app() & (F.col("app_from") > day), no)
    over = F.coalesce(~_base() | (F.col("valid_until") < day), no) & F.coalesce(~_app() | (F.col("app_until") < day), no)
    now = F.coalesce(base_current(day), no) | F.coalesce(app_current(day), no)
    return F.when(now, "current").when(upcoming, "upcoming").when((_base() | _app()) & over, "expired").otherwise("unknown")


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by ``order``, which ends in something unique."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def winners(obs: DataFrame, day: Column) -> DataFrame:
    """The latest observation per state and identity; of equal times the larger id."""
    rated = obs.withColumn("state", state(day))
    return newest(rated, ["state", "chain", "store", "offer"], F.desc("collected_at"), F.desc("id"))


def expand_days(df: DataFrame, start: str, end: str, first: Column, last: Column, name: str = "on_day") -> DataFrame:
    """A row for each day of [first, last] on which [start, end] is open: the range join, without a nested loop."""
    a, b = F.greatest(F.col(start), first), F.least(F.col(end), last)
    return df.filter((F.col(start) <= last) & (F.col(end) >= first)).withColumn(name, F.explode(F.sequence(a, b)))


def interval_buckets(df: DataFrame, start: str, end: str, width: int = 8) -> DataFrame:
    """A row for each bucket of ``width`` days that the interval touches: the equi-key for interval joins."""
    number = lambda c: F.floor(F.unix_date(F.col(c)) / width)
    return df.withColumn("_bucket", F.explode(F.sequence(number(start), number(end))))


def islands(df: DataFrame, keys: list[str], day: str, gap: int = 1) -> DataFrame:
    """Runs of rows whose days follow each other at ``gap`` days: keys, first and last day, length."""
    w = Window.partitionBy(*keys).orderBy(day)
    broken = F.coalesce(F.datediff(day, F.lag(day).over(w)) != gap, F.lit(True)).cast("int")
    runs = df.select(*keys, day).distinct().withColumn("_new", broken).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("length")).drop("_run")


def trailing_streak(df: DataFrame, keys: list[str], order: list[Column], flag: Column) -> DataFrame:
    """How many of the last rows in a row have the flag."""
    w = Window.partitionBy(*keys).orderBy(*order)
    breaks = F.sum((~flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_breaks", breaks).groupBy(*keys).agg(F.count_if(F.col("_breaks") == 0).alias("streak"))


def last_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
