"""Descriptors of samples in rows, as window expressions: no row leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def onset_envelope(rows: DataFrame, key: str, order: list[str], value: str, around: int = 25) -> DataFrame:
    """Rises of a value, less their mean over `around` rows on either side, at least 0."""
    by = Window.partitionBy(key).orderBy(*order)
    rise = F.greatest(F.col(value) - F.lag(value, 1).over(by), F.lit(0.0))
    flux = rows.withColumn("flux", F.coalesce(rise, F.lit(0.0)))
    return flux.withColumn("onset", F.greatest(F.col("flux") - F.avg("flux").over(by.rowsBetween(-around, around)), F.lit(0.0)))


def zero_crossing_rate(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """The share of steps at which the value's sign changes."""
    by = Window.partitionBy(key).orderBy(*order)
    signed = rows.withColumn("up", (value >= 0).cast("int")).withColumn("crossed", (F.col("up") != F.lag("up", 1).over(by)).cast("int"))
    return signed.groupBy(key).agg(F.coalesce(F.avg("crossed"), F.lit(0.0)).alias("zero_crossing_rate"), F.count("*").alias("n"))


def dynamic_complexity(levels: DataFrame, key: str, level: str, gate: float = -70.0) -> DataFrame:
    """Mean absolute deviation of block levels above the gate; null under two blocks."""
    open_ = levels.where(F.col(level) > gate)
    mean = open_.groupBy(key).agg(F.avg(level).alias("mean"))
    each = open_.join(mean, key)
    return each.groupBy(key).agg(F.when(F.count("*") >= 2, F.avg(F.abs(F.col(level) - F.col("mean")))).alias("dynamic_complexity"))


def onset_rate(envelope: DataFrame, key: str, order: list[str], value: str, fps: float = 100.0, around: int = 3, apart: float = 0.05) -> DataFrame:
    """Peaks a second of an envelope: values over its mean and deviation that none of
    `around` rows on either side exceeds, each at least `apart` seconds after the last
    one taken; 0 under three rows. A key is one excerpt, so its peaks fit a row; nulls count as 0."""
    by, whole = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key)
    v = F.coalesce(F.col(value), F.lit(0.0)).alias("v")
    placed = envelope.select(key, v, F.row_number().over(by).alias("place"), F.max(v).over(by.rowsBetween(-around, around)).alias("top"), (F.avg(v).over(whole) + F.stddev_pop(v).over(whole)).alias("level"))
    peak = F.when((F.col("v") > F.col("level")) & (F.col("v") >= F.col("top")), F.col("place"))
    peaks = placed.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(peak)).alias("at"))
    gap = math.ceil(apart * fps)
    start = F.struct(F.lit(0).alias("taken"), F.lit(-gap).alias("last"))
    taken = F.aggregate("at", start, lambda s, t: F.when(t - s["last"] >= gap, F.struct((s["taken"] + 1).alias("taken"), t.alias("last"))).otherwise(s))
    return peaks.select(key, "n", F.when(F.col("n") >= 3, taken["taken"] * F.lit(fps) / F.col("n")).otherwise(F.lit(0.0)).alias("onset_rate"))
