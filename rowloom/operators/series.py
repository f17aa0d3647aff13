"""Series of values at whole positions: smoothing, the best lag, the widest run above a threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense(series: DataFrame, group: list[str], position: str, value: str) -> DataFrame:
    """A row for every position between a group's first and last one, 0 where there was none."""
    ends = series.groupBy(*group).agg(F.min(position).alias("_a"), F.max(position).alias("_b"))
    every = ends.select(*group, F.explode(F.sequence("_a", "_b")).alias(position))
    return every.join(series.select(*group, position, value), [*group, position], "left").withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))


def smoothed(series: DataFrame, group: list[str], position: str, value: str, reach: int = 24, sigma: float = 8.0) -> DataFrame:
    """``series`` with ``smooth``: the neighbours within ``reach``, weighted by a bell curve; what lies beyond an end counts as 0."""
    total = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1))
    frame = Window.partitionBy(*group).orderBy(position).rangeBetween(-reach, reach)
    near = F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v"))).over(frame)
    weighted = F.transform("_near", lambda x: x["v"] * F.exp(F.pow((x["p"] - F.col(position)) / sigma, 2) * -0.5))
    return series.withColumn("_near", near).withColumn("smooth", F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x) / total).drop("_near")


def best_lag(series: DataFrame, group: list[str], position: str, value: str, low: int = 25, high: int = 55, inside: tuple[float, float] = (0.27, 0.90), default: int = 36) -> DataFrame:
    """The lag at which each group's values are most like themselves: group, lag, correlation.

    Positions count from 0 in each group; pairs lie between the two shares of its length. Of equal
    correlations, to nine decimals, the smallest lag wins; ``default`` where nothing can be compared.
    """
    whole = Window.partitionBy(*group)
    zero = series.withColumns({"_q": F.col(position) - F.min(position).over(whole), "_h": F.max(position).over(whole) - F.min(position).over(whole) + 1})
    zero = zero.select(*group, "_q", F.floor(F.col("_h") * inside[0]).alias("_lo"), F.floor(F.col("_h") * inside[1]).alias("_hi"), F.col(value).alias("_a"))
    later = zero.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_q").alias("_q2"), F.col("_a").alias("_b"))
    first = zero.filter("_q >= _lo").withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high)))).filter(F.col("_q") + F.col("lag") < F.col("_hi"))
    same = F.col("_q2") == F.col("_q") + F.col("lag")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    top = F.sum(F.col("_a") * F.col("_b")) / F.sqrt(F.greatest(F.lit(1e-9), F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b"))))
    lags = first.join(later, same).groupBy(*group, "lag").agg(F.round(top, 9).alias("correlation")).filter("correlation > -1")
    best = lags.groupBy(*group).agg(F.max_by(F.struct("lag", "correlation"), F.struct(F.col("correlation"), -F.col("lag"))).alias("_best"))
    return series.select(*group).distinct().join(best, group, "left").select(*group, F.coalesce("_best.lag", F.lit(default)).alias("lag"), F.col("_best.correlation").alias("correlation"))


def widest_run(series: DataFrame, group: list[str], position: str, passes: Column, low: Column, high: Column, least: int = 4) -> DataFrame:
    """The widest run of neighbouring positions from ``low`` to below ``high`` that pass: group, start, stop (exclusive), width; nulls where none has ``least``.

    Of equal widths the first. Islands by the difference of position and rank; a missing position ends a run.
    """
    kept = series.filter((F.col(position) >= low) & (F.col(position) < high) & passes)
    island = F.col(position) - F.row_number().over(Window.partitionBy(*group).orderBy(position))
    runs = kept.withColumn("_island", island).groupBy(*group, "_island").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("stop"), F.count("*").alias("width"))
    best = runs.filter(F.col("width") >= least).groupBy(*group).agg(F.max_by(F.struct("start", "stop", "width"), F.struct(F.col("width"), -F.col("start"))).alias("_best"))
    return series.select(*group).distinct().join(best, group, "left").select(*group, "_best.start", "_best.stop", "_best.width")
