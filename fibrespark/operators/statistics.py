"""Histograms and summary statistics of angles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fibrespark.functions.angles import resultant_length


def angle_histogram(angles: DataFrame, value: str = "angle", full: float = 180.0, mode: str = "edges", by: tuple[str, ...] = ("image_id",), first: float = 2.5, step: float = 5.0) -> DataFrame:
    """(by..., bin, center, count): counts of five-degree bins, empty ones included.

    ``edges``: bins lie between first, first + step, ... below ``full``; the last is closed on the right; values outside are dropped.
    ``centers``: first, first + step, ... are the bins' centres and the outer bins take what lies beyond.
    """
    marks = int(-(-(full - first) // step))
    x = (F.col(value) - first) / step
    if mode == "edges":
        n, bin_ = marks - 1, F.least(F.floor(x), F.lit(marks - 2))
        inside = (F.col(value) >= first) & (F.col(value) <= first + step * (marks - 1))
        middle = first + step / 2
    else:
        n, bin_ = marks, F.greatest(F.lit(0), F.least(F.floor(x + 0.5), F.lit(marks - 1)))
        inside, middle = F.col(value).isNotNull(), first
    counted = angles.where(inside).groupBy(*by, bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = angles.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = grid.join(counted, [*by, "bin"], "left")
    return out.select(*by, "bin", (F.lit(middle) + F.col("bin") * step).alias("center"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def angle_statistics(angles: DataFrame, value: str = "angle", by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Number, mean, median, variance and deviation (n - 1), alignment, skewness and kurtosis (3 for a normal distribution), per group."""
    v = F.col(value)
    return angles.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("std"),
        resultant_length(F.radians(v) * 2).alias("alignment"), F.skewness(v).alias("skewness"), (F.kurtosis(v) + 3).alias("kurtosis"),
    )


def uniformity_test(angles: DataFrame, value: str = "angle", by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(by..., n, m, p): the omnibus test of Hodges and Ajne for orientations: m is the least number of angles in any quarter turn, p how likely it is that few without a direction.

    A quarter turn holds the same angles until it passes one at either end, so those that begin at an angle, or at a right angle to one, are all there are. Equal angles are counted
    before they are put in order; a group's distinct angles are one window. Up to 50 angles p is exact, beyond by its limit.
    """
    counted = angles.where(F.col(value).isNotNull()).groupBy(*by, F.pmod(F.col(value).cast("double"), F.lit(180.0)).alias("a")).agg(F.count(F.lit(1)).alias("w"))
    zero = F.lit(0).cast("long")
    places = F.array(
        F.struct(F.col("a"), F.col("w"), F.lit(True).alias("begins")), F.struct((F.col("a") + 180).alias("a"), F.col("w"), F.lit(False).alias("begins")),
        F.struct(F.pmod(F.col("a") + 90, F.lit(180.0)).alias("a"), zero.alias("w"), F.lit(True).alias("begins")),
    )
    each = counted.select(*by, F.explode(places).alias("x")).select(*by, "x.*")
    order = Window.partitionBy(*by).orderBy("a")
    held = F.sum("w").over(order.rangeBetween(0, 90)) - F.coalesce(F.sum("w").over(order.rangeBetween(90, 90)), zero)
    least = each.withColumn("held", held).where("begins").groupBy(*by).agg(F.sum("w").alias("n"), F.min("held").alias("m"))
    n, m = F.col("n"), F.col("m")
    choices = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(m, F.lit(1).cast("long"))), F.lit(1.0), lambda c, k: F.when(m == 0, c).otherwise(c * (n - m + k) / k))
    exact = F.pow(F.lit(2.0), 1 - n) * (n - 2 * m) * choices
    a = math.pi * F.sqrt(n) / (2 * (n - 2 * m))
    limit = math.sqrt(2 * math.pi) / a * F.exp(-(math.pi**2) / (8 * a * a))
    p = F.when(n == 2 * m, 1.0).when(n <= 50, exact).otherwise(limit)
    return least.select(*by, "n", "m", F.least(F.lit(1.0), p).alias("p"))
