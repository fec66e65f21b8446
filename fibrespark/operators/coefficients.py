"""Curvelet coefficients as rows: thresholds, wedges, centres, orientations. 2-D: image_id, wedge, k1, k2, value (magnitude)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fibrespark.functions.angles import azimuth, direction, polar_angle

BINS = 101


def keep_threshold(coeffs: DataFrame, keep: float, bins: int = BINS) -> DataFrame:
    """(image_id, threshold): centre of the first of ``bins`` bins, centred on 0 ... the largest magnitude, at which the running count exceeds 1 - keep of all.

    Counts are aggregated to at most ``bins`` rows per image before anything runs in order.
    """
    top = coeffs.groupBy("image_id").agg(F.max("value").alias("top"), F.count("value").alias("n"))
    with_top = coeffs.join(top, "image_id")
    step = F.col("top") / (bins - 1)
    bin_ = F.when(F.col("top") > 0, F.least(F.lit(bins - 1), F.floor(F.col("value") / step + 0.5))).otherwise(0)
    counts = with_top.where(F.col("value").isNotNull()).groupBy("image_id", "top", "n", bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    running = Window.partitionBy("image_id").orderBy("bin")
    over = counts.withColumn("upto", F.sum("c").over(running)).where(F.col("upto") > (1 - keep) * F.col("n"))
    return over.groupBy("image_id").agg((F.min("bin") * F.first("top") / (bins - 1)).alias("threshold"))


def kept_coefficients(coeffs: DataFrame, keep: float, n_wedges: int | None = None) -> DataFrame:
    """Rows at or above the threshold and not zero; with ``n_wedges`` only of its first half, the other half being the same orientations."""
    out = coeffs.join(keep_threshold(coeffs, keep), "image_id").where((F.col("value") >= F.col("threshold")) & (F.col("value") != 0))
    return out.where(F.col("wedge") < n_wedges // 2) if n_wedges else out


def inside_edges(points: DataFrame, height: int, width: int) -> DataFrame:
    """Points further from the image's border than a hundredth of its shorter side, rounded up."""
    edge = -(-min(height, width) // 100)
    inside = lambda c, n: (F.col(c) > edge) & (F.col(c) < n - edge)
    return points.where(inside("center_row", height) & inside("center_col", width))


def wedge_means(coeffs: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return coeffs.groupBy(*by, "wedge").agg(F.avg(F.abs("value")).alias("mean_magnitude"))


def top_wedges(means: DataFrame, percent: float, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The int(percent / 100 * n) wedges of largest mean, ties by wedge; none where that is 0."""
    order = Window.partitionBy(*by).orderBy(F.col("mean_magnitude").desc(), "wedge")
    ranked = means.withColumn("rank", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return ranked.where(F.col("rank") <= F.floor(F.lit(percent) / 100 * F.col("_n"))).drop("_n")


def above_percentile(coeffs: DataFrame, share: float = 0.9999, by: tuple[str, ...] = ("image_id", "wedge")) -> DataFrame:
    """Rows above their wedge's percentile (exact, interpolated), which is added as threshold."""
    limits = coeffs.groupBy(*by).agg(F.percentile(F.abs("value"), F.lit(share)).alias("threshold"))
    return coeffs.join(limits, list(by)).where(F.abs("value") > F.col("threshold"))


def orientations3d(coeffs: DataFrame, scale: int | Column, percent: float, share: float = 0.9999) -> DataFrame:
    """Places of the strongest coefficients of the strongest wedges with their direction: image_id, wedge, k1, k2, k3, x, y, z."""
    chosen = top_wedges(wedge_means(coeffs), percent).select("image_id", "wedge")
    strong = above_percentile(coeffs.join(chosen, ["image_id", "wedge"]), share)
    s = F.lit(scale) if isinstance(scale, int) else scale
    x, y, z = direction(polar_angle(s), azimuth(s, F.col("wedge")))
    return strong.select("image_id", "wedge", "k1", "k2", "k3", x.alias("x"), y.alias("y"), z.alias("z"))
