"""Regions: filled masks, properties, alignment of fibers to regions and roll-ups. Outlines: image_id, roi_id, seq, row, col."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fibrespark.functions.angles import centers_line, fold90
from fibrespark.functions.tables import merged

from .boundary import nearest_point, with_edge_angle, with_slopes


def polygon_runs(points: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """(image_id, roi_id, row, first, last): runs of pixels whose centre is inside the closed polygon by the even-odd rule.

    Each edge sends one crossing to every pixel row that it spans; crossings of a row are paired in order. Work grows with the outline, and a row of a region is the largest group.
    """
    order = Window.partitionBy("image_id", "roi_id").orderBy("seq")
    ends = points.withColumns({"r2": F.lead("row").over(order), "c2": F.lead("col").over(order), "fr": F.first("row").over(order), "fc": F.first("col").over(order)})
    edges = ends.select("image_id", "roi_id", F.col("row").cast("double").alias("r1"), F.col("col").cast("double").alias("c1"), F.coalesce("r2", "fr").cast("double").alias("r2"), F.coalesce("c2", "fc").cast("double").alias("c2"))
    low, high = F.least("r1", "r2"), F.greatest("r1", "r2")
    spans = edges.where(F.col("r1") != F.col("r2")).where(F.ceil(low) < high)  # rows r with low <= r < high
    crossed = spans.withColumn("row", F.explode(F.sequence(F.ceil(low), F.ceil(high) - 1)))
    at = F.col("c1") + (F.col("row") - F.col("r1")) * (F.col("c2") - F.col("c1")) / (F.col("r2") - F.col("r1"))
    crossings = crossed.select("image_id", "roi_id", "row", at.alias("x"))
    lists = crossings.groupBy("image_id", "roi_id", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = lists.select("image_id", "roi_id", "row", F.explode(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1)).alias("k"), "xs")
    first, last = F.ceil(F.get("xs", F.col("k") * 2)), F.ceil(F.get("xs", F.col("k") * 2 + 1)) - 1
    if width is not None:
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(width - 1))
    out = pairs.select("image_id", "roi_id", "row", first.alias("first"), last.alias("last")).where("first <= last")
    if height is not None:
        out = out.where((F.col("row") >= 0) & (F.col("row") < height))
    return out


def polygon_mask(points: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """(image_id, roi_id, row, col): the pixels of ``polygon_runs``."""
    return polygon_runs(points, height, width).select("image_id", "roi_id", "row", F.explode(F.sequence("first", "last")).alias("col"))


def mask_of_polygons(points: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """(image_id, row, first, last): the disjoint runs of pixels that any of an image's polygons holds. Pixels of many regions are never rows."""
    order = Window.partitionBy("image_id", "row").orderBy("first")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = polygon_runs(points, height, width).select("image_id", "row", "first", "last")
    begins = F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True))
    runs = runs.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("image_id", "row", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def region_properties(pixels: DataFrame) -> DataFrame:
    """(image_id, roi_id, roi_row, roi_col, area, orientation): centroid, number of pixels, and the main axis in [0, 180) from the second central moments, each pixel a unit square."""
    m = pixels.groupBy("image_id", "roi_id").agg(
        F.avg("row").alias("roi_row"), F.avg("col").alias("roi_col"), F.count(F.lit(1)).alias("area"),
        (F.var_pop("row") + 1 / 12).alias("vr"), (F.var_pop("col") + 1 / 12).alias("vc"), F.covar_pop("row", "col").alias("cv"),
    )
    # what is left of a sum that should be 0 is 0, or the axis of a symmetric region would be left to rounding
    spread = 1e-9 * (F.col("vr") + F.col("vc"))
    cv = F.when(F.abs("cv") <= spread, 0.0).otherwise(F.col("cv"))
    apart = F.when(F.abs(F.col("vr") - F.col("vc")) <= spread, 0.0).otherwise(F.col("vr") - F.col("vc"))
    # angle of the main axis from the row axis, half the angle of the moments; of a region without a main axis -45
    turn = F.when((apart == 0) & (cv <= 0), -45.0).otherwise(F.degrees(0.5 * F.atan2(2 * cv, apart)))
    # counted counter-clockwise from the column axis, rows pointing down
    return m.select("image_id", "roi_id", "roi_row", "roi_col", "area", F.pmod(turn + 90, F.lit(180.0)).alias("orientation"))


def roi_alignment(fibers: DataFrame, points: DataFrame, height: int, width: int, threshold: float | None = 100.0, origin: int = 0, slopes: bool = True) -> DataFrame:
    """One row per region and fiber within the threshold of its outline (every fiber, at the outline's first point and without a distance, if the threshold is None).

    angle_to_boundary_edge, angle_to_boundary_center (to the region's axis), angle_to_center_line (to the line between the centres), all of the fiber; fiber
    centre and angle, distance and boundary point. Region properties are computed once per region and joined.
    """
    f = fibers.select("image_id", "fiber_id", F.col("center_row").cast("double"), F.col("center_col").cast("double"), F.col("angle").cast("double"))
    if threshold is None:
        first = points.groupBy("image_id", "roi_id").agg(F.min(F.struct("seq", "row", "col")).alias("p"))
        near = f.join(merged(first), "image_id").select(
            "image_id", "roi_id", "fiber_id", "center_row", "center_col", "angle", F.lit(None).cast("double").alias("distance"),
            F.col("roi_id").alias("boundary_roi"), F.col("p.seq").alias("boundary_seq"), F.col("p.row").alias("boundary_point_row"), F.col("p.col").alias("boundary_point_col"),
        )
    else:
        near = nearest_point(f, points, ("image_id", "roi_id"), threshold)
    if slopes:
        near = with_edge_angle(with_slopes(near, points), height, width, origin).withColumnRenamed("relative_angle", "angle_to_boundary_edge")
    props = region_properties(polygon_mask(points, height, width))
    out = near.join(merged(props), ["image_id", "roi_id"], "left")
    line = centers_line(F.col("center_row") - F.col("roi_row"), F.col("center_col") - F.col("roi_col"))
    out = out.withColumns({"angle_to_boundary_center": fold90(F.col("angle"), F.col("orientation")), "angle_to_center_line": fold90(F.col("angle"), line)})
    edge = ["angle_to_boundary_edge"] if slopes else []
    return out.select(
        "image_id", "roi_id", "fiber_id", *edge, "angle_to_boundary_center", "angle_to_center_line", F.col("center_row").alias("fiber_center_row"), F.col("center_col").alias("fiber_center_col"),
        F.col("angle").alias("fiber_angle"), "distance", "boundary_point_row", "boundary_point_col",
    )


def roi_summary(details: DataFrame, points: DataFrame, height: int, width: int) -> DataFrame:
    """One row per region: centre, orientation, area, means of its fibers' angles and their number (null and 0 where there is none), and status: ok, or no-area."""
    angles = [c for c in ("angle_to_boundary_edge", "angle_to_boundary_center", "angle_to_center_line") if c in details.columns]
    means = details.groupBy("image_id", "roi_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in angles])
    props = region_properties(polygon_mask(points, height, width))
    every = points.select("image_id", "roi_id").distinct()
    out = every.join(merged(props), ["image_id", "roi_id"], "left").join(merged(means), ["image_id", "roi_id"], "left")
    return out.select(
        "image_id", "roi_id", F.col("roi_row").alias("center_row"), F.col("roi_col").alias("center_col"), "orientation", "area", *[f"mean_{c}" for c in angles],
        F.coalesce("n", F.lit(0)).cast("long").alias("number_of_fibers"), F.when(F.col("area").isNull(), "no-area").otherwise("ok").alias("status"),
    )
