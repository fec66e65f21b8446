"""What is written: feature tables, histograms, values, region tables and the geometry of overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrespark.functions.tables import merged

#: Columns of the feature table before the neighbourhood features, in order.
BASE = ("fiber_key", "center_row", "center_col", "fiber_absolute_angle", "fiber_weight", "total_length", "end_to_end_length", "curvature", "width")
#: And after them.
BOUNDARY = ("nearest_distance_to_boundary", "inside_epicenter_region", "nearest_relative_boundary_angle", "extension_point_distance", "extension_point_angle", "boundary_point_col", "boundary_point_row")


def feature_columns(minimum_neighbors: int = 2, minimum_box: int = 32) -> list[str]:
    near = [minimum_neighbors * s for s in (1, 2, 4, 8)]
    box = [minimum_box * s for s in (1, 2, 4)]
    return [
        *(f"distance_to_nearest_{k}_fibers" for k in near), "distance_to_nearest_fiber_mean", "distance_to_nearest_fiber_std", *(f"fibers_within_box_density{b}" for b in box),
        *(f"alignment_of_nearest_{k}_fibers" for k in near), "alignment_mean", "alignment_std", *(f"fiber_alignment_in_box_{b}" for b in box),
    ]


def feature_table(fibers: DataFrame, features: DataFrame, association: DataFrame | None = None, minimum_neighbors: int = 2, minimum_box: int = 32) -> DataFrame:
    """The feature table: image_id and 34 columns in their fixed order; what wasn't measured is null."""
    have = set(fibers.columns)
    own = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    base = fibers.select(
        "image_id", "fiber_id", F.col("center_row"), F.col("center_col"), F.col("angle").alias("fiber_absolute_angle"), own("weight").alias("fiber_weight"),
        *[own(c).alias(c) for c in ("total_length", "end_to_end_length", "curvature", "width")],
    )
    out = base.join(merged(features), ["image_id", "fiber_id"])
    if association is not None:
        a = association.select(
            "image_id", "fiber_id", F.col("distance").alias(BOUNDARY[0]), F.col("region").cast("double").alias(BOUNDARY[1]), F.col("relative_angle").alias(BOUNDARY[2]),
            "extension_point_distance", "extension_point_angle", "boundary_point_col", "boundary_point_row",
        )
        out = out.join(merged(a), ["image_id", "fiber_id"], "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in BOUNDARY})
    return out.withColumnRenamed("fiber_id", "fiber_key").select("image_id", *BASE, *feature_columns(minimum_neighbors, minimum_box), *BOUNDARY)


def write_features(features: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """Partitioned by image, so that an image is read alone."""
    features.repartition("image_id").write.partitionBy("image_id").format(form).option("header", True).mode(mode).save(path)


def values(rows: DataFrame, angle: str, with_distance: bool) -> DataFrame:
    """Angles of included fibers, with their distance if asked."""
    kept = rows.where("included") if "included" in rows.columns else rows
    return kept.select("image_id", "fiber_id", F.col(angle).alias("angle"), *([F.col("distance")] if with_distance else []))


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.option("header", True).mode(mode).csv(path)


def _segment(kind: str, colour: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), colour.alias("color"), *[c.cast("double").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))]]


def fiber_segments(fibers: DataFrame, length: float, colour: Column | None = None) -> DataFrame:
    """Each fiber as a segment of twice ``length`` along its angle, x to the right and y down: green if included, red if not."""
    dx, dy = length * F.cos(F.radians("angle")), length * F.sin(F.radians("angle"))
    colour = colour if colour is not None else F.when(F.col("included"), "green").otherwise("red") if "included" in fibers.columns else F.lit("green")
    x, y = F.col("center_col"), F.col("center_row")
    return fibers.select("image_id", *_segment("fiber", colour, x - dx, y + dy, x + dx, y - dy))


def association_segments(rows: DataFrame) -> DataFrame:
    """Lines from included fibers to their boundary points."""
    kept = rows.where("included AND boundary_point_row IS NOT NULL")
    return kept.select("image_id", *_segment("association", F.lit("blue"), F.col("center_col"), F.col("center_row"), F.col("boundary_point_col"), F.col("boundary_point_row")))


def boundary_segments(points: DataFrame) -> DataFrame:
    """Outlines as segments between points that follow each other."""
    nxt = points.select("image_id", "roi_id", (F.col("seq") - 1).alias("seq"), F.col("row").alias("row2"), F.col("col").alias("col2"))
    return points.join(merged(nxt), ["image_id", "roi_id", "seq"]).select("image_id", *_segment("boundary", F.lit("yellow"), F.col("col"), F.col("row"), F.col("col2"), F.col("row2")))


def overlay(association: DataFrame, points: DataFrame | None = None, length: float = 4.0) -> DataFrame:
    """All segments of an image's overlay: image_id, kind, color, x1, y1, x2, y2."""
    out = fiber_segments(association, length)
    if points is not None:
        out = out.unionByName(association_segments(association)).unionByName(boundary_segments(points))
    return out


def roi_labels(summary: DataFrame) -> DataFrame:
    """Where the number of each region is written, with its axis as a segment of 20 pixels to both sides."""
    dx, dy = 20 * F.cos(F.radians("orientation")), 20 * F.sin(F.radians("orientation"))
    x, y = F.col("center_col"), F.col("center_row")
    return summary.where("center_row IS NOT NULL").select("image_id", "roi_id", *_segment("axis", F.lit("white"), x - dx, y + dy, x + dx, y - dy))
