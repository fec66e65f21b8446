"""Whole analyses: from images or fibers to feature tables, histograms, maps, overlays and region tables, for any number of images at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibrespark.operators import boundary, coefficients, curvelet, curvelet3d, grouping, heatmap, neighbors, roi, sinks, statistics


class AnalysisError(Exception):
    """An analysis that can't be set up."""


class ParameterError(AnalysisError):
    """Parameters that don't fit together."""


@dataclass(frozen=True)
class CurveletParameters:
    keep: float = 0.05
    scale: int = 1  # 1: the second finest
    radius: float = 10.0
    coarse_wedges: int = 16


@dataclass(frozen=True)
class FeatureParameters:
    minimum_nearest_fibers: int = 2
    minimum_box_size: int = 32


@dataclass(frozen=True)
class BoundaryParameters:
    distance_threshold: float = 100.0
    min_distance: float | None = None
    exclude_fibers_in_mask: bool = True
    origin: int = 0


@dataclass(frozen=True)
class MapParameters:
    circular: int = 19
    square: int = 12
    sigma: float = 4.0


@dataclass(frozen=True)
class AnalysisParameters:
    height: int
    width: int
    curvelet: CurveletParameters = field(default_factory=CurveletParameters)
    features: FeatureParameters = field(default_factory=FeatureParameters)
    boundary: BoundaryParameters = field(default_factory=BoundaryParameters)
    map: MapParameters = field(default_factory=MapParameters)

    def __post_init__(self):
        if self.height < 1 or self.width < 1:
            raise ParameterError("height and width must be positive")
        if not 0 < self.curvelet.keep <= 1:
            raise ParameterError("keep must be in (0, 1]")


def extract_fibers(images: DataFrame, parameters: AnalysisParameters) -> DataFrame:
    """Images (image_id, height, width, pixels) to fibers: transform, keep the strongest coefficients, place them, group them, leave the border out."""
    return fibers_of_coefficients(curvelet.transform_images(images, parameters.curvelet.scale, parameters.curvelet.coarse_wedges), parameters)


def extract_fibers_of_bands(bands: DataFrame, parameters: AnalysisParameters) -> DataFrame:
    """The same for images too large for a task, given as bands of pixel rows (image_id, first_row, height, width, pixels)."""
    planes = curvelet3d.transform_bands(bands, None, parameters.curvelet.coarse_wedges)
    return fibers_of_coefficients(curvelet3d.band_coefficients(planes, parameters.curvelet.scale), parameters)


def fibers_of_coefficients(coeffs: DataFrame, parameters: AnalysisParameters) -> DataFrame:
    c = parameters.curvelet
    kept = coeffs.join(coefficients.keep_threshold(coeffs, c.keep), "image_id").where("value >= threshold AND value <> 0 AND wedge < n_wedges / 2")
    at = lambda size, step, i, n: F.floor(1 + size * (F.col(step) * (F.col(i) + 1 - F.ceil((F.col(n) + 1) / 2)) + 0.5) + 0.5)
    from fibrespark.functions.angles import wedge_angle

    points = kept.select(
        "image_id", "wedge", "k1", "k2", (F.col("wedge").cast("long") * 1_000_000_000 + F.col("k1") * 30_000 + F.col("k2")).alias("seed"),
        at(parameters.height, "sx", "k1", "nx").alias("center_row"), at(parameters.width, "sy", "k2", "ny").alias("center_col"), wedge_angle(F.col("wedge"), F.col("n_wedges")).alias("angle"),
    )
    n = curvelet.wedges_at(max(0, curvelet.number_of_scales(parameters.height, parameters.width) - 1 - c.scale), curvelet.number_of_scales(parameters.height, parameters.width), c.coarse_wedges)
    return coefficients.inside_edges(grouping.group_curvelets(points, c.radius, 360.0 / n), parameters.height, parameters.width)


@dataclass(frozen=True)
class Analysis:
    """Lazy tables of one analysis; each is computed when it is written."""

    features: DataFrame
    histogram: DataFrame
    values: DataFrame
    map: DataFrame
    overlay: DataFrame
    roi_details: DataFrame | None = None
    roi_summary: DataFrame | None = None
    roi_labels: DataFrame | None = None

    def write(self, path: str, mode: str = "overwrite") -> None:
        sinks.write_features(self.features, f"{path}/features", mode=mode)
        for name in ("histogram", "values", "map", "overlay", "roi_details", "roi_summary", "roi_labels"):
            if (table := getattr(self, name)) is not None:
                table.write.mode(mode).parquet(f"{path}/{name}")


def analyze_fibers(fibers: DataFrame, parameters: AnalysisParameters, points: DataFrame | None = None, mask: DataFrame | None = None) -> Analysis:
    """Fibers to all tables; with outlines (and a mask; else the outlines' insides) also their association with boundaries and the region tables."""
    p, h, w = parameters, parameters.height, parameters.width
    features = neighbors.fiber_features(fibers, p.features.minimum_nearest_fibers, p.features.minimum_box_size)
    if points is None:
        table = sinks.feature_table(fibers, features, None, p.features.minimum_nearest_fibers, p.features.minimum_box_size)
        raw = heatmap.raw_map(fibers, h, w)
        mapped = heatmap.processed_map(raw, h, w, p.map.circular, p.map.square, p.map.sigma)
        return Analysis(table, statistics.angle_histogram(fibers), sinks.values(fibers, "angle", False), mapped.withColumn("color", heatmap.colour(F.col("value"), False)), sinks.overlay(fibers))
    if mask is None:
        mask = roi.mask_of_polygons(points, h, w)
    b = p.boundary
    near = boundary.global_association(fibers, points, mask, h, w, b.distance_threshold, b.min_distance, b.exclude_fibers_in_mask, b.origin)
    table = sinks.feature_table(fibers, features, near, p.features.minimum_nearest_fibers, p.features.minimum_box_size)
    included = near.where("included")
    raw = heatmap.raw_map(included, h, w, "relative_angle", 90.0)
    mapped = heatmap.processed_map(raw, h, w, None, p.map.square, p.map.sigma)
    details = roi.roi_alignment(fibers, points, h, w, b.distance_threshold, b.origin)
    summary = roi.roi_summary(details, points, h, w)
    return Analysis(
        table, statistics.angle_histogram(included, "relative_angle", 90.0), sinks.values(near, "relative_angle", True), mapped.withColumn("color", heatmap.colour(F.col("value"), True)),
        sinks.overlay(near, points), details, summary, sinks.roi_labels(summary),
    )


def analyze_images(images: DataFrame, parameters: AnalysisParameters, points: DataFrame | None = None, mask: DataFrame | None = None) -> Analysis:
    return analyze_fibers(extract_fibers(images, parameters), parameters, points, mask)


@dataclass(frozen=True)
class StackAnalysis:
    """Lazy tables of stacks: the directions of their strongest coefficients, and the slices put together from what was kept."""

    orientations: DataFrame
    slices: DataFrame


def analyze_stacks(slices: DataFrame, scale: int = 2, percent: float = 1.0, share: float = 0.9999, scales: int = curvelet3d.SCALES, coarse_wedges: int = curvelet3d.COARSE_WEDGES) -> StackAnalysis:
    """Stacks (image_id, z, height, width, pixels) to the orientations of one scale's strongest wedges and the reconstruction from all coefficients."""
    if not 0 < scale < scales - 1:
        raise ParameterError("scale must be one that has directions")
    planes = curvelet3d.transform_stacks(slices, scales, coarse_wedges)
    return StackAnalysis(coefficients.orientations3d(curvelet3d.coefficient_rows(planes, scale), scale, percent, share), curvelet3d.reconstruct_stacks(planes, scales, coarse_wedges))
