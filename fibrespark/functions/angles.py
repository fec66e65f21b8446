"""Angles and rounding as column expressions. Angles are degrees unless a name says radians; orientations have a period of 180."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def resultant_length(radians: Column, weight: Column | None = None, spacing: float = 0.0) -> Column:
    """Aggregate: length of the mean resultant vector; ``spacing`` (radians) corrects for binned angles."""
    w = F.lit(1.0) if weight is None else weight
    # a weight of a null angle doesn't count
    total = F.sum(F.when(radians.isNotNull(), w))
    length = F.sqrt(F.pow(F.sum(w * F.cos(radians)), 2) + F.pow(F.sum(w * F.sin(radians)), 2)) / F.when(total != 0, total)
    return length * (spacing / (2 * math.sin(spacing / 2))) if spacing else length


def alignment(degrees: Column, weight: Column | None = None) -> Column:
    """Aggregate: alignment of orientations in [0, 1]."""
    return resultant_length(2 * F.radians(degrees), weight)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def round_half_even(x: Column) -> Column:
    return F.rint(x)


def fold90(a: Column, b: Column) -> Column:
    """Acute difference of two directions given in [0, 180]."""
    d = F.abs(a - b)
    return F.when(d > 90, 180 - d).otherwise(d)


def edge_angle(fiber: Column, slope: Column) -> Column:
    """Angle between an orientation and an outline whose slope is measured from the row axis."""
    return F.degrees(F.asin(F.least(F.lit(1.0), F.abs(F.cos(F.radians(fiber - slope))))))


def on_image_edge(row: Column, col: Column, height: Column, width: Column, origin: int = 0) -> Column:
    """Whether a point lies on the image's border, with the first pixel at ``origin``."""
    low = origin
    return (row == low) | (col == low) | (row == height - 1 + origin) | (col == width - 1 + origin)


def centers_line(d_row: Column, d_col: Column) -> Column:
    """Direction of the line between two centres, in [0, 180]; null for one point."""
    t = F.degrees(F.atan(d_row / F.when(d_col != 0, d_col)))
    steep = F.when(d_row > 0, 90.0).when(d_row < 0, -90.0)
    t = F.coalesce(t, steep)
    return F.when(t < 0, -t).otherwise(180 - t)


def wrap180(a: Column) -> Column:
    return F.pmod(a + 180, F.lit(180.0))


def wedge_angle(wedge: Column, n_wedges: int | Column) -> Column:
    """Orientation of a curvelet wedge, counted from 0."""
    inc = 360.0 / n_wedges if isinstance(n_wedges, int) else F.lit(360.0) / n_wedges
    a = 225 - inc * (wedge + 0.5)
    a = F.when(a < 0, a + 360).otherwise(a)
    return F.when(a > 225, a - 180).when(a < 45, a + 180).otherwise(a)


def polar_angle(scale: Column) -> Column:
    """Polar angle in radians of a 3-D scale."""
    return F.pow(F.lit(2.0), -scale / 2.0)


def azimuth(scale: Column, wedge: Column) -> Column:
    return wedge * F.pow(F.lit(2.0), -scale / 2.0)


def direction(polar: Column, azimuthal: Column) -> tuple[Column, Column, Column]:
    return F.sin(polar) * F.cos(azimuthal), F.sin(polar) * F.sin(azimuthal), F.cos(polar)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def grey_of_angle(angle: Column, full: float) -> Column:
    """An angle as a grey level: 255 at ``full`` (90 for relative angles, 180 for orientations)."""
    return 255.0 * angle / full


def uint8(x: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))).cast("int")
