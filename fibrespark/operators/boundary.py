"""Fibers against tissue boundaries: nearest points, distances, flags, outline slopes and relative angles.

Boundary points: image_id, roi_id, seq, row, col (closed outlines, neighbours in seq touch). Distances are to the nearest point, ties by (roi_id, seq).
Fibers and points meet on grid cells within a threshold, cells of that size. Without one, small images are searched whole, each in a task; in the others fibers go down a tree of boxes, so a
large image is many keys and a fiber meets few points of each outline.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fibrespark.functions.angles import edge_angle, on_image_edge, round_half_even
from fibrespark.functions.tables import Rounds, merged

from .outlines import OUTLINE_POINTS, outline_slopes, slopes_in_task


#: Side of the finest boxes in which the nearest point is looked for; each level above has boxes of four times the side.
FINEST = 8.0
BRANCH = 4
#: Images of at most so many fibers and outline points are searched whole.
WHOLE, WHOLE_POINTS = 2048, 8192
#: And so many distances are held at once.
PAIRS = 1 << 15
#: What is told of a fiber's nearest point.
POINT_COLUMNS = {"roi_id": "boundary_roi", "seq": "boundary_seq", "row": "boundary_point_row", "col": "boundary_point_col"}
#: Columns of a cell in which places meet the runs of a mask.
RUN_CELL = 64
#: Side of the cells in which the lines through fibers meet outline points.
LINE_CELL = 16


def _cells(row: Column, col: Column, size: Column, reach: int) -> Column:
    """Cells (r, c) within ``reach`` of a place's own."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    own = lambda x: F.floor(x / size).cast("long")
    return F.explode(F.flatten(F.transform(steps, lambda a: F.transform(steps, lambda b: F.struct((own(row) + a).alias("r"), (own(col) + b).alias("c"))))))


def box_distances(row: Column, col: Column) -> tuple[Column, Column]:
    """Squares of the least and the largest distance between a place and the points of a box (_r0, _r1, _c0, _c1 are their extremes)."""
    square = lambda a, b: a * a + b * b
    least = square(F.greatest(F.lit(0.0), F.col("_r0") - row, row - F.col("_r1")), F.greatest(F.lit(0.0), F.col("_c0") - col, col - F.col("_c1")))
    return least, square(F.greatest(row - F.col("_r0"), F.col("_r1") - row), F.greatest(col - F.col("_c0"), F.col("_c1") - col))


def _near_pairs(fibers: DataFrame, points: DataFrame, match: list[str], keys: list[str]) -> DataFrame:
    """Fibers (center_row, center_col) with every point of the same ``keys`` that may be their nearest.

    Down a tree of boxes, level by level: a box goes if another of the fiber's surely holds a nearer point, the others meet their parts. A few boxes a level are left, however far the
    points are and however many there are; each box is a key of its own.
    """
    extremes = [F.min("_row").alias("_r0"), F.max("_row").alias("_r1"), F.min("_col").alias("_c0"), F.max("_col").alias("_c1")]
    wide = points.groupBy(*keys).agg(*extremes).agg(F.max(F.greatest(F.col("_r1") - F.col("_r0"), F.col("_c1") - F.col("_c0")))).first()[0]
    placed = points.withColumns({"_r": F.floor(F.col("_row") / FINEST).cast("long"), "_c": F.floor(F.col("_col") / FINEST).cast("long")})
    levels = [placed.groupBy(*keys, "_r", "_c").agg(*extremes)]
    while FINEST * BRANCH ** (len(levels) - 1) < (wide or 0):
        up = levels[-1].withColumns({c: F.floor(F.col(c) / BRANCH).cast("long") for c in ("_r", "_c")})
        levels.append(up.groupBy(*keys, "_r", "_c").agg(F.min("_r0").alias("_r0"), F.max("_r1").alias("_r1"), F.min("_c0").alias("_c0"), F.max("_c1").alias("_c1")))
    own = Window.partitionBy(*dict.fromkeys([*keys, "image_id", "fiber_id"]))
    least, most = box_distances(F.col("center_row"), F.col("center_col"))
    columns = list(dict.fromkeys([*fibers.columns, *keys]))
    held = fibers.join(merged(levels[-1]), match)
    for finer in (*reversed(levels[:-1]), None):
        held = held.withColumn("_bound", F.min(most).over(own)).where(least <= F.col("_bound") * (1 + 1e-9)).select(*columns, "_r", "_c")
        if finer is not None:
            parts = finer.withColumnsRenamed({"_r": "_fr", "_c": "_fc"}).withColumns({"_r": F.floor(F.col("_fr") / BRANCH).cast("long"), "_c": F.floor(F.col("_fc") / BRANCH).cast("long")})
            held = held.join(merged(parts), [*keys, "_r", "_c"]).drop("_r", "_c").withColumnsRenamed({"_fr": "_r", "_fc": "_c"})
    return held.join(merged(placed), [*keys, "_r", "_c"]).drop("_r", "_c")


def _pairs_within(fibers: DataFrame, points: DataFrame, match: list[str], threshold: float) -> DataFrame:
    """Fibers with every point within the threshold and some more, on cells of its size."""
    size = F.lit(max(float(threshold), 1.0))
    gridded = points.withColumns({"_r": F.floor(F.col("_row") / size).cast("long"), "_c": F.floor(F.col("_col") / size).cast("long")})
    cells = fibers.select("*", _cells(F.col("center_row"), F.col("center_col"), size, 1).alias("_x")).select(*fibers.columns, F.col("_x.r").alias("_r"), F.col("_x.c").alias("_c"))
    return cells.join(merged(gridded), [*match, "_r", "_c"]).drop("_r", "_c")


def _crowded(fibers: DataFrame, points: DataFrame, match: list[str]) -> DataFrame:
    """Keys of ``match`` with too many fibers or points for one task, a written table."""
    n = fibers.select(*match, F.lit(1).alias("_f"), F.lit(0).alias("_p")).unionByName(points.select(*match, F.lit(0).alias("_f"), F.lit(1).alias("_p")))
    many = n.groupBy(*match).agg(F.sum("_f").alias("_f"), F.sum("_p").alias("_p")).where((F.col("_f") > WHOLE) | (F.col("_p") > WHOLE_POINTS))
    return Rounds(fibers.sparkSession, "crowded").write(many.select(*match))


def _nearest_in_whole_images(fibers: DataFrame, points: DataFrame, match: list[str], keys: list[str], slopes: tuple[float, float] | None = None) -> DataFrame:
    """nearest_point() where the fibers and points of a key of ``match`` fit a task: distances of a few fibers at a time to all points."""
    apart = [k for k in keys if k not in match]
    own = [c for c in fibers.columns if c not in apart]
    fields = [*[fibers.schema[c] for c in own], *[points.schema[c] for c in apart], StructField("distance", DoubleType())]
    fields += [StructField(b, points.schema[a].dataType) for a, b in POINT_COLUMNS.items()]
    fields += [StructField("slope", DoubleType())] if slopes else []
    schema = StructType([StructField(x.name, x.dataType) for x in fields])

    def run(f: pa.Table, p: pa.Table) -> pa.Table:
        p = p.sort_by([(c, "ascending") for c in dict.fromkeys([*apart, "roi_id", "seq", "row", "col"])], null_placement="at_start")  # of equal distances the first is taken
        y, x, row, col = (t.column(c).cast(pa.float64(), safe=False).to_numpy() for t, c in ((f, "center_row"), (f, "center_col"), (p, "row"), (p, "col")))
        named = p.column(apart[0]).combine_chunks().dictionary_encode().indices.to_numpy() if apart and len(p) else np.zeros(len(p), np.int32)
        starts = np.flatnonzero(np.r_[True, named[1:] != named[:-1]]) if len(p) else []
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        rows = 1 + PAIRS // (len(p) + 1)
        held = np.empty((2, min(rows, len(f)), len(p)))
        for block in range(0, len(f), rows):
            d, e = held[:, : len(f) - block]
            np.subtract(y[block : block + rows, None], row, out=d)
            np.subtract(x[block : block + rows, None], col, out=e)
            d *= d
            e *= e
            d += e
            np.sqrt(d, out=d)
            each = np.arange(len(d))
            for a, b in zip(starts, [*starts[1:], len(p)]):
                best = a + d[:, a:b].argmin(axis=1)
                found.append((block + each, best, d[each, best]))
        i, k, distance = (np.concatenate(z) for z in zip(*found))
        more = []
        if slopes:
            # each wanted point is walked from once, over its own outline
            found_at = np.full(len(p), np.nan)
            seq = p.column("seq").to_numpy()
            roi = p.column("roi_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() if len(p) else named
            wanted = np.unique(k[(distance > slopes[0]) & (distance <= slopes[1])])
            for one in np.unique(roi[wanted]):
                of = np.flatnonzero(roi == one)
                at = wanted[roi[wanted] == one]
                found_at[at] = slopes_in_task(row[of], col[of], seq[of], np.searchsorted(of, at))
            more = [pa.array(found_at[k], from_pandas=True)]
        columns = [*[f.column(c).take(pa.array(i)) for c in own], *[p.column(c).take(pa.array(k)) for c in apart], pa.array(distance), *[p.column(c).take(pa.array(k)) for c in POINT_COLUMNS], *more]
        return pa.table(columns, names=schema.names)

    return fibers.groupBy(*match).cogroup(points.groupBy(*match)).applyInArrow(run, schema)


def nearest_point(fibers: DataFrame, points: DataFrame, keys: tuple[str, ...] = ("image_id",), threshold: float | None = None, slopes: tuple[float, float] | None = None) -> DataFrame:
    """Adds distance, boundary_roi, boundary_seq, boundary_point_row and boundary_point_col of the nearest point with the same ``keys``.

    One row per fiber and key; with a roi_id among the keys, per fiber and region. (image_id, fiber_id) names a fiber. With a threshold only rows within it. Centers are taken as they are, not
    rounded. Fibers or points without a place have no part. Only ids and places are joined in large images; further columns come back by id.
    ``slopes``, without a threshold: adds slope as well, the outline's direction at nearest points beyond the first and up to the second distance.
    """
    match = [k for k in keys if k != "roi_id" or "roi_id" in fibers.columns]
    ids = list(dict.fromkeys([*match, "image_id", "fiber_id"]))
    group = list(dict.fromkeys([*keys, "image_id", "fiber_id"]))
    own = [c for c in fibers.columns if c not in group]
    columns = [*group, *own, "distance", *POINT_COLUMNS.values(), *(["slope"] if slopes else [])]
    points = points.select(*dict.fromkeys([*keys, *POINT_COLUMNS]))
    if threshold is None:
        placed = fibers.where(" AND ".join(f"{c} IS NOT NULL" for c in (*ids, "center_row", "center_col")))
        at = points.where(" AND ".join(f"{c} IS NOT NULL" for c in (*keys, "row", "col")))
        found = _crowded(placed, at, match)
        crowded = merged(found)
        whole = _nearest_in_whole_images(placed.join(crowded, match, "left_anti"), at.join(crowded, match, "left_anti"), match, list(keys), slopes).select(*columns)
        if found.isEmpty():
            return whole
        fibers, points = placed.join(crowded, match, "left_semi"), at.join(crowded, match, "left_semi")
    p = points.select(*keys, *[F.col(c).alias(f"_{c}") for c in POINT_COLUMNS])
    f = fibers.select(*ids, F.col("center_row").cast("double"), F.col("center_col").cast("double"))
    if threshold is not None:
        joined = _pairs_within(f, p, match, threshold)
    else:
        joined = _near_pairs(f, p, match, list(keys))
    distance = F.sqrt(F.pow(F.col("center_row") - F.col("_row"), 2) + F.pow(F.col("center_col") - F.col("_col"), 2))
    joined = joined.withColumn("_d", distance)
    if threshold is not None:
        joined = joined.where(F.col("_d") <= threshold)
    best = F.min(F.struct("_d", F.col("_roi_id").alias("roi"), F.col("_seq").alias("seq"), F.col("_row").alias("row"), F.col("_col").alias("col"))).alias("best")
    out = fibers.join(merged(joined.groupBy(*group).agg(best)), ids)
    names = {"_d": "distance", "roi": "boundary_roi", "seq": "boundary_seq", "row": "boundary_point_row", "col": "boundary_point_col"}
    out = out.select(*group, *own, *[F.col(f"best.{a}").alias(b) for a, b in names.items()])
    if threshold is not None:
        return out
    if slopes:
        found = with_slopes(out.where((F.col("distance") > slopes[0]) & (F.col("distance") <= slopes[1])), points)
        out = out.join(merged(found.select(*group, "slope")), group, "left")
    return whole.unionByName(out)


def mask_value(fibers: DataFrame, mask: DataFrame, height: int, width: int) -> DataFrame:
    """Adds region: 1 where the mask under the rounded, clipped centre is 1 or 255, else 0. Mask: image_id, row, col, value; missing pixels are 0. Or disjoint runs of filled pixels: image_id, row, first, last."""
    clip = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), round_half_even(F.col(x)).cast("int")))
    at = fibers.withColumn("_r", clip("center_row", height)).withColumn("_c", clip("center_col", width))
    if "first" in mask.columns:
        cell = lambda x: F.floor(x / RUN_CELL)
        m = mask.select("image_id", F.col("row").cast("int").alias("_r"), F.col("first").alias("_f"), F.col("last").alias("_l"), F.explode(F.sequence(cell(F.col("first")), cell(F.col("last")))).alias("_x"))
        at, m = at.withColumn("_x", cell(F.col("_c"))).alias("a"), merged(m).alias("m")
        same = [F.col(f"a.{c}") == F.col(f"m.{c}") for c in ("image_id", "_r", "_x")]
        met = at.join(m, [*same, F.col("a._c").between(F.col("m._f"), F.col("m._l"))], "left")
        return met.select(*[F.col(f"a.{c}").alias(c) for c in fibers.columns], F.when(F.col("m._f").isNull(), 0).otherwise(1).alias("region"))
    m = mask.where(F.col("value").isin(1, 255)).select("image_id", F.col("row").cast("int").alias("_r"), F.col("col").cast("int").alias("_c"), F.lit(1).alias("_in"))
    return at.join(merged(m), ["image_id", "_r", "_c"], "left").withColumn("region", F.coalesce("_in", F.lit(0))).drop("_r", "_c", "_in")


def association_flags(rows: DataFrame, threshold: float, min_distance: float | None = None, exclude_inside: bool = True) -> DataFrame:
    """Adds included and excluded: within the threshold (inclusive), beyond the least distance if one is given, outside of the mask if asked."""
    inside: Column = F.col("distance") <= threshold
    if min_distance is not None:
        inside = inside & (F.col("distance") > min_distance)
    if exclude_inside:
        inside = inside & (F.col("region") == 0)
    included = F.coalesce(inside, F.lit(False))
    return rows.withColumn("included", included).withColumn("excluded", ~included)


def with_slopes(nearest: DataFrame, points: DataFrame, outline_points: int = OUTLINE_POINTS) -> DataFrame:
    """Adds slope at each row's (boundary_roi, boundary_seq). Only points that are some fiber's nearest are walked from, each once."""
    wanted = nearest.select("image_id", F.col("boundary_roi").alias("roi_id"), F.col("boundary_seq").alias("seq"))
    found = outline_slopes(wanted, points, outline_points).select("image_id", F.col("roi_id").alias("boundary_roi"), F.col("seq").alias("boundary_seq"), "slope")
    return nearest.join(merged(found), ["image_id", "boundary_roi", "boundary_seq"], "left")


def with_edge_angle(rows: DataFrame, height: int, width: int, origin: int = 0) -> DataFrame:
    """Adds relative_angle: 0 where the boundary point lies on the image's border, else the angle between fiber and outline."""
    edge = on_image_edge(F.col("boundary_point_row"), F.col("boundary_point_col"), F.lit(height), F.lit(width), origin)
    return rows.withColumn("relative_angle", F.when(edge, 0.0).otherwise(edge_angle(F.col("angle"), F.col("slope"))))


def global_association(fibers: DataFrame, points: DataFrame, mask: DataFrame, height: int, width: int, threshold: float = 100.0, min_distance: float | None = None, exclude_inside: bool = True, origin: int = 0) -> DataFrame:
    """Every fiber with its nearest boundary point of the image, region, flags and, within the threshold, relative angle (null beyond)."""
    near = nearest_point(fibers, points, slopes=(-1.0 if min_distance is None else min_distance, threshold))
    near = association_flags(mask_value(near, mask, height, width), threshold, min_distance, exclude_inside)
    measured = F.col("distance") <= threshold
    if min_distance is not None:
        measured = measured & (F.col("distance") > min_distance)
    angles = with_edge_angle(near, height, width, origin).withColumn("relative_angle", F.when(measured, F.col("relative_angle"))).drop("slope")
    return angles.withColumns({"extension_point_distance": F.lit(None).cast("double"), "extension_point_angle": F.lit(None).cast("double")})


def area_samples(points: DataFrame, height: int, width: int, threshold: float) -> DataFrame:
    """(image_id, num_points): pixels of the image within the threshold of its boundary, estimated from every (width // 20)-th pixel in
    column order and every third boundary point in the order of (col, row); one row per image with points."""
    step = max(1, width // 20)
    order = Window.partitionBy("image_id").orderBy("col", "row", "roi_id", "seq")
    third = points.withColumn("_n", F.row_number().over(order)).where((F.col("_n") - 1) % 3 == 0).select("image_id", F.col("row").alias("br"), F.col("col").alias("bc"))
    sample = points.sparkSession.range(0, height * width, step).select((F.col("id") % height).alias("r"), F.floor(F.col("id") / height).alias("c"))
    # pixels meet boundary points in cells as wide as the threshold
    cell = float(threshold)
    at = lambda x: F.floor(F.col(x) / cell)
    near_cells = F.explode(F.array(*[F.struct((at("br") + a).alias("gr"), (at("bc") + b).alias("gc")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = third.select("image_id", "br", "bc", near_cells.alias("g")).select("image_id", "br", "bc", "g.gr", "g.gc")
    met = sample.withColumn("gr", at("r")).withColumn("gc", at("c")).join(spread, ["gr", "gc"])
    distance = F.sqrt(F.pow(F.col("r") - F.col("br"), 2) + F.pow(F.col("c") - F.col("bc"), 2))
    hit = met.where(distance <= threshold + 1e-12).select("image_id", "r", "c").distinct().groupBy("image_id").agg((F.count(F.lit(1)) * step).alias("n"))
    return points.select("image_id").distinct().join(hit, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).cast("long").alias("num_points"))


def _segment_steps(dr: Column, dc: Column) -> Column:
    """Steps of half a pixel at most; rounded, so that a whole length stays whole."""
    return F.greatest(F.ceil(F.round(2 * F.sqrt(dr * dr + dc * dc), 6)).cast("int"), F.lit(1))


def _segment_pixel(start: str, d: Column, k: Column) -> Column:
    """Row or column of the pixel after ``k`` of _steps steps, rounded half up."""
    return F.floor(F.round(F.col(start) + d * k / F.col("_steps"), 6) + 0.5).cast("long")


def segment_pixels(rows: DataFrame, r1: str, c1: str, r2: str, c2: str) -> DataFrame:
    """Explodes each row into the pixels (px_step, px_row, px_col) of its segment: half a pixel a step, rounded half up, none twice in a row. A segment without length is its pixel."""
    dr, dc = F.col(r2) - F.col(r1), F.col(c2) - F.col(c1)
    # a pixel is a function of its step, so whether it repeats the one before is known without looking back
    walked = rows.withColumn("_steps", _segment_steps(dr, dc)).withColumn("px_step", F.explode_outer(F.sequence(F.lit(0), F.col("_steps"))))
    k = F.col("px_step")
    walked = walked.withColumn("px_row", _segment_pixel(r1, dr, k)).withColumn("px_col", _segment_pixel(c1, dc, k))
    moved = (k == 0) | (F.col("px_row") != _segment_pixel(r1, dr, k - 1)) | (F.col("px_col") != _segment_pixel(c1, dc, k - 1))
    return walked.where(moved).select(*rows.columns, "px_step", "px_row", "px_col")


def fiber_lines(fibers: DataFrame, reach: float) -> DataFrame:
    """Adds the ends r1, c1, r2, c2 of the line through each fiber, ``reach`` columns and rows to both sides along its angle (rows grow downwards)."""
    dr, dc = -F.sin(F.radians("angle")) * reach, F.cos(F.radians("angle")) * reach
    return fibers.withColumns({"r1": F.col("center_row") - dr, "c1": F.col("center_col") - dc, "r2": F.col("center_row") + dr, "c2": F.col("center_col") + dc})


def extension_points(fibers: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """(image_id, fiber_id, extension_point_distance, extension_row, extension_col): the nearest boundary point on each fiber's line, within the threshold; fibers without one are absent."""
    lines = fiber_lines(fibers.select("image_id", "fiber_id", "center_row", "center_col", "angle"), threshold).where("r1 IS NOT NULL AND c1 IS NOT NULL")
    dr, dc = F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")
    length = F.sqrt(dr * dr + dc * dc)
    off = lambda row, col: F.when(length > 0, F.abs((row - F.col("r1")) * dc - (col - F.col("c1")) * dr) / length).otherwise(F.lit(0.0))
    # a line goes to the cells that its pixels may lie in; a pixel's centre is less than 0.71 from the line
    cell = lambda x: F.floor(x / LINE_CELL).cast("long")
    across = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - 1), cell(F.greatest(a, b) + 1)))
    middle = lambda x: (F.col(x) + 0.5) * LINE_CELL
    sent = lines.withColumn("_steps", _segment_steps(dr, dc)).withColumn("_r", across("r1", "r2")).withColumn("_c", across("c1", "c2")).where(off(middle("_r"), middle("_c")) <= LINE_CELL * 0.7072 + 1)
    p = points.select("image_id", F.col("row").cast("long").alias("px_row"), F.col("col").cast("long").alias("px_col")).withColumns({"_r": cell(F.col("px_row")), "_c": cell(F.col("px_col"))})
    near = sent.join(merged(p), ["image_id", "_r", "_c"]).where(off(F.col("px_row"), F.col("px_col")) < 0.71)
    # a step is a quarter of a pixel at least, unless the first is the last: the pixel's step is one of the few beside the foot of its perpendicular
    foot = F.when(length > 0, ((F.col("px_row") - F.col("r1")) * dr + (F.col("px_col") - F.col("c1")) * dc) / (length * length) * F.col("_steps")).otherwise(F.lit(0.0))
    foot = F.least(F.greatest(F.floor(foot), F.lit(0)), F.col("_steps")).cast("int")
    steps = F.sequence(F.greatest(foot - 4, F.lit(0)), F.least(foot + 4, F.col("_steps")))
    met = near.where(F.exists(steps, lambda k: (_segment_pixel("r1", dr, k) == F.col("px_row")) & (_segment_pixel("c1", dc, k) == F.col("px_col"))))
    distance = F.sqrt(F.pow(F.col("center_row") - F.col("px_row"), 2) + F.pow(F.col("center_col") - F.col("px_col"), 2))
    best = met.groupBy("image_id", "fiber_id").agg(F.min(F.struct(distance.alias("d"), "px_row", "px_col")).alias("b"))
    return best.select("image_id", "fiber_id", F.col("b.d").alias("extension_point_distance"), F.col("b.px_row").alias("extension_row"), F.col("b.px_col").alias("extension_col"))
