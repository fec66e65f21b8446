"""Directions of outlines at given points: walks over touching points and fitted parabolas, as columns.

Each wanted point gathers the outline's points that it could reach, on grid cells, as a short list of offsets; a walk is a fold over at most half of ``outline_points`` steps, and the
parabola comes from the normal equations over whole offsets. So an outline is many keys, however long it is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrespark.functions.tables import merged

OUTLINE_POINTS = 21

# The order in which an outline's neighbours are tried, as (row, column) steps, going back and going on.
BACK = ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))
ON = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))

# The fitted parabola is sampled at so many places, and its slope is taken between these two.
SLOPE_STEPS = 50
SLOPE_BETWEEN = (23, 25)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _neighbourhoods(wanted: DataFrame, points: DataFrame, reach: int) -> DataFrame:
    """wanted (image_id, roi_id, seq) that are on an outline, with near: codes (row offset + reach) * (2 * reach + 1) + column offset + reach of the places around, and again: whether the place was passed before."""
    place = ["image_id", "roi_id", "row", "col"]
    size = reach + 1
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    places = points.groupBy(*place).agg(F.min("seq").alias("first")).withColumns({"gr": cell("row"), "gc": cell("col")})
    starts = wanted.join(merged(points.select(*place, "seq")), ["image_id", "roi_id", "seq"]).dropDuplicates(["image_id", "roi_id", "seq"])
    around = F.explode(F.array(*[F.struct((cell("row") + a).alias("gr"), (cell("col") + b).alias("gc")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    starts = starts.select("image_id", "roi_id", "seq", F.col("row").alias("r"), F.col("col").alias("c"), around.alias("g")).select("image_id", "roi_id", "seq", "r", "c", "g.gr", "g.gc")
    dr, dc = F.col("row") - F.col("r"), F.col("col") - F.col("c")
    met = starts.join(merged(places), ["image_id", "roi_id", "gr", "gc"]).where((F.abs(dr) <= reach) & (F.abs(dc) <= reach) & (dr == F.floor(dr)) & (dc == F.floor(dc)))
    code = ((dr + reach) * (2 * reach + 1) + dc + reach).cast("int")
    again = F.max(F.when((dr == 0) & (dc == 0), F.col("first") != F.col("seq")))
    return met.groupBy("image_id", "roi_id", "seq").agg(F.collect_set(code).alias("near"), again.alias("again"))


def _walk(left: Column, center: int, reach: int, steps: tuple) -> Column:
    """(left, path) after ``reach`` steps from the center over places of ``left``, each met once. With no neighbour left the walk stays, and the place counts again."""

    def step(state: Column, _: Column) -> Column:
        tried = [state["here"] + dr * (2 * reach + 1) + dc for dr, dc in steps]
        following = F.coalesce(*[F.when(F.array_contains(state["left"], t), t) for t in tried], state["here"])
        return _bind(following, lambda p: F.struct(p.alias("here"), F.array_remove(state["left"], p).alias("left"), F.concat(state["path"], F.array(p)).alias("path")))

    start = F.struct(F.lit(center).alias("here"), left.alias("left"), F.array().cast("array<int>").alias("path"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(reach)), start, step)


def _direction(over: Column, value: Column, along_rows: Column) -> Column:
    """Degrees, from the row axis, of the parabola through (over, value) between its two middle samples."""
    powers = F.aggregate(
        F.arrays_zip(over.alias("t"), value.alias("v")), F.struct(*[F.lit(0.0).alias(n) for n in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")]),
        lambda a, x: F.struct(
            (a["s0"] + 1).alias("s0"), (a["s1"] + x["t"]).alias("s1"), (a["s2"] + x["t"] * x["t"]).alias("s2"), (a["s3"] + F.pow(x["t"], F.lit(3))).alias("s3"), (a["s4"] + F.pow(x["t"], F.lit(4))).alias("s4"),
            (a["t0"] + x["v"]).alias("t0"), (a["t1"] + x["t"] * x["v"]).alias("t1"), (a["t2"] + x["t"] * x["t"] * x["v"]).alias("t2"),
        ),
    )

    def sampled(p: Column) -> Column:
        s0, s1, s2, s3, s4, t0, t1, t2 = (p[n] for n in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
        whole = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        linear = (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / whole
        square = (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / whole
        first, last = F.get(over, 0), F.element_at(over, -1)
        a, b = [first + (last - first) * k / (SLOPE_STEPS - 1) for k in SLOPE_BETWEEN]
        rise = linear * (b - a) + square * (b * b - a * a)
        return F.pmod(F.degrees(F.when(along_rows, F.atan2(rise, b - a)).otherwise(F.atan2(b - a, rise))), F.lit(180.0))

    return _bind(powers, sampled)


def outline_slopes(wanted: DataFrame, points: DataFrame, outline_points: int = OUTLINE_POINTS) -> DataFrame:
    """wanted (image_id, roi_id, seq) to (image_id, roi_id, seq, slope): the outline's direction there in degrees [0, 180), from the row axis; null where too few points touch.

    From the point the outline is followed half of ``outline_points`` each way over touching points that weren't met before. A parabola through them, over the axis along which they
    run, gives the direction at its middle. Points with the same place are one. Wanted points that no outline has are left out.
    """
    reach = outline_points // 2
    width = 2 * reach + 1
    center = reach * width + reach
    own = F.col("again")
    near = _neighbourhoods(wanted.select("image_id", "roi_id", "seq").distinct(), points, reach)
    back = near.withColumn("back", _walk(F.when(own, F.col("near")).otherwise(F.array_remove("near", center)), center, reach, BACK))
    on = back.withColumn("on", _walk(F.col("back.left"), center, reach, ON))
    path = F.concat(F.reverse(F.col("back.path")), F.array(F.when(own, -1).otherwise(center)), F.col("on.path"))
    offset = lambda part: lambda p: F.when(p < 0, 0).otherwise(part(p) - reach).cast("double")
    walked = on.select("image_id", "roi_id", "seq", path.alias("path"))
    walked = walked.withColumns({"x": F.transform("path", offset(lambda p: F.floor(p / width))), "y": F.transform("path", offset(lambda p: p % width)), "n": F.size(F.array_distinct("path"))})
    rough = F.pmod(F.degrees(F.atan2(F.element_at("y", -1) - F.get("y", 0), F.element_at("x", -1) - F.get("x", 0))), F.lit(180.0))
    walked = walked.withColumn("rough", rough).withColumn("rows", (F.col("rough") < 45) | (F.col("rough") > 135))
    walked = walked.withColumns({"over": F.when(F.col("rows"), F.col("x")).otherwise(F.col("y")), "value": F.when(F.col("rows"), F.col("y")).otherwise(F.col("x"))})
    slope = F.when(F.col("n") < 3, None).when(F.size(F.array_distinct("over")) < 3, F.col("rough")).otherwise(_direction(F.col("over"), F.col("value"), F.col("rows")))
    return walked.select("image_id", "roi_id", "seq", slope.alias("slope"))


def _pmod180(x: np.ndarray) -> np.ndarray:
    r = np.fmod(np.degrees(x), 180.0)
    return np.where(r < 0, np.fmod(r + 180.0, 180.0), r)


def slopes_in_task(row: np.ndarray, col: np.ndarray, seq: np.ndarray, wanted: np.ndarray, outline_points: int = OUTLINE_POINTS) -> np.ndarray:
    """outline_slopes() of one outline that fits a task: its points in the order of seq, and the positions of those wanted. NaN where too few points touch."""
    reach = outline_points // 2
    width = 2 * reach + 1
    center = reach * width + reach
    order = np.lexsort((np.arange(len(row)), col, row))
    new = np.r_[True, (np.diff(row[order]) != 0) | (np.diff(col[order]) != 0)]
    first = np.empty(len(row), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    place = order[new]
    near = np.zeros((len(wanted), width * width), bool)
    some = 1 + (1 << 15) // len(place)
    for k in range(0, len(wanted), some):
        dr, dc = (x[place] - x[wanted[k : k + some], None] for x in (row, col))
        a, b = np.nonzero((np.abs(dr) <= reach) & (np.abs(dc) <= reach) & (dr == np.floor(dr)) & (dc == np.floor(dc)))
        near[k + a, ((dr[a, b] + reach) * width + dc[a, b] + reach).astype(np.int64)] = True
    own = seq[first[wanted]] != seq[wanted]
    near[~own, center] = False
    each = np.arange(len(wanted))
    paths = []
    for steps in (BACK, ON):
        here, path, offsets = np.full(len(wanted), center), [], np.array([dr * width + dc for dr, dc in steps])
        for _ in range(reach):
            tried = here[:, None] + offsets
            hit = near[each[:, None], tried]
            here = np.where(hit.any(axis=1), tried[each, hit.argmax(axis=1)], here)
            near[each, here] = False
            path.append(here)
        paths.append(path)
    path = np.stack([*paths[0][::-1], np.where(own, -1, center), *paths[1]], axis=1)
    x, y = (np.where(path < 0, 0, part - reach).astype(float) for part in (path // width, path % width))
    distinct = lambda v: 1 + (np.diff(np.sort(v, axis=1), axis=1) != 0).sum(axis=1)
    rough = _pmod180(np.arctan2(y[:, -1] - y[:, 0], x[:, -1] - x[:, 0]))
    by_row = (rough < 45) | (rough > 135)
    t, v = np.where(by_row[:, None], x, y), np.where(by_row[:, None], y, x)
    # sums of whole numbers, in the order of _direction()
    s0, s1, s2, s3, s4, t0, t1, t2 = (z.sum(axis=1) for z in (np.ones_like(t), t, t * t, t**3, t**4, v, t * v, t * t * v))
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        linear = (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / whole
        square = (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / whole
        a, b = (t[:, 0] + (t[:, -1] - t[:, 0]) * k / (SLOPE_STEPS - 1) for k in SLOPE_BETWEEN)
        rise = linear * (b - a) + square * (b * b - a * a)
        fitted = _pmod180(np.where(by_row, np.arctan2(rise, b - a), np.arctan2(b - a, rise)))
    return np.where(distinct(path) < 3, np.nan, np.where(distinct(t) < 3, rough, fitted))
