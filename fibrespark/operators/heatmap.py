"""Angle maps: a raster of grey levels per fiber, smoothed in three steps. Pixels are rows (image_id, row, col, value), one a pixel; absent pixels and null values are empty.

Steps look at a box around each pixel. So, but for density_maximum() alone, images are cut into tiles, a pixel goes to its tile and to those that see it, and a task holds the raster of one tile with its margin, whatever the image's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrespark.functions.angles import grey_of_angle, round_half_even, uint8
from fibrespark.functions.tables import merged

#: Side of a tile in pixels, without its margin.
TILE = 512
#: Columns of a cell in which a pixel row's values are spread by density_maximum().
CELL = 64


def raw_map(fibers: DataFrame, height: int, width: int, angle: str = "angle", full: float = 180.0) -> DataFrame:
    """Grey level of the last fiber (largest id) on each pixel; centres outside of the image and null angles are left out."""
    at = fibers.where(F.col(angle).isNotNull()).select("image_id", "fiber_id", round_half_even(F.col("center_row")).cast("int").alias("row"), round_half_even(F.col("center_col")).cast("int").alias("col"), grey_of_angle(F.col(angle), full).alias("value"))
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return at.where(inside).groupBy("image_id", "row", "col").agg(F.max_by("value", "fiber_id").alias("value"))


def _by_tiles(pixels: DataFrame, step: Callable[[np.ndarray], np.ndarray], reach: int, height: int | None, width: int | None, tile: int) -> DataFrame:
    """``step`` of each tile's raster (NaN where it is empty), of which no value depends on pixels further than ``reach``. Pixels outside of the image, where its size is given, are left out."""
    kind = pixels.schema["image_id"].dataType.simpleString()
    sizes = {"row": height, "col": width}
    held = pixels.where("value IS NOT NULL").select("image_id", F.col("row").cast("int"), F.col("col").cast("int"), F.col("value").cast("double"))
    for c, size in sizes.items():
        first, last = F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)
        if size is not None:
            held, first, last = held.where(F.col(c).between(0, size - 1)), F.greatest(first, F.lit(0)), F.least(last, F.lit((size - 1) // tile))
        held = held.withColumn(f"_{c}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))

    def run(table: pa.Table) -> pa.Table:
        at, starts, ends, own = [], [], [], []
        for c, size in sizes.items():
            first = table.column(f"_{c}")[0].as_py() * tile
            start, end = (first - reach, first + tile + reach) if size is None else (max(0, first - reach), min(size, first + tile + reach))
            at.append(table.column(c).to_numpy() - start)
            starts.append(first)
            ends.append(end - start)
            own.append(slice(first - start, min(first + tile, end) - start))
        raster = np.full(ends, np.nan)
        raster[tuple(at)] = table.column("value").to_numpy()
        done = step(raster)[tuple(own)]
        row, col = np.nonzero(~np.isnan(done))
        made = [pa.repeat(table.column("image_id")[0], len(row)), pa.array((row + starts[0]).astype(np.int32)), pa.array((col + starts[1]).astype(np.int32)), pa.array(done[row, col])]
        return pa.table(made, names=["image_id", "row", "col", "value"])

    # tiles cost much more than their rows weigh, by which few of them would be taken together
    session = pixels.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return held.repartition(parts, "image_id", "_row", "_col").groupBy("image_id", "_row", "_col").applyInArrow(run, f"image_id {kind}, row int, col int, value double")


def _box_sum(raster: np.ndarray, at: tuple[np.ndarray, np.ndarray], half: int) -> np.ndarray:
    """Sums over the boxes of 2 * half + 1 around the places ``at``."""
    upto = np.zeros([n + 1 for n in raster.shape], raster.dtype)
    np.cumsum(np.cumsum(raster, 0), 1, out=upto[1:, 1:])
    (r0, c0), (r1, c1) = ([np.maximum(x - half, 0) for x in at], [np.minimum(x + half + 1, n) for x, n in zip(at, raster.shape)])
    return upto[r1, c1] - upto[r0, c1] - upto[r1, c0] + upto[r0, c0]


def _box_max(raster: np.ndarray, half: int) -> np.ndarray:
    """Largest value of the box of 2 * half + 1 around each pixel; NaN where it is empty."""
    raster = np.where(np.isnan(raster), -np.inf, raster)
    for axis in (0, 1):
        raster = np.pad(raster, [(half, half) if k == axis else (0, 0) for k in (0, 1)], constant_values=-np.inf).swapaxes(0, axis)
        size = 1
        while size <= 2 * half:
            step = min(size, 2 * half + 1 - size)
            raster = np.maximum(raster[:-step], raster[step:])
            size += step
        raster = raster.swapaxes(0, axis)
    return np.where(raster == -np.inf, np.nan, raster)


def _aligned(raster: np.ndarray, size: int) -> np.ndarray:
    filled = ~np.isnan(raster)
    at = np.nonzero(filled)
    turns, out = np.zeros(raster.shape, dtype=complex), np.full(raster.shape, np.nan)
    turns[at] = np.exp(raster[at] * (1j * math.pi / 127.5))
    n = _box_sum(filled.astype(np.int32), at, size - 1)
    out[at] = np.where(n > 2, 255 * np.abs(_box_sum(turns, at, size - 1)) / n, np.nan)
    return out


def _spread(raster: np.ndarray, half: int) -> np.ndarray:
    filled = ~np.isnan(raster)
    at, shared = np.nonzero(filled), np.full(raster.shape, np.nan)
    shared[at] = raster[at] / _box_sum(filled.astype(np.int32), at, half)
    return _box_max(shared, half)


def _kernel(sigma: float) -> list[float]:
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [x / sum(raw) for x in raw]


def _blurred(raster: np.ndarray, kernel: list[float]) -> np.ndarray:
    """A raster's cut sides repeat too, but only their margin sees that; the image's own sides are the raster's where they meet."""
    reach, raster = len(kernel) // 2, np.where(np.isnan(raster), 0, raster)
    for axis in (0, 1):
        n = raster.shape[axis]
        wide = np.pad(raster, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="edge").swapaxes(0, axis)
        raster = sum(w * wide[k : k + n] for k, w in enumerate(kernel)).swapaxes(0, axis)
    return np.where(raster > 0, raster, np.nan)


def circular_filter(pixels: DataFrame, size: int, height: int | None = None, width: int | None = None, tile: int = TILE) -> DataFrame:
    """Each filled pixel becomes 255 times the alignment of the filled pixels in the open box of ``size`` around it; emptied where those are two or fewer."""
    return _by_tiles(pixels, lambda x: _aligned(x, size), size - 1, height, width, tile)


def _boxed(pixels: DataFrame, reach: int, closed: bool) -> DataFrame:
    """Pairs of filled pixels (a: the box's centre, b: in its box) of one image, met in grid cells as wide as the reach."""
    cell = lambda c: F.floor(F.col(c) / reach)
    a = pixels.withColumn("gr", cell("row")).withColumn("gc", cell("col"))
    ring = F.explode(F.array(*[F.struct((cell("row") + r).alias("gr"), (cell("col") + c).alias("gc")) for r in (-1, 0, 1) for c in (-1, 0, 1)]))
    b = pixels.select("image_id", F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("value").alias("value2"), ring.alias("g")).select("image_id", "row2", "col2", "value2", "g.gr", "g.gc")
    apart = F.greatest(F.abs(F.col("row") - F.col("row2")), F.abs(F.col("col") - F.col("col2")))
    return a.join(merged(b), ["image_id", "gr", "gc"]).where(apart <= reach if closed else apart < reach)


def density_maximum(pixels: DataFrame, height: int, width: int, square: int = 12) -> DataFrame:
    """Each filled pixel, divided by the number of filled pixels in the closed box around it, is spread over that box; the largest value of a pixel stays."""
    half = math.ceil(square / 2)
    counted = _boxed(pixels, half, closed=True).groupBy("image_id", "row", "col").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
    low, high = F.greatest(F.lit(0), F.col("col") - half), F.least(F.lit(width - 1), F.col("col") + half)
    rows = F.explode(F.sequence(F.greatest(F.lit(0), F.col("row") - half), F.least(F.lit(height - 1), F.col("row") + half)))
    cells = F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))
    # only the rows of a box are sent; a column's largest value per row, and its spread over columns, stay where a cell of a pixel row is
    sent = counted.select("image_id", "col", (F.col("value") / F.col("n")).alias("value"), rows.alias("row"), cells.alias("cell")).repartition("image_id", "row", "cell")
    sent = sent.groupBy("image_id", "row", "cell", "col").agg(F.max("value").alias("value")).groupBy("image_id", "row", "cell").agg(F.collect_list(F.struct("col", "value")).alias("held"))
    first, last = F.greatest(F.lit(0), F.col("cell") * CELL), F.least(F.lit(width - 1), F.col("cell") * CELL + CELL - 1)
    reached = F.array_distinct(F.flatten(F.transform("held", lambda x: F.sequence(F.greatest(first, x["col"] - half), F.least(last, x["col"] + half)))))
    spread = sent.select("image_id", "row", "held", F.explode(reached).alias("_to"))
    largest = F.aggregate("held", F.lit(None).cast("double"), lambda most, x: F.when(F.abs(x["col"] - F.col("_to")) <= half, F.greatest(most, x["value"])).otherwise(most))
    return spread.select("image_id", "row", F.col("_to").cast("int").alias("col"), largest.alias("value"))


def gaussian_filter(pixels: DataFrame, height: int, width: int, sigma: float = 4.0, tile: int = TILE) -> DataFrame:
    """Separable Gaussian over the image with its border pixels repeated outwards; empty pixels count as 0. Only pixels with a sum above 0 are rows."""
    kernel = _kernel(sigma)
    return _by_tiles(pixels, lambda x: _blurred(x, kernel), len(kernel) // 2, height, width, tile)


def processed_map(raw: DataFrame, height: int, width: int, circular: int | None = 19, square: int = 12, sigma: float = 4.0, tile: int = TILE) -> DataFrame:
    """Grey levels (0 to 255) of the smoothed map; without ``circular`` (maps of relative angles) its first step is left out. All steps are one pass over tiles, whose margin is that of all."""
    half, kernel = math.ceil(square / 2), _kernel(sigma)
    steps = lambda x: _blurred(_spread(_aligned(x, circular) if circular else x, half), kernel)
    smooth = _by_tiles(raw, steps, (circular - 1 if circular else 0) + 2 * half + len(kernel) // 2, height, width, tile)
    return smooth.select("image_id", "row", "col", uint8(F.col("value")).alias("value"))


def colour(value: Column, relative: bool) -> Column:
    """Colour of a grey level: none, green, yellow or red. Relative angles change at 10, 45 and 60 degrees of 90."""
    low, middle, high = (int(d * 255 / 90) for d in (10, 45, 60)) if relative else (32, 64, 128)
    return F.when(value > high, "red").when(value > middle, "yellow").when(value > low, "green").otherwise("none")
