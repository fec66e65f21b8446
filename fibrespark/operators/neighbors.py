"""Neighbourhood features of fibers: nearest neighbours and boxes, within each image.

Fibers: image_id, fiber_id, center_row, center_col, angle. Both joins meet on grid cells, so an image of n fibers costs about n times
the neighbours of one cell and not n squared, and a crowded image spreads over as many keys as it has cells. Where fibers are crowded in places, the nearest are found down a tree of boxes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fibrespark.functions.angles import alignment
from fibrespark.functions.tables import Rounds, merged

from .boundary import PAIRS, box_distances

RING = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
#: Fibers around a cell of the even grid, in so many times k + 1, beyond which its fibers go down the tree of boxes.
CROWD = 32
#: Side of the tree's finest boxes, how many times wider each level's are, and levels; images beyond the coarsest box begin with several.
FINEST, BRANCH, LEVELS = 2.0, 8, 6


#: Means and deviations over the four numbers of neighbours.
MEANS = ("distance_to_nearest_fiber_mean", "distance_to_nearest_fiber_std", "alignment_mean", "alignment_std")

#: Images of at most so many fibers are searched whole, each in a task.
WHOLE = 2048


def _steps(minimum: int) -> list[int]:
    return [minimum * s for s in (1, 2, 4, 8)]


def _boxes(minimum: int) -> list[int]:
    return [minimum * s for s in (1, 2, 4)]


def _near_names(k: int) -> tuple[str, str]:
    return f"distance_to_nearest_{k}_fibers", f"alignment_of_nearest_{k}_fibers"


def _box_names(b: int) -> tuple[str, str]:
    return f"fibers_within_box_density{b}", f"fiber_alignment_in_box_{b}"


def _around(row: Column, col: Column) -> Column:
    return F.explode(F.array(*[F.struct((row + r).alias("r"), (col + c).alias("c")) for r, c in RING]))


def _distance(a: str = "a", b: str = "b") -> Column:
    return F.sqrt(F.pow(F.col(f"{a}.center_row") - F.col(f"{b}.center_row"), 2) + F.pow(F.col(f"{a}.center_col") - F.col(f"{b}.center_col"), 2))


def _celled(fibers: DataFrame) -> DataFrame:
    return fibers.withColumns({"_r": F.floor(F.col("center_row") / FINEST).cast("long"), "_c": F.floor(F.col("center_col") / FINEST).cast("long")})


def _boxes_in_reach(some: DataFrame, fibers: DataFrame, k: int) -> DataFrame:
    """Fibers of ``some`` with the finest boxes (_r, _c) that may hold one of their k nearest.

    Level by level: the boxes in order of their furthest point hold k others at some distance; boxes that begin beyond go, the others meet their parts. So a fiber keeps about as many
    boxes as it has neighbours, wherever the image is crowded or empty.
    """
    levels = [_celled(fibers).groupBy("image_id", "_r", "_c").agg(
        F.count(F.lit(1)).alias("_n"), F.min("center_row").alias("_r0"), F.max("center_row").alias("_r1"), F.min("center_col").alias("_c0"), F.max("center_col").alias("_c1")
    )]
    while len(levels) < LEVELS:
        up = levels[-1].withColumns({c: F.floor(F.col(c) / BRANCH).cast("long") for c in ("_r", "_c")})
        levels.append(up.groupBy("image_id", "_r", "_c").agg(F.sum("_n").alias("_n"), F.min("_r0").alias("_r0"), F.max("_r1").alias("_r1"), F.min("_c0").alias("_c0"), F.max("_c1").alias("_c1")))
    own = Window.partitionBy("image_id", "fiber_id")
    least, most = box_distances(F.col("center_row"), F.col("center_col"))
    held = some.join(merged(levels[-1]), "image_id")
    for finer in (*reversed(levels[:-1]), None):
        held = held.withColumns({"_least": least, "_most": most})
        held = held.withColumn("_upto", F.sum("_n").over(own.orderBy("_most").rowsBetween(Window.unboundedPreceding, 0)))
        held = held.withColumn("_bound", F.min(F.when(F.col("_upto") >= k + 1, F.col("_most"))).over(own))
        held = held.where(F.col("_bound").isNull() | (F.col("_least") <= F.col("_bound") * (1 + 1e-9))).select(*some.columns, "_r", "_c")
        if finer is not None:
            parts = finer.withColumnsRenamed({"_r": "_fr", "_c": "_fc"}).withColumns({"_r": F.floor(F.col("_fr") / BRANCH).cast("long"), "_c": F.floor(F.col("_fc") / BRANCH).cast("long")})
            held = held.join(merged(parts), ["image_id", "_r", "_c"]).drop("_r", "_c").withColumnsRenamed({"_fr": "_r", "_fc": "_c"})
    return held


def _nearest_in_whole_images(f: DataFrame, k: int) -> DataFrame:
    """nearest_neighbors() where an image's fibers fit a task: distances of 256 fibers at a time to all others."""
    types = {x.name: x.dataType.simpleString() for x in f.schema}

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column("fiber_id").to_numpy(), kind="stable"))  # so that places stand for ids where distances are equal
        row, col = (table.column(c).to_numpy() for c in ("center_row", "center_col"))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))]
        most = min(k, len(row) - 1)
        for start in range(0, len(row) if most > 0 else 0, 256):
            d = np.sqrt((row[start : start + 256, None] - row) ** 2 + (col[start : start + 256, None] - col) ** 2)
            own = np.arange(len(d))
            d[own, start + own] = np.inf
            a, b = np.nonzero(d <= np.partition(d, most - 1, axis=1)[:, most - 1 : most])
            order = np.lexsort((b, d[a, b], a))
            a, b = a[order], b[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a) + 1
            kept = rank <= most
            found.append((start + a[kept], b[kept], rank[kept].astype(np.int32), d[a, b][kept]))
        a, b, rank, distance = (np.concatenate(x) for x in zip(*found))
        made = [table.column("image_id").take(a), table.column("fiber_id").take(a), pa.array(rank), pa.array(distance), table.column("fiber_id").take(b), table.column("angle").take(b)]
        return pa.table(made, names=["image_id", "fiber_id", "rank", "distance", "nb_id", "nb_angle"])

    return f.groupBy("image_id").applyInArrow(run, f"image_id {types['image_id']}, fiber_id {types['fiber_id']}, rank int, distance double, nb_id {types['fiber_id']}, nb_angle double")


def _features_in_whole_images(f: DataFrame, minimum_neighbors: int, minimum_box: int) -> DataFrame:
    """fiber_features() where an image's fibers fit a task: from the distances of a few fibers at a time to all others, one row a fiber."""
    types = {x.name: x.dataType.simpleString() for x in f.schema}
    steps, boxes = _steps(minimum_neighbors), _boxes(minimum_box)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column("fiber_id").to_numpy(), kind="stable"))  # so that places stand for ids where distances are equal
        row, col = (table.column(c).to_numpy() for c in ("center_row", "center_col"))
        degrees = table.column("angle").to_numpy()
        known = ~np.isnan(degrees)
        doubled = np.where(known, 2 * np.radians(degrees), 0.0)
        # cosine, sine and one of every known angle: their sums over a set give its alignment
        parts = np.stack([np.where(known, np.cos(doubled), 0.0), np.where(known, np.sin(doubled), 0.0), known.astype(float)], axis=1)
        n = len(row)
        out = {c: np.full(n, np.nan) for k in steps for c in _near_names(k)} | {c: np.full(n, np.nan) for b in boxes for c in _box_names(b)}
        most = min(steps[-1], n - 1)

        def aligned(sums: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(sums[:, 2] > 0, np.sqrt(sums[:, 0] ** 2 + sums[:, 1] ** 2) / sums[:, 2], np.nan)

        rows = 1 + PAIRS // n
        held = np.empty((3, min(rows, n), n))
        for start in range(0, n, rows):
            block = slice(start, min(start + rows, n))
            dr, dc, reach = held[:, : block.stop - start]
            np.abs(np.subtract(row[block, None], row, out=dr), out=dr)
            np.abs(np.subtract(col[block, None], col, out=dc), out=dc)
            np.maximum(dr, dc, out=reach)
            a, b = np.nonzero(reach < math.ceil(boxes[-1] / 2))
            pairs, apart = parts[b], reach[a, b]
            for box in reversed(boxes):
                inside = apart < math.ceil(box / 2)
                a, pairs, apart = a[inside], pairs[inside], apart[inside]
                count, align = _box_names(box)
                out[count][block] = np.bincount(a, minlength=len(reach))
                out[align][block] = aligned(np.stack([np.bincount(a, x, len(reach)) for x in pairs.T], axis=1))
            dr *= dr
            dc *= dc
            d = np.sqrt(np.add(dr, dc, out=dr), out=dr)
            own = np.arange(len(d))
            d[own, start + own] = np.inf
            if most < steps[0]:
                continue
            a, b = np.nonzero(d <= np.partition(d, most - 1, axis=1)[:, most - 1 : most])
            order = np.lexsort((b, d[a, b], a))
            a, b = a[order], b[order]
            kept = np.arange(len(a)) - np.searchsorted(a, a) < most
            near = b[kept].reshape(len(d), most)
            distances = np.cumsum(d[own[:, None], near], axis=1)
            sums = np.cumsum(parts[near], axis=1)
            for k in (x for x in steps if x <= most):
                mean, align = _near_names(k)
                out[mean][block] = distances[:, k - 1] / k
                out[align][block] = aligned(sums[:, k - 1])
        made = [pa.array(x.astype(np.int64)) if c.startswith("fibers_within") else pa.array(x, from_pandas=True) for c, x in out.items()]
        return pa.table([table.column("image_id"), table.column("fiber_id"), *made], names=["image_id", "fiber_id", *out])

    names = [f"{c} double" for k in steps for c in _near_names(k)] + [f"{c} {t}" for b in boxes for c, t in zip(_box_names(b), ("long", "double"))]
    return f.groupBy("image_id").applyInArrow(run, ", ".join([f"image_id {types['image_id']}", f"fiber_id {types['fiber_id']}", *names]))


def nearest_neighbors(fibers: DataFrame, k: int, reach: float = 1.6, whole: int = WHOLE) -> DataFrame:
    """(image_id, fiber_id, rank, distance, nb_id, nb_angle): the k nearest other fibers, equal distances by id; fewer in images with fewer. Fibers without a place have no rows.

    Fibers go once to the task of their image where it has at most ``whole``. In larger images they meet on cells, sized per image so that a fiber and its neighbours fill a cell or two. A fiber whose k-th neighbour is nearer than the unseen
    cells has its answer; the others (corners, empty stretches), and fibers where many crowd, go down a tree of boxes.
    """
    f = fibers.select("image_id", "fiber_id", F.col("center_row").cast("double"), F.col("center_col").cast("double"), F.col("angle").cast("double")).where("center_row IS NOT NULL AND center_col IS NOT NULL")
    counted = f.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("image_id")))
    at_once, f = _nearest_in_whole_images(counted.where(F.col("_n") <= whole).drop("_n"), k), counted.where(F.col("_n") > whole).drop("_n")
    area = (F.max("center_row") - F.min("center_row") + 1) * (F.max("center_col") - F.min("center_col") + 1)
    size = F.greatest(F.lit(1.0), reach * F.sqrt((k + 1) * area / (F.count(F.lit(1)) * math.pi)))
    images = f.groupBy("image_id").agg(size.alias("cell"), F.min("center_row").alias("r0"), F.min("center_col").alias("c0"), F.max("center_row").alias("r1"), F.max("center_col").alias("c1"))
    g = f.join(merged(images), "image_id")
    at = lambda x, low: F.floor((F.col(x) - F.col(low)) / F.col("cell"))
    g = g.withColumn("gr", at("center_row", "r0")).withColumn("gc", at("center_col", "c0"))
    around = g.groupBy("image_id", "gr", "gc").agg(F.count(F.lit(1)).alias("n")).select("image_id", "n", _around(F.col("gr"), F.col("gc")).alias("g"))
    around = around.groupBy("image_id", F.col("g.r").alias("gr"), F.col("g.c").alias("gc")).agg(F.sum("n").alias("n")).where(F.col("n") <= CROWD * (k + 1)).drop("n")
    sent = g.select("image_id", "fiber_id", "center_row", "center_col", "angle", _around(F.col("gr"), F.col("gc")).alias("g")).select("*", "g.r", "g.c").drop("g")
    pairs = g.join(merged(around), ["image_id", "gr", "gc"]).alias("a").join(merged(sent).alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.gr") == F.col("b.r")) & (F.col("a.gc") == F.col("b.c")) & (F.col("a.fiber_id") != F.col("b.fiber_id")))

    def ranked(joined: DataFrame) -> DataFrame:
        rows = joined.select(F.col("a.image_id").alias("image_id"), F.col("a.fiber_id").alias("fiber_id"), _distance().alias("distance"), F.col("b.fiber_id").alias("nb_id"), F.col("b.angle").alias("nb_angle"))
        order = Window.partitionBy("image_id", "fiber_id").orderBy("distance", "nb_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # distance to the nearest cell that was not looked at; beyond the image there is none
    x = lambda c: F.col(f"a.{c}")
    far = F.lit(float("inf"))
    lows = [F.when(x(g_) > 1, x(p) - (x(low) + (x(g_) - 1) * x("cell"))).otherwise(far) for p, g_, low in (("center_row", "gr", "r0"), ("center_col", "gc", "c0"))]
    highs = [F.when(x(low) + (x(g_) + 2) * x("cell") <= x(high), x(low) + (x(g_) + 2) * x("cell") - x(p)).otherwise(far) for p, g_, low, high in (("center_row", "gr", "r0", "r1"), ("center_col", "gc", "c0", "c1"))]
    seen = F.least(*lows, *highs).alias("seen")
    near = ranked(pairs)
    # counted without putting in order: with k neighbours nearer than any unseen cell, the k nearest were seen
    reached = pairs.select(F.col("a.image_id").alias("image_id"), F.col("a.fiber_id").alias("fiber_id"), _distance().alias("distance"), seen).groupBy("image_id", "fiber_id")
    whole = reached.agg(((F.count(F.when(F.col("distance") < F.col("seen"), 1)) >= k) | (F.min("seen") == float("inf"))).alias("whole")).where("whole").select("image_id", "fiber_id")
    done = near.join(merged(whole), ["image_id", "fiber_id"])
    left = f.join(merged(whole), ["image_id", "fiber_id"], "left_anti")
    cells = _boxes_in_reach(left, f, k)
    met = cells.alias("a").join(merged(_celled(f)).alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a._r") == F.col("b._r")) & (F.col("a._c") == F.col("b._c")) & (F.col("a.fiber_id") != F.col("b.fiber_id")))
    wide = ranked(met)
    columns = ["image_id", "fiber_id", "rank", "distance", "nb_id", "nb_angle"]
    return at_once.unionByName(done.select(*columns)).unionByName(wide.select(*columns))


def _mean_and_std(columns: list[str]) -> tuple[Column, Column]:
    mean = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
    square = lambda c: F.pow(F.col(c) - mean, 2)
    return mean, F.sqrt(sum((square(c) for c in columns[1:]), square(columns[0])) / (len(columns) - 1))


def _with_means(out: DataFrame, steps: list[int]) -> DataFrame:
    d, d_std = _mean_and_std([_near_names(k)[0] for k in steps])
    a, a_std = _mean_and_std([_near_names(k)[1] for k in steps])
    return out.withColumns(dict(zip(MEANS, (d, d_std, a, a_std))))


def neighbor_features(fibers: DataFrame, minimum: int = 2) -> DataFrame:
    """Mean distance and alignment of the m, 2m, 4m and 8m nearest fibers, with mean and standard deviation over the four.

    A column is null where an image has fewer fibers than it asks for; so are its mean and deviation.
    """
    steps = _steps(minimum)
    near = nearest_neighbors(fibers, steps[-1])
    aggregates = []
    for k in steps:
        inside = F.col("rank") <= k
        enough = F.count(F.when(inside, 1)) == k
        distance, aligned = _near_names(k)
        aggregates.append(F.when(enough, F.avg(F.when(inside, F.col("distance")))).alias(distance))
        aggregates.append(F.when(enough, alignment(F.when(inside, F.col("nb_angle")))).alias(aligned))
    out = fibers.select("image_id", "fiber_id").join(merged(near.groupBy("image_id", "fiber_id").agg(*aggregates)), ["image_id", "fiber_id"], "left")
    return _with_means(out, steps)


def box_features(fibers: DataFrame, minimum: int = 32) -> DataFrame:
    """Number of fibers and their alignment in open boxes of minimum, twice and four times that, the fiber itself included. One join serves all three."""
    boxes = _boxes(minimum)
    half = {b: math.ceil(b / 2) for b in boxes}
    cell = float(max(half.values()))
    f = fibers.select("image_id", "fiber_id", F.col("center_row").cast("double"), F.col("center_col").cast("double"), F.col("angle").cast("double"))
    f = f.withColumn("gr", F.floor(F.col("center_row") / cell)).withColumn("gc", F.floor(F.col("center_col") / cell))
    sent = f.select("image_id", "center_row", "center_col", "angle", _around(F.col("gr"), F.col("gc")).alias("g")).select("image_id", "center_row", "center_col", "angle", "g.r", "g.c")
    reach = F.greatest(F.abs(F.col("a.center_row") - F.col("b.center_row")), F.abs(F.col("a.center_col") - F.col("b.center_col")))
    met = f.alias("a").join(merged(sent).alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.gr") == F.col("b.r")) & (F.col("a.gc") == F.col("b.c")) & (reach < cell))
    rows = met.select(F.col("a.image_id").alias("image_id"), F.col("a.fiber_id").alias("fiber_id"), reach.alias("reach"), F.col("b.angle").alias("angle"))
    aggregates = []
    for b in boxes:
        inside = F.col("reach") < half[b]
        count, aligned = _box_names(b)
        aggregates += [F.count(F.when(inside, 1)).alias(count), alignment(F.when(inside, F.col("angle"))).alias(aligned)]
    return rows.groupBy("image_id", "fiber_id").agg(*aggregates)


def fiber_features(fibers: DataFrame, minimum_neighbors: int = 2, minimum_box: int = 32, whole: int = WHOLE) -> DataFrame:
    """All neighbourhood features of every fiber with a place: nine of density, nine of alignment. Fibers of images that have at most ``whole`` go once to the task of their image."""
    f = fibers.select("image_id", "fiber_id", F.col("center_row").cast("double"), F.col("center_col").cast("double"), F.col("angle").cast("double"))
    f = f.where("image_id IS NOT NULL AND fiber_id IS NOT NULL AND center_row IS NOT NULL AND center_col IS NOT NULL")
    found = Rounds(f.sparkSession, "crowded").write(f.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole).select("image_id"))
    crowded = merged(found)
    few = _with_means(_features_in_whole_images(f.join(crowded, "image_id", "left_anti"), minimum_neighbors, minimum_box), _steps(minimum_neighbors))
    few = few.select("image_id", "fiber_id", *[c for k in _steps(minimum_neighbors) for c in _near_names(k)], *MEANS, *[c for b in _boxes(minimum_box) for c in _box_names(b)])
    if found.isEmpty():
        return few
    rest = f.join(crowded, "image_id", "left_semi")
    many = neighbor_features(rest, minimum_neighbors).join(merged(box_features(rest, minimum_box)), ["image_id", "fiber_id"])
    return few.unionByName(many)
