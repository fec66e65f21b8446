"""Grouping of curvelets that describe one fiber: the greedy scan in the order of seeds, as rounds of joins.

The first free point seeds a group that takes every free point in the open box around it. So a point is a seed unless an earlier seed's box holds it, and belongs to the first
seed whose box does. Points meet on grid cells, so an image is many keys; a round decides every point all of whose earlier neighbours are decided:
neighbours that no undecided earlier point reaches are seeds, and what they reach isn't. The undecided shrink with each round, whatever the order; how many rounds there are
depends on it (some ten on images, as many as there are boxes in a row where seeds are sorted along one).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fibrespark.functions.tables import Rounds

#: Deviations closer than that count as equal; of equal ones the larger cut is taken.
PLACES = 9


def reaches(points: DataFrame, radius: float) -> DataFrame:
    """Points (image_id, seed, center_row, center_col) to (image_id, seed, by): the earlier points ``by`` in whose open box a point lies."""
    size = F.lit(max(1.0, math.ceil(radius) + 1.0))
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    p = points.select("image_id", "seed", F.col("center_row").alias("r"), F.col("center_col").alias("c"), cell("center_row").alias("gr"), cell("center_col").alias("gc"))
    around = F.explode(F.array(*[F.struct((F.col("gr") + a).alias("gr"), (F.col("gc") + b).alias("gc")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    q = p.select("image_id", F.col("seed").alias("by"), F.col("r").alias("qr"), F.col("c").alias("qc"), around.alias("g")).select("image_id", "by", "qr", "qc", "g.gr", "g.gc")
    r, c, qr, qc = (F.col(x) for x in ("r", "c", "qr", "qc"))
    inside = (r > F.floor(qr - radius)) & (r < F.ceil(qr + radius)) & (c > F.ceil(qc - radius)) & (c < F.floor(qc + radius))
    return p.join(q, ["image_id", "gr", "gc"]).where((F.col("by") < F.col("seed")) & inside).select("image_id", "seed", "by")


def seeds(points: DataFrame, radius: float) -> DataFrame:
    """(image_id, seed, group): the seed that takes each point, itself for a seed. Seeds are unique in an image."""
    rounds = Rounds(points.sparkSession, "groups")
    own = rounds.write(points.select("image_id", "seed", F.col("center_row").cast("double"), F.col("center_col").cast("double")))
    edges = rounds.write(reaches(own, radius))
    left, taken = edges, []
    while not left.isEmpty():
        # earlier points that no undecided one reaches are seeds; whom they reach is taken, and reaches no one
        nodes = left.select("image_id", "seed", F.lit(1).alias("waits")).unionByName(left.select("image_id", F.col("by").alias("seed"), F.lit(0).alias("waits")))
        ready = nodes.groupBy("image_id", "seed").agg(F.max("waits").alias("waits")).where("waits = 0").select("image_id", F.col("seed").alias("by"), F.lit(True).alias("ready"))
        met = left.join(ready, ["image_id", "by"]).groupBy("image_id", "seed").agg(F.lit(True).alias("met"))
        told = left.join(met, ["image_id", "seed"], "left").join(met.select("image_id", F.col("seed").alias("by"), F.col("met").alias("gone")), ["image_id", "by"], "left")
        told = rounds.write(told.select("image_id", "seed", "by", "met", "gone"))
        taken.append(told.where("met").select("image_id", "seed"))
        left = told.where("met IS NULL AND gone IS NULL").select("image_id", "seed", "by")
    if not taken:
        return own.select("image_id", "seed", F.col("seed").alias("group"))
    every = rounds.write(reduce(DataFrame.unionByName, taken).distinct())
    first = edges.join(every.withColumnRenamed("seed", "by"), ["image_id", "by"], "left_anti").groupBy("image_id", "seed").agg(F.min("by").alias("group"))
    return own.select("image_id", "seed").join(first, ["image_id", "seed"], "left").withColumn("group", F.coalesce("group", "seed"))


def mean_orientations(angles: DataFrame, step: float, by: tuple[str, ...] = ("image_id", "group")) -> DataFrame:
    """Angles (..., angle) in [0, 180) to (..., angle): the mean of each group's, cut where that makes them least scattered.

    Cuts are multiples of ``step`` above the group's smallest angle; angles from the cut on are turned back by 180. In the order of angles a cut's deviation is one expression of
    running sums. Nulls don't count; the deviation that no cut lessens is that of the angles as they are.
    """
    known = angles.where("angle IS NOT NULL").select(*by, F.col("angle").cast("double").alias("a"))
    every = Window.partitionBy(*by)
    upto = every.orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    m, total, squares = F.count("a").over(every), F.sum("a").over(every), F.sum(F.col("a") * F.col("a")).over(every)
    rows = known.select(*by, "a", m.alias("m"), total.alias("s"), squares.alias("q"), F.min("a").over(every).alias("low"), F.lag("a").over(every.orderBy("a")).alias("before"),
                        F.coalesce(F.count("a").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("a").over(upto), F.lit(0.0)).alias("s0"))
    n1, s1 = F.col("m") - F.col("n0"), F.col("s") - F.col("s0")
    mean = (F.col("s") - 180 * n1) / F.col("m")
    spread = lambda q, mu: F.round(F.sqrt(F.greatest(F.lit(0.0), q / F.col("m") - mu * mu)), PLACES)
    cut = F.col("low") + F.floor(F.round((F.col("a") - F.col("low")) / step, PLACES)) * step  # the last cut at or before the angle
    parts = F.col("before").isNotNull() & (cut > F.col("before") + 1e-9)
    turned = F.when(parts, F.struct(spread(F.col("q") - 360 * s1 + 32400 * n1, mean).alias("d"), (-F.col("a")).alias("o"), mean.alias("mean")))
    plain = F.struct(spread(F.col("q"), F.col("s") / F.col("m")).alias("d"), F.lit(float("-inf")).alias("o"), (F.col("s") / F.col("m")).alias("mean"))
    best = F.min(F.least(plain, F.coalesce(turned, plain)))["mean"]
    return rows.groupBy(*by).agg(F.pmod(best, F.lit(180.0)).alias("angle"))


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("double")


def group_curvelets(points: DataFrame, radius: float, step: float) -> DataFrame:
    """(image_id, fiber_id, center_row, center_col, angle, weight): one fiber per group: median centre rounded half up, mean orientation, number of curvelets.

    Points: image_id, seed (order of seeds), center_row, center_col, angle. fiber_id is the group's first seed. An image without points has no fibers.
    """
    grouped = points.select("image_id", "seed", "center_row", "center_col", "angle").join(seeds(points, radius), ["image_id", "seed"])
    centers = grouped.groupBy("image_id", "group").agg(_half_up(F.median("center_row")).alias("center_row"), _half_up(F.median("center_col")).alias("center_col"), F.count(F.lit(1)).cast("double").alias("weight"))
    angles = mean_orientations(grouped, step)
    return centers.join(angles, ["image_id", "group"], "left").select("image_id", F.col("group").cast("long").alias("fiber_id"), "center_row", "center_col", "angle", "weight")
