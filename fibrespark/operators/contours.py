"""Masks to outlines: connected components of a raster and closed contours, as joins and grouped aggregates; an image may be many keys.

Components: pixels become runs of a pixel row; runs of neighbouring rows that overlap, corners included, are linked; alternating stars (Kiveris et al., 2014) join linked runs to their first.
Contours: a filled pixel with an empty neighbour holds a point between the two. Which point follows is told by the eight pixels around, so the points of a loop are a linked list.
Masks are pixels (image_id, row, col, value) or disjoint runs of them (image_id, row, first, last); pixels inside of a region are never sent, only runs and the pixels at their edges.
Lists are ranked by pointer doubling: after k rounds a point knows the least of the next 2 ** k points and how far it is, and rounds end when no point learns a lesser one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fibrespark.functions.tables import Rounds, merged

#: Columns of a cell in which runs of neighbouring rows meet.
CELL = 64
#: Columns of a cell in which the pixels around are told, as bits of a long with one column more to each side.
BITS = 60
#: Steps (row, column) up, right, down, left: each is the one before it turned clockwise.
STEPS = ((-1, 0), (0, 1), (1, 0), (0, -1))


def _filled(mask: DataFrame) -> DataFrame:
    return mask.where("value > 0").select("image_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()


def mask_runs(mask: DataFrame) -> DataFrame:
    """(image_id, row, first, last): the runs of filled pixels of every pixel row. Mask: image_id, row, col, value; above 0 is filled, repeated pixels count once. Or such runs."""
    if "first" in mask.columns:
        return mask.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("row", "first", "last")])
    order = Window.partitionBy("image_id", "row").orderBy("col")
    rows = _filled(mask).withColumn("run", F.col("col") - F.row_number().over(order))
    return rows.groupBy("image_id", "row", "run").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("run")


def run_links(runs: DataFrame) -> DataFrame:
    """Runs (image_id, row, first, last, node) to (image_id, a, b): runs of neighbouring rows that overlap or touch by a corner."""
    cell = lambda c: F.floor(c / CELL)
    spread = runs.select("image_id", "row", "first", "last", "node", F.explode(F.sequence(cell(F.col("first") - 1), cell(F.col("last") + 1))).alias("cell"))
    above = spread.select("image_id", (F.col("row") + 1).alias("row"), "cell", F.col("first").alias("f"), F.col("last").alias("l"), F.col("node").alias("b"))
    met = spread.join(merged(above), ["image_id", "row", "cell"]).where("first <= l + 1 AND f <= last + 1")
    return met.select("image_id", F.col("node").alias("a"), "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (image_id, a, b) between longs to (image_id, node, root): each linked node with the least one that links reach. Large star and small star in turn, until neither moves a link."""
    rounds = Rounds(links.sparkSession, "components")
    both = lambda e: e.unionByName(e.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
    ordered = lambda e: e.where("a <> b").select("image_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = rounds.write(ordered(links))
    while True:
        around = both(edges)
        least = around.groupBy("image_id", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = rounds.write(ordered(around.where("b > a").join(merged(least), ["image_id", "a"]).select("image_id", F.col("b").alias("a"), F.col("m").alias("b"))))
        least = large.groupBy("image_id", "a").agg(F.min("b").alias("m"))
        small = large.join(merged(least), ["image_id", "a"]).select("image_id", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("image_id", "a", F.col("m").alias("b")))
        small = rounds.write(ordered(small))
        moved = small.join(merged(edges), ["image_id", "a", "b"], "left_anti")
        done = moved.isEmpty() and edges.join(merged(small), ["image_id", "a", "b"], "left_anti").isEmpty()
        rounds.drop(edges, large)
        edges = small
        if done:
            return edges.select("image_id", F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("image_id", F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def labelled_runs(mask: DataFrame) -> DataFrame:
    """(image_id, row, first, last, roi_id): runs with the number of their component, from 1 in the order of components' first pixels, row by row."""
    rounds = Rounds(mask.sparkSession, "runs")
    # a run is named by its first pixel, so a component's least run is its first
    runs = rounds.write(mask_runs(mask).withColumn("node", F.shiftleft("row", 32) + F.col("first")))
    roots = components(run_links(runs))
    rooted = runs.join(merged(roots), ["image_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("root")).cast("long")
    numbers = rooted.select("image_id", "root").distinct().withColumn("roi_id", number)
    return rooted.join(merged(numbers), ["image_id", "root"]).select("image_id", "row", "first", "last", "roi_id")


def mask_components(mask: DataFrame) -> DataFrame:
    """(image_id, row, col, roi_id) of every filled pixel."""
    return labelled_runs(mask).select("image_id", "row", F.explode(F.sequence("first", "last")).alias("col"), "roi_id")


def contour_steps(mask: DataFrame) -> DataFrame:
    """(image_id, r, c, next_r, next_c, row, col): the points of all contours in half pixels (r and c are doubled), the point after each, and the filled pixel that it is beside.

    Filled pixels lie to the left. Where two of them touch by their corner, the empty ones stay apart from each other.
    """
    bit = {step: 1 << k for k, step in enumerate((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))}
    # a run tells its own pixel row and the two beside it which columns of a cell it fills; the cell's first bit is the column before it
    cells = F.explode(F.sequence(F.floor((F.col("first") - 1) / BITS), F.floor((F.col("last") + 1) / BITS)))
    runs = mask_runs(mask).select("image_id", "row", "first", "last", cells.alias("cell")).withColumn("base", F.col("cell") * BITS - 1)
    runs = runs.withColumns({"low": F.greatest(F.lit(0), F.col("first") - F.col("base")).cast("int"), "high": F.least(F.lit(BITS + 1), F.col("last") - F.col("base")).cast("int")})
    runs = runs.withColumn("bits", F.expr("shiftleft(shiftleft(1L, high - low + 1) - 1L, low)"))
    told = F.explode(F.array(*[F.struct((F.col("row") - a).alias("row"), *[(F.col("bits") if x == a else F.lit(0).cast("long")).alias(n) for x, n in ((-1, "up"), (0, "own"), (1, "down"))]) for a in (-1, 0, 1)]))
    rows = runs.select("image_id", "cell", "base", told.alias("x")).select("image_id", "cell", "base", "x.*").groupBy("image_id", "row", "cell", "base").agg(*[F.bit_or(n).alias(n) for n in ("up", "own", "down")])
    three = lambda n: F.expr(f"shiftright({n}, i - 1) & 7L")
    at_edge = F.expr(f"filter(sequence(1, {BITS}), i -> (shiftright(own & ~(up & down & shiftleft(own, 1) & shiftright(own, 1)), i) & 1L) = 1L)")
    seen = rows.where("own <> 0").withColumn("i", F.explode(at_edge)).select("image_id", "row", (F.col("base") + F.col("i")).alias("col"), (three("up") + three("own") * 8 + three("down") * 64).cast("int").alias("seen"))
    edge = sum(bit[s] for s in STEPS)
    seen = seen.where((F.col("seen").bitwiseAND(F.lit(bit[0, 0])) != 0) & (F.col("seen").bitwiseAND(F.lit(edge)) != edge))
    filled = lambda *step: F.col("seen").bitwiseAND(F.lit(bit[step])) != 0

    def point(at: tuple[int, int], towards: tuple[int, int]) -> Column:
        return F.struct((2 * (F.col("row") + at[0]) + towards[0]).alias("r"), (2 * (F.col("col") + at[1]) + towards[1]).alias("c"))

    points = []
    for k, (dr, dc) in enumerate(STEPS):
        side, back = STEPS[(k + 1) % 4], STEPS[k - 1]
        ahead = (side[0] + dr, side[1] + dc)
        follows = F.when(~filled(*side), point((0, 0), side)).when(~filled(*ahead), point(side, (dr, dc))).otherwise(point(ahead, back))
        points.append(F.when(~filled(dr, dc), F.struct(point((0, 0), (dr, dc)).alias("p"), follows.alias("n"))))
    each = seen.select("image_id", "row", "col", F.explode(F.array_compact(F.array(*points))).alias("x"))
    return each.select("image_id", F.col("x.p.r").alias("r"), F.col("x.p.c").alias("c"), F.col("x.n.r").alias("next_r"), F.col("x.n.c").alias("next_c"), "row", "col")


def ranked_loops(steps: DataFrame) -> DataFrame:
    """Closed lists (image_id, at, next) to (image_id, at, start, left): the least place of each loop, and how many steps lead there."""
    rounds = Rounds(steps.sparkSession, "loops")
    state = rounds.write(steps.select("image_id", "at", "next", F.col("at").alias("start"), F.lit(0).cast("long").alias("left")))
    reach = 1
    while True:
        ahead = state.select("image_id", F.col("at").alias("next"), F.col("next").alias("_next"), F.col("start").alias("_start"), F.col("left").alias("_left"))
        better = F.col("_start") < F.col("start")
        both = state.join(merged(ahead), ["image_id", "next"])
        doubled = rounds.write(
            both.select("image_id", "at", F.col("_next").alias("next"), F.least("start", "_start").alias("start"), F.when(better, F.col("_left") + reach).otherwise(F.col("left")).alias("left"), better.alias("moved"))
        )
        rounds.drop(state)
        state, reach = doubled, 2 * reach
        if state.where("moved").isEmpty():
            return state.select("image_id", "at", "start", "left")


def contours(mask: DataFrame) -> DataFrame:
    """(image_id, loop, size, seq, row, col, pixel_row, pixel_col): every closed contour in half-pixel coordinates from its least point on; loop names it, and the first point isn't repeated."""
    rounds = Rounds(mask.sparkSession, "contours")
    at = lambda r, c: F.shiftleft(r, 32) + F.col(c)
    steps = rounds.write(contour_steps(mask).select("image_id", at("r", "c").alias("at"), at("next_r", "next_c").alias("next"), "row", "col"))
    found = rounds.write(ranked_loops(steps))
    sizes = found.groupBy("image_id", "start").agg(F.count(F.lit(1)).alias("size"))
    placed = found.join(merged(sizes), ["image_id", "start"]).join(merged(steps.select("image_id", "at", F.col("row").alias("pixel_row"), F.col("col").alias("pixel_col"))), ["image_id", "at"])
    seq = F.pmod(F.col("size") - F.col("left"), F.col("size"))
    r = F.shiftright(F.col("at") + 1, 32)  # c is -1 at least
    return placed.select("image_id", F.col("start").alias("loop"), "size", seq.alias("seq"), (r / 2).alias("row"), ((F.col("at") - F.shiftleft(r, 32)) / 2).alias("col"), "pixel_row", "pixel_col")


def mask_contours(mask: DataFrame) -> DataFrame:
    """(image_id, roi_id, seq, row, col): the longest contour of each component (the first of equal ones), in half-pixel coordinates, closed. Mask: image_id, row, col, value (above 0 is filled), or disjoint runs: image_id, row, first, last."""
    rounds = Rounds(mask.sparkSession, "contours")
    mask = rounds.write(mask_runs(mask))
    points = rounds.write(contours(mask))
    loops = points.where("seq = 0").select("image_id", "loop", "size", F.col("pixel_row").alias("row"), "pixel_col", F.floor(F.col("pixel_col") / CELL).alias("cell"))
    runs = labelled_runs(mask).withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL))))
    named = loops.join(merged(runs), ["image_id", "row", "cell"]).where(F.col("pixel_col").between(F.col("first"), F.col("last")))
    longest = named.groupBy("image_id", "roi_id").agg(F.min(F.struct((-F.col("size")).alias("less"), "loop"))["loop"].alias("loop"))
    chosen = points.join(merged(longest), ["image_id", "loop"])
    again = chosen.where("seq = 0").withColumn("seq", F.col("size"))
    return chosen.unionByName(again).select("image_id", "roi_id", "seq", "row", "col")
