"""Fibers, outlines, masks, coefficients and images derived from the general test tables; each has the same definition in SQL for the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 512  # height and width of a derived image

FIBERS_SQL = """fibers AS (
  SELECT CAST(floor(o_orderkey / 500.0) AS BIGINT) AS image_id, o_orderkey AS fiber_id, CAST((o_orderkey * 7919) % 512 AS DOUBLE) AS center_row,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 512 AS DOUBLE) AS center_col, CAST(round(o_totalprice * 10) AS BIGINT) % 1440 * 0.125::DOUBLE AS angle FROM orders)"""

POINTS_SQL = """boxes AS (
  SELECT CAST(floor(s_suppkey * 3 / 10.0) AS BIGINT) AS image_id, s_suppkey AS roi_id, 40 + (s_suppkey * 37) % 300 AS r0, 40 + (s_suppkey * 53) % 300 AS c0,
         30 + (s_suppkey * 11) % 90 AS h, 30 + (s_suppkey * 17) % 90 AS w FROM supplier),
points AS (
  SELECT image_id, roi_id, s AS seq,
         CASE WHEN s <= w THEN r0 WHEN s <= w + h THEN r0 + s - w WHEN s <= 2 * w + h THEN r0 + h ELSE r0 + h - (s - 2 * w - h) END AS row,
         CASE WHEN s <= w THEN c0 + s WHEN s <= w + h THEN c0 + w WHEN s <= 2 * w + h THEN c0 + w - (s - w - h) ELSE c0 END AS col
  FROM (SELECT *, unnest(range(2 * (h + w) + 1)) AS s FROM boxes))"""

MASK_SQL = """mask AS (SELECT DISTINCT image_id, CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col
  FROM (SELECT image_id, r0, c0, h, w, unnest(range(r0, r0 + h)) AS r FROM boxes), LATERAL (SELECT unnest(range(c0, c0 + w)) AS c))"""

COEFFS_SQL = """coeffs AS (
  SELECT vec_id AS image_id, CAST(floor(i / 8.0) AS BIGINT) AS wedge, i % 8 AS k, abs(v)::DOUBLE AS value FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings))"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fibers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 fibers an image, spread over 512 x 512 pixels."""
    key = F.col("o_orderkey")
    cents = lambda m: F.round(F.col("o_totalprice") * m).cast("long")
    return _table(spark, sf_dir, "orders").select(
        F.floor(key / 500.0).cast("long").alias("image_id"), key.alias("fiber_id"), (key * 7919 % 512).cast("double").alias("center_row"),
        (cents(100) % 512).cast("double").alias("center_col"), (cents(10) % 1440 * F.lit(0.125)).alias("angle"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About three rectangular regions an image."""
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(
        F.floor(k * 3 / 10.0).cast("long").alias("image_id"), k.alias("roi_id"), (40 + k * 37 % 300).alias("r0"), (40 + k * 53 % 300).alias("c0"), (30 + k * 11 % 90).alias("h"), (30 + k * 17 % 90).alias("w")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed outlines of the boxes, neighbours touching."""
    b = boxes(spark, sf_dir).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), 2 * (F.col("h") + F.col("w")))))
    s, r0, c0, h, w = (F.col(c) for c in ("s", "r0", "c0", "h", "w"))
    row = F.when(s <= w, r0).when(s <= w + h, r0 + s - w).when(s <= 2 * w + h, r0 + h).otherwise(r0 + h - (s - 2 * w - h))
    col = F.when(s <= w, c0 + s).when(s <= w + h, c0 + w).when(s <= 2 * w + h, c0 + w - (s - w - h)).otherwise(c0)
    return b.select("image_id", "roi_id", s.alias("seq"), row.alias("row"), col.alias("col"))


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as coefficients: eight wedges of eight."""
    v = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    return v.select("image_id", F.floor(F.col("i") / 8.0).cast("long").alias("wedge"), (F.col("i") % 8).alias("k1"), F.lit(0).alias("k2"), F.abs(F.col("v").cast("double")).alias("value"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 3-D coefficients: eight wedges of 2 x 2 x 2."""
    c = coefficients(spark, sf_dir)
    k = F.col("k1")
    return c.select("image_id", "wedge", F.shiftright(k, 2).alias("k1"), F.shiftright(k, 1).bitwiseAND(F.lit(1)).alias("k2"), k.bitwiseAND(F.lit(1)).alias("k3"), "value")


def _lit(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """(image_id, r, c, v): how often a pixel of a plane of ``side`` is met by short lines through its fibers."""
    scale = side / SIDE
    step = F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("t")
    # fibers are dealt by image once, before lines are drawn; pictures cost more than their fibers weigh, by which few tasks would be made
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    at = fibers(spark, sf_dir).select("image_id", "angle", "center_row", "center_col").repartition(parts, "image_id").select("*", step)
    place = lambda x: F.floor(x + 0.5000005)  # noqa: E731  # floor(round(x, 6) + 0.5), without decimals
    r, c = F.col("center_row") * scale - F.col("t") * F.sin(F.radians("angle")), F.col("center_col") * scale + F.col("t") * F.cos(F.radians("angle"))
    at = at.select("image_id", place(r).alias("r"), place(c).alias("c"))
    return at.where(F.col("r").between(0, side - 1) & F.col("c").between(0, side - 1)).groupBy("image_id", "r", "c").agg(F.count(F.lit(1)).cast("double").alias("v"))


def lit_pictures(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """pictures() by their lit pixels alone: image_id, height, width, places, levels."""
    at = F.struct((F.col("r") * side + F.col("c")).cast("int").alias("k"), "v")
    cells = _lit(spark, sf_dir, side).groupBy("image_id").agg(F.collect_list(at).alias("cells"))  # at most side * side
    return cells.select("image_id", F.lit(side).alias("height"), F.lit(side).alias("width"), F.col("cells.k").alias("places"), F.col("cells.v").alias("levels"))


def pictures(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """A picture per image of fibers (image_id, height, width, pixels): each fiber a short bright line, on a plane scaled to ``side``."""
    lit = _lit(spark, sf_dir, side)
    cells = lit.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((F.col("r") * side + F.col("c")).alias("k"), "v"))).alias("cells"))  # at most side * side
    dark = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    before = lambda i: F.coalesce(F.get("cells", i - 1)["k"], F.lit(-1))
    runs = F.transform("cells", lambda x, i: F.concat(dark(x["k"] - before(i) - 1), F.array(x["v"])))
    pixels = F.concat(F.flatten(runs), dark(F.lit(side * side - 1) - F.element_at("cells", -1)["k"]))
    return cells.select("image_id", F.lit(side).alias("height"), F.lit(side).alias("width"), pixels.alias("pixels"))


STACK = 16  # slices of a derived stack
STACK_SIDE = 32

STACKS_SQL = f"""lit AS (SELECT CAST(floor(image_id / {STACK}.0) AS BIGINT) AS image_id, (image_id % {STACK})::INT AS z, r, c, count(*) AS v
  FROM (SELECT image_id, floor(round(center_row * {STACK_SIDE / SIDE} - t * sin(radians(angle)), 6) + 0.5)::INT AS r, floor(round(center_col * {STACK_SIDE / SIDE} + t * cos(radians(angle)), 6) + 0.5)::INT AS c
    FROM fibers, (SELECT unnest(range(-3, 4)) AS t)) WHERE r BETWEEN 0 AND {STACK_SIDE - 1} AND c BETWEEN 0 AND {STACK_SIDE - 1} GROUP BY ALL)"""


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small pictures, one upon the other: image_id (the stack), z, height, width, pixels."""
    image = F.col("image_id")
    return pictures(spark, sf_dir, STACK_SIDE).select(F.floor(image / float(STACK)).cast("long").alias("image_id"), (image % STACK).cast("int").alias("z"), "height", "width", "pixels")
