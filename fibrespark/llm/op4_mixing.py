"""Mixing sources to target weights by hash-threshold histograms.

1. Size of a document: its words. Totals per source, pre-aggregated on the map side.
2. Targets: shares by weight of ``budget`` times all sizes, none above ``most`` times its source's size; the excess goes to
   the others by weight. That is the water level over sources ordered by (cap / weight): one window over one row per source.
3. Each row has a 60-bit hash. Every document is taken ``floor(target / size)`` times; the rest of the target is a budget that
   the documents with the smallest hashes fill. The threshold hash is found from sums by (source, hash bucket) of 4096 buckets:
   the bucket in which the running sum crosses the budget is the only one that is refined, again into 4096, until
   it holds one hash. Thresholds are nested: a larger budget takes a superset. No row is ever sorted.
4. Rows are filtered by comparing their hash with their source's threshold.

The row at the threshold is taken if that brings the source nearer to its target; so a source misses it by half of one
document at most (up to the target's cap of twice). The hash is of the id and the text: reruns agree, and copies under
different ids are apart. Rows equal in id and text stand or fall together.

Null text: size 0. Null source: a source of its own, ordered last. Null id: hashed as an empty one. Empty table: empty result.
A source without words: target 0, taken 0. Further columns ride in a struct, so names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
LEVELS = (48, 36, 24, 12, 0)  # right shifts of the 60-bit hash: 4096 buckets at each level


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 over id and text, as a long of 0 or more."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(_source, source_size) to (_source, source_size, target). One row per source; the windows run over that small table."""
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    by_level = Window.orderBy(most * F.col("source_size") / F.col("_w"), F.col("_source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    leveled = (
        ranked.withColumn("_cap", (most * F.col("source_size")).cast("double"))
        .withColumn("_want", F.lit(budget) * F.sum("source_size").over(everything))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        # as if this source and all after it were open; the first that stays under its cap gives the level
        .withColumn("_level", (F.col("_want") - F.col("_capped")) / F.col("_open"))
    )
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_capped"), F.col("_level")))).over(everything)["_level"]
    return leveled.select("_source", "source_size", F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w"))).alias("target"))


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(_source, _whole, _cut): every row is taken _whole times, and once more if its hash is below _cut."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.select(
        "_source", "source_size", "target", whole.cast("long").alias("_whole"),
        (F.col("target") - whole * F.col("source_size")).alias("_left"), F.lit(0).cast("long").alias("_prefix"),
    )
    for depth, shift in enumerate(LEVELS):
        state = written(state, f"mix-level{depth}")
        here = state.select(F.col("_source").alias("_s"), F.col("_prefix").alias("_p"), F.col("_left").alias("_l"))
        bucket = F.shiftright("_hash", shift)
        inside = rows.join(here, F.col("_source").eqNullSafe(F.col("_s"))).where(F.shiftright(bucket, 12) == F.col("_p"))
        sums = inside.groupBy("_s", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"), F.first("_l").alias("_l"))
        running = Window.partitionBy("_s").orderBy("_bucket")  # at most 4096 rows a source
        sums = sums.withColumn("_upto", F.sum("_sum").over(running))
        crossing = sums.where(F.col("_upto") > F.col("_l")).groupBy("_s").agg(F.min(F.struct("_bucket", "_upto", "_sum")).alias("_b"))
        found = crossing.select(F.col("_s").alias("_k"), F.col("_b._bucket").alias("_bucket"), (F.col("_b._upto") - F.col("_b._sum")).alias("_below"), F.col("_b._sum").alias("_at"))
        joined = state.join(found, F.col("_source").eqNullSafe(F.col("_k")), "left")
        last = shift == LEVELS[-1]
        # no bucket crosses: all of the prefix is below the cut; carried on as the bucket after the last
        none = F.shiftleft(F.col("_prefix") + 1, 12)
        left = F.col("_left") - F.coalesce(F.col("_below").cast("double"), F.lit(0.0))
        nearer = F.col("_at") - left < left  # taking the hash at the cut misses the target by less
        state = joined.select(
            "_source", "source_size", "target", "_whole", left.alias("_left"),
            F.coalesce(F.col("_bucket") + F.when(F.lit(last) & nearer, 1).otherwise(0), none).cast("long").alias("_prefix"),
        )
    return state.select(F.col("_source").alias("_s"), "source_size", "target", "_whole", F.col("_prefix").alias("_cut"))


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """Every row of ``docs`` as struct _row, with size, source_size, target, _times (how often it is taken) and taken (words)."""
    size = count_words(F.col(text_col))
    base = docs.select(F.struct("*").alias("_row"), F.col(source_col).alias("_source"), size.alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("_hash"))
    small = written(base.select("_source", "size", "_hash"), "mix-sizes")
    totals = small.groupBy("_source").agg(F.sum("size").alias("source_size"))
    cuts = written(_thresholds(small, written(source_targets(totals, weights, budget, most), "mix-targets")), "mix-cuts")
    times = F.col("_whole") + (F.col("_hash") < F.col("_cut")).cast("long")
    joined = base.join(cuts, F.col("_source").eqNullSafe(F.col("_s")))
    return joined.withColumn("_times", times).withColumn("taken", F.col("_times") * F.col("size")).select("_row", "size", "source_size", "target", "_times", "taken")


def mix_report(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **how) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    return mixed(rows, "doc_id", "text", "source", **how).select(F.col("_row.doc_id").alias(id_col), "size", "source_size", "target", "taken")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    return mixed(docs, **how).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")
