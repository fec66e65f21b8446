"""Filter interaction audit: what every order of a set of filters removes, from one count a (part, mask).

1. Each document becomes a mask: bit k is set where it fails filter k. Texts are read once; the masks are written.
2. Documents are counted by (part, mask), in all and by label: at most 2 ** filters rows a part, combined on the map side, whatever a part holds.
3. Subset-zeta transform: per part the counts are summed over the subsets of every mask, one bit after the other, which gives the survivors of every
   subset of filters (those whose mask is a subset of the other filters). Labelled documents likewise.
4. A step of an order is the difference between two neighbouring subsets; a filter's Shapley value is the sum of such differences over all orders.

``duplicate_of_smaller`` is the one condition that needs other rows. Copies are counted by (text key, part, label), so that a text that a third of the rows
share is a few rows after the map side, and only the copies with the smallest id pass.

Null text: as empty. Null part: the empty string. Null ids come after all others, are no copies of each other, and have no labels.
Rows equal in id and text: each counts, none is a copy of the other. A document with several label rows has a label if one of them has it.
Very long texts: one pass each. Empty table: empty result. Further columns aren't read.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, words_of, written

#: Labels that are followed through the orders.
LABELS = ("good", "toxic")


def text_conditions(text: Column) -> list[Column]:
    """The conditions A, B, C and D on a text that isn't null: few words, few distinct words, many capitals, symbols."""

    def by_words(words: Column) -> Column:
        return F.struct((F.size(words) < 50).alias("A"), (100 * F.size(F.array_distinct(words)) < 65 * F.size(words)).alias("B"))

    pair = F.get(F.transform(F.array(words_of(text)), by_words), 0)
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [pair["A"], pair["B"], 100 * capitals > 5 * F.char_length(text), text.rlike("[#$%&*|]")]


def masked(docs: DataFrame, part_col: str, id_col: str, text_col: str, conditions=text_conditions) -> DataFrame:
    """One written row a document: _id, part, k1, k2 (the text's key) and mask, the bits of the ``conditions`` that it meets."""
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("_text"))
    bits = [F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(conditions(F.col("_text")))]
    return written(base.select("_id", "part", F.xxhash64("_text").alias("k1"), F.xxhash64(F.lit("second"), "_text").alias("k2"), sum(bits[1:], bits[0]).cast("int").alias("mask")), "audit-masks")


def labelled(rows: DataFrame, labels: DataFrame | None, label_id: str = "doc_id") -> DataFrame:
    """``rows`` with good and toxic (0 or 1). Ids without labels, null ones too, have neither; null ids aren't moved."""
    if labels is None:
        return rows.select("*", *[F.lit(0).alias(name) for name in LABELS])
    of = labels.groupBy(F.col(label_id).cast("long").alias("_l")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    of = of.where("_l IS NOT NULL AND good + toxic > 0")
    known = rows.where("_id IS NOT NULL").join(of, F.col("_id") == F.col("_l"), "left").drop("_l")
    known = known.withColumns({name: F.coalesce(name, F.lit(0)) for name in LABELS})
    return known.unionByName(rows.where("_id IS NULL").select("*", *[F.lit(0).alias(name) for name in LABELS]))


def duplicate_of_smaller(rows: DataFrame, bit: int) -> DataFrame:
    """rows (_id, part, k1, k2, mask, labels) to counts (part, mask, labels, n) in which the texts of a smaller id have ``bit`` set in their mask."""
    alike = ["k1", "k2", "part", "mask", *LABELS]
    here = F.coalesce("_id", F.lit(LAST_ID))
    by_id = rows.groupBy(here.alias("i"), *alike).agg(F.count(F.lit(1)).alias("m"))
    groups = by_id.groupBy(*alike).agg(F.sum("m").alias("n"), F.min(F.struct("i", "m")).alias("first"))
    # of one text: parts x labels rows at most
    least = groups.groupBy("k1", "k2").agg(F.min("first.i").alias("least"), F.count(F.lit(1)).alias("parts"))
    several = least.where("parts > 1").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "least")
    held = groups.join(several, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    held = held.withColumn("passed", F.when(F.col("first.i") == F.coalesce("least", F.col("first.i")), F.col("first.m")).otherwise(0))
    cases = F.array(F.struct(F.col("mask").alias("mask"), F.col("passed").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))
    told = held.select("part", *LABELS, F.explode(cases).alias("c")).select("part", "c.mask", *LABELS, "c.n").where("n > 0")
    return told.groupBy("part", "mask", *LABELS).agg(F.sum("n").alias("n"))


def zeta_step(counts: Column, bit: int) -> Column:
    """Adds to each mask that has ``bit`` the count of the mask without it; done for every bit, counts become sums over subsets."""
    return F.transform(counts, lambda value, at: value + F.when(at.bitwiseAND(F.lit(bit)) != 0, F.get(counts, at - bit)).otherwise(0))


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """counts (part, mask, labels, n) to (part, all, good, toxic): arrays in which element S is how many documents pass every filter of the subset S."""
    size = 1 << filters
    kinds = {"all": F.col("n"), **{name: F.col("n") * F.col(name) for name in LABELS}}
    by_mask = counts.groupBy("part").agg(*[F.array(*[F.sum(F.when(F.col("mask") == m, value).otherwise(0)) for m in range(size)]).alias(name) for name, value in kinds.items()])
    summed = by_mask
    for k in range(filters):  # a projection a bit, so that no array is computed twice
        summed = summed.select("part", *[zeta_step(F.col(name), 1 << k).alias(name) for name in kinds])
    # a document passes all of S if its mask is a subset of the rest: the array read from its end
    return summed.select("part", *[F.reverse(name).alias(name) for name in kinds])


def order_steps(passed: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of the filters and step, from the survivors of every subset."""
    filters = len(letters)
    full = (1 << filters) - 1
    steps = []
    for order in permutations(range(filters)):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append({"filter_order": "".join(letters[f] for f in order), "step": step, "bit": 1 << k, "before": before, "filter": k})
            before |= 1 << k
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int,filter:int>>")

    def shapley(k: int) -> Column:
        terms = []
        for subset in range(full + 1):
            if not subset >> k & 1:
                chosen = subset.bit_count()
                terms.append(F.lit(factorial(chosen) * factorial(filters - 1 - chosen)) * (F.get("all", F.lit(subset)) - F.get("all", F.lit(subset | 1 << k))))
        return sum(terms[1:], terms[0])

    rows = passed.withColumn("values", F.array(*[shapley(k) for k in range(filters)])).select("part", "all", *LABELS, "values", F.inline(plan))
    after, before, bit = F.col("before") + F.col("bit"), F.col("before"), F.col("bit")
    lost = lambda name: F.get(F.col(name), before) - F.get(F.col(name), after)
    failing = F.get("all", F.lit(0)) - F.get(F.col("all"), bit)
    return rows.select(
        "part", "filter_order", "step", F.get(F.col("all"), after).alias("kept"), lost("all").alias("removed"), (failing - lost("all")).alias("redundant"),
        (F.get(F.col("all"), F.lit(full) - bit) - F.get("all", F.lit(full))).alias("unique_fails"), *[lost(name).alias(f"{name}_lost") for name in LABELS],
        F.get("values", F.col("filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame | None = None, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text", letters: str = "ABCDE", conditions=text_conditions) -> DataFrame:
    """One row per part, order and step. The filters are the ``conditions`` on the text, and last the copies of a smaller id's text; ``letters`` names them."""
    rows = labelled(masked(docs, part_col, id_col, text_col, conditions), labels)
    return order_steps(survivors(duplicate_of_smaller(rows, 1 << (len(letters) - 1)), len(letters)), letters)
