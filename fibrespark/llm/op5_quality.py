"""Quality rules with adaptive thresholds; DataFrame functions only.

1. Each text's measures are computed inside its row (no shuffle): words, characters in words, symbols, repeated
   lines, words in repeated 3-word windows. Windows are told apart by a 64-bit hash of their three words within one text.
2. Rows that pass the base rule feed mergeable KLL quantile sketches per (language, source). Sketches of a language
   and of everything are merged from those. A group with fewer than ``min_group`` rows uses its language's sketch, a
   language with fewer uses the sketch of everything.
3. Thresholds are fences around the quartiles, ``q75 + width * max(q75 - q25, least spread)`` and, for the mean
   word length, the mirrored lower fence. They are joined back to the measures and filter the rows.

The measures are written to the shared folder between the two passes, so texts are read once. The join with the thresholds has no
broadcast hint: Spark broadcasts by the written table's size, and a hot source is split by adaptive execution.

Null text: no words, fails the base rule. Null language or source: a group of its own (null-safe join). Repeated
rows: each is judged alone. Empty table: empty result. Further columns never clash: they ride in a struct.
A sketch holds every value while a group has at most ``sketch_k`` rows; above, ranks are within about 3/sketch_k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, has_word, words_of, written

#: Measure -> least spread. Fences never come closer to a quartile than ``width`` times this.
LEAST_SPREAD = {"mean_chars": 0.5, "symbols": 0.03, "dup_lines": 0.1, "repeats": 0.1}
#: Only this measure has a lower fence.
TWO_SIDED = "mean_chars"
WIDTH = 3.0
MIN_GROUP = 200
SKETCH_K = 1024


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort (hash, position), mark equal neighbours, add up the steps."""

    def marked(pairs: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        found = F.transform(pairs, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.sort_array(F.filter(found, lambda p: p.isNotNull()))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _bind(pairs, lambda p: _bind(marked(p), covered))


def measures(rows: DataFrame, text_col: str = "_text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with a text column."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = rows.withColumn("_words", words_of(text)).withColumn("n_words", F.size("_words").cast("long"))
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    hashes = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), window))
    out = out.withColumn("_hashes", F.coalesce(hashes, F.array().cast("array<bigint>")))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n"), has_word))
    out = out.withColumns({
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _repeat_words(F.col("_hashes"))).otherwise(0).cast("long"),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_hashes", "_lines")


def _ratios() -> dict[str, Column]:
    share = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    return {"mean_chars": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "_n_lines"), "repeats": share("n_repeat_words", "n_words")}


def thresholds(measured: DataFrame, width: float = WIDTH, min_group: int = MIN_GROUP, sketch_k: int = SKETCH_K) -> DataFrame:
    """Per (_lang, _source): lo_<measure> and hi_<measure>. Sketches are aggregated per group on the map side first, then merged upward."""
    names = list(LEAST_SPREAD)
    sketches = (
        measured.where(~F.col("base_failed")).groupBy("_lang", "_source")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.kll_sketch_agg_double(v, F.lit(sketch_k)).alias(k) for k, v in _ratios().items()])
    )
    sketches = written(sketches, "quality-sketches")  # one row a group
    merged = [F.kll_merge_agg_double(k, F.lit(sketch_k)).alias(f"_up_{k}") for k in names]
    by_lang = sketches.groupBy("_lang").agg(F.sum("_n").alias("_n_up"), *merged).withColumnRenamed("_lang", "_l")
    over_all = by_lang.agg(F.sum("_n_up").alias("_n_all"), *[F.kll_merge_agg_double(f"_up_{k}", F.lit(sketch_k)).alias(f"_all_{k}") for k in names])
    # each language's row holds the sketch to back off to, so no row is joined with another of its own level
    by_lang = by_lang.join(F.broadcast(over_all))  # one row, by construction
    by_lang = by_lang.select("_l", *[F.when(F.col("_n_up") >= min_group, F.col(f"_up_{k}")).otherwise(F.col(f"_all_{k}")).alias(f"_up_{k}") for k in names])
    joined = sketches.join(by_lang, F.col("_lang").eqNullSafe(F.col("_l")), "inner")
    bounds = []
    for k in names:
        sketch = F.when(F.col("_n") >= min_group, F.col(k)).otherwise(F.col(f"_up_{k}"))
        q25, q75 = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        reach = F.lit(width) * F.greatest(q75 - q25, F.lit(LEAST_SPREAD[k]))
        bounds += [(q25 - reach).alias(f"lo_{k}"), (q75 + reach).alias(f"hi_{k}")]
    return joined.select(F.col("_lang").alias("_t_lang"), F.col("_source").alias("_t_source"), *bounds)


def _judged(measured: DataFrame, **how) -> DataFrame:
    """Adds kept. A row without thresholds (all of its group failed the base rule) has failed the base rule itself."""
    limits = written(thresholds(measured, **how), "quality-thresholds")
    joined = measured.join(limits, F.col("_lang").eqNullSafe(F.col("_t_lang")) & F.col("_source").eqNullSafe(F.col("_t_source")), "left")
    within = ~F.col("base_failed")
    for k, v in _ratios().items():
        within = within & (v <= F.col(f"hi_{k}"))
        if k == TWO_SIDED:
            within = within & (v >= F.col(f"lo_{k}"))
    return joined.withColumn("kept", F.coalesce(within, F.lit(False)))


def quality_report(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", **how) -> DataFrame:
    """One row per input row: id, the measures, base_failed and kept."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    measured = written(measures(rows).drop("_text"), "quality-measures")
    return _judged(measured, **how).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def filter_quality(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    measured = written(measures(rows).drop("_text"), "quality-measures")
    return _judged(measured, **how).where("kept").select("_row.*")
