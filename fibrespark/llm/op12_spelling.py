"""Spelling variant grouping: a trie self-join of the vocabulary with active-node sets, at distance one.

Two words are near if one becomes the other by one inserted, deleted or replaced code point. Written with m for the shorter length, such words agree up to
one position i in 0 ... m and again behind it; they agree on their first half if i lies in the second, and on their second half if it lies in the first.

1. Words are counted, combined on the map side. From here on work grows with the vocabulary.
2. A word goes to four partitions of the tries of the words and of the reversed words: as a word of its length and as one that is longer by one, by its first half
   with the window of positions in the second, and by its second half with the window in the first. Partitions of one word, or of longer words alone, end here.
3. A task builds the trie of what a partition's words hold in their window and goes down from the root. At each node, which is at distance 0 of itself, its pairs
   of children, and a child of the longer words' trie with the node, become active at distance 1; active pairs go down along equal labels only. Where both end, a pair is emitted.
   A deleted code point counts as the last of its run, so a pair is found in one partition, at one node.
4. A partition of more than ``CROWDED`` words is dealt anew by half its window, and so on. A window of one position leaves as many words as code points may stand there.
5. A word's form is its near word of the largest count, if that is ``ratio`` times its own; roots are found by pointer doubling along forms, whose counts grow each step.

Null text: no words. Null ids: an empty string before the colon of what is hashed. Repeated rows count again. Words of any length: rows and tries
grow with it. Empty table: empty result. Further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5
#: One in so many (document, run) loses a code point before it is counted; 0: none.
HOLES = 199
#: Words of a partition that one task takes.
CROWDED = 4096
LINKS = "word string, near string, near_n long"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, holes: int = HOLES) -> DataFrame:
    """(word, n) of the words of at least ``least_chars`` code points that occur ``least_count`` times: runs of letters, with A-Z lower-cased.

    Where ``holes`` divides the CRC-32 h of ``<id>:<run>``, the run loses its code point h modulo its length.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least_chars)
    # lower() would change accented capitals as well
    word = F.when(F.col("run").rlike("[À-Þ]"), F.translate("run", UPPER, LOWER)).otherwise(F.lower("run"))
    words = runs.select("_id", word.alias("word"))
    if holes:
        words = words.withColumn("h", F.crc32(F.concat("_id", F.lit(":"), "word"))).withColumn("size", F.char_length("word"))
        at = (F.col("h") % F.col("size")).cast("int")
        holed = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.col("size")))
        words = words.select(F.when(F.col("h") % holes == 0, holed).otherwise(F.col("word")).alias("word"))
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _window(m: Column, lo: Column, hi: Column, longer: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), longer.alias("longer"))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (word, n, w) to (word, n, w, key, inner): the key is all of the word but the window w, which is ``inner``; its lengths are fixed by m, lo and hi."""
    lo, more = F.col("w.lo"), F.when(F.col("w.longer"), 1).otherwise(0)
    end = F.col("w.hi") + more
    size = F.char_length("word")
    key = F.concat_ws(",", F.col("w.m"), lo, F.concat(F.col("w.hi").cast("string"), F.lit(";"), F.substring("word", F.lit(1), lo), F.substring("word", end + 1, size)))
    return rows.withColumns({"key": key, "inner": F.substring("word", lo + 1, end - lo)})


def _trie(strings: list[str]) -> dict:
    root: dict = {}
    for k, s in enumerate(strings):
        node = root
        for char in s:
            node = node.setdefault(char, {})
        node[""] = k
    return root


def _down(u: dict, v: dict, unlike: str | None) -> Iterator[tuple[int, int]]:
    """Terminals below nodes active for each other at distance 1: equal labels only, the first of them other than ``unlike``."""
    stack = [(u, v, unlike)]
    while stack:
        u, v, unlike = stack.pop()
        if "" in u and "" in v:
            yield u[""], v[""]
        for label in (u if len(u) < len(v) else v).keys():
            if label and label != unlike and label in u and label in v:
                stack.append((u[label], v[label], None))


def joined(shorter: list[str], longer: list[str], positions: int) -> Iterator[tuple[int, int, bool]]:
    """(i, j, whether j is of ``longer``) of strings at distance one that part at one of the first ``positions``.

    Each list holds distinct strings of one length, those of ``longer`` one code point more.
    """
    stack = [(_trie(shorter), _trie(longer), 0)]
    while stack:
        node, other, depth = stack.pop()
        children = [(label, child) for label, child in node.items() if label]
        for (_, u), (_, v) in combinations(children, 2):
            for i, j in _down(u, v, None):
                yield i, j, False
        for label, child in other.items():
            if label:
                for j, i in _down(child, node, label):
                    yield i, j, True
        if depth + 1 < positions:
            stack += [(child, other.get(label, {}), depth + 1) for label, child in children]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, inner, longer, positions, word, n), those of a key one after the other, to links in both directions."""
    out: list[tuple[str, str, int]] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), ()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])
        out.clear()
        return batch

    def finish(group: list[tuple]) -> None:
        short, long = [r for r in group if not r[2]], [r for r in group if r[2]]
        if not short or len(group) < 2:
            return
        for i, j, is_longer in joined([r[1] for r in short], [r[1] for r in long], short[0][3]):
            a, b = short[i], (long if is_longer else short)[j]
            out.append((a[4], b[4], b[5]))
            out.append((b[4], a[4], a[5]))

    key, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != key:
                finish(group)
                key, group = row[0], []
                if len(out) >= 20_000:
                    yield flush()
            group.append(row)
    finish(group)
    yield flush()


def near_words(words: DataFrame, least_chars: int = 1, crowded: int = CROWDED) -> DataFrame:
    """words (word, n), each once, to (word, near, near_n): every two words at distance one, in both directions, each once."""
    size = F.char_length("word")
    half = lambda m: F.floor((m + 1) / 2)
    windows = [_window(m, lo, hi, F.lit(longer)) for m, longer in ((size, False), (size - 1, True)) for lo, hi in ((F.lit(0), half(m)), (half(m), m + 1))]
    rows = words.select("word", "n", F.explode(F.array(*windows)).alias("w")).where((F.col("w.m") >= least_chars) & (F.col("w.lo") < F.col("w.hi")))
    links: DataFrame | None = None
    while True:
        rows = _dealt(rows)
        met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("w.longer").alias("alone")).where("size > 1 AND NOT alone")
        rows = written(rows.join(met.drop("alone"), "key"), "spelling-partitions")
        many = (F.col("size") > crowded) & (F.col("w.hi") - F.col("w.lo") > 1)
        few = rows.where(~many).select("key", "inner", "w.longer", (F.col("w.hi") - F.col("w.lo")).alias("positions"), "word", "n")
        found = few.repartition("key").sortWithinPartitions("key").mapInArrow(_links, LINKS)
        links = found if links is None else links.unionByName(found)
        more = rows.where(many)
        if more.isEmpty():
            return links
        w, mid = F.col("w"), F.floor((F.col("w.lo") + F.col("w.hi")) / 2)
        rows = more.select("word", "n", F.explode(F.array(_window(w["m"], w["lo"], mid, w["longer"]), _window(w["m"], mid, w["hi"], w["longer"]))).alias("w"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) to (word, root): where the forms lead in the end, by pointer doubling. Forms must not lead in a circle."""
    to = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = to.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = to.join(further, F.col("root") == F.col("_word"), "left")
        step = written(step.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "spelling-roots")
        to = step.select("word", "root")
        if step.where("moved").isEmpty():
            return to


def group_variants(words: DataFrame, ratio: int = RATIO, least_chars: int = 1, crowded: int = CROWDED) -> DataFrame:
    """words (word, n), each once, to word, form, root, n, n_near, form_n: one row per word."""
    near = near_words(words, least_chars, crowded).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    near = near.select(F.col("word").alias("_w"), "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    told = words.join(near, F.col("word") == F.col("_w"), "left")
    has = F.col("form_n") >= ratio * F.col("n")
    told = written(
        told.select("word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form_n")).alias("form_n")), "spelling-forms"
    )
    ends = roots(told.where("form IS NOT NULL")).select(F.col("word").alias("_w"), "root")
    return told.join(ends, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """The vocabulary of ``docs`` with each word's form and root."""
    return group_variants(written(vocabulary(docs, id_col, text_col), "spelling-words"), ratio, LEAST_CHARS)
