"""MinHash near-dedup with tensored banding.

1. A text's set: 64-bit hashes of its 5-word shingles (lower-cased A-Z). Rows with equal sets are one class, found by a grouped aggregate,
   so a group of copies costs one vertex.
2. ``collections`` = 16 small collections of ``per_collection`` = 2 minhashes each. A table's key combines two collections, so
   32 minhashes make 120 tables of 4: about the square root of what 120 separate tables would compute. Two sets of
   similarity 0.75 meet in a table unless fewer than two collections agree: 4 in 100,000 at exactly 0.75, far fewer above.
   Collections held by one class alone can't meet and are dropped before keys are formed.
3. Each class is compared with the first class (smallest id) of its table keys: with one, then with up to ``FIRST_CENTERS`` where that leaves
   components apart. Links are confirmed on the full sets and contracted. Keys that are still open then draw other classes, and each class is compared with the one that
   most of its keys drew, for up to ``SETTLING`` rounds. Keys whose classes are in one component are done; that settles groups of near copies without listing their pairs.
4. What is left is joined exactly by prefix filter: shingles in order of rarity among these classes, sets of similarity 0.75 share one of their first ones, and
   the place of the match bounds what can still follow. Pairs in different components are confirmed on the full sets. So a frequent
   passage, which fills tables but isn't rare, makes no pairs.

Null or blank text: empty set, linked with nothing, a component of its own id. Null id: null component unless linked with an id; ids are
compared without nulls. Repeated rows fall into one class. Empty table: empty result. Further columns ride in a struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, written
from .components import components
from .wordhash import mixed, windows, words_of_texts

WORDS = 5
SIMILAR = 75  # of 100
COLLECTIONS = 16
PER_COLLECTION = 2
#: First classes that a class is compared with before the rest is joined by prefixes.
FIRST_CENTERS = 4
#: Rounds of other classes that open keys choose to compare with before that.
SETTLING = 2


def _seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = [t.encode("utf-8") for t in texts]
    hashes, counts = words_of_texts(data, lower=True)
    at = 0
    for n in counts.tolist():
        own = hashes[at : at + n]
        at += n
        if 0 < n < words:
            own = mixed(windows(own, n) + np.uint64(n))
        yield np.unique(own if 0 < n < words else windows(own, words))


def signature(shingles: np.ndarray, collections: int, per: int) -> np.ndarray:
    """One key per collection: a hash of its ``per`` minhashes."""
    least = np.full(collections * per, np.iinfo(np.uint64).max, dtype=np.uint64)
    seeds = _seeds(collections * per)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096, None]
        h = (part ^ seeds) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        least = np.minimum(least, h.min(axis=0))
    keys = least.reshape(collections, per)
    out = np.arange(collections, dtype=np.uint64)
    for k in range(per):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + keys[:, k])
    return out.view(np.int64)


def _signed(docs: DataFrame, words: int, collections: int, per: int) -> DataFrame:
    """(_uid, _text) to uid, text_key, n, set_key (null for an empty set) and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sets = list(shingle_sets([t or "" for t in batch.column(1).to_pylist()], words))
                keys = [hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets]
                sigs = [signature(s, collections, per).tolist() if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                    names=["_id", "text_key", "n", "set_key", "sig"],
                )

    return docs.mapInArrow(run, "_id long, text_key long, n long, set_key binary, sig array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(cid, _text) to (cid, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sets = [s.view(np.int64) for s in shingle_sets([t or "" for t in batch.column(1).to_pylist()], words)]
                offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["cid", "set"])

    return texts.mapInArrow(run, "cid long, set array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough; sizes are checked before sets are moved."""
    sizes = sets.select("cid", F.size("set").cast("long").alias("n"))
    p = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    p = p.where((100 * F.least("na", "nb") >= similar * F.greatest("na", "nb"))).select("a", "b")
    p = p.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return p.where(100 * both >= similar * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) whose ends aren't in one component."""
    ra, rb = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    joined = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return joined.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def _prefix_pairs(rest: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of ``rest`` (cid, root) in different components that may be similar enough, by prefixes of the rarest shingles and their places.

    Of two sets with similarity t the smaller has one of its first n - ceil(2t / (1 + t) n) + 1 shingles among the first m - ceil(t m) + 1 of the larger,
    and the first such match leaves enough shingles after it in both.
    """
    shingles = rest.join(sets, "cid").select("cid", "root", F.size("set").cast("long").alias("n"), F.explode("set").alias("s"))
    rarity = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a shingle of one class matches nothing, but keeps its place before the others
    common = shingles.join(rarity, "s").groupBy("cid", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("own"))
    placed = common.select("cid", "root", "n", (F.col("n") - F.size("own")).alias("before"), F.posexplode("own").alias("p", "x"))
    placed = placed.select("cid", "root", "n", (F.col("before") + F.col("p")).alias("p"), F.col("x.s").alias("s"))
    least = lambda up, down: F.floor((up + (down - 1)) / F.lit(float(down)))  # noqa: E731  ceil(up / down)
    small = placed.where(F.col("p") <= F.col("n") - least(2 * similar * F.col("n"), 100 + similar))
    large = placed.where(F.col("p") <= F.col("n") - least(similar * F.col("n"), 100)).toDF("b", "rb", "m", "q", "s2")
    both = (
        (F.col("s") == F.col("s2")) & (F.col("root") != F.col("rb")) & ((F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("cid") < F.col("b")))
        & (100 * F.col("n") >= similar * F.col("m"))
        & (F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= least(similar * (F.col("n") + F.col("m")), 100 + similar))
    )
    return small.join(large, both).select(F.col("cid").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int, similar: int, collections: int, per: int) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): rows has _id, text_key, n and cid (class) per input row; roots has (node, root) per linked class."""
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("text_key"))
    signed = written(_signed(base, words, collections, per), "minhash")
    # a class is named by 64 bits of its 128-bit key
    cid = F.xxhash64("set_key").alias("cid")
    full = signed.where(F.col("set_key").isNotNull())
    classes = written(
        full.groupBy("set_key").agg(F.min(F.struct(F.coalesce("_id", F.lit(LAST_ID)).alias("i"), F.col("text_key").alias("k"), "n", "sig")).alias("x"))
        .select(cid, "x.n", "x.sig", F.when(F.col("x.i") < LAST_ID, F.col("x.i")).alias("i"), F.col("x.k").alias("k")), "minhash-classes",
    )

    # collections that two classes hold
    held = classes.select("cid", F.posexplode("sig").alias("c", "h"))
    shared = held.groupBy("c", "h").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x <> y").select(F.col("c").alias("c2"), F.col("h").alias("h2"))
    repeated = held.join(shared, (F.col("c") == F.col("c2")) & (F.col("h") == F.col("h2"))).select("cid", "c", "h")
    per_class = repeated.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("own")).where(F.size("own") > 1)  # at most 16
    pairs_of = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.xxhash64(x["c"], x["h"], y["c"], y["h"]))))
    tables = per_class.select("cid", F.explode(pairs_of).alias("key"))
    # the first class of a key is the one with the smallest id: of near copies most often what the others were made from
    ids = classes.select("cid", F.coalesce("i", F.lit(LAST_ID)).alias("i"))
    tables = tables.join(ids, "cid")
    first = tables.groupBy("key").agg(F.min(F.struct("i", "cid")).alias("f"), F.min("cid").alias("low"), F.max("cid").alias("high")).where("low <> high").select(F.col("key").alias("k2"), "f")
    keyed = written(tables.join(first, F.col("key") == F.col("k2")).select("key", "cid", F.col("f.cid").alias("center"), F.col("f.i").alias("center_i")), "minhash-tables")

    # sets of the classes that meet another
    wanted = keyed.select("cid").distinct().join(classes.select("cid", "i", "k"), "cid")
    texts = base.join(wanted, F.col("_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))).select("cid", "_text")
    sets = written(_sets(texts, words).groupBy("cid").agg(F.first("set").alias("set")), "minhash-sets")

    # each class is compared with the first classes of its keys: with one, and where that leaves components apart, with the next ones
    order = Window.partitionBy("a").orderBy("center_i", "b")
    stars = keyed.where("cid <> center").groupBy(F.col("cid").alias("a"), F.col("center").alias("b")).agg(F.min("center_i").alias("center_i"))
    stars = written(stars.withColumn("r", F.row_number().over(order)).select("a", "b", "r"), "minhash-stars")
    roots = components(written(_confirmed(stars.where("r = 1").select("a", "b"), sets, similar), "minhash-links"))
    apart = written(_apart(stars.where("r > 1"), roots), "minhash-apart")
    late = written(_confirmed(apart.where(F.col("r") <= FIRST_CENTERS).select("a", "b"), sets, similar), "minhash-links")
    if not late.isEmpty():
        roots = components(late, roots)

    # keys that are still open choose other classes to compare with, one a class and round: near copies may be near each other and not near the first
    for settling in range(SETTLING):
        rooted = keyed.select("key", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
        drawn = F.min(F.struct(F.xxhash64("cid", F.lit(settling)).alias("h"), F.col("cid").alias("b"), F.col("root").alias("rb"))).alias("c")
        centers = rooted.groupBy("key").agg(drawn, F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key", "c.b", "c.rb")
        met = rooted.join(centers, "key").where("root <> rb").groupBy(F.col("cid").alias("a"), "b").agg(F.count(F.lit(1)).alias("m"))
        chosen = met.groupBy("a").agg(F.max(F.struct("m", "b"))["b"].alias("b"))  # the one that most of its keys chose
        found = written(_confirmed(chosen, sets, similar), "minhash-links")
        if found.isEmpty():
            break
        roots = components(found, roots)

    # the rest: classes of keys in which others than the first are apart, and those not compared with the first
    rooted = keyed.where("cid <> center").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(F.col("key").alias("k2"))
    open_pairs = _apart(apart.where(F.col("r") > FIRST_CENTERS), roots)
    rest = rooted.join(open_keys, F.col("key") == F.col("k2")).select("cid").unionByName(open_pairs.select(F.explode(F.array("a", "b")).alias("cid"))).distinct()
    rest = written(rest.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("root")), "minhash-rest")
    final = written(_confirmed(_prefix_pairs(rest, sets, similar), sets, similar), "minhash-links")
    if not final.isEmpty():
        roots = components(final, roots)
    return signed.withColumn("cid", F.when(F.col("set_key").isNotNull(), F.xxhash64("set_key"))), roots


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root (class of the component, null for an empty set)."""
    return rows.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).drop("node")


def minhash_report(docs: DataFrame, id_col="doc_id", text_col="text", words=WORDS, similar=SIMILAR, collections=COLLECTIONS, per=PER_COLLECTION) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept (id = component_id)."""
    rows, roots = near_duplicates(docs, id_col, text_col, words, similar, collections, per)
    rows = _labelled(rows, roots)
    least = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("_id").alias("least")).withColumnRenamed("root", "_r")
    out = rows.join(least, F.col("root") == F.col("_r"), "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("_id")).otherwise(F.col("least")))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words=WORDS, similar=SIMILAR, collections=COLLECTIONS, per=PER_COLLECTION) -> DataFrame:
    """The rows of ``docs`` with one row of each component (its smallest id; of equal ids, one), and every row without words."""
    stable = docs.withColumn("_row", F.struct("*")).select(F.col("_row"), F.col(id_col).cast("long").alias("_i"), F.col(text_col).alias("_t"))
    rows, roots = near_duplicates(stable, "_i", "_t", words, similar, collections, per)
    rows = _labelled(rows, roots)
    best = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.coalesce("_id", F.lit(LAST_ID)).alias("i"), F.col("text_key").alias("k"))).alias("x"))
    best = best.select(F.when(F.col("x.i") < LAST_ID, F.col("x.i")).alias("_bi"), F.col("x.k").alias("_bk"))
    keyed = stable.withColumn("_k", F.xxhash64("_t"))
    worded = F.length(F.regexp_replace(F.coalesce("_t", F.lit("")), r"[\x20\x09-\x0D]+", "")) > 0
    kept = keyed.where(worded).join(best, F.col("_i").eqNullSafe(F.col("_bi")) & (F.col("_k") == F.col("_bk")), "left_semi")
    # rows equal in id and text are one document
    once = kept.groupBy("_i", "_k").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(keyed.where(~worded).select("_row")).select("_row.*")
