"""Line dedup by a segment-partition edit join; DataFrame functions only.

Lines are the pieces of a text between line feeds; lines without a word are kept and never compared. Two lines are linked if they are equal, or
if both have at least ``least_bytes`` bytes and one becomes the other by at most ``edits`` edits of a byte (UTF-8). A line is removed if its
class (lines reachable by links) occurs earlier, in the order of (document id, line number).

1. Each line becomes a 128-bit key, written once with its place. Copies of a hot line fall together on the map side wherever lines are counted.
2. Segments: a line of length n is cut into edits + 1 even segments; a line within ``edits`` edits holds one of them unchanged. Probes: for each
   length n - edits ... n the substrings of a line that can be that segment under the multi-match-aware bounds. Length and segment number are part of the hash.
   Hashes under which only one line is found are dropped before anything is joined.
3. Lines that probe a segment are compared with its center, the most frequent line that has it. A segment whose lines are in one component after that is
   done, so that groups of near copies never list their pairs.
4. A segment whose lines are still apart (a common opening, a passage in which each document changed other words) doesn't list its pairs either. Its lines are placed
   by how far they agree with the center: without an edit (``none``) and within ``edits`` edits (``most``). Lines within ``edits`` edits of each other have
   overlapping ranges none ... most, so only lines that left the center at the same place meet, on cells of that place, and only if their counts of bytes allow it.
   Lines that meet more than ``LISTED`` others in a cell are cut anew, each crowded segment's where its lines vary: into ``FINER * (edits + 1)`` pieces with equal shares of what
   varies, however short. All but ``edits`` pieces must agree, and lines for which they do go through 3 and 4 again. They vary in the other pieces only, so the places
   at which lines of a length vary get fewer each time, until there are ``edits`` of them: then such lines are all linked by their center, and what else meets them is listed.
5. Candidates whose counts of bytes differ by more than edits explain, or of which more than ``edits`` pieces differ, can't be near and go; the others are verified with a banded
   bit-parallel edit distance: a fold over one line's bytes in which the band of 2 * edits + 1 rows is the bits of an integer.

Null text: no lines. Null ids come after all others. Rows equal in id and text are one document: they keep the same lines.
Very long lines: segments and bands grow linearly. Empty table: empty result. Further columns ride in a struct.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, SPACE_CHARS, has_word, written
from .components import components

EDITS = 2
LEAST_BYTES = 24
#: Pieces of a line that are looked up in the other before the distance is computed.
PIECES = 8
#: A line from its first word on.
WORDED_LINE = r"[^\x20\x09-\x0D][^\n]*"
#: Bits that tell which hashes may be shared; a larger table only lets more pass that the join then drops.
FILTER_BITS = 1 << 24
#: Cells of a line's length in which lines of a crowded segment meet.
CELLS = 32
#: Classes of bytes that are counted before two lines are compared.
CLASSES = 16
#: A line lists its pairs with at most so many lines of a cell; those of fuller cells are cut anew.
LISTED = 256
#: How many times edits + 1 pieces a line is cut into where its segment is crowded.
FINER = 3


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), body), 0)


def _patterns(edits: int, pieces: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(bytes fewer, runs (first segment, segment after the last, shift)) of everything a line of ``pieces`` segments sends: all but ``edits`` segments unchanged.

    A gap of g segments between two runs moves what follows by g bytes at most; what ends with the line is moved by the difference of lengths.
    """
    out = []
    for fewer in range(edits + 1):
        for changed in combinations(range(pieces), edits):
            kept = [k for k in range(pieces) if k not in changed]
            runs: list[list[int]] = []
            for k in kept:
                if runs and runs[-1][1] == k:
                    runs[-1][1] = k + 1
                else:
                    runs.append([k, k + 1])
            moved = [[0]]
            for n, (start, _) in enumerate(runs):
                gap = start - (runs[n - 1][1] if n else 0)
                moved = [[*m, m[-1] + d] for m in moved for d in range(-gap, gap + 1)]
            last = pieces - runs[-1][1]
            out += [(fewer, [(i, j, shift) for (i, j), shift in zip(runs, m[1:])]) for m in moved if abs(fewer - m[-1]) <= last]
    return out


def probed(lines: DataFrame, edits: int, pieces: int) -> DataFrame:
    """lines (..., line) to (..., key, own): a row for everything a line sends, and whether it is made of the line's own segments.

    Segments are even, and sent for every length that is up to ``edits`` less. Lines that also have (group, cuts) send within their group for the length that ``cuts`` ends with.
    One expression over a short list of patterns, exploded; written out it would be a method too long to be compiled.
    """
    rows = []
    names: dict[tuple, int] = {}
    for fewer, runs in _patterns(edits, pieces):
        name = names.setdefault(tuple((i, j) for i, j, _ in runs), len(names))
        parts = [x for run in [*runs, *[(0, 0, 0)] * (edits + 1 - len(runs))] for x in run]
        rows.append([fewer, name, *parts])
    fields = ["fewer", "name", *[f"{c}{r}" for r in range(edits + 1) for c in ("i", "j", "shift")]]
    patterns = F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'_{f}', {x}" for f, x in zip(fields, row)) + ")" for row in rows) + ")")
    grouped = "cuts" in lines.columns
    others = [c for c in lines.columns if c not in ("line", "group", "cuts")]
    sent = lines.select(*[c for c in lines.columns if c != "line"], F.octet_length("line").alias("_n"), F.col("line").cast("binary").alias("_data"), F.inline(patterns))
    size = F.col("_n") - F.col("_fewer")
    if grouped:
        sent = sent.where(size == F.element_at("cuts", -1))
        cut = lambda k: F.get("cuts", k)
    else:
        cut = lambda k: F.floor(size / pieces).cast("int") * k + F.greatest(F.lit(0), size % pieces - pieces + k)
    runs = [(cut(F.col(f"_i{r}")), cut(F.col(f"_j{r}")), F.col(f"_shift{r}")) for r in range(edits + 1)]
    inside, own = F.lit(True), F.col("_fewer") == 0
    for first, end, shift in runs:
        inside, own = inside & (first + shift >= 0) & (end + shift <= F.col("_n")), own & (shift == 0)
    key = F.xxhash64(*(["group"] if grouped else []), size, "_name", *[F.substring("_data", first + shift + 1, end - first) for first, end, shift in runs])
    return sent.where(inside).select(*others, key.alias("key"), own.alias("own"))


def cuts_where_lines_vary(met: DataFrame, lines: DataFrame, pieces: int) -> DataFrame:
    """met (key, id, own, center) to (group, cuts, varying): where to cut the lines of a key, from 0 to their length, and at how many bytes they differ from the center.

    Half of a byte's weight is how many lines differ there, half is the same for all such bytes, so that a piece can't hold more than a fair number of them.
    Only lines that are as long as the center, those with segments of their own, are asked.
    """
    text = lines.select("id", "line")
    both = met.where("own").select("key", "id", "center").distinct().join(text, "id").join(text.toDF("center", "middle"), "center")
    differs = F.zip_with(_bytes(F.col("line")), _bytes(F.col("middle")), lambda x, y: x != y)
    size = F.octet_length("middle")
    places = both.select("key", size.alias("size"), F.posexplode(differs).alias("pos", "differs")).where("differs")
    places = places.groupBy("key", "pos").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    whole, before = Window.partitionBy("key"), Window.partitionBy("key").orderBy("pos")
    share = (F.col("n") / F.sum("n").over(whole) + F.lit(1.0) / F.count(F.lit(1)).over(whole)) / 2
    places = places.select("key", "pos", "size", share.alias("share"))
    piece = F.floor((F.sum("share").over(before) - F.col("share") / 2) * pieces)
    starts = [F.coalesce(F.min(F.when(F.col("piece") >= k, F.col("pos"))), F.max("size")) for k in range(1, pieces)]
    placed_ = places.select("key", "pos", "size", piece.alias("piece")).groupBy(F.col("key").alias("group"))
    return placed_.agg(F.array(F.lit(0), *starts, F.max("size")).alias("cuts"), F.count(F.lit(1)).alias("varying"))


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edits between arrays of bytes with size(a) >= size(b) >= edits, if at most ``edits``; a larger number if more."""
    width = 2 * edits + 1
    every = (1 << width) - 1
    m = F.size(a)

    def matches(byte: Column, j: Column) -> Column:  # j from 0; bit k stands for row j + 1 + edits - (width - 1 - k)
        bits = [F.when(F.get(a, j + edits - (width - 1 - k)) == byte, F.lit(1 << k)).otherwise(0) for k in range(width)]
        return sum(bits[1:], bits[0])

    def step(acc: Column, pm: Column) -> Column:
        vp, vn = acc["vp"], acc["vn"]
        diagonal = (((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn)).bitwiseAND(F.lit(every))

        def rest(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(every)))
            hn = d0.bitwiseAND(vp)
            slid = F.shiftright(d0, 1)
            bit = lambda x, k: F.when(x.bitwiseAND(F.element_at(F.array(*[F.lit(1 << q) for q in range(width)]), k + 1)) != 0, 1).otherwise(0)
            j = acc["j"] + 1
            down = F.greatest(F.lit(0), m - (j + edits) + (width - 1)).cast("int")
            down = F.least(down, F.lit(width - 1))
            more = F.when(j <= m - edits, 1 - bit(d0, F.lit(width - 1))).otherwise(bit(hp, down) - bit(hn, down))
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(slid.bitwiseOR(hp))).bitwiseAND(F.lit(every)).alias("vp"), slid.bitwiseAND(hp).alias("vn"),
                (acc["d"] + more).alias("d"), j.alias("j"),
            )

        return _bind(diagonal, rest)

    start = F.struct(F.lit((every << (width - 1 - edits)) & every).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"), F.lit(0).alias("j"))
    return F.aggregate(F.transform(b, matches), start, step, lambda acc: acc["d"])


def _bytes(line: Column) -> Column:
    return F.split(F.decode(F.encode(line, "UTF-8"), "ISO-8859-1"), "")


def _lines(docs: DataFrame) -> DataFrame:
    """(_id, _text_key, line_no, line) of every line with a word."""
    exploded = docs.select("_id", "_text_key", F.posexplode(F.split("_text", "\n")).alias("line_no", "line"))
    return exploded.where(F.ltrim("line", F.lit(SPACE_CHARS)) != "")


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("second"), line).alias("k2")]


def _pieces_agree(x: Column, y: Column, edits: int) -> Column:
    """Whether all but ``edits`` of PIECES even pieces of y (binary) occur in x within ``edits`` bytes of their place: an edit changes one piece at most."""
    m = F.octet_length(y)
    changed = []
    for i in range(PIECES):
        start, end = F.floor(m * i / PIECES).cast("int"), F.floor(m * (i + 1) / PIECES).cast("int")
        first = F.greatest(F.lit(1), start + 1 - edits)
        around = F.substring(x, first, end + edits - first + 1)
        changed.append(F.when(F.contains(around, F.substring(y, start + 1, end - start)), 0).otherwise(1))
    return sum(changed[1:], changed[0]) <= edits


def _counts(line: Column) -> Column:
    """How many of the line's bytes fall in each of CLASSES classes; an edit changes two of them by one at most."""
    latin = F.decode(line.cast("binary"), "ISO-8859-1")
    members = ["".join(chr(b) for b in range(256) if b % CLASSES == k) for k in range(CLASSES)]
    return F.array(*[F.octet_length(line) - F.char_length(F.translate(latin, m, "")) for m in members])


def _may_be_near(a: str, b: str, edits: int) -> Column:
    """Whether two arrays of counts allow ``edits`` edits."""
    apart = [F.abs(F.col(a)[k] - F.col(b)[k]) for k in range(CLASSES)]
    return sum(apart[1:], apart[0]) <= 2 * edits


def _verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """Of pairs (a, b) of lines (id, line, counts) those within ``edits`` edits."""
    counts = lines.select("id", "counts")
    pairs = pairs.join(counts.toDF("a", "ca"), "a").join(counts.toDF("b", "cb"), "b").where(_may_be_near("ca", "cb", edits)).select("a", "b")
    both = pairs.join(lines.select("id", "line").toDF("a", "la"), "a").join(lines.select("id", "line").toDF("b", "lb"), "b")
    longer = F.octet_length("la") >= F.octet_length("lb")
    x, y = F.when(longer, F.col("la")).otherwise(F.col("lb")), F.when(longer, F.col("lb")).otherwise(F.col("la"))
    # bound once per pair: a filter over plain columns would be given the expression that splits a line, and split it at every byte
    sides = F.struct(_bytes(x).alias("x"), _bytes(y).alias("y"))
    near = (F.abs(F.octet_length("la") - F.octet_length("lb")) <= edits) & _pieces_agree(x.cast("binary"), y.cast("binary"), edits)
    return both.where(near & (_bind(sides, lambda s: edit_distance(s["x"], s["y"], edits)) <= edits)).select("a", "b")


def placed(pairs: DataFrame, edits: int) -> DataFrame:
    """pairs (a, b, la, lb, ...) of a line and its segment's center, which isn't longer, to (a, b, ..., none, most): cells of lb, up to which la agrees with it without an edit, and within ``edits``.

    Both are found by halving. ``none`` is never too large and ``most`` never too small.
    """
    text = lambda c, size: F.decode(F.substring(F.col(c).cast("binary"), F.lit(1), size), "ISO-8859-1")
    n, m = F.octet_length("lb"), F.octet_length("la")

    def halve(at: Column, step: Column) -> Column:
        none, most = at["none"] + step, at["most"] + step
        end = lambda cell: F.floor(cell * n / CELLS).cast("int")
        same = text("la", end(none)) == text("lb", end(none))
        near = lambda shift: F.levenshtein(text("la", F.least(m, F.greatest(F.lit(0), end(most) + shift))), text("lb", end(most)), edits) >= 0
        within = F.exists(F.sequence(F.lit(-edits), F.lit(edits)), near)
        return F.struct(F.when(same, none).otherwise(at["none"]).alias("none"), F.when(within, most).otherwise(at["most"]).alias("most"))

    steps = F.array(*[F.lit(CELLS >> k) for k in range(1, CELLS.bit_length())])
    found = F.aggregate(steps, F.struct(F.lit(0).alias("none"), F.lit(0).alias("most")), halve)
    others = [c for c in pairs.columns if c not in ("la", "lb")]
    # a generated row: columns taken from a struct would each compute it again
    return pairs.select(*others, F.inline(F.array(found)))


def _crowded(met: DataFrame, roots: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """Lines (key, id, own, center) of one segment in different components, as rows (key, cell, begins, id, own, center, root, counts, listed): those of a cell may be near."""
    rooted = met.join(roots.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.col("own") & (F.col("id") != F.col("center"))).alias("more"))
    keys = keys.where("low <> high AND more").select(F.col("key").alias("key2"))
    # the center was compared with all of them
    crowded = rooted.join(keys, F.col("key") == F.col("key2")).where("id <> center").select("key", F.col("id").alias("a"), F.col("center").alias("b"), "own", "root")
    pairs = crowded.select("a", "b").distinct().join(lines.select("id", "line", "counts").toDF("a", "la", "counts"), "a").join(lines.select("id", "line").toDF("b", "lb"), "b")
    spread = crowded.join(placed(pairs, edits), ["a", "b"]).select("key", F.col("a").alias("id"), F.col("b").alias("center"), "own", "root", "counts", "none", "most", F.explode(F.sequence("none", "most")).alias("cell"))
    spread = written(spread.withColumn("begins", F.col("cell") == F.col("none")), "line-placed")
    groups = spread.groupBy("key", "cell").agg(F.count(F.when(F.col("begins"), 1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("own").alias("any"))
    groups = groups.where("low <> high AND any AND n > 0").select(F.col("key").alias("gk"), F.col("cell").alias("gc"), (F.col("n") <= LISTED).alias("listed"))
    return written(spread.join(groups, (F.col("key") == F.col("gk")) & (F.col("cell") == F.col("gc"))).drop("gk", "gc"), "line-cells")


def _meeting(cells: DataFrame) -> DataFrame:
    """Rows of ``_crowded`` to pairs of rows of one cell, the second's columns with an underscore, one of which left the center there."""
    other = cells.select(*[F.col(c).alias(f"{c}_") for c in cells.columns])
    meet = (F.col("key") == F.col("key_")) & (F.col("cell") == F.col("cell_")) & (F.col("root") != F.col("root_")) & (F.col("own") | F.col("own_"))
    return cells.where("begins").join(other, meet)


def _pairs(cells: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of lines that meet in a cell and may be near; a pair may come more than once."""
    met = _meeting(cells).where(_may_be_near("counts", "counts_", edits))
    return met.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends aren't in one component."""
    joined = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    return joined.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _may_be_in(rows: DataFrame, column: str, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` isn't among ``name`` of ``wanted``, before a join moves them.

    By a bitmap that is broadcast, of FILTER_BITS at most whatever the table.
    """
    bit = lambda c: f"shiftleft(1L, cast(pmod({c}, 64L) AS int))"
    word = lambda c: f"floor(pmod({c}, {FILTER_BITS}L) / 64)"
    bitmap = wanted.select(F.expr(word(name)).alias("_word"), F.expr(bit(name)).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.join(F.broadcast(bitmap), F.expr(f"_word = {word(column)} AND _bits & {bit(column)} <> 0")).drop("_word", "_bits")


def _met(sent: DataFrame, names: list[str]) -> DataFrame:
    """sent (key, *names, own) of lines to its rows with hashes under which two lines are found, one of them with segments of its own; each once."""
    # of lines named by 128 bits those that differ in the first 64
    shared = sent.groupBy("key").agg(F.min(names[0]).alias("low"), F.max(names[0]).alias("high"), F.max("own").alias("any")).where("low <> high AND any").select(F.col("key").alias("key2"))
    shared = written(shared, "line-keys")
    sent = _may_be_in(sent, "key", shared, "key2")  # most hashes are found once
    return written(sent.join(shared, F.col("key") == F.col("key2")).groupBy("key", *[c for c in sent.columns if c not in ("key", "own")]).agg(F.max("own").alias("own")), "line-segments")


def _near_lines(docs: DataFrame, edits: int, least_bytes: int) -> DataFrame:
    """(k1, k2, root): every line that is within ``edits`` edits of another, with its component."""
    lines = _lines(docs).where(F.octet_length("line") >= least_bytes).select(*_keys(F.col("line")), "line")
    met = _met(probed(lines, edits, edits + 1), ["k1", "k2"])
    names = written(met.select("k1", "k2").distinct().withColumn("id", F.monotonically_increasing_id()), "line-names")
    texts = _may_be_in(lines, "k1", names, "k1").join(names, ["k1", "k2"]).groupBy("id", "k1", "k2").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("m"))
    texts = written(texts.withColumn("counts", _counts(F.col("line"))), "line-texts")
    met = met.join(texts.select("k1", "k2", "id", "m"), ["k1", "k2"]).select("key", "id", "m", "own")
    roots: DataFrame | None = None
    late: list[DataFrame] = []
    pieces = FINER * (edits + 1)
    while True:
        center = met.where("own").groupBy("key").agg(F.max(F.struct("m", "id"))["id"].alias("center")).withColumnRenamed("key", "key2")
        met = written(met.join(center, F.col("key") == F.col("key2")).select("key", "id", "own", "center"), "line-met")
        stars = met.where("id <> center").select(F.least("id", "center").alias("a"), F.greatest("id", "center").alias("b")).distinct()
        roots = components(written(_verified(stars, texts, edits), "line-links"), roots)
        cells = _crowded(met, roots, texts, edits)
        full = cells.where("NOT listed")
        done = full.isEmpty()
        late.append(_pairs(cells.where("listed"), edits))
        if done:
            break
        cuts = written(cuts_where_lines_vary(full, texts, pieces), "line-cuts")
        full = full.join(cuts, F.col("key") == F.col("group"))
        # too few places left to cut at
        late.append(_pairs(full.where(F.col("varying") <= edits).select(*cells.columns), edits))
        rest = full.where(F.col("varying") > edits).select("group", "cuts", "id").distinct()
        met = _met(probed(rest.join(texts.select("id", "m", "line"), "id"), edits, pieces), ["id"])
    # what the rounds list is verified at once, but for what their centers have linked since
    pairs = _apart(reduce(DataFrame.unionByName, late).distinct(), roots)
    roots = components(written(_verified(pairs, texts, edits), "line-late"), roots)
    return texts.join(roots, F.col("id") == F.col("node")).select("k1", "k2", "root")


def removed_lines(docs: DataFrame, edits: int = EDITS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """docs (_id, _text, _text_key) to (_id, _text_key, gone, near): numbers (from 0) of the lines to remove, and how many of them have no equal line before."""
    lines = written(_lines(docs).select("_id", "_text_key", "line_no", *_keys(F.col("line"))), "line-hashes")
    linked = _near_lines(docs, edits, least_bytes)
    repeated = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k1", "k2", F.lit(None).cast("long").alias("root"))
    # a component is named by its root, a line that is only repeated by its key
    wanted = repeated.unionByName(linked).groupBy("k1", "k2").agg(F.max("root").alias("root"))
    alone = F.col("root").isNull()
    wanted = wanted.select("k1", "k2", alone.alias("g0"), F.coalesce("root", "k1").alias("g1"), F.when(alone, F.col("k2")).otherwise(0).alias("g2"))
    wanted = written(wanted, "line-classes")
    met = written(_may_be_in(lines, "k1", wanted, "k1").join(wanted, ["k1", "k2"]), "line-occurrences")
    here = F.struct(F.coalesce("_id", F.lit(LAST_ID)).alias("i"), F.col("_text_key").alias("t"), F.col("line_no").alias("l"))
    own = met.groupBy("k1", "k2", "g0", "g1", "g2").agg(F.min(here).alias("o"))
    first = own.groupBy("g0", "g1", "g2").agg(F.min("o").alias("first"))
    firsts = written(own.join(first, ["g0", "g1", "g2"]).select("k1", "k2", "o", "first"), "line-firsts")
    late = met.join(firsts, ["k1", "k2"]).where(here > F.col("first")).select("_id", "_text_key", "line_no", (here == F.col("o")).alias("near"))
    # rows equal in id and text repeat each line's number
    near = F.size(F.collect_set(F.when(F.col("near"), F.col("line_no"))))
    return late.groupBy("_id", "_text_key").agg(F.array_sort(F.collect_set("line_no")).alias("gone"), near.alias("near"))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_text_key"))


def line_report(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """One row per input row: id, n_lines (with a word), n_removed, n_near (removed without an equal line before), removed (line numbers from 1, joined by commas)."""
    base = _prepared(docs, id_col, text_col)
    gone = removed_lines(base, **how).toDF("_i", "_k", "gone", "near")
    counted = base.select("_id", "_text_key", F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(WORDED_LINE)).cast("long").alias("n_lines"))
    out = counted.join(gone, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text_key") == F.col("_k")), "left")
    numbers = F.array_join(F.transform(F.coalesce("gone", F.array().cast("array<int>")), lambda x: (x + 1).cast("string")), ",")
    return out.select(
        F.col("_id").alias(id_col), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), numbers.alias("removed")
    )


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """The rows of ``docs`` with the removed lines cut from their text. A row all of whose lines with words are removed goes; a row that had none stays."""
    base = _prepared(docs, id_col, text_col)
    gone = removed_lines(base, **how).select(F.col("_id").alias("_i"), F.col("_text_key").alias("_k"), "gone")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_text_key"))
    joined = rows.join(gone, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text_key") == F.col("_k")), "left")
    lines = F.split("_text", "\n")
    kept = F.filter(lines, lambda x, k: ~F.array_contains(F.col("gone"), k))
    joined = joined.withColumn("_new", F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")))
    joined = joined.where(F.col("gone").isNull() | has_word(F.coalesce("_new", F.lit(""))))
    names = [F.col("_new").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns]
    return joined.select(*names)
