"""Substring dedup by level-wise doubling: windows repeated at half the length alone are extended to the full length.

A window is ``length`` consecutive words of one document (13 by default). Each word covered by a window that also starts in a
document with a smaller id is removed; windows are judged on the input.

Level 0 (whole texts). Documents whose words are those of a document with a smaller id are settled by one grouped aggregate.
Level 1 (half the length, rounded up). Of the half windows inside a full window the one with the least hash is its anchor, so
equal windows have equal anchors and only about a quarter of all positions is an anchor. Each block of documents sends its
distinct anchors, dealt by hash; an anchor that two documents hold is answered with one bit.
Level 2 (twice that length). Windows whose anchor is repeated are extended to the full length, under 128 bits of hash. Each block sends its distinct ones with the
smallest id that holds them, dealt by hash again; the answer is a bit: does a smaller id hold it. No candidates are left after that.

What a frequent passage costs is bounded by the number of blocks, not by the number of its documents, and no group holds
more than its share of hashes. Blocks are written in the shared folder once, and stages start from there.

Null text: no words, nothing removed, kept text empty. Null ids are greater than every other id and not smaller than each other.
Repeated rows of one id are one document to this rule: neither removes the other. Fewer words than a window: nothing removed.
Empty table: empty result. Further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_ids, pack_ints, pack_strings, runs, unpack_ints, unpack_strings
from .common import LAST_ID, written
from .wordhash import windows, words_of_texts

LENGTH = 13
BLOCK_BYTES = 12 << 20
GROUP_HASHES = 1_000_000


def _pack(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row a block: ids, a key of each text's words, number of words, and the texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (ids, texts) in zip(block_ids(), runs(batches, block_bytes)):
            keys = [hashlib.sha256(b" ".join(t.encode("utf-8").split())).digest()[:16] for t in texts]
            n_words = sum(t.count(" ") + t.count("\n") + 1 for t in texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.array([[LAST_ID if i is None else i for i in ids]], pa.list_(pa.int64())),
                    pa.array([[i is None for i in ids]], pa.list_(pa.bool_())), pa.array([keys], pa.list_(pa.binary())), pa.array([n_words], pa.int64()),
                    pa.array([pack_strings(texts)], pa.binary()),
                ],
                names=["block", "ids", "nulls", "keys", "n_words", "texts"],
            )

    return docs.mapInArrow(pack, "block long, ids array<long>, nulls array<boolean>, keys array<binary>, n_words long, texts binary")


class _Block:
    """The word hashes of a block, and per full window its anchor."""

    def __init__(self, texts: bytes, length: int):
        self.length = length
        self.texts = [t.encode("utf-8") for t in unpack_strings(texts)]
        self.words, self.counts = words_of_texts(self.texts)
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        half = -(-length // 2)
        grams = windows(self.words, half)
        n = max(0, len(self.words) - length + 1)
        least, span = grams, 1
        while span < length - half + 1:  # the least of 1, 2, 4, ... neighbours
            step = min(span, length - half + 1 - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        inside = self.doc[:n] == self.doc[length - 1 : length - 1 + n] if n else np.zeros(0, bool)
        self.starts = np.flatnonzero(inside).astype(np.int32)
        self.anchors = least[self.starts] if n else np.zeros(0, np.uint64)

    def distinct_anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct anchors, whether two of the block's documents hold it)."""
        if not len(self.anchors):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        doc = self.doc[self.starts]
        order = np.lexsort((doc, self.anchors))
        a, d = self.anchors[order], doc[order]
        first = np.concatenate(([True], a[1:] != a[:-1]))
        at = np.flatnonzero(first)
        return a[at], np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)

    def candidates(self, repeated: np.ndarray, ids: np.ndarray, open_docs: np.ndarray) -> dict[str, np.ndarray]:
        """Windows with a repeated anchor in open documents, and the distinct ones of them with the smallest id, by hash."""
        keep = open_docs[self.doc[self.starts]]
        if len(repeated):
            place = np.minimum(np.searchsorted(repeated, self.anchors), len(repeated) - 1)
            keep &= repeated[place] == self.anchors
            del place
        else:
            keep[:] = False
        starts = self.starts[keep]
        h1 = windows(self.words, self.length)[starts]
        h2 = windows(self.words, self.length, kind=1)[starts]
        own = ids[self.doc[starts]]
        order = np.lexsort((own, h2, h1))
        a, b = h1[order], h2[order]
        del h1, h2
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        entry = np.empty(len(order), dtype=np.int32)
        entry[order] = np.cumsum(first) - 1
        return {"starts": starts, "own": own, "entry": entry, "h1": a[at], "h2": b[at], "least": own[order][at]}


def _parts(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Bounds of each group in sorted hashes; groups are equal ranges of the hash."""
    edges = np.array([(g << 64) // groups for g in range(1, groups)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _hashes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def _settled(row: dict, right: pa.Table, length: int) -> tuple[_Block, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(block, ids, whether each document still is to be judged by its windows, its candidates) from a block and its answers."""
    block = _Block(row["texts"], length)
    ids = np.array(row["ids"], dtype=np.int64)
    kinds, groups, bits = (_column(right, c) for c in ("kind", "grp", "bits"))
    least_of = {k: i for kind, k, i in zip(kinds, _column(right, "key"), _column(right, "least")) if kind == 0}
    open_docs = np.array([least_of.get(k, i) >= i for k, i in zip(row["keys"], row["ids"])], dtype=bool)
    anchors, repeated = block.distinct_anchors()
    found = {g: b for kind, g, b in zip(kinds, groups, bits) if kind == 1}
    told = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for g in sorted(found) for n, b in [(int.from_bytes(found[g][:8], "little"), found[g][8:])]]
    if told:
        repeated = repeated | np.concatenate(told).astype(bool)
    return block, ids, open_docs, block.candidates(anchors[repeated], ids, open_docs)


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes()


ANSWER = "block long, kind int, grp int, bits binary, key binary, least long"


def _answers(table: pa.Table, kind: int, bits: list[bytes]) -> pa.Table:
    n = table.num_rows
    return pa.table({
        "block": table.column("block").cast(pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "grp": table.column("grp").cast(pa.int32()),
        "bits": pa.array(bits, pa.binary()), "key": pa.nulls(n, pa.binary()), "least": pa.nulls(n, pa.int64()),
    })


def _repeated_anchors(table: pa.Table) -> pa.Table:
    """A group of anchors, each block's distinct: those of two blocks are repeated."""
    lists = [_hashes(x) for x in _column(table, "h1")]
    flat = np.concatenate(lists)
    order = np.argsort(flat, kind="stable")
    a = flat[order]
    same = np.zeros(len(a), dtype=bool)
    same[1:] = a[1:] == a[:-1]
    same[:-1] |= a[1:] == a[:-1]
    flags = np.empty(len(a), dtype=bool)
    flags[order] = same
    ends = np.cumsum([len(x) for x in lists])
    return _answers(table, 1, [_bits(flags[e - len(x) : e]) for x, e in zip(lists, ends)])


def _held_before(table: pa.Table) -> pa.Table:
    """A group of windows, each block's distinct with its smallest id: the bit says that a smaller id of another block holds it."""
    h1, h2 = ([_hashes(x) for x in _column(table, c)] for c in ("h1", "h2"))
    least = []
    for ids, codes in zip(_column(table, "ids"), _column(table, "codes")):
        least.append(np.array(ids, dtype=np.int64)[unpack_ints(codes)])
    a, b, own = np.concatenate(h1), np.concatenate(h2), np.concatenate(least)
    order = np.lexsort((own, b, a))
    x, y = a[order], b[order]
    first = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    at = np.flatnonzero(first)
    smallest = np.empty(len(own), dtype=np.int64)
    smallest[order] = own[order][at][np.cumsum(first) - 1]
    flags = smallest < own
    ends = np.cumsum([len(v) for v in h1])
    # with the bit goes the smallest id where it is smaller, since a block's other documents must compare with it as well
    out = []
    for v, e in zip(h1, ends):
        f = flags[e - len(v) : e]
        out.append(_bits(f) + smallest[e - len(v) : e][f].tobytes())
    return _answers(table, 2, out)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, block_bytes: int = BLOCK_BYTES, group_hashes: int = GROUP_HASHES) -> DataFrame:
    """One row per input row: id, n_words, n_removed, and the kept words joined by one space (kept_text, or kept_sha256 with ``digests``)."""
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    blocks = written(_pack(docs, block_bytes), "substring-blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    groups = max(1, -(-total // (4 * group_hashes)))

    # level 0
    keys = blocks.select("block", F.explode(F.arrays_zip("ids", "keys")).alias("d")).select("block", F.col("d.keys").alias("key"), F.col("d.ids").alias("id"))
    copies = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    null = lambda kind: F.lit(None).cast(kind)
    level0 = keys.groupBy("block", "key").agg(F.min("id").alias("id")).join(copies, "key").select("block", F.lit(0).alias("kind"), null("int").alias("grp"), null("binary").alias("bits"), "key", "least")

    # level 1
    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                anchors, _ = _Block(texts.as_py(), length).distinct_anchors()
                bounds = _parts(anchors, groups)
                parts = [anchors[bounds[g] : bounds[g + 1]].tobytes() for g in range(groups)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * groups, pa.int64()), pa.array(range(groups), pa.int32()), pa.array(parts, pa.binary())], names=["block", "grp", "h1"])

    anchors = blocks.select("block", "texts").mapInArrow(send_anchors, "block long, grp int, h1 binary")
    level1 = anchors.groupBy("grp").applyInArrow(_repeated_anchors, ANSWER)
    known = written(level0.unionByName(level1), "substring-anchors")

    # level 2
    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "grp": [], "h1": [], "h2": [], "ids": [], "codes": []}
        for k in range(left.num_rows):
            row = {c: left.column(c)[k].as_py() for c in left.column_names}
            _, _, _, found = _settled(row, right, length)
            bounds = _parts(found["h1"], groups)
            for g in range(groups):
                part = slice(bounds[g], bounds[g + 1])
                if bounds[g] == bounds[g + 1]:
                    continue
                ids, codes = np.unique(found["least"][part], return_inverse=True)
                for name, value in zip(out, (row["block"], g, found["h1"][part].tobytes(), found["h2"][part].tobytes(), ids.tolist(), pack_ints(codes))):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    sent = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send_windows, "block long, grp int, h1 binary, h2 binary, ids array<long>, codes binary")
    level2 = sent.groupBy("grp").applyInArrow(_held_before, ANSWER)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"id": [], "n": [], "r": [], "kept": []}
        for k in range(left.num_rows):
            row = {c: left.column(c)[k].as_py() for c in left.column_names}
            block, ids, open_docs, found = _settled(row, right, length)
            least = found["least"].copy()
            told = {g: b for kind, g, b in zip(*(_column(right, c) for c in ("kind", "grp", "bits"))) if kind == 2}
            at = 0
            for g in sorted(told):
                n = int.from_bytes(told[g][:8], "little")
                end = 8 + -(-n // 8)
                flags = np.unpackbits(np.frombuffer(told[g][8:end], np.uint8), count=n).astype(bool)
                least[at : at + n][flags] = np.frombuffer(told[g][end:], np.int64)
                at += n
            marks = np.zeros(len(block.words) + 1, dtype=np.int32)
            hit = found["starts"][least[found["entry"]] < found["own"]] if len(least) else np.zeros(0, np.int64)
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + length, -1)
            removed = np.cumsum(marks[:-1]) > 0
            first = np.cumsum(block.counts) - block.counts
            for d, text in enumerate(block.texts):
                n = int(block.counts[d])
                own = removed[first[d] : first[d] + n]
                if not open_docs[d] and n >= length:
                    own = np.ones(n, dtype=bool)
                words = text.split()
                kept = b" ".join(compress(words, (~own).tolist()) if own.any() else words)
                out["id"].append(None if row["nulls"][d] else int(ids[d]))
                out["n"].append(n)
                out["r"].append(int(own.sum()))
                out["kept"].append(hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8"))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=[id_col, "n_words", "n_removed", "kept_sha256" if digests else "kept_text"])

    schema = f"`{id_col}` long, n_words long, n_removed long, {'kept_sha256' if digests else 'kept_text'} string"
    return blocks.groupBy("block").cogroup(known.unionByName(level2).groupBy("block")).applyInArrow(cut, schema)
