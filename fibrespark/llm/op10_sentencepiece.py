"""SentencePiece encoding and decoding over a table of distinct chunks.

A chunk is a run of white-space markers with the word after it, or a line feed with the word after it. If no piece of the model
holds a marker after another character, nor a line feed, no merge crosses a chunk's edge, and a text's ids are its
chunks' ids put together. ``check_model`` proves that of the model before anything runs.

1. Rows are cut into blocks; each block lists its distinct chunks and writes its texts as codes into that list.
2. The lists are dealt by a hash of the chunk. Each group segments each distinct chunk once, however many blocks hold it, and answers
   every block in the order in which the block listed its chunks.
3. Blocks, kept bucketed so that they aren't moved again, meet their answers (one cogroup by block) and put ids back by position; decoding is the library's decode(ids).

Null text: as empty, no ids, decoded to an empty text. Repeated rows and null ids: one row each. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_ids, pack_ints, pack_strings, runs, unpack_ints, unpack_strings
from .common import bucketed, parts_for

MARK = "▁"
CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*")
BLOCK_BYTES = 16 << 20
BLOCKS_A_BUCKET = 4
GROUP_CHUNKS = 250_000
_models: dict[str, object] = {}


def model_of(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def check_model(path: str) -> None:
    """Raises ValueError unless chunks can be segmented apart."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, train = proto.normalizer_spec, proto.trainer_spec
    whole = (
        train.model_type == train.BPE and train.byte_fallback and norm.name == "identity" and norm.add_dummy_prefix
        and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not train.treat_whitespace_as_suffix
        and not norm.precompiled_charsmap
    )
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    for p in proto.pieces:
        if p.type == kinds.USER_DEFINED or p.type == kinds.NORMAL and ("\n" in p.piece or re.search(f"[^{MARK}]{MARK}", p.piece)):
            whole = False
    if not whole:
        raise ValueError(f"{path}: pieces may cross white-space markers; chunks can't be segmented apart")


def chunks_of(text: str) -> list[str]:
    return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def segment(model, chunks: list[str]) -> list[list[int]]:
    """Ids of each chunk. The library puts a marker before a text: it stands for the first space of a chunk, and is dropped before a line feed."""
    mark = model.piece_to_id(MARK)
    out = model.encode([c if c[0] == "\n" else c[1:] for c in chunks], num_threads=1)
    return [ids[1:] if c[0] == "\n" else ids or [mark] for c, ids in zip(chunks, out)]


class _Codes(dict):
    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        return code


def _pack(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row a block: ids, number of chunks of each text, codes, and the distinct chunks in the order of their codes."""
    kind = docs.schema["_id"].dataType.simpleString()
    id_type = docs.select("_id").limit(0).toArrow().schema.field(0).type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (ids, texts) in zip(block_ids(), runs(batches, block_bytes)):
            codes = _Codes()
            rows = [np.array([codes[c] for c in chunks_of(t)], dtype=np.uint32) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([[len(r) for r in rows]], pa.list_(pa.int32())),
                    pa.array([pack_ints(np.concatenate(rows))], pa.binary()), pa.array([len(codes)], pa.int64()), pa.array([pack_strings(list(codes))], pa.binary()),
                ],
                names=["block", "ids", "counts", "codes", "n_chunks", "chunks"],
            )

    return docs.mapInArrow(pack, f"block long, ids array<{kind}>, counts array<int>, codes binary, n_chunks long, chunks binary")


def _group_of(chunks: list[str], groups: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(c.encode("utf-8")) % groups for c in chunks), dtype=np.uint32, count=len(chunks))


def encoded_blocks(docs: DataFrame, model_path: str, block_bytes: int, group_chunks: int) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, answers, number of groups): an answer holds, for one block and group, how many ids each of its chunks has, and the ids."""
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = bucketed(_pack(docs, block_bytes), "chunks", "block", parts_for(size, BLOCKS_A_BUCKET * block_bytes))
    total = blocks.agg(F.sum("n_chunks")).first()[0] or 0
    groups = max(1, -(-total // group_chunks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunks = unpack_strings(packed.as_py())
                group = _group_of(chunks, groups)
                order = np.argsort(group, kind="stable")
                bounds = np.searchsorted(group[order], np.arange(groups + 1))
                full = [g for g in range(groups) if bounds[g] < bounds[g + 1]]
                lists = [pack_strings([chunks[k] for k in order[bounds[g] : bounds[g + 1]]]) for g in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array(lists, pa.binary())], names=["grp", "block", "chunks"]
                )

    def answer(table: pa.Table) -> pa.Table:
        model = model_of(model_path)
        lists = [unpack_strings(x.as_py()) for x in table.column("chunks")]
        codes = _Codes()
        places = [np.array([codes[c] for c in chunks], dtype=np.int64) for chunks in lists]
        ids = segment(model, list(codes))
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.array([i for x in ids for i in x], dtype=np.uint32)
        ends = np.cumsum(sizes)
        out = [(pack_ints(sizes[p]), pack_ints(flat[_gather(ends[p] - sizes[p], sizes[p])])) for p in places]
        return pa.table({
            "block": table.column("block").cast(pa.int64()), "grp": table.column("grp").cast(pa.int32()),
            "sizes": pa.array([a for a, _ in out], pa.binary()), "flat": pa.array([b for _, b in out], pa.binary()),
        })

    dealt = blocks.select("block", "chunks").mapInArrow(deal, "grp int, block long, chunks binary")
    return blocks, dealt.groupBy("grp").applyInArrow(answer, "block long, grp int, sizes binary, flat binary"), groups


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[k], ... starts[k] + sizes[k] - 1 of every k, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _restore(left: pa.Table, right: pa.Table, groups: int) -> Iterator[tuple[object, np.ndarray, str]]:
    """For each text of a block: its row's id, its token ids, and those as decimal numbers joined by commas."""
    answers = {g: (s, f) for g, s, f in zip(*(right.column(c).to_pylist() for c in ("grp", "sizes", "flat")))}
    for k in range(left.num_rows):
        row = {c: left.column(c)[k].as_py() for c in left.column_names}
        chunks = unpack_strings(row["chunks"])
        order = np.argsort(_group_of(chunks, groups), kind="stable")
        del chunks
        parts = [answers[g] for g in sorted(answers)]
        sizes = np.concatenate([unpack_ints(s) for s, _ in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        flat = np.concatenate([unpack_ints(f) for _, f in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        by_code_size, by_code_start = np.empty_like(sizes), np.empty_like(sizes)
        by_code_size[order] = sizes
        by_code_start[order] = np.cumsum(sizes) - sizes
        text = [str(i) for i in range(int(flat.max()) + 1)] if len(flat) else []
        joined = [",".join([text[i] for i in flat[s : s + n].tolist()]) for s, n in zip(by_code_start.tolist(), by_code_size.tolist())]
        codes, at = unpack_ints(row["codes"]), 0
        for doc_id, n in zip(row["ids"], row["counts"]):
            own = codes[at : at + n]
            at += n
            yield doc_id, flat[_gather(by_code_start[own], by_code_size[own])], ",".join([joined[c] for c in own.tolist()])


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded"), block_bytes: int = BLOCK_BYTES, group_chunks: int = GROUP_CHUNKS
) -> DataFrame:
    """One row per input row: id, n_tokens and the ``outputs``: ids (array<int>), decoded (text), ids_sha256 (of decimal ids joined by commas), decoded_sha256."""
    check_model(model_path)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    id_type = docs.select("_id").limit(0).toArrow().schema.field(0).type
    blocks, answers, groups = encoded_blocks(docs, model_path, block_bytes, group_chunks)
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        model = model_of(model_path)
        row_ids: list = []
        lengths: list[int] = []
        made: dict[str, list] = {name: [] for name in outputs}
        for doc_id, ids, joined in _restore(left, right, groups):
            row_ids.append(doc_id)
            lengths.append(len(ids))
            decoded = (model.decode(ids.tolist()) if len(ids) else "") if "decoded" in made or "decoded_sha256" in made else ""
            for name in outputs:
                made[name].append(
                    ids.astype(np.int32) if name == "ids" else decoded if name == "decoded"
                    else hashlib.sha256((joined if name == "ids_sha256" else decoded).encode("utf-8")).hexdigest()
                )
        columns = [pa.array(made[name], kinds[name][1]) for name in outputs]
        return pa.table([pa.array(row_ids, id_type), pa.array(lengths, pa.int64()), *columns], names=[id_col, "n_tokens", *outputs])

    schema = ", ".join([f"`{id_col}` {kind}", "n_tokens long", *[f"{name} {kinds[name][0]}" for name in outputs]])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)
