"""Chat formatting: reply trees to conversations by iterative self-joins, each chosen path under one template.

1. Messages (tree, id, parent, role, text, score) become nodes with a pointer to their parent. Rows of nodes hold no text.
2. Pointers are doubled: round k knows each node's ancestor 2 ** k above it, the sum of the scores up to there and its depth, so a chain of n messages takes
   log2(n) self-joins. Each round is written.
3. Leaves are ranked within their tree by the score of their path from the root; a tree's first ``branches`` are chosen.
4. The nodes of a chosen path are found from its leaf by the rounds' jumps, the longest first, and meet their texts.
5. A path is one conversation: turns in order between markers, control strings inside texts escaped, with the spans of the text to be learnt.

Escape: a control string is its first character and a rest; a backslash is put between them. Where backslashes stand there already, one more is put, so that
taking one away gives every text back. Roles have line feeds and backslashes escaped as well.

Null text, null role: as empty. Null scores: 0. A message whose parent isn't in its tree is a root. A null tree is a tree. Messages without an id have no replies; of several with
one id (first by role, then text) replies go to the first, and each is a message. Ties of paths: the longer, then the smaller id of the leaf. Messages whose parents lead in a
circle are on no path. Long conversations: one row each; formatting and reading are linear in it. Empty table: empty result. Further columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Template:
    """``start`` role ``middle`` text ``end`` for each turn. ``controls``: what texts mustn't hold unescaped; ``learnt``: roles under the loss mask."""

    start: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learnt: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for a in self.controls:
            for b in self.controls:
                if any(a[k:].startswith(b) or b.startswith(a[k:]) for k in range(1, len(a))):
                    raise ValueError(f"control strings may overlap, so escapes can't be taken back: {a} {b}")

    def _pattern(self, escaped: str) -> re.Pattern:
        rests: dict[str, list[str]] = {}
        for c in self.controls:
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        return re.compile("|".join(rf"(?<={re.escape(first)}){escaped}(?=\\*(?:{'|'.join(rest)}))" for first, rest in rests.items()))

    def escape(self, text: str) -> str:
        return self._pattern("").sub(r"\\", text)

    def unescape(self, text: str) -> str:
        return self._pattern(r"\\").sub("", text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """(text, spans to be learnt) of turns (role, text)."""
        out, at, spans = [], 0, []
        for role, text in turns:
            own = self.escape(text)
            head = self.start + self.escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + self.middle
            if role in self.learnt:
                spans.append((at + len(head), at + len(head) + len(own)))
            out += [head, own, self.end]
            at += len(head) + len(own) + len(self.end)
        return "".join(out), spans

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns that ``render`` was given."""
        turns = []
        for piece in formatted.split(self.start)[1:]:
            role, text = piece.removesuffix(self.end).split(self.middle, 1)
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))
            turns.append((role, self.unescape(text)))
        return turns


CHAT = Template()


def _nodes(messages: DataFrame) -> DataFrame:
    """Written rows (node, t, tree, id, parent, role, text, score); t names the tree, null ones too, and node is fixed from then on."""
    return written(
        messages.select(
            F.monotonically_increasing_id().alias("node"), F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")).alias("t"), "tree", "id", "parent",
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        ),
        "chat-messages",
    )


def _pointers(nodes: DataFrame) -> DataFrame:
    heads = nodes.where("id IS NOT NULL").groupBy("t", "id").agg(F.min(F.struct("role", "text", "node"))["node"].alias("up")).select(F.col("t").alias("_t"), F.col("id").alias("_id"), "up")
    own = nodes.select("node", "t", "parent", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    return own.join(heads, (F.col("t") == F.col("_t")) & (F.col("parent") == F.col("_id")), "left").select("node", "up", "total", "depth")


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(jumps (node, up) of each round, (node, total, depth) of the nodes whose parents lead to a root)."""
    most = nodes.groupBy("t").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    state = written(_pointers(nodes), "chat-pointers")
    jumps = []
    for _ in range(most.bit_length()):
        open_rows = state.where("up IS NOT NULL")
        if open_rows.isEmpty():
            break
        jumps.append(open_rows.select("node", "up"))
        above = state.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("depth").alias("_depth"))
        both = open_rows.join(above, F.col("up") == F.col("_node"))
        moved = both.select("node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("depth") + F.col("_depth")).alias("depth"))
        state = written(moved.unionByName(state.where("up IS NULL")), "chat-pointers")
    return jumps, state.where("up IS NULL").select("node", "total", "depth")


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """messages (tree, id, parent, role, text, score) to a row per chosen path: tree, leaf (its id), branch (from 1), score, turns (array of role, text).

    ``branches``: how many paths of a tree are taken; None: all.
    """
    nodes = _nodes(messages)
    jumps, ends = _rounds(nodes)
    leaves = nodes.select("node", "t", "tree", "id").join(ends, "node")
    if jumps:
        leaves = leaves.join(jumps[0].select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    best = Window.partitionBy("t").orderBy(F.desc("total"), F.desc("depth"), F.asc_nulls_last("id"), "node")
    leaves = leaves.withColumn("branch", F.row_number().over(best))
    if branches is not None:
        leaves = leaves.where(F.col("branch") <= branches)
    leaves = written(leaves.select(F.col("node").alias("path"), "tree", F.col("id").alias("leaf"), "branch", F.col("total").alias("score")), "chat-paths")
    on = leaves.select("path", F.col("path").alias("node"))
    for jump in reversed(jumps):
        on = written(on.unionByName(on.join(jump, "node").select("path", F.col("up").alias("node"))), "chat-members")
    texts = on.join(nodes.select("node", "role", "text"), "node").join(ends.select("node", "depth"), "node")
    turns = texts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return leaves.join(turns.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p")).select("tree", "leaf", "branch", "score", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def format_paths(chosen: DataFrame, template: Template = CHAT) -> DataFrame:
    """paths() to tree, leaf, branch, score, formatted and loss_spans: (first, end) code points of the texts that are learnt."""
    spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row each, so that an output batch holds one conversation
                text, learnt = template.render([(x["role"], x["text"]) for x in batch.column("turns")[k].as_py()])
                kept = [batch.column(c).slice(k, 1) for c in batch.schema.names if c != "turns"]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([text], pa.string()), pa.array([[{"first": a, "end": b} for a, b in learnt]], spans)], names=[*[c for c in batch.schema.names if c != "turns"], "formatted", "loss_spans"]
                )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name != "turns")
    return chosen.mapInArrow(render, f"{kept}, formatted string, loss_spans array<struct<first:long,end:long>>")


def chat_messages(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as reply trees: each row answers the one before it, by turn (null last), role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("id"))
    return rows.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """format_paths() to conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all taken from the formatted text and its spans."""
    kind = formatted.schema["tree"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                turns, digest = template.read(text), hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                n, learnt = 0, hashlib.sha256()
                for span in batch.column(2)[k].as_py():
                    own = template.unescape(text[span["first"] : span["end"]])
                    n += len(own)
                    learnt.update(own.encode())
                made.append((len(turns), digest.hexdigest(), n, learnt.hexdigest(), len(text)))
            columns = list(zip(*made)) or [(), (), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=names)

    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_report(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """Every conversation, formatted and read back."""
    return read_back(format_paths(paths(chat_messages(conversations)), template), template)
