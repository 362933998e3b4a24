"""Chat formatting over reply trees.

Messages name their parent. Iterative self-joins double the known ancestors of every message until all root-to-leaf
paths are known with their depth and score; of each conversation the branch with the highest score (then the longest,
then the one with the largest leaf) is chosen and its messages are marked by the same joins, from far to near. Each
chosen path becomes one conversation:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n   per turn

In roles and texts every "<", backslashes, "|" gets one more backslash, so that no control string stands inside them;
roles also escape backslash and line break. ``unescape`` undoes both. The loss mask holds the [start, end) code points of
the assistants' texts.

Null text and role: empty. Null scores count as 0. A parent that does not exist makes a root; messages on a cycle are on no
root-to-leaf path and are left out. A conversation is one output row, so it must fit into one task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import settle
from .text import whole

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def branches(messages: DataFrame) -> DataFrame:
    """node and depth (root: 1) of the messages on the chosen branch of each conversation.

    ``messages``: conv_id, node (unique over the whole table), parent (node or null), score; a written table.
    """
    nodes = messages.select("conv_id", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("node").alias("_far"))
    # far: the ancestor ``hops`` up (null past the root); score: of the messages from the node up to before it.
    first = settle(nodes.join(known, F.col("parent") == F.col("_far"), "left").select(
        "conv_id", "node", F.col("_far").alias("far"), F.lit(1).alias("hops"), "score"), "paths")
    done, open_ = [first.where(F.col("far").isNull())], first.where(F.col("far").isNotNull())
    jumps, left = [], open_.count()
    limit = left
    while left and 2 ** len(jumps) <= 2 * limit:  # who is not done then is on a cycle or below one
        jumps.append(open_)
        up = reduce(DataFrame.unionByName, [*done, open_]).select(
            F.col("node").alias("_node"), F.col("far").alias("_far"), F.col("hops").alias("_hops"), F.col("score").alias("_score"))
        after = settle(open_.join(up, F.col("far") == F.col("_node")).select(
            "conv_id", "node", F.col("_far").alias("far"), (F.col("hops") + F.col("_hops")).alias("hops"),
            (F.col("score") + F.col("_score")).alias("score")), "paths")
        done.append(after.where(F.col("far").isNull()))
        open_ = after.where(F.col("far").isNotNull())
        left = open_.count()
    rooted = reduce(DataFrame.unionByName, done)
    parents = nodes.select(F.col("parent").alias("node")).distinct()
    leaves = rooted.join(parents, "node", "left_anti")
    best = leaves.groupBy("conv_id").agg(F.max(F.struct("score", "hops", "node")).alias("best"))
    marked = settle(best.select(F.col("best.node").alias("node"), F.col("best.hops").cast("long").alias("depth")), "marked")
    for i, jump in reversed(list(enumerate(jumps))):
        above = marked.join(jump.select("node", "far"), "node").select(F.col("far").alias("node"), (F.col("depth") - 2**i).alias("depth"))
        marked = settle(marked.unionByName(above), "marked")
    return marked


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of start and end) of the chosen branch of every conversation.

    ``messages``: conv_id, node, parent, role, text, score; further columns are ignored.
    """
    role, text = escape_role(whole("role")), escape(whole("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turns = messages.join(branches(messages), "node").select(
        "conv_id", "depth", F.concat(head, text, F.lit(END + "\n")).alias("turn"), F.length(head).alias("head"),
        F.length(text).alias("body"), F.col("role").eqNullSafe(ASSISTANT).alias("learn"))
    before = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.col("head")
    turns = turns.withColumn("start", start)
    span = F.struct(F.col("start"), (F.col("start") + F.col("body")).alias("end"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", "learn", span.alias("span")))).alias("turns"))
    return rows.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["span"]).alias("loss"))


TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn, read back."""
    return [(unescape_role(r), unescape(t)) for r, t in TURN.findall(formatted)]


def read_back(rows: DataFrame) -> DataFrame:
    """What the formatted text and its loss mask hold: conv_id, n_turns, digests of all turns and of the text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = parse(formatted)
                learned = "".join(unescape(formatted[s["start"]:s["end"]]) for s in loss)
                all_turns = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(learned),
                            hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, (
                batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "formatted", "loss").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chained(turns: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) as messages that reply to the one before, as a written table."""
    rows = settle(turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("node")), "messages")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text"), "node")
    return settle(rows.select("conv_id", "node", F.lag("node").over(order).alias("parent"), "role", "text", F.lit(0.0).alias("score")), "replies")
