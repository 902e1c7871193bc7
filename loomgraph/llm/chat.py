"""Chat formatting: reply trees to single conversations with a loss mask.

``paths`` treats messages as a forest (parent ids).  Iterative self-joins by doubling give every node its jump pointers,
depth and score summed from the root; leaves are ranked within a tree by that score, and the chosen leaves' ancestors
are collected by the same pointers from the longest jump down.  The number of joins is the logarithm of the depth.
``render`` writes one path with role marks, escaped control strings and the loss mask; ``parse`` reads it back.

Defined results: null role or text is empty; a message whose parent isn't there is a root; turns that tie keep a fixed
order (role, text); repeated rows are turns of their own; parents that form a cycle belong to no tree and give no path;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .repeats import columns

OPEN, CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_NEXT = re.compile(r"\\(?:\\|###|</turn>|:)|### |</turn>\n|: ")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The text, and the (start, end) stretches in code points that count for the loss."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN}{_ROLE_CONTROL.sub(lambda m: chr(92) + m[0], role)}: "
        body = escape(text)
        at += len(head)
        if role == learn:
            mask.append((at, at + len(body)))
        at += len(body) + len(CLOSE) + 1
        parts += [head, body, CLOSE, "\n"]
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the text alone."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        start = at = at + len(OPEN)
        role = None
        while True:
            m = _NEXT.search(formatted, at)
            if not m:
                raise ValueError(f"a turn without an end after {start}")
            at = m.end()
            if m[0] == ": " and role is None:
                role, start = unescape(formatted[start : m.start()]), at
            elif m[0] == CLOSE + "\n":
                turns.append((role, unescape(formatted[start : m.start()])))
                break
    return turns


def paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """nodes: tree, node, parent, score.  Returns tree, path (its leaf), place, node for the ``best`` leaves of each tree.

    Leaves rank by the sum of the scores on their path, higher first, then by node.
    """
    base = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    there = base.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    known = base.join(there, _same("tree", "t") & (F.col("parent") == F.col("n")), "left")
    step = known.select("tree", "node", F.when(F.col("n").isNotNull(), F.col("parent")).alias("up"), "score", F.when(F.col("n").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    first = C.materialize(step, "jump")
    pool, active, jumps, finished = first, first.where("up is not null"), [], []
    # a tree leaves the pool once all its messages know their root: short trees after a few rounds
    while len(jumps) < 40 and not active.isEmpty():
        jumps.append(active.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up"))
        live = active.select(F.col("tree").alias("t")).distinct()
        finished.append(pool.join(live, _same("tree", "t"), "left_anti"))
        pool = pool.join(live, _same("tree", "t"), "left_semi")
        over = pool.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"))
        longer = active.join(over, _same("tree", "t") & (F.col("up") == F.col("n")))
        longer = longer.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("depth") + F.col("d2")).alias("depth"))
        pool = C.materialize(pool.where("up is null").union(longer), "jump")
        active = pool.where("up is not null")
    step = pool.where("up is null")  # after 40 rounds, deeper than any table, what still has an ancestor runs in a cycle
    for part in finished:
        step = step.union(part)
    step = C.materialize(step, "depth")
    inner = first.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = step.join(inner, _same("tree", "t") & (F.col("node") == F.col("n")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    found = chosen.select("tree", F.col("node").alias("path"), "node")
    for k, jump in enumerate(reversed(jumps)):
        more = found.join(jump, _same("tree", "t") & (F.col("node") == F.col("n"))).select("tree", "path", F.col("up").alias("node"))
        found = found.union(more)
        if k % 4 == 3:
            found = C.materialize(found, "path")
    depth = step.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("depth").alias("place"))
    return found.join(depth, _same("tree", "t") & (F.col("node") == F.col("n"))).select("tree", "path", "place", "node")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def format_paths(nodes: DataFrame, best: int = 1, learn: str = "assistant") -> DataFrame:
    """nodes: tree, node, parent, score, role, text.  Returns tree, path, formatted, mask (start, end, ...)."""
    C.small_batches(C.session_of(nodes))
    texts = nodes.select("tree", "node", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chosen = paths(nodes, best)
    texts = texts.withColumnsRenamed({"tree": "t", "node": "n"})
    turns = chosen.join(texts, _same("tree", "t") & (F.col("node") == F.col("n")))
    each = turns.groupBy("tree", "path").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns], learn) for (turns,) in columns(batch, "turns")]
            tree, path = (batch.column(batch.schema.get_field_index(n)) for n in ("tree", "path"))
            yield pa.RecordBatch.from_arrays([tree, path, pa.array([m[0] for m in made], pa.string()), pa.array([[x for s in m[1] for x in s] for m in made], pa.list_(pa.int64()))], names=["tree", "path", "formatted", "mask"])

    return each.mapInArrow(run, "tree long, path long, formatted string, mask array<long>")


def as_nodes(messages: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees with one branch: a turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digest(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read back from text and mask."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, text, mask in columns(batch, "tree", "formatted", "mask"):
                turns = parse(text)
                told = "".join(f"{role}\n{body}\n" for role, body in turns).encode("utf-8", "surrogatepass")
                loss = "".join(unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True))
                out.append((tree, len(turns), hashlib.sha256(told).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
