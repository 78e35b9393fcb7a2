"""Chat formatting of reply trees: iterative self-joins find root-to-leaf paths, branches are ranked by
score, and each chosen path becomes one formatted conversation with a loss mask."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from snapstrata.llm.common import table

#: Marks of the template, fixed: a turn is TURN role newline text END newline.
TURN, END = "<|turn|>", "<|end|>"
#: Fixed control strings of common chat templates that a text must not be able to forge:
#: <| (any mark of that kind), <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
_HEAD = r"(<(?=\\*(?:\||/?s>|</?SYS>>))|\[(?=\\*/?INST\]))"
_ESCAPE, _UNESCAPE = re.compile(_HEAD), re.compile(_HEAD + r"\\")
_ROLE = re.compile(r"\\(.)", re.S)
_PARSE = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    """One backslash more after the first character of every control string, however many are there."""
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns, loss_role: str = "assistant") -> tuple[str, list[int], list[int]]:
    """(formatted text, starts, ends): the spans, in code points, hold the text of loss_role's turns."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{_role_out(role or '')}\n", escape(text or "")
        if (role or "") == loss_role:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from format_turns."""
    return [(_role_in(r), unescape(t)) for r, t in _PARSE.findall(formatted)]


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null meets null; the keys come from the left side."""
    other = right.withColumnsRenamed({c: f"__{c}" for c in on})
    return left.join(other, F.expr(" and ".join(f"{c} <=> __{c}" for c in on)), how).drop(*(f"__{c}" for c in on))


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees: (tree, leaf, branch_rank, branch_score, depth, msg), one row per message.

    messages: tree, msg, parent, score. A message whose parent is null or missing is a root. ``branches``
    keeps that many leaves of each tree by total score (ties: smaller leaf id); None keeps all.

    Jumps of 1, 2, 4, ... ancestors come from joining the jump table with itself, so a path of n
    messages takes log2(n) joins; a leaf's path is then every jump or none, level by level. Only ids and
    scores travel. Messages on a reply cycle reach no root and belong to no path; joining ends when the largest tree's
    number of messages is passed, as no path is longer. msg must be unique in a tree.
    Null is a tree as any other; a null msg is nobody's parent."""
    m = messages.select("tree", "msg", "parent", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    up = m.select(F.col("tree").alias("t"), F.col("msg").alias("p"))
    first = m.join(up, m.tree.eqNullSafe(up.t) & (m.parent == up.p), "left").select("tree", "msg", F.col("p").alias("anc"), F.lit(1).cast("long").alias("hops"), "score")
    state = table(first, "chat-jump")
    jumps, done = [state.where("anc is not null")], [state.where("anc is null")]
    largest = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while 2 ** (len(jumps) - 1) < largest and jumps[-1].limit(1).count():  # what is left in the end lies on cycles
        a = jumps[-1]  # only messages that have not reached their root take part
        b = done[0]
        for x in done[1:]:
            b = b.unionByName(x)
        b = b.unionByName(a).select(F.col("tree").alias("t"), F.col("msg").alias("p"), F.col("anc").alias("anc2"), F.col("hops").alias("h2"), F.col("score").alias("s2"))
        b = _join(b, a.select(F.col("tree").alias("t")).distinct(), ["t"], "left_semi")
        new = a.join(b, a.tree.eqNullSafe(b.t) & (a.anc == b.p)).select("tree", "msg", F.col("anc2").alias("anc"), (F.col("hops") + F.col("h2")).alias("hops"), (F.col("score") + F.col("s2")).alias("score"))
        state = table(new, "chat-jump")
        done.append(state.where("anc is null"))
        jumps.append(state.where("anc is not null"))
    ends = done[0]
    for x in done[1:]:
        ends = ends.unionByName(x)
    depth = ends.select("tree", "msg", (F.col("hops") - 1).alias("depth"), "score")
    parents = jumps[0].select("tree", F.col("anc").alias("msg")).distinct()
    leaves = _join(depth, parents, ["tree", "msg"], "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "msg"))
    leaves = leaves.select("tree", F.col("msg").alias("leaf"), rank.alias("branch_rank"), F.col("score").alias("branch_score"))
    leaves = leaves if branches is None else leaves.where(F.col("branch_rank") <= branches)
    found = leaves.withColumn("msg", F.col("leaf"))
    for jump in reversed(jumps[:-1] if len(jumps) > 1 else jumps):
        step = jump.select("tree", "msg", "anc")
        more = _join(found, step, ["tree", "msg"]).select(*leaves.columns, F.col("anc").alias("msg"))
        found = table(found.unionByName(more), "chat-path") if jump is not jumps[0] else found.unionByName(more)
    return _join(found, depth.select("tree", "msg", "depth"), ["tree", "msg"])


def format_trees(messages: DataFrame, branches: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, branch_rank, branch_score, n_turns, formatted, loss_starts, loss_ends) for each chosen path.

    messages: tree, msg, parent, role, text, score. Null roles and texts count as empty; null is a tree as any other. An empty table gives an
    empty result. Extra columns are ignored."""
    found = paths(messages, branches)
    body = messages.select("tree", "msg", "role", "text")
    rows = _join(found, body, ["tree", "msg"]).groupBy("tree", "leaf", "branch_rank", "branch_score").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("tree", "leaf", "branch_rank", "branch_score")] + [T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_starts", T.ArrayType(T.LongType())), T.StructField("loss_ends", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            turns = b.column("turns").to_pylist()
            out = [format_turns([(t["role"], t["text"]) for t in x], loss_role) for x in turns]
            head = [b.column(c) for c in ("tree", "leaf", "branch_rank", "branch_score")]
            spans = [pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*head, pa.array([len(x) for x in turns], pa.int64()), pa.array([o[0] for o in out], pa.string()), *spans], names=schema.names)

    return rows.mapInArrow(run, schema)


def as_messages(conversations: DataFrame) -> DataFrame:
    """A table of turns as reply trees: each turn answers the one before it. Rows that share a turn number
    follow one another by role, then text; nulls first."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), n.alias("msg"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted texts alone."""
    from hashlib import sha256

    def run(batches):
        for b in batches:
            rows = []
            for text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends")), strict=True):
                turns = parse(text)
                whole = sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                loss = "".join(unescape(text[x:y]) for x, y in zip(starts, ends, strict=True))
                rows.append((len(turns), whole.hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("tree").cast(pa.int64()), *out], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
