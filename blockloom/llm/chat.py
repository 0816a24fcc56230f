"""Chat formatting of reply trees.

Messages form trees: each names its parent, and a root names none.  Self-joins that double the
distance each round give every message its ancestors at distances 1, 2, 4, ... with the sum of
the scores between; from these each leaf's whole path is scored without being listed.  The best
branches of each tree are chosen by score, and only their paths are listed, again by joins over
doubled distances, so a path of n messages takes about log2 n joins.

Each chosen path becomes one conversation in a template that marks turns:

    [USER] text [/USER]   [ASSISTANT] text</s>   [SYSTEM] text [/SYSTEM]   [ROLE:x] text [/ROLE]

Within texts and role names a backslash stands before every backslash, ``[`` and ``<``, so that no
control string can come from a text and the texts can be read back exactly.  The loss mask is a
list of character ranges: the texts of the assistant's turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

#: Of each known role, what opens and what closes its turns; any other role is named in its mark.
MARKS = {"user": ("[USER] ", " [/USER]"), "assistant": ("[ASSISTANT] ", "</s>"), "system": ("[SYSTEM] ", " [/SYSTEM]")}
OPEN = re.compile(r"\[(?:USER|ASSISTANT|SYSTEM|ROLE:((?:\\.|[^\\\]])*))\] ", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]<])", r"\\$1")


def _of_tree(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left and right joined on key and, null-safe, on tree; both columns come from left."""
    own = right.withColumnsRenamed({"tree": "_tree", key: f"_{key}"})
    return left.join(own, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col(key) == F.col(f"_{key}")), how).drop("_tree", f"_{key}")


def best_paths(messages: DataFrame, n_best: int = 1) -> DataFrame:
    """(tree, leaf, node, step): the messages of the n_best branches of each tree, step 0 at the root.

    messages has tree, node, parent (null at a root) and score.  A branch's score is the sum over
    its messages, null counting as 0; equal branches go by the lesser leaf.  Messages whose
    ancestors don't lead to a root of their tree (a missing parent, a cycle) belong to no branch.
    Messages without a tree (null) form one tree of their own.
    """
    nodes = written(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).dropDuplicates(["tree", "node"]), "messages")
    count = nodes.count()
    up = nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("above"), F.col("score").alias("sum"))
    jumps = []
    while 1 << len(jumps) <= max(count, 1):
        up = written(up, "jumps")
        if up.isEmpty():
            break
        jumps.append(up)
        far = up.select("tree", F.col("node").alias("above"), F.col("above").alias("next"), F.col("sum").alias("more"))
        up = _of_tree(up, far, "above").select("tree", "node", F.col("next").alias("above"), (F.col("sum") + F.col("more")).alias("sum"))
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node"))
    leaves = _of_tree(nodes, parents, "node", "left_anti").select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("total"))
    for jump in reversed(jumps):
        step = jump.select("tree", F.col("node").alias("at"), "above", "sum")
        leaves = _of_tree(leaves, step, "at", "left").select("tree", "leaf", F.coalesce("above", "at").alias("at"), (F.col("total") + F.coalesce("sum", F.lit(0.0))).alias("total"))
    roots = nodes.where("parent is null").select("tree", F.col("node").alias("at"), "score")
    scored = _of_tree(leaves, roots, "at").select("tree", "leaf", (F.col("total") + F.col("score")).alias("total"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")))
    path = written(ranked.where(F.col("rank") <= n_best).select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("away")), "branches")
    for k in reversed(range(len(jumps))):
        further = _of_tree(path, jumps[k].select("tree", "node", "above"), "node")
        # Written, since each round's plan holds the last one's twice.
        path = written(path.union(further.select("tree", "leaf", F.col("above").alias("node"), (F.col("away") + (1 << k)).alias("away"))), "branches")
    return path.withColumn("step", F.max("away").over(Window.partitionBy("tree", "leaf")) - F.col("away")).select("tree", "leaf", "node", "step")


def formatted(turns: DataFrame, *keys: str) -> DataFrame:
    """keys, formatted (string), loss_spans (array of (start, end) in characters) and n_turns, of turns with keys, step, role and text.

    A null text counts as empty, a null role as a role of the empty name.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = escaped(F.coalesce(F.col("text").cast("string"), F.lit("")))
    opens = closes = None
    for name, (a, b) in MARKS.items():
        opens = F.when(role == name, F.lit(a)) if opens is None else opens.when(role == name, F.lit(a))
        closes = F.when(role == name, F.lit(b)) if closes is None else closes.when(role == name, F.lit(b))
    opens = opens.otherwise(F.concat(F.lit("[ROLE:"), escaped(role), F.lit("] ")))
    closes = closes.otherwise(F.lit(" [/ROLE]"))
    turn = F.struct("step", opens.alias("open"), text.alias("text"), closes.alias("close"), (role == "assistant").alias("loss"))
    whole = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    size = lambda x: F.length(x["open"]) + F.length(x["text"]) + F.length(x["close"])
    empty = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["open"])
        span = F.array(F.struct(start.alias("start"), (start + F.length(x["text"])).alias("end")))
        return F.struct((acc["at"] + size(x)).alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("t", empty, step)["spans"]
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["open"], x["text"], x["close"])), "")
    return whole.select(*keys, joined.alias("formatted"), spans.alias("loss_spans"), F.size("t").cast("bigint").alias("n_turns"))


def format_trees(messages: DataFrame, n_best: int = 1) -> DataFrame:
    """One conversation for each of the n_best branches of a tree: tree, leaf, formatted, loss_spans, n_turns.

    messages has tree, node, parent, role, text and score.  Repeated rows of a node count once
    (the least by role and text).  An empty table gives an empty result; other columns are not
    read.
    """
    messages = messages.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.parent", "m.role", "m.text", "m.score")
    path = best_paths(messages, n_best)
    return formatted(_of_tree(path, messages.select("tree", "node", "role", "text"), "node"), "tree", "leaf")


def read_back(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    closes = {a[1:-2].lower(): b for a, b in MARKS.values()}
    while at < len(text):
        m = OPEN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = ESCAPED.sub(r"\1", m[1]) if m[1] is not None else m[0][1:-2].lower()
        close = " [/ROLE]" if m[1] is not None else closes[role]
        end = m.end()
        # Every control string begins with a bracket, and those of texts follow a backslash.
        mark = re.compile(r"(?:\\.|[^\\])*?" + re.escape(close), re.S).match(text, end)
        if not mark:
            raise ValueError(f"no end of the turn at {at}")
        turns.append((role, ESCAPED.sub(r"\1", text[end : mark.end() - len(close)])))
        at = mark.end()
    return turns


def digests(conversations: DataFrame, key: str) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read back from formatted and loss_spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(ESCAPED.sub(r"\1", text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return conversations.select(key, "formatted", "loss_spans").mapInArrow(run, f"{key} bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def as_tree(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each turn replies to the one before.

    Turns that share a number come in the order of role and text; rows that are wholly equal are
    turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("bigint").alias("node"))
    return node.select(F.col("conv_id").cast("bigint").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


#: SQL for the columns of digests; formatted_chars counts the marks and a backslash for each escaped character.
ORACLE = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\\[\]<]', '', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 16 WHEN 'system' THEN 19 ELSE 16 + length(role) + length(regexp_replace(role, '[^\\\[\]<]', '', 'g')) END AS chars FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""
