"""Chat formatting of reply trees.

Messages name the message they answer. Iterative self-joins enumerate the paths from
root to leaf: round k joins every path so far with the 2^k-th ancestors, so a path of
n messages takes log2(n) rounds, and no row holds more than one message. Branches are
ranked by score and each chosen path is formatted as one conversation, with the spans
of the loss mask. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelab.llm.store import written

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
#: Characters that could form a control string, and what stands for them inside texts and
#: roles. The backslash comes first, so every backslash in the output starts a code.
CODES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]


def escape(c: Column) -> Column:
    for plain, code in CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(CODES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(``tree``, ``leaf``, ``node``, ``up``) for every node on the path from each leaf to its root.

    ``nodes`` has ``tree``, ``node`` (unique in its tree) and ``parent``; a null or missing
    parent makes a root. ``up`` is the distance from the leaf. Messages on a cycle of
    replies, or below one, reach no root and are in no path."""
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    step = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    step = written(step, "replies")
    answered = step.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    paths = step.join(answered, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    roots = step.where("parent is null").select("tree", "node")
    most = step.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jump, length = step.where("parent is not null"), 1
    while length < most:
        further = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("parent").alias("node"), (F.col("up") + length).alias("up"))
        paths = written(paths.union(further), "paths")
        onward = jump.select("tree", F.col("node").alias("parent"), F.col("parent").alias("ancestor"))
        jump = written(jump.join(onward, ["tree", "parent"]).select("tree", "node", F.col("ancestor").alias("parent")), "jumps")
        length *= 2
        if jump.isEmpty():
            break
    ends = paths.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    return paths.join(ends, ["tree", "leaf"], "left_semi")


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """Format the best ``top`` root-to-leaf paths of each tree.

    ``messages`` has ``tree``, ``node``, ``parent``, ``role``, ``text`` and ``score``; null
    roles and texts count as empty, null scores as 0. Paths rank by total score, then
    length (both: more first), then the smaller leaf. Returns ``tree``, ``leaf``,
    ``formatted`` and ``spans``: (start, length) in code points of each assistant text,
    in order. Extra columns are ignored; no rows give no rows."""
    rows = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = written(rows, "messages")
    paths = written(reply_paths(rows.select("tree", "node", "parent")), "reply-paths")
    ranked = paths.join(rows.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(
        F.sum("score").alias("score"), F.count("*").alias("n"))
    best = W.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")
    chosen = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("tree", "leaf", "rank")
    turns = paths.join(chosen, ["tree", "leaf"]).join(rows, ["tree", "node"])
    turns = turns.select("tree", "leaf", "rank", "up", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BETWEEN)).alias("head"),
                         escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + F.lit(len(CLOSE)))
    order = W.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    start = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") + F.length("head")
    turns = turns.select("tree", "leaf", "rank", F.struct(
        (-F.col("up")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"), "learn",
        start.alias("start"), F.length("body").alias("length")).alias("t"))
    done = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return done.select("tree", "leaf", "rank", F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"),
                       F.transform(F.filter("t", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    role = lambda p: F.substring_index(p, BETWEEN, 1)
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring(role(p), len(OPEN) + 1, 2**31 - 1)).alias("role"),
        unescape(p.substr(F.length(role(p)) + len(BETWEEN) + 1, F.length(p))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, one span after the other, as it was before escaping."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def from_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations as trees without branches: each row answers the row before it.

    Rows of a conversation are ordered by turn (null first), ties by role and text, so
    rows with the same turn and repeated rows all stay. A null conversation is one of its
    own. ``tree`` is the conversation as a string, which tells null from any id."""
    tree = F.coalesce(F.col(f"`{conv_col}`").cast("string"), F.lit("null"))
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    rows = df.select(tree.alias("tree"), F.col(f"`{turn_col}`").alias("turn"), "role", "text").withColumn("node", F.row_number().over(order))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
