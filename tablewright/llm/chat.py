"""Reply trees to formatted conversations, with DataFrame and SQL functions only.

Messages point at the message they answer.  Self-joins that double the distance
each time find every message's way up; from the same tables the chosen
root-to-leaf paths are written out.  Branches are ranked by their mean score, and
each chosen path becomes one text with a loss mask over the assistant's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import materialise

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """A backslash more in every ``<``, backslashes, ``|``: no text can hold a mark, and ``unescape`` undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``, and without line breaks, since one ends the role."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def linear_messages(turns: DataFrame) -> DataFrame:
    """``conv_id, msg, parent, role, text, score`` of conversations whose rows follow each other by ``turn``.

    Null conversations are one of their own.  Equal turns follow by role and text;
    null turns come first.  Null roles and texts are empty.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select(
        "conv_id", F.row_number().over(order).cast("long").alias("msg"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return numbered.withColumn("parent", F.when(F.col("msg") > 1, F.col("msg") - 1)).withColumn("score", F.lit(1.0))


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every message's depth, score sum and root, and the tables of its 1st, 2nd, 4th, ... ancestors.

    ``nodes``: conv, msg, parent (null at a root), score.  A message on or below a
    cycle never meets a root; it keeps a null root.
    """
    jumps = []
    state = materialise(
        nodes.selectExpr("conv", "msg", "parent AS up", "if(parent IS NULL, msg, NULL) AS root", "1L AS depth", "score AS total"),
        "replies",
    )
    limit = nodes.count()
    while True:
        open_rows = state.filter("up IS NOT NULL")
        if (1 << len(jumps)) > max(limit, 1) or open_rows.isEmpty():
            return state, jumps
        jumps.append(open_rows.select("conv", "msg", "up"))
        above = state.selectExpr("conv AS a_conv", "msg AS a_msg", "up AS a_up", "root AS a_root", "depth AS a_depth", "total AS a_total")
        climbed = open_rows.join(above, F.expr("conv = a_conv AND up = a_msg")).selectExpr(
            "conv", "msg", "a_up AS up", "coalesce(root, a_root) AS root", "depth + a_depth AS depth", "total + a_total AS total"
        )
        state = materialise(state.filter("up IS NULL").unionByName(climbed), "replies")


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``conv_id, leaf, rank, position, role, text``: the ``branches`` best root-to-leaf paths under each root.

    ``messages``: conv_id, msg (unique in its conversation), parent, role, text, score.  A parent that does not
    occur makes a root; null scores count 0.  Paths rank by mean score, then by leaf.
    Messages that hang on a cycle lie on no root-to-leaf path.  No messages, no paths.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = materialise(
        messages.select(
            key.alias("conv"), "conv_id", "msg", "parent",
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        ),
        "messages",
    )
    known = rows.selectExpr("conv AS k_conv", "msg AS k_msg")
    nodes = rows.join(known, F.expr("conv = k_conv AND parent = k_msg"), "left").selectExpr(
        "conv", "msg", "k_msg AS parent", "score"
    )
    state, jumps = _climb(nodes)
    answered = nodes.filter("parent IS NOT NULL").selectExpr("conv", "parent AS msg").distinct()
    leaves = state.filter("root IS NOT NULL").join(answered, ["conv", "msg"], "left_anti")
    best = Window.partitionBy("conv", "root").orderBy(F.expr("total / depth").desc(), "msg")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    path = chosen.selectExpr("conv", "msg AS leaf", "rank", "msg")
    for jump in reversed(jumps):  # highest power first: every ancestor is met once
        higher = path.join(jump, ["conv", "msg"]).selectExpr("conv", "leaf", "rank", "up AS msg")
        path = materialise(path.unionByName(higher), "paths")
    deep = state.selectExpr("conv", "msg", "depth AS position")
    return path.join(deep, ["conv", "msg"]).join(rows, ["conv", "msg"]).select(
        "conv_id", "conv", "leaf", "rank", "position", "role", "text"
    )


def format_paths(paths: DataFrame) -> DataFrame:
    """``conv_id, leaf, rank, formatted, loss_spans``, one row per path.

    ``loss_spans`` holds (start, length) in code points of ``formatted``: the escaped texts of assistant turns.
    """
    each = Window.partitionBy("conv", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = (
        paths.withColumn("body", escape(F.col("text")))
        .withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
        .withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
        .withColumn("before", F.coalesce(F.sum(F.length("turn")).over(each), F.lit(0)))
    )
    span = F.struct(
        (F.col("before") + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length")
    )
    grouped = turns.groupBy("conv", "leaf", "rank").agg(
        F.first("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list(F.struct("position", "turn"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss_spans"),
    )
    return grouped.select("conv_id", "leaf", "rank", F.array_join("turns.turn", "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` plus ``turns`` (role, text) and ``loss_text``, both parsed from the text and its mask."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x: x != "")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    loss = F.transform(
        "loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(loss, ""))


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The formatted conversations of reply trees: paths, ranking and template together."""
    return format_paths(reply_paths(messages, branches))
