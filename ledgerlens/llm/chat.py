"""Chat formatting of reply trees.

Messages name the message they reply to. Self-joins enumerate every path from a root to a
leaf: a path is built upwards from its leaf, and each round joins it with ancestors twice as far
away as the round before, so a thread of n messages takes about log2 n rounds. Branches are
ranked by the mean score of their messages, and each chosen path becomes one conversation.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for every turn. Inside a text a backslash
is put between ``<`` and ``|``, behind any that stand there already, and taken out again on
reading; roles are percent-encoded. So nothing in a text can be taken for a mark.

Null text, role and score count as empty, empty and zero. A message whose parent is not there
is a root. Message ids are unique within a conversation; of messages that repeat one all are
on its paths. Messages of a reply cycle are on no path. Null conversations count as one. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import remove, written

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """The text with every ``<|`` broken up by a backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _same(left: str, right: str, column: str, other: str) -> Column:
    return F.col(f"{left}.conv").eqNullSafe(F.col(f"{right}.conv")) & (
        F.col(f"{left}.{column}") == F.col(f"{right}.{other}")
    )


def rooted_messages(known: DataFrame, jumps: DataFrame) -> DataFrame:
    """(conv, msg): the messages from which replies lead up to a root, as a table.

    By pointer jumping: each message points to an ancestor, twice as far in every round, until that
    is known to reach a root. Messages in a circle, or in reply to one, never do; they are given up
    once the pointers have gone farther than the largest conversation is long. No round has more
    rows than there are replies.
    """
    spark = known.sparkSession
    roots = known.alias("k").join(jumps.alias("j"), _same("k", "j", "msg", "msg"), "left_anti")
    rooted, rooted_path = written(roots, "rooted")
    largest = known.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    far, far_path = written(jumps, "far")
    reach = 1
    while reach <= 2 * largest and not far.isEmpty():
        arrived = far.alias("f").join(rooted.alias("r"), _same("f", "r", "up_msg", "msg"), "left_semi")
        more, more_path = written(rooted.union(arrived.select("conv", "msg")).distinct(), "rooted")
        left = far.alias("f").join(more.alias("r"), _same("f", "r", "msg", "msg"), "left_anti")
        # A pointer to a message that has arrived, and so has no pointer of its own, stays.
        farther = (
            left.alias("i")
            .join(left.alias("j"), _same("i", "j", "up_msg", "msg"), "left")
            .select("i.conv", "i.msg", F.coalesce("j.up_msg", "i.up_msg").alias("up_msg"))
        )
        old = rooted_path, far_path
        far, far_path = written(farther.distinct(), "far")
        rooted, rooted_path = more, more_path
        for path in old:
            remove(spark, path)
        reach *= 2
    return rooted


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, msg, up): the messages of every path; the leaf has ``up`` 0, its parent 1.

    ``messages`` has conv, msg and parent. Only messages that reach a root are followed, so a
    circle of replies costs no more than the messages it holds.
    """
    spark, same = messages.sparkSession, _same
    replies = messages.select("conv", "msg", F.col("parent").alias("up_msg"))
    known = messages.select("conv", "msg").distinct()
    jumps = (
        replies.alias("r")
        .join(known.alias("k"), same("r", "k", "up_msg", "msg"))
        .select("r.conv", "r.msg", "up_msg")
        .distinct()
    )
    jumps, all_path = written(jumps, "jumps")
    known = rooted_messages(known, jumps)
    for end in ("msg", "up_msg"):
        jumps = jumps.alias("j").join(known.alias("k"), same("j", "k", end, "msg"), "left_semi")
    jumps, jumps_path = written(jumps.select("conv", "msg", "up_msg"), "jumps")
    remove(spark, all_path)
    leaves = known.alias("k").join(jumps.alias("j"), same("k", "j", "msg", "up_msg"), "left_anti")
    paths, paths_path = written(
        leaves.select("conv", F.col("msg").alias("leaf"), "msg", F.lit(0).alias("up")), "paths"
    )
    roots = known.alias("k").join(jumps.alias("j"), same("k", "j", "msg", "msg"), "left_anti")
    roots, _ = written(roots, "roots")
    reach, limit = 1, 2 * known.count()
    while reach <= limit and not jumps.isEmpty():
        further = (
            paths.alias("p")
            .join(jumps.alias("j"), same("p", "j", "msg", "msg"))
            .select("p.conv", "leaf", F.col("up_msg").alias("msg"), F.col("up") + reach)
        )
        twice = (
            jumps.alias("i")
            .join(jumps.alias("j"), same("i", "j", "up_msg", "msg"))
            .select("i.conv", "i.msg", "j.up_msg")
        )
        old = paths_path, jumps_path
        paths, paths_path = written(paths.union(further), "paths")
        jumps, jumps_path = written(twice, "jumps")
        for path in old:
            remove(spark, path)
        reach *= 2
    if reach <= limit:
        return paths
    # Some replies go round in a circle: only paths that end at a root count.
    ended = paths.alias("p").join(roots.alias("r"), same("p", "r", "msg", "msg"), "left_semi")
    whole = ended.select("conv", "leaf")
    return paths.alias("p").join(whole.alias("w"), same("p", "w", "leaf", "leaf"), "left_semi")


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv, leaf, branch, formatted, loss): one row per chosen path.

    ``messages`` has conv, msg, parent, role, text and score. ``branches`` is the number of
    best branches to take from each conversation, all if None; ``branch`` counts them from 1.
    ``loss`` lists the (start, end) code points of the assistant texts in ``formatted``.
    """
    text = escaped(F.coalesce("text", F.lit("")))
    role = F.url_encode(F.coalesce("role", F.lit("")))
    parts = messages.select(
        F.col("conv").alias("c"),
        F.col("msg").alias("m"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learnt"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("head"),
        text.alias("body"),
    )
    paths = root_to_leaf_paths(messages)
    rows = paths.join(parts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m")))
    size = F.char_length("head") + F.char_length("body") + len(END)
    before = (
        Window.partitionBy("conv", "leaf")
        .orderBy(F.desc("up"), "head", "body")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    start = F.col("at") + F.char_length("head")
    spans = F.when(
        F.col("learnt"),
        F.struct(start.alias("start"), (start + F.char_length("body")).alias("end")),
    )
    turn = F.struct("at", F.concat("head", "body", F.lit(END)).alias("turn"))
    formatted = rows.groupBy("conv", "leaf").agg(
        F.avg("score").alias("score"),
        F.array_join(F.sort_array(F.collect_list(turn))["turn"], "").alias("formatted"),
        F.sort_array(F.collect_list(spans)).alias("loss"),
    )
    best = Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")
    ranked = formatted.withColumn("branch", F.row_number().over(best))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    return ranked.select("conv", "leaf", "branch", "formatted", "loss")


def turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    marked = F.split(formatted, r"<\|im_end\|>\n")
    marked = F.slice(marked, F.lit(1), F.size(marked) - 1)

    def read(turn: Column) -> Column:
        role = F.substring_index(turn, "\n", 1)
        text = F.substr(turn, F.char_length(role) + 2)
        plain = F.url_decode(F.substr(role, F.lit(len(START) + 1)))
        return F.struct(plain.alias("role"), unescaped(text).alias("text"))

    return F.transform(marked, read)


def loss_text(formatted: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return F.array_join(
        F.transform(
            loss,
            lambda s: unescaped(
                F.substr(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
            ),
        ),
        "",
    )


def as_threads(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages of plain conversations, each a reply to the turn before it.

    Turns are ordered by ``turn``, those without one first, and equal ones by role and text.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    named = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    numbered = named.withColumn("msg", F.row_number().over(order))
    parent = F.when(F.col("msg") > 1, F.col("msg") - 1)
    return numbered.select("conv", "msg", parent.alias("parent"), "role", "text").withColumn(
        "score", F.lit(0.0)
    )
