"""Chat formatting of reply trees, with DataFrame operations only.

Messages form trees through parent ids. ``root_paths`` finds every root-to-leaf path: self-joins double the reach of the
ancestor pointers until none is left, then double each leaf's known ancestors downwards, so depth d takes about 2*log2(d)
joins. ``rank_paths`` orders a tree's branches by their summed score; ``format_paths`` renders the chosen ones.

Template: ``<turn:ROLE>\\nTEXT</turn>\\n`` per turn. In role and text a backslash becomes ``\\e`` and ``<`` becomes ``\\l``, in a
role also ``>`` becomes ``\\g``, so that no control string can occur in them and both can be read back exactly. The loss mask is an array of spans
(start, end in code points of the formatted string) over the texts of the trained roles.

Null texts and roles count as empty. A message whose parent isn't in the table (or is null) is a root. Trees and nodes
with a null id are told apart from all others but form one tree, or are leaves with no children. Messages on a cycle have
no root and so give no path. Repeated (tree, node) rows must be told apart by the caller (``conversation_tree`` does, by
position). An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, require

OPEN, MIDDLE, CLOSE = "<turn:", ">\n", "</turn>\n"
TRAINED = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\e"), F.lit("\\"))


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: node_id is the place in the order of turn, parent_id the place before it."""
    rows = require(conversations, "conv_id", "turn", "role", "text")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    out = rows.select(F.col("conv_id").alias("tree_id"), place.alias("node_id"), "role", "text")
    return out.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(0.0))


def root_paths(tree: DataFrame) -> DataFrame:
    """(tree, leaf_id, node_id, up) for each message on the path of each leaf; up is 0 at the leaf, 1 at its parent.

    ``tree`` (see ``keyed``) is a key that is never null. Each level is written down before the next reads it twice.
    """
    t = tree.select("tree", "node_id", "parent_id")
    known = t.select("tree", F.col("node_id").alias("above")).distinct()
    real = durable(t.select("tree", "node_id", F.col("parent_id").alias("above")).join(known, ["tree", "above"], "left_semi"))
    leaves = t.join(real.select("tree", F.col("above").alias("node_id")), ["tree", "node_id"], "left_anti")
    # A path has at most as many messages as its tree; deeper jumps than that, or than the first empty one, aren't needed.
    largest = t.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, reach = [real], 1
    while 2 * reach < largest:
        again = jumps[-1].select("tree", F.col("node_id").alias("above"), F.col("above").alias("higher"))
        step = durable(jumps[-1].join(again, ["tree", "above"]).select("tree", "node_id", F.col("higher").alias("above")))
        if step.isEmpty():
            break
        jumps.append(step)
        reach *= 2
    paths = leaves.select("tree", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).alias("up"))
    for step in reversed(jumps):
        paths = durable(paths)
        higher = paths.join(step, ["tree", "node_id"]).select("tree", "leaf_id", F.col("above").alias("node_id"), (F.col("up") + reach).alias("up"))
        paths = paths.union(higher)
        reach //= 2
    return paths


def keyed(tree: DataFrame) -> DataFrame:
    """The tree's columns and ``tree``, its id as a text that tells null from all others."""
    key = F.when(F.col("tree_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("tree_id").cast("string")))
    return require(tree, "tree_id", "node_id", "parent_id", "score", "role", "text").withColumn("tree", key)


def rank_paths(tree: DataFrame, paths: DataFrame, most: int | None = 1) -> DataFrame:
    """Messages of the ``most`` best paths of every tree (None: all), with path_score and path_rank."""
    full = paths.join(tree.select("tree", "tree_id", "node_id", "role", "text", "score"), ["tree", "node_id"])
    full = full.withColumn("path_score", F.sum(F.coalesce("score", F.lit(0.0))).over(Window.partitionBy("tree", "leaf_id")))
    full = full.withColumn("path_rank", F.dense_rank().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf_id")))
    return full if most is None else full.filter(F.col("path_rank") <= most)


def format_paths(messages: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(tree_id, leaf_id, path_rank, path_score, formatted, loss_spans), one row per path."""
    turn = F.struct(F.col("up"), escape_role(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce(F.col("role").isin(*trained), F.lit(False)).alias("loss"))
    turns = F.reverse(F.array_sort(F.collect_list(turn)))
    out = messages.groupBy("tree", "leaf_id", "path_rank", "path_score").agg(F.first("tree_id").alias("tree_id"), turns.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")
    head = lambda t: F.char_length(t["role"]) + len(OPEN) + len(MIDDLE)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + head(t) + F.char_length(t["text"]) + len(CLOSE)).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + head(t)).alias("start"), (acc["at"] + head(t) + F.char_length(t["text"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return out.select("tree_id", "leaf_id", "path_rank", "path_score", formatted.alias("formatted"), spans.alias("loss_spans"))


def format_trees(tree: DataFrame, most: int | None = 1, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Every tree's ``most`` best-scored root-to-leaf paths as conversations."""
    tree = keyed(tree)
    return format_paths(rank_paths(tree, root_paths(tree), most), trained)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    body = lambda b: F.substring(b, len(OPEN) + 1, 2**31 - 1)
    return F.transform(blocks, lambda b: F.struct(unescape(F.substring_index(body(b), MIDDLE, 1)).alias("role"), unescape(F.substr(body(b), F.instr(body(b), F.lit(MIDDLE)) + len(MIDDLE))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
