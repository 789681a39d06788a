"""Chat formatting of reply trees.

Nodes are (tree, node, parent, role, text, score). Iterative self-joins double
the reach of each node's ancestor pointer; the tables of pointers give the
score of every root-to-leaf path (sum of its nodes' scores) and then list the
nodes of the chosen paths, each once, in as many rounds as the logarithm of the
deepest path. Leaves of a tree are ranked by score, longer paths first on ties,
then by node; the best ``branches`` become one conversation each.

The template is ``<s>`` and, for each turn, ``[INST]role[/INST]text</s>``. In
roles and texts a backslash goes after the first character of every control
string (also of one that has backslashes there already), so they cannot end a
turn, and taking one off gives the text back. The loss mask covers the texts of
``assistant`` turns as (start, length) in code points.

Null roles and texts are empty, null scores are zero, a null tree is a tree of
its own. A node whose parent is null or missing is a root; nodes that only
cycle have no leaf and give no path. Node ids are unique in a tree; repeated
ids would repeat turns, so ``from_turns`` numbers rows by turn, role and text.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import saved

BEGIN, OPEN, SHUT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"(<(?=\\*/?s>)|\[(?=\\*/?INST\]))"
ESCAPED = r"(<(?=\\+/?s>)|\[(?=\\+/?INST\]))\\"
LOSS_ROLE = "assistant"
MAX_LEVELS = 40  # 2^40 turns; only cycles would go on


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


def from_turns(rows: DataFrame) -> DataFrame:
    """Nodes of plain conversations (conv_id, turn, role, text): each turn replies to the one before."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    numbered = rows.select(F.col("conv_id").alias("tree"), place.cast("long").alias("node"), "role", "text")
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def best_paths(nodes: DataFrame, branches: int) -> DataFrame:
    """(tree, leaf, rank, node, up): the nodes of the chosen paths, ``up`` steps above the leaf."""
    tree = F.coalesce(F.col("tree").cast("string"), F.lit("null"))
    key = F.struct(tree.alias("t"), F.col("tree").isNull().alias("n"))
    links = saved(nodes.select(key.alias("k"), "tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    known = links.select("k", F.col("node").alias("parent"))
    child = links.join(known, ["k", "parent"], "left_semi").where("node <> parent")
    leaves = links.join(child.select("k", F.col("parent").alias("node")), ["k", "node"], "left_anti")

    # reach: what lies up to 2^level nodes from each node; above: the pointer beyond them
    level = child.select("k", "node", F.col("parent").alias("above"))
    levels = [saved(level)]
    sums = links.join(levels[0], ["k", "node"], "left").select("k", "node", "above", "score", F.lit(1).cast("long").alias("length"))
    sums = saved(sums)
    while not levels[-1].isEmpty() and len(levels) < MAX_LEVELS:
        far = sums.select("k", F.col("node").alias("above"), F.col("above").alias("next"), F.col("score").alias("more"), F.col("length").alias("steps"))
        moved = sums.where("above IS NOT NULL").join(far, ["k", "above"], "left")
        moved = moved.select("k", "node", F.col("next").alias("above"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), (F.col("length") + F.coalesce("steps", F.lit(0))).alias("length"))
        sums = saved(sums.where("above IS NULL").select("k", "node", "above", "score", "length").unionByName(moved))  # paths that reached the root rest
        levels.append(saved(sums.where("above IS NOT NULL").select("k", "node", "above")))
    totals = sums.where("above IS NULL").select("k", "node", "score", "length")  # cycles never end
    order = Window.partitionBy("k").orderBy(F.desc("total"), F.desc("length"), "node")
    chosen = leaves.select("k", "tree", "node").join(totals.withColumnRenamed("score", "total"), ["k", "node"])
    chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    paths = saved(chosen.select("k", "tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("up")))
    for i in range(len(levels) - 1, -1, -1):
        step = paths.join(levels[i], ["k", "node"]).select("k", "tree", "leaf", "rank", F.col("above").alias("node"), (F.col("up") + (1 << i)).alias("up"))
        paths = saved(paths.unionByName(step)) if i % 4 == 0 else paths.unionByName(step)
    return paths


def conversations(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans) of the chosen paths."""
    paths = best_paths(nodes, branches)
    tree = F.coalesce(F.col("tree").cast("string"), F.lit("null"))
    body = nodes.select(F.struct(tree.alias("t"), F.col("tree").isNull().alias("n")).alias("k"), "node", escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"))
    turns = paths.join(body, ["k", "node"]).groupBy("k", "leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SHUT), t["text"], F.lit(END)))
    head = len(OPEN) + len(SHUT)
    start = F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        own = F.length(t["text"]).cast("long")
        before = state["at"] + head + F.length(t["role"])
        span = F.struct(before.alias("start"), own.alias("length"))
        return F.struct((before + own + len(END)).cast("long").alias("at"), F.when(t["role"] == LOSS_ROLE, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return turns.select(
        "tree", "leaf", "rank",
        F.concat(F.lit(BEGIN), F.array_join(written, "")).alias("formatted"),
        F.aggregate("turns", start, add, lambda s: s["spans"]).alias("loss_spans"),
    )


def parsed(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, escapes taken off."""
    units = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), END, -1)
    turns = F.slice(units, 1, F.size(units) - 1)
    head = len(OPEN)

    def turn(unit: Column) -> Column:
        cut = F.instr(unit, SHUT)
        return F.struct(unescaped(F.substring(unit, F.lit(head + 1), cut - F.lit(head + 1))).alias("role"), unescaped(F.substring(unit, cut + len(SHUT), F.lit(2**31 - 1))).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, escapes taken off."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
