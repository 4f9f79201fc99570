"""Conversations from reply trees: paths by self-joins, ranked by score, written in one template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedalytics.llm.common import materialize

# <turn:ROLE> line end TEXT </turn> line end; "<" stands in markers only
OPEN, CLOSE = "<turn:", "</turn>\n"


def escape(text: Column) -> Column:
    """Backslashes doubled, "<" as ``\\l`` and ">" as ``\\g``: no marker can arise inside a text."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    # pairs are read from the left, so doubled backslashes are taken out before the other two
    parts = F.split(F.replace(text, F.lit("\\\\"), F.lit("<")), F.lit("<"), -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(plain, "\\")


def _same(left: DataFrame, right: DataFrame, *keys: tuple[str, str]) -> Column:
    cond = F.lit(True)
    for a, b in keys:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def paths(nodes: DataFrame) -> DataFrame:
    """Every root-to-leaf path of ``nodes`` (tree, node, parent): rows ``tree, leaf, node, up``.

    ``up`` counts the steps from the leaf.  Jump tables hold each node's
    ancestor 1, 2, 4 ... steps up, each table a self-join of the one before.
    From the leaves, the tables are joined from the longest jump to the
    shortest; a path of any length is complete after log2 of it joins.  A
    parent that is no node of its tree makes a root.  Nodes that reach no
    root (cycles) are on no path.
    """
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    linked = nodes.filter(F.col("parent").isNotNull()).select("tree", "node", "parent")
    jump = materialize(linked.join(known, _same(linked, known, ("tree", "t"), ("parent", "n")), "left_semi")
                       .select("tree", "node", F.col("parent").alias("ancestor")), "jumps")
    parents = jump.select(F.col("tree").alias("t"), F.col("ancestor").alias("n")).distinct()
    leaves = nodes.select("tree", "node").join(parents, _same(nodes, parents, ("tree", "t"), ("node", "n")), "left_anti")
    children = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    roots = nodes.select("tree", "node").join(children, _same(nodes, children, ("tree", "t"), ("node", "n")), "left_anti")
    largest = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    jumps, reach = [jump], 1
    while 2 * reach < largest:
        upper = jumps[-1].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("ancestor").alias("far"))
        twice = materialize(jumps[-1].join(upper, _same(jumps[-1], upper, ("tree", "t"), ("ancestor", "n")))
                            .select("tree", "node", F.col("far").alias("ancestor")), "jumps")
        if twice.isEmpty():
            break
        jumps.append(twice)
        reach *= 2
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        far = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "ancestor")
        more = found.join(far, _same(found, far, ("tree", "t"), ("node", "n"))).select(
            "tree", "leaf", F.col("ancestor").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = materialize(found.unionByName(more), "paths")
    ends = roots.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    whole = found.join(ends, _same(found, ends, ("tree", "t"), ("node", "n")), "left_semi") \
        .select(F.col("tree").alias("t"), F.col("leaf").alias("l"))
    return found.join(whole, _same(found, whole, ("tree", "t"), ("leaf", "l")), "left_semi")


def format_trees(df: DataFrame, tree_col: str = "conv_id", node_col: str = "node", parent_col: str = "parent",
                 role_col: str = "role", text_col: str = "text", score_col: str = "score", branches: int = 1,
                 learn_role: str = "assistant") -> DataFrame:
    """The best ``branches`` root-to-leaf paths of every reply tree, each written as one conversation.

    A path's score is the sum of its nodes' scores (null: 0); ties go to the
    smaller leaf.  Returns ``tree, leaf, branch`` (1: best), ``formatted`` and
    ``loss``: start and length, in code points of ``formatted``, of the
    escaped texts of ``learn_role``.  A null text or role is empty; a null
    tree id is a tree of its own; an empty table gives an empty result.  A
    node id belongs to one row: of several rows that repeat it in a tree, the
    least role and text count.
    """
    rows = df.select(F.col(tree_col).alias("tree"), F.col(node_col).alias("node"), F.col(parent_col).alias("parent"),
                     F.col(role_col).alias("role"), F.col(text_col).alias("text"),
                     F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)).alias("score")) \
        .filter(F.col("node").isNotNull())
    keep = F.row_number().over(Window.partitionBy("tree", "node").orderBy("role", "text", "parent", "score"))
    rows = materialize(rows.withColumn("k", keep).filter("k = 1").drop("k"), "nodes")
    steps = paths(rows.select("tree", "node", "parent"))
    right = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text", "score")
    told = steps.join(right, _same(steps, right, ("tree", "t"), ("node", "n")))
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")
    ranked = told.groupBy("tree", "leaf").agg(F.sum("score").alias("total")) \
        .withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches) \
        .select(F.col("tree").alias("t2"), F.col("leaf").alias("l2"), "branch")
    told = told.join(ranked, _same(told, ranked, ("tree", "t2"), ("leaf", "l2")))
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(">\n"))
    told = told.withColumn("head", head).withColumn("body", body) \
        .withColumn("size", F.char_length("head") + F.char_length("body") + len(CLOSE))
    before = Window.partitionBy("tree", "leaf", "branch").orderBy(F.desc("up")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    span = F.struct((F.col("at") + F.char_length("head")).cast("long").alias("start"),
                    F.char_length("body").cast("long").alias("length"))
    done = told.groupBy("tree", "leaf", "branch").agg(
        F.array_sort(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("s")))).alias("parts"),
        F.array_sort(F.collect_list(F.when(F.col("role") == learn_role, span))).alias("loss"))
    return done.select("tree", "leaf", "branch",
                       F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"), "loss")


def linear_trees(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """Conversations as reply trees: each row answers the one before it (by turn, then role and text)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                     F.col(text_col).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                       F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Roles and texts of each formatted conversation, and its text under the loss mask, unescaped."""
    chunks = F.slice(F.split("formatted", OPEN, -1), 2, 1 << 30)
    turns = F.transform(chunks, lambda c: F.struct(
        unescape(F.substring_index(c, ">", 1)).alias("role"),
        unescape(F.substring_index(F.substring(c, F.char_length(F.substring_index(c, ">", 1)) + 3, 1 << 30), CLOSE, 1))
        .alias("text")))
    learned = F.transform("loss", lambda s: unescape(
        F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("*", turns.alias("turns"), F.array_join(learned, "").alias("learned"))
