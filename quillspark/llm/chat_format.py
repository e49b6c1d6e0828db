r"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by parent. Iterative self-joins with doubling steps give each node its ancestor at distance 2 ** j
and the scores up to there, in logarithmically many rounds, so that each root-to-leaf path is enumerated by its leaf and
ranked by mean score; the nodes of the chosen paths alone are then listed by the same steps, and each chosen path becomes
one formatted text. A turn is

    ### ROLE: TEXT</turn>\n

and texts and roles are escaped reversibly: \ becomes \b, the < of </turn> becomes \l, the # of ### becomes \h, in
roles : becomes \c. Thus no control string is left inside a text, and each backslash starts an escape.

Defined results: null texts and roles count as empty; equal (turn, role, text) rows all count, in that order, a null
turn first; rows with a null conv_id are one conversation, whose conv_id is null; messages whose ancestors form a cycle
or miss a parent have no root and aren't formatted; an empty table gives no rows; extra columns are ignored. A
conversation is one output row, so its texts meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

LOSS_ROLE = "assistant"
HEAD, MID, END = "### ", ": ", "</turn>\n"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(out, F.lit("</turn>"), F.lit("\\l/turn>"))
    return F.regexp_replace(out, "#(?=##)", r"\\h")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def unescaped(text: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def lifted(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables j = 0, 1, ... of tree, node, above (the ancestor at distance 2 ** j) of the nodes that have one, and tree, node,
    total, length (scores and nodes from the node to its root). A node that has met its root isn't joined again.
    """
    state = ["tree", "node", "above", "total", "length"]
    up = [written(messages.select("tree", "node", F.col("parent").alias("above"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("length")))]
    size = up[0].groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    done = up[0].filter("above IS NULL")
    while 2 ** len(up) < 2 * size and not (one := up[-1].filter("above IS NOT NULL")).isEmpty():
        top = one.unionByName(done).select("tree", F.col("node").alias("above"), F.col("above").alias("top"), F.col("total").alias("more"), F.col("length").alias("longer"))
        # without an ancestor of that name, above stays: such a node never meets a root
        gone = F.col("longer").isNull()
        new = {"above": F.when(gone, F.col("above")).otherwise(F.col("top")), "total": F.col("total") + F.coalesce("more", F.lit(0.0)), "length": F.col("length") + F.coalesce("longer", F.lit(0))}
        up.append(written(one.join(top, ["tree", "above"], "left").select(*(new.get(c, F.col(c)).alias(c) for c in state))))
        done = done.unionByName(up[-1].filter("above IS NULL"))
    return up, done


def branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, branch (rank from 1), node, distance (from the leaf) of the paths of the best branches of each tree: by
    mean score, then length, then the smaller leaf."""
    up, whole = lifted(messages)
    parents = up[0].select("tree", F.col("above").alias("node")).distinct()
    leaves = whole.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("length")).alias("score"), "length")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("length"), "leaf")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= best)
    found = [written(chosen.select("tree", "leaf", "branch", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("distance"), "length"))]
    for j, table in enumerate(up):
        # found: the nodes nearer to the leaf than 2 ** j; those with an ancestor that far
        near = reduce(DataFrame.unionByName, found).filter(F.col("distance") + 2**j < F.col("length"))
        if near.isEmpty():
            break
        further = near.join(table.select("tree", "node", "above"), ["tree", "node"])
        found.append(written(further.select("tree", "leaf", "branch", F.col("above").alias("node"), (F.col("distance") + 2**j).alias("distance"), "length")))
    dropped(*up)
    return reduce(DataFrame.unionByName, found).drop("length")


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, branch, formatted, segments of each chosen path; segments (text, loss) cut formatted at the loss mask.

    messages: tree, node, parent (null at a root), role, text, score.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    segment = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    turn = F.array(segment(F.concat(F.lit(HEAD), escaped_role(role), F.lit(MID)), no), segment(escaped(text), role == LOSS_ROLE), segment(F.lit(END), no))
    placed = branches(messages, best).join(messages.select("tree", "node", turn.alias("turn")), ["tree", "node"])
    grouped = placed.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), "turn"))).alias("turns"))
    cut = grouped.select("tree", "branch", F.flatten(F.transform("turns", lambda t: t["turn"])).alias("segments"))
    return cut.select("tree", "branch", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Messages of conversations without branches: each row answers the one before it, by turn, role, text. tree is conv_id
    as text; `none` where that is null."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    rows = conversations.select(tree.alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    rows = written(rows.withColumn("node", node.cast("long")))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns, array of (role, text) parsed from the text, and loss_text, all text under the loss mask."""
    pieces = F.split("formatted", END, -1)

    def parse(piece: Column) -> Column:
        head = F.substring_index(piece, MID, 1)
        return F.struct(unescaped(F.substr(head, F.lit(len(HEAD) + 1))).alias("role"), unescaped(F.substr(piece, F.length(head) + len(MID) + 1)).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"])
    parsed = formatted.withColumn("pieces", F.filter(pieces, lambda p: p != ""))
    return parsed.withColumn("turns", F.transform("pieces", parse)).withColumn("loss_text", unescaped(F.array_join(loss, ""))).drop("pieces")


def digests(conversations: DataFrame) -> DataFrame:
    """Counts and digests of each conversation as read back from its formatted text."""
    back = read_back(format_trees(linear_trees(conversations)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.when(F.col("tree") != "none", F.col("tree")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same digests, counted from the rows.
ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (
  SELECT *, length(x) - length(replace(x, '\', '')) + (length(x) - length(replace(x, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(x, '#+'), lambda s: greatest(length(s) - 2, 0))), 0) AS more,
    length(role) - length(replace(role, ':', '')) AS colons
  FROM (SELECT *, role || text AS x FROM r))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(14 + length(role) + length(text) + more + colons) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""
