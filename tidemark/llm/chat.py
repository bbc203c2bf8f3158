r"""Chat formatting: reply trees to conversations (operator 1). DataFrame functions only.

Messages point to their parents. Self-joins with pointers that double their reach in every round
enumerate the root-to-leaf paths in a number of rounds logarithmic in the depth; branches are ranked by
the score of their messages and each chosen path is formatted as one conversation. All joins are on
(tree, message), so the enumeration of one tree with a third of all messages spreads over all tasks. A chosen path is one value of the
result: its turns meet in one task, where they are numbered and joined. conversations_as_trees() numbers the rows of a conversation, which is one such path.

Template: every turn is `### <role>:\n<text>\n</turn>\n`. In texts `\`, `###` and `</turn>` become `\b`, `\h`
and `\e`, in roles also `:` and line feeds `\c` and `\n`, so the template's marks never stand inside
a turn and read_chats() gets every role and text back. loss_spans are the texts of assistant turns, in code points of `formatted`.

Defined cases: null texts and roles are empty. A null tree is a tree of its own. Of repeated message ids in a tree one row counts
(the least role and text). A message whose parent is null or absent is a root. Messages on a cycle have no
root: paths that lead into one are left out. An empty table gives none. A text of any length is formatted whole. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import written

HEAD, MIDDLE, END = "### ", ":\n", "\n</turn>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, sign in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e")):
        text = F.replace(text, F.lit(plain), F.lit(sign))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Signs hold no backslash but their own, so the one for the backslash comes last."""
    for plain, sign in (("###", "\\h"), ("</turn>", "\\e"), ("\\", "\\b")):
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\c"), F.lit(":")), F.lit("\\n"), F.lit("\n")))


def choose_paths(nodes: DataFrame, branches: int) -> DataFrame:
    """tree, leaf, node, up: the messages on the best `branches` paths of each tree, up steps above the leaf.

    nodes: tree, node, parent, score; parent is null at roots.
    """
    jumps, done = [], []
    reach = written(nodes.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length")), "chat-reach")
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while True:
        # Messages whose pointer has passed the root are done; only the others go on.
        done.append(reach.where("up is null"))
        open_ = reach.where("up is not null")
        if not open_.limit(1).count() or (1 << len(jumps)) > 2 * most:
            break
        jumps.append(open_.select("tree", "node", "up"))
        everything = open_
        for d in done:
            everything = everything.unionByName(d)
        above = everything.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("further"), F.col("total").alias("more"), F.col("length").alias("longer"))
        step = open_.join(above, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")), "left")
        reach = written(
            step.select("tree", "node", F.col("further").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("length") + F.coalesce("longer", F.lit(0))).alias("length")),
            "chat-reach",
        )
    reached = done[0]
    for d in done[1:]:
        reached = reached.unionByName(d)
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = reached.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("length"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    path = chosen.select("tree", F.col("node").alias("leaf"), "rank", "length", "node", F.lit(0).cast("long").alias("up_steps"))
    # A path of n messages is whole after log2(n) rounds and then leaves the loop, so all rounds together write twice the result's rows.
    whole = []
    for k, jump in enumerate(jumps):
        far = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("above"))
        moved = path.join(far, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
        moved = moved.select("tree", "leaf", "rank", "length", F.col("above").alias("node"), (F.col("up_steps") + (1 << k)).alias("up_steps"))
        grown = written(path.unionByName(moved), "chat-paths")
        whole.append(grown.where(F.col("length") <= 2 << k))
        path = grown.where(F.col("length") > 2 << k)
    for w in whole:
        path = path.unionByName(w)
    return path.drop("length")


def format_chats(messages: DataFrame, tree_col: str = "tree_id", id_col: str = "message_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str | None = None, branches: int = 1) -> DataFrame:
    """tree_id, leaf_id, branch, n_turns, formatted, loss_spans: one row for each of the best `branches` paths of a tree."""
    name = lambda c: F.col(f"`{c}`")
    base = messages.select(
        F.coalesce(F.concat(F.lit("="), name(tree_col).cast("string")), F.lit("null")).alias("tree"),
        name(tree_col).alias("tree_id"),
        name(id_col).alias("node"),
        name(parent_col).alias("parent"),
        F.coalesce(name(role_col), F.lit("")).alias("role"),
        F.coalesce(name(text_col), F.lit("")).alias("text"),
        (F.coalesce(name(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)).alias("score"),
    )
    once = base.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score", "tree_id")).alias("m")).select("tree", "node", "m.*")
    once = written(once, "chat-messages")
    ids = once.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    parent = F.when(F.col("n").isNotNull(), F.col("parent"))
    nodes = once.select("tree", "node", "parent", "score").join(ids, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n")), "left").select("tree", "node", parent.alias("parent"), "score")
    path = choose_paths(nodes, branches)

    turns = path.join(once.select("tree", "node", "tree_id", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(MIDDLE))
    turns = turns.select("tree", "tree_id", "leaf", "rank", "up_steps", (F.col("role") == TRAINED_ROLE).alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("turn_text", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("up_steps"))
    before = F.coalesce(F.sum(F.char_length("turn_text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumns({"turn": F.row_number().over(order) - 1, "turn_start": before})
    item = F.struct("turn", "turn_text", "loss", "turn_start", F.char_length("head").alias("head_chars"), F.char_length("body").alias("body_chars"))
    whole = turns.groupBy("tree", "leaf").agg(F.first("tree_id").alias("tree_id"), F.first("rank").alias("branch"), F.sort_array(F.collect_list(item)).alias("items"))
    span = lambda x: F.struct(x["turn"].alias("turn"), x["turn_start"].alias("turn_start"), (x["turn_start"] + x["head_chars"]).alias("start"), x["body_chars"].alias("length"))
    return whole.select(
        "tree_id",
        F.col("leaf").alias("leaf_id"),
        "branch",
        F.size("items").cast("long").alias("n_turns"),
        F.array_join(F.transform("items", lambda x: x["turn_text"]), "").alias("formatted"),
        F.transform(F.filter("items", lambda x: x["loss"]), span).alias("loss_spans"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """chats with turns (role and text of each, read back from formatted) and loss_texts (the texts under the loss mask, unescaped)."""
    pieces = F.split("formatted", END)
    chats = chats.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    middle = lambda p: F.instr(p, MIDDLE)
    turn = lambda p: F.struct(
        unescape_role(F.substring(p, F.lit(len(HEAD) + 1), middle(p) - len(HEAD) - 1)).alias("role"), unescape(F.substring(p, middle(p) + len(MIDDLE), F.char_length(p))).alias("text")
    )
    masked = lambda s: unescape(F.substring(F.get("pieces", s["turn"]), (s["start"] - s["turn_start"] + 1).cast("int"), s["length"]))
    return chats.withColumns({"turns": F.transform("pieces", turn), "loss_texts": F.transform("loss_spans", masked)}).drop("pieces")


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as reply trees: each row replies to the one before it in the order of turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return conversations.select(F.col("conv_id").alias("tree_id"), "role", "text", n.alias("message_id")).withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))
