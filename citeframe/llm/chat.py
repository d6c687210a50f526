"""Chat formatting over reply trees, with DataFrame functions only.

Messages name their parent.  Iterative self-joins double the parent pointers (parent, grandparent, the 4th above,
...), and from the leaves these tables enumerate all root-to-leaf paths: each step joins what it has with a jump
half as long, so a path of n messages takes about log2(n) joins.  Branches of a conversation are ranked by score
and every chosen path is formatted as one conversation.

Template: `### role: text</turn>` and a line feed for each turn.  Inside role and text, backslash, < and # (and : in
a role) become \\b, \\l, \\h and \\c, so control strings can't occur there and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeframe.llm.common import settle

END = "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))  # the backslash first, and last on the way back


def escape(text: Column, role: bool = False) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, code in (*_ESCAPES, *[(":", "\\c")] * role):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(text: Column, role: bool = False) -> Column:
    for raw, code in reversed((*_ESCAPES, *[(":", "\\c")] * role)):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def paths(messages: DataFrame) -> DataFrame:
    """key, leaf, node, back (steps from the leaf) for every root-to-leaf path of messages (key, node, parent).

    A parent that doesn't exist counts as none.  Messages on a cycle have no root; a cycle is refused.
    """
    own = messages.select("key", "node")
    up = settle(messages.filter(F.col("parent").isNotNull()).select("key", "node", F.col("parent").alias("up")).join(own.withColumnRenamed("node", "up"), ["key", "up"], "left_semi").distinct())
    jumps = [up]
    longest = messages.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        last = jumps[-1]
        next_ = settle(last.withColumnRenamed("up", "mid").join(last.select("key", F.col("node").alias("mid"), "up"), ["key", "mid"]).select("key", "node", "up"))
        if next_.limit(1).count() == 0:
            break
        jumps.append(next_)
        if 2 ** (len(jumps) - 1) > longest:
            raise ValueError("replies form a cycle")
    found = own.join(up.select("key", F.col("up").alias("node")), ["key", "node"], "left_anti").distinct().select("key", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("back"))
    for k in range(len(jumps) - 1, -1, -1):
        found = found.unionByName(found.join(jumps[k], ["key", "node"]).select("key", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back")))
        if k:
            found = settle(found)
    return found


def messages_of(rows: DataFrame) -> DataFrame:
    """Each message once: rows (key, node, parent, score, role, text) without those that name no node.

    Rows that repeat a key and node count once, the smallest by parent, score, role and text (nulls first); a null key is a
    conversation of its own.
    """
    one = F.min(F.struct("parent", "score", "role", "text")).alias("m")
    return rows.filter(F.col("node").isNotNull()).withColumn("key", F.coalesce(F.col("key").cast("string"), F.lit("null"))).groupBy("key", "node").agg(one).select("key", "node", "m.*")


def format_paths(messages: DataFrame, *, branches: int | None = None, learn: str = "assistant", unique: bool = False) -> DataFrame:
    """key, leaf, rank, formatted, loss_spans for messages (key, node, parent, score, role, text), as messages_of reads them;
    `unique` says that they are so already.

    Branches rank by the sum of their scores (null: 0), ties by the smaller leaf; `branches` keeps the best only, before
    any text is joined.  loss_spans are the code points [start, end) of the texts of `learn`'s turns within the formatted
    string.  Null roles and texts are empty.  A conversation of any length is one value.
    """
    rows = settle(messages.select("key", "node", "parent", "score", "role", "text") if unique else messages_of(messages))
    found = settle(paths(rows.select("key", "node", "parent")))
    scored = found.join(rows.select("key", "node", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), ["key", "node"])
    leaves = scored.groupBy("key", "leaf").agg(F.sum("score").alias("score"))
    leaves = leaves.select("key", "leaf", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "leaf")).alias("rank"))
    chosen = found.join(leaves.filter(F.col("rank") <= branches), ["key", "leaf"]) if branches else found.join(leaves, ["key", "leaf"])
    role, text = escape(F.col("role"), role=True), escape(F.col("text"))
    way = chosen.join(rows.select("key", "node", "role", "text"), ["key", "node"])
    way = way.select("key", "leaf", "rank", "back", (F.col("role") == learn).alias("mine"), F.length(role).alias("r"), F.length(text).alias("t"), F.concat(F.lit("### "), role, F.lit(": "), text, F.lit(END)).alias("piece"))
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("key", "leaf").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    way = way.withColumn("start", before + 6 + F.col("r"))
    span = F.when(F.coalesce("mine", F.lit(False)), F.struct("start", (F.col("start") + F.col("t")).alias("end")))
    made = way.groupBy("key", "leaf").agg(F.first("rank").alias("rank"), F.sort_array(F.collect_list(F.struct(-F.col("back"), "piece"))).alias("p"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return made.select("key", "leaf", "rank", F.array_join("p.piece", "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and learned (the unescaped text under the loss mask), read from formatted and loss_spans alone."""
    chunks = F.split("formatted", END, -1)
    def turn(c: Column) -> Column:
        role = F.regexp_extract(c, r"^### ([^:]*): ", 1)
        return F.struct(unescape(role, role=True).alias("role"), unescape(c.substr(F.length(role) + 7, F.length(c))).alias("text"))
    turns = F.transform(F.slice(chunks, F.lit(1), F.size(chunks) - 1), turn)
    learned = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumn("turns", turns).withColumn("learned", learned)


def from_turns(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each turn answers the one before.

    Turns of equal number are ordered by role and text, so that none is lost; rows without conv_id are one conversation.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    node = F.row_number().over(Window.partitionBy("key").orderBy("turn", "role", "text"))
    rows = conversations.select(key.alias("key"), "conv_id", "turn", "role", "text").withColumn("node", node.cast("bigint"))
    return rows.select("key", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(None).cast("double").alias("score"), "role", "text")
