"""Chat formatting of reply trees, in DataFrame functions alone.

Messages (tree, message, parent, role, text, score) form trees. Self-joins that double their reach find for every message
its root, its depth and the sum of scores above it; leaves rank the branches of their tree by mean score; further
doubling self-joins list the messages of the chosen branches, and each branch becomes one conversation in a template.

The template is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed for each turn. In roles and
texts a backslash becomes two, ``<|`` becomes ``<\\|`` and, in roles, a line feed becomes ``<\\n>``: no control string
can come from a text, and ``unescaped`` gives every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import stored

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("<\\n>")) if role else out


def unescaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("<\\n>"), F.lit("\n")) if role else text
    return F.replace(F.replace(out, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _climbed(links: DataFrame) -> DataFrame:
    """(tree, message, root, depth, total): each message's root, its distance and the sum of scores from it to the root.

    Round k joins every message to the one 2**k above, so a tree of depth d takes log2(d) rounds.
    """
    at = stored(links.select("tree", "message", F.col("parent").alias("up"), F.col("score").alias("total"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while at.where("up IS NOT NULL").limit(1).count():
        above = at.select("tree", F.col("message").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("further"))
        # Messages that have reached their root take part in no further join.
        climbed = at.where("up IS NOT NULL").join(above, ["tree", "up"]).select(
            "tree", "message", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"),
            (F.col("depth") + F.col("further")).alias("depth"),
        )
        at = stored(at.where("up IS NULL").select(*climbed.columns).union(climbed))
    return at.select("tree", "message", "depth", "total")


def _jumps(links: DataFrame) -> list[DataFrame]:
    """(tree, message, up) to the message 2**k above, for k = 0, 1, ... as long as there is one."""
    out = []
    at = stored(links.select("tree", "message", F.col("parent").alias("up")).where("up IS NOT NULL"))
    while at.limit(1).count():
        out.append(at)
        at = stored(at.join(at.select("tree", F.col("message").alias("up"), F.col("up").alias("next")), ["tree", "up"]).select("tree", "message", F.col("next").alias("up")))
    return out


def branches(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, place, rank, message): the messages of the ``best`` branches of each tree (None: of all).

    A branch is the path from a root to a leaf. Branches rank by the mean score of their messages (null: 0), then by
    length, longer first, then by the leaf's key. A parent that is null or not in its tree makes a root.
    """
    known = messages.select("tree", F.col("message").alias("parent"), F.lit(True).alias("_known"))
    links = messages.select("tree", "message", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    links = links.join(known, ["tree", "parent"], "left").withColumn("parent", F.when(F.col("_known"), F.col("parent")))
    links = stored(links.select("tree", "message", "parent", "score"))
    parents = links.where("parent IS NOT NULL").select("tree", F.col("parent").alias("message")).distinct()
    leaves = _climbed(links).join(parents, ["tree", "message"], "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), F.col("depth").desc(), "message")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    chosen = stored((ranked if best is None else ranked.where(F.col("rank") <= best)).select("tree", F.col("message").alias("leaf"), "rank", "depth"))
    on = chosen.select("tree", "leaf", "rank", F.col("leaf").alias("message"), F.col("depth").alias("place"))
    for k, jump in enumerate(_jumps(links)):
        further = on.join(jump, ["tree", "message"]).select("tree", "leaf", "rank", F.col("up").alias("message"), (F.col("place") - (1 << k)).alias("place"))
        on = stored(on.union(further))
    return on


def formatted(messages: DataFrame, best: int | None = 1, learned: str = LEARNED) -> DataFrame:
    """One row for each chosen branch: tree, leaf, rank, n_turns, formatted string, loss array<struct<start, end>>.

    ``messages``: tree, message (unique in its tree, no null), parent, role, text, score. ``loss`` holds the code point
    spans of the escaped texts of role ``learned``, in order. Null roles and texts count as empty. An empty table gives
    no rows. Messages whose parents form a circle have no root and must not occur.
    """
    turns = branches(messages, best).join(messages.select("tree", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "message"])
    head = F.concat(F.lit(START), escaped(F.col("role"), role=True), F.lit("\n"))
    turns = turns.select(
        "tree", "leaf", "rank",
        F.struct("place", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == learned).alias("learned")).alias("turn"),
    )
    held = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    tail = END + "\n"
    lengths = F.transform("turns", lambda t: F.struct((F.char_length(t["head"])).alias("head"), F.char_length(t["body"]).alias("body"), t["learned"].alias("learned")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        begin = done["at"] + t["head"]
        span = F.array(F.struct(begin.alias("start"), (begin + t["body"]).alias("end")))
        return F.struct((begin + t["body"] + len(tail)).alias("at"), F.when(t["learned"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return held.select(
        "tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate(lengths, start, step, lambda done: done["spans"]).alias("loss"),
    )


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped."""
    parts = F.slice(F.split(text, F.lit("<\\|im_start\\|>")), F.lit(2), F.greatest(F.size(F.split(text, F.lit("<\\|im_start\\|>"))) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        cut = F.instr(part, "\n")
        role = F.substring(part, F.lit(1), cut - 1)
        body = F.substring(part, cut + 1, F.char_length(part) - cut - len(END) - 1)
        return F.struct(unescaped(role, role=True).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def learned_text(text: Column, loss: Column) -> Column:
    """The text under a loss mask, unescaped, with nothing between its spans."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")


def conversation_trees(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each turn answers the one before.

    Turns stand in the order of ``turn`` (null first), then role and text, so ties and repeated rows have a fixed place.
    A null conv_id is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("message"))
    return numbered.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "message",
        F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"), "conv_id",
    )
