"""Chat formatting by quotation linking.

A line that begins with ``>`` marks is quoted; the number of marks is its level. Consecutive lines of one
level are a passage. A passage, its paragraphs and its lines are normalised (lower case, white space as one
space) and hashed, and so are every message's own words. A hash joins a passage to the first message of the
conversation that has it, if that one is earlier. The parent of a message is the target of its lowest level,
of the largest piece there, and of the latest message among equals. Chains of parents give each message its
thread (first ancestor) and depth, and messages are sorted so that a reply follows what it answers, thread
by thread, in the order of turns.

How it scales. Only messages with quotes are cut into lines, and only conversations that hold one are hashed.
Originals are aggregated to one row per hash before the join, so a line that all messages quote gives one
match each. Threads are found by doubling pointers, in rounds that grow with the logarithm of the longest chain.
The result is range-sorted by conversation, thread and turn: no conversation is collected or put into one
task.

Edge cases. Null texts count as empty and stay null when nothing is quoted; a null role is ``unknown`` in the
formatted text. A row without conversation or turn is its own thread. Rows that share both are one message for
linking and stay apart in the result. A quote without an original is removed like any other. Extra columns
are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import kept, register, table

_QUOTED = r"(?m)^[ \t]*>"
_MARKS = r"^((?:[ \t]*>)+)[ \t]?"
_LINE = r"(?m)^[ \t]*>[^\n]*(?:\n|\z)"
#: The line that announces a quote in the four languages at hand, only where a quote follows.
_ATTRIBUTION = r"(?m)^[^\n>]*(?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*\n(?=[ \t]*>)"
_BLANK = r"[ \t\n\x0B\f\r]+"
_WHITE = " \t\n\x0b\x0c\r"


def _normal(text):
    return F.btrim(F.regexp_replace(F.lower(text), _BLANK, " "), F.lit(_WHITE))


def _pieces(text):
    """Normalised whole (0), paragraphs (1) and lines (2) of a text with their kind."""
    def of(parts, kind):
        return F.transform(parts, lambda p: F.struct(F.lit(kind).alias("kind"), _normal(p).alias("piece")))
    found = F.concat(of(F.array(text), 0), of(F.split(text, r"\n[ \t]*\n"), 1), of(F.split(text, "\n"), 2))
    return F.array_distinct(F.filter(found, lambda x: x["piece"] != ""))


def _hash(piece):
    return [F.xxhash64(piece).alias("h1"), F.xxhash64(F.lit(1), piece).alias("h2")]


def without_quotes(text):
    """The text's own words: quoted lines and their announcements removed, blank ends trimmed."""
    own = F.btrim(F.regexp_replace(F.regexp_replace(text, _ATTRIBUTION, ""), _LINE, ""), F.lit(_WHITE))
    return F.when(text.rlike(_QUOTED), own).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage: runs of quoted lines of one level."""
    quoting = messages.where(F.col("text").rlike(_QUOTED)).select("conv_id", "turn", "text").distinct()  # a row given twice is one message
    lines = (quoting.select("conv_id", "turn", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
             .withColumn("marks", F.regexp_extract("line", _MARKS, 1))
             .withColumn("level", F.length(F.regexp_replace("marks", "[^>]", ""))))
    inside = Window.partitionBy("conv_id", "turn", "copy").orderBy("no")
    return (lines.withColumn("change", F.when(F.col("level") == F.lag("level").over(inside), 0).otherwise(1))
            .withColumn("run", F.sum("change").over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("level > 0")
            .groupBy("conv_id", "turn", "copy", "run", "level")  # the lines of one passage of one message
            .agg(F.array_sort(F.collect_list(F.struct("no", F.regexp_replace("line", _MARKS, "").alias("line")))).alias("lines"))
            .select("conv_id", "turn", "level", F.array_join("lines.line", "\n").alias("passage")))


def parents(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the message each message answers, where a quote tells."""
    named = messages.where("conv_id is not null and turn is not null")
    quoted = kept(passages(named).select("conv_id", "turn", "level", F.explode(_pieces(F.col("passage"))).alias("p"))
                  .select("conv_id", "turn", "level", "p.kind", *_hash(F.col("p.piece"))).distinct(), "quoted")
    first = (named.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
             .select("conv_id", "turn", F.explode(_pieces(without_quotes(F.col("text")))).alias("p"))
             .select("conv_id", "turn", *_hash(F.col("p.piece"))).groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("original")))
    return (quoted.join(first, ["conv_id", "h1", "h2"]).where("original < turn").groupBy("conv_id", "turn")
            .agg(F.min(F.struct("level", "kind", (-F.col("original")).alias("late"))).alias("best"))
            .select("conv_id", "turn", (-F.col("best.late")).alias("parent")))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent, thread, depth of every message that answers another."""
    state = kept(links.select("conv_id", "turn", "parent", F.col("parent").alias("thread"), F.lit(1).cast("bigint").alias("depth"),
                              F.lit(True).alias("moved")), "threads")
    while not state.where("moved").isEmpty():
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("top"), F.col("depth").alias("more"))
        state = kept(state.join(up, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", "parent", F.coalesce("top", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("top").isNotNull().alias("moved")), "threads")
    return state.drop("moved")


def conversations_by_reply(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, parent_turn, thread_turn, depth and the formatted message,
    sorted by conversation, thread and turn."""
    messages = messages.select("conv_id", "turn", "role", "text")
    links = threads(parents(messages))
    own = without_quotes(F.col("text"))
    done = messages.join(links, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", own.alias("text"), F.col("parent").alias("parent_turn"),
        F.coalesce("thread", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce(own, F.lit("")), F.lit("\n<|end|>")).alias("message"))
    return done.orderBy("conv_id", "thread_turn", "turn", "text")


@register("op3_chat_quotes")
def op3_chat_quotes(spark, sf_dir):
    return conversations_by_reply(table(spark, sf_dir, "conversations"))
