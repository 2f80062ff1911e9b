"""Chat formatting by quotation linking.

Lines that begin with ``>`` are quotes; the number of marks is the nesting level, and consecutive lines of
one level are a passage, which a blank quoted line ends.  Passages are normalised (marks off, lower case, white
space collapsed, line breaks included), so a re-wrapped quote equals its original.  A passage of any length links to
a message whose unquoted text has its words in a row, all of its message or any part.  To find it, runs of words are
hashed: a passage asks for one of its runs (the one with the smallest hash, of 8 words if it has as many, else of 4, or
all of it), messages answer with the runs that somebody asks for, and what meets is confirmed on the texts.

The origin is the earliest such message of the same conversation before the quoting one, else the earliest (by
conversation and turn) of another conversation.  The message that a first-level quote comes from
is the parent; of several the latest turn.  Conversations are then ordered by reply: threads by
their root's turn, within a thread by depth and turn, with all quoted lines taken out.

Cases: null texts are empty messages; a message whose quotes are found nowhere, or that has none, begins a
thread; rows with a null conv_id or turn are kept as threads of their own; quotes of quotes count for
links but not for the parent; repeated rows are kept each.  An empty table gives an empty result.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import bound
from .common import drop_staged, staged

#: Lengths of the runs of words that are hashed; a passage asks with the longest that fits it.
RUNS = (8, 4, 3, 2, 1)


def _marks(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:[ \t]*>)+)", 1), r"[ \t]", ""))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?:[ \t]*>)+", "")


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, place, level, norm``: passages in order, level 0 being unquoted text."""
    lines = F.split(F.translate(F.coalesce("text", F.lit("")), "\x01\x02", "  "), "\n")
    marked = F.transform(lines, lambda x: F.struct(_marks(x).alias("level"), F.trim(F.regexp_replace(_bare(x), r"\s+", " ")).alias("words")))

    def glued(rows: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last = F.element_at(rows, F.greatest(i, F.lit(1)))
            goes_on = (i > 0) & (last["level"] == x["level"]) & ((x["level"] == 0) | (last["words"] != "") & (x["words"] != ""))
            return F.when(goes_on, F.concat(F.lit(" "), x["words"])).otherwise(F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"), x["words"]))

        return F.split(F.array_join(F.transform(rows, one), ""), "\x01")

    cut = messages.select("conv_id", "turn", F.posexplode(bound(marked, glued)).alias("place", "piece")).where("piece <> ''")
    half = F.split("piece", "\x02")
    norm = F.lower(F.trim(F.regexp_replace(half[1], " +", " ")))
    return cut.select("conv_id", "turn", "place", half[0].cast("int").alias("level"), norm.alias("norm")).where("norm <> ''")


def _hashes(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(words, i, n), " ")))


def _asking(norm: Column) -> Column:
    """The hash that a passage asks with."""
    def smallest(words: Column) -> Column:
        best = F.lit(None).cast("long")
        for n in reversed(RUNS):
            best = F.when(F.size(words) >= n, F.array_min(_hashes(words, n))).otherwise(best)
        return best

    return bound(F.split(norm, " "), smallest)


def links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, from_conv, from_turn``: one row for each quoting message, level and origin."""
    parts = passages(messages).where("conv_id is not null and turn is not null")
    quotes = staged(parts.where("level > 0").select("conv_id", "turn", "level", "norm").distinct().withColumn("h", _asking(F.col("norm"))), "quotes")
    asked = staged(quotes.select("h").distinct(), "asked")  # its size is known when the join is planned
    plain = parts.where("level = 0").select("conv_id", "turn", "place", "norm")
    answers = F.array_distinct(bound(F.split("norm", " "), lambda w: F.concat(*(_hashes(w, n) for n in RUNS))))
    hits = staged(plain.select("conv_id", "turn", "place", F.explode(answers).alias("h")).join(asked, "h", "left_semi").distinct(), "hits")

    def confirmed(wanted: DataFrame, on: list[str]) -> DataFrame:
        """``conv_id, turn, norm`` of messages that hold a wanted passage."""
        met = wanted.withColumnRenamed("norm", "quote").join(hits, on)
        return met.join(plain, ["conv_id", "turn", "place"]).where(F.concat(F.lit(" "), "norm", F.lit(" ")).contains(F.concat(F.lit(" "), "quote", F.lit(" ")))).select("conv_id", "turn", F.col("quote").alias("norm"))

    # one row for each passage and conversation: quoting a hot passage often doesn't multiply what it meets
    near = confirmed(quotes.select("conv_id", "norm", "h").distinct(), ["conv_id", "h"]).groupBy("conv_id", "norm").agg(F.min("turn").alias("t"))
    known = staged(quotes.join(near, ["conv_id", "norm"], "left").withColumn("t", F.when(F.col("t") < F.col("turn"), F.col("t"))), "known")
    found = known.where("t is not null").select("conv_id", "turn", "level", F.col("conv_id").alias("from_conv"), F.col("t").alias("from_turn"))
    lost = known.where("t is null")
    origin = staged(confirmed(lost.select("norm", "h").distinct(), ["h"]).groupBy("norm", "conv_id").agg(F.min("turn").alias("t")), "origins")
    first = origin.groupBy("norm").agg(F.min(F.struct("conv_id", "t")).alias("first"))
    second = origin.join(first, "norm").where(F.col("conv_id") != F.col("first.conv_id")).groupBy("norm").agg(F.min(F.struct("conv_id", "t")).alias("second"))
    far = lost.join(first.join(second, "norm", "left"), "norm").withColumn("o", F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))).where("o is not null")
    return found.union(far.select("conv_id", "turn", "level", "o.conv_id", "o.t")).distinct()


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """Messages without quotes: ``conv_id, turn, role, text, parent_turn, thread, depth, n_quoted, n_linked``.

    Sort by (conv_id, thread, depth, turn) to read a conversation in reply order.
    """
    messages = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    linked = staged(links(messages), "links")
    per = linked.groupBy("conv_id", "turn").agg(F.max(F.when((F.col("level") == 1) & (F.col("from_conv") == F.col("conv_id")), F.col("from_turn"))).alias("parent"), F.count("*").alias("n_linked"))
    per = staged(per, "parents")
    # root and depth by pointer jumping over messages that have a parent; others are roots
    reach = staged(per.where("parent is not null").select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")), "reach")
    while reach.limit(1).count():
        step = reach.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        after = staged(reach.join(step, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")), "reach")
        moved = after.where("moved").limit(1).count()
        drop_staged(reach)
        reach = after.select("conv_id", "turn", "up", "depth")
        if not moved:
            break
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    plain = F.filter(lines, lambda x: _marks(x) == 0)
    base = messages.select("conv_id", "turn", "role", F.trim(F.array_join(plain, "\n")).alias("text"), (F.size(lines) - F.size(plain)).cast("long").alias("n_quoted"))
    out = base.join(per, ["conv_id", "turn"], "left").join(reach, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", F.col("parent").alias("parent_turn"), F.coalesce("up", "turn").alias("thread"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "n_quoted", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"))
