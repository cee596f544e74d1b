"""Chat formatting by quotation linking.

Lines that begin with ``>`` quote, one level for each mark. A quoted passage (lines of one level in
a row), its paragraphs and each of its lines are normalised and hashed, and so are every message's own lines and paragraphs
and its own text as a whole; a paragraph ends at a blank line or where the level changes, however its lines are wrapped. A quoted hash is linked to the latest earlier message of the conversation whose own text has it. A message
replies to the message that most of the words of its first-level quotes are linked to. Conversations are ordered by
replies: a message stands after the message it replies to and after that one's earlier replies; one that quotes nothing
known starts a thread, in turn order. Texts are returned without quotes.

Only DataFrame functions are used. A conversation is never one row nor one task: positions are running counts over ranges
of rows, and the reply tree is walked by pointer doubling on rows of a few numbers. A line is linked by a window
over its conversation's equal lines, so a common line makes no pairs. The work on one message grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.llm.common import forget, materialise, materialise_at

MARKS = r"^[ \t]*((?:>[ \t]?)++)"
# How mail programs in four languages introduce a quotation.
ATTRIBUTION = r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
BEGIN, END = "\x01", "\x02"  # around the level of a paragraph
MAX_ROUNDS = 40


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower-cased, with every run of white space as one blank and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _parsed(line: Column) -> Column:
    return F.struct(quote_level(line).alias("level"), F.regexp_replace(line, MARKS, "").alias("body"))


def _line(level: Column, body: Column) -> Column:
    return F.struct(level.alias("level"), F.translate(body, BEGIN + END, "  ").alias("body"))


def _quoted_lines(lines: Column) -> Column:
    """The lines with level -1 for those that quote nothing."""
    return F.transform(lines, lambda line: _line(F.when(line["level"] > 0, line["level"]).otherwise(F.lit(-1)), line["body"]))


def _marked(lines: Column) -> Column:
    """The lines with level -1 for those that end a paragraph and are part of none."""

    def mark(line: Column, i: Column) -> Column:
        introduces = line["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > line["level"])
        return _line(F.when(~line["body"].rlike(r"\S") | introduces, F.lit(-1)).otherwise(line["level"]), line["body"])

    return F.transform(lines, mark)


def _runs(marked: Column) -> Column:
    """The runs of lines of one level, their lines joined by blanks, as (level, body); lines of level -1 are left out."""

    def spell(line: Column, i: Column) -> Column:
        same = F.get(marked, i - 1)["level"] == line["level"]
        opened = F.concat(F.lit(BEGIN), line["level"].cast("string"), F.lit(END))
        body = F.when(line["level"] < 0, F.lit("")).otherwise(line["body"])
        return F.concat(F.when(same, F.lit(" ")).otherwise(opened), body)

    pieces = F.split(F.array_join(F.transform(marked, spell), ""), BEGIN)
    parsed = lambda x: F.struct(F.substring_index(x, END, 1).try_cast("int").alias("level"), F.substring_index(x, END, -1).alias("body"))
    return F.filter(F.transform(pieces, parsed), lambda x: x["level"] >= 0)


def _own_text(lines: Column) -> Column:
    """The lines of level 0, without those that only introduce a quotation."""
    kept = F.filter(
        lines,
        lambda line, i: (line["level"] == 0)
        & ~(line["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)),
    )
    return F.array_join(F.transform(kept, lambda line: line["body"]), "\n")


def _hashed_units(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, words, h1, h2) of the distinct lines, paragraphs, passages and own text of every message."""
    quotes = F.col("n_quotes") > 0
    messages = messages.withColumn("marked", _marked(F.col("lines"))).withColumn("quoting", F.when(quotes, _quoted_lines(F.col("lines"))))
    passages = F.coalesce(_runs(F.col("quoting")), F.slice("lines", 1, 0))
    messages = messages.withColumn("paragraphs", _runs(F.col("marked"))).withColumn("passages", passages)
    quoted = F.filter(F.concat("lines", "passages", "paragraphs"), lambda line: line["level"] > 0)
    own_paragraphs = F.transform(F.filter("paragraphs", lambda x: x["level"] == 0), lambda x: x["body"])
    mine = F.concat(F.split("own", "\n"), F.array("own"), own_paragraphs)
    # units are strings until they are distinct, since distinct structs are compared one by one
    unit = lambda level, body: F.concat(level.cast("string"), F.lit(END), normalised(F.translate(body, BEGIN + END, "  ")))
    units = F.concat(F.transform(quoted, lambda q: unit(q["level"], q["body"])), F.transform(mine, lambda body: unit(F.lit(0), body)))
    rows = messages.select("conv", "turn", F.explode(F.array_distinct(units)).alias("u"))
    rows = rows.select("conv", "turn", F.substring_index("u", END, 1).cast("int").alias("level"), F.substr("u", F.instr("u", END) + 1).alias("body"))
    return rows.where("body != ''").select(
        "conv",
        "turn",
        "level",
        F.size(F.split("body", " ")).alias("words"),
        F.xxhash64("body").alias("h1"),
        F.xxhash64(F.lit(1), F.col("body")).alias("h2"),
    )


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, words, source) of every quoted passage, paragraph and line of messages (conv, turn, lines, own, n_quotes)."""
    hashed = _hashed_units(messages)
    # only what is quoted somewhere needs its place; the rest never meets a quote
    asked = _hashed_units(messages.where("n_quotes > 0")).where("level > 0").select("conv", "h1", "h2").distinct()
    matched = hashed.alias("m").join(asked.alias("a"), F.col("m.conv").eqNullSafe(F.col("a.conv")) & (F.col("m.h1") == F.col("a.h1")) & (F.col("m.h2") == F.col("a.h2")), "left_semi")
    earlier = W.partitionBy("conv", "h1", "h2").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    source = F.max(F.when(F.col("level") == 0, F.col("turn"))).over(earlier)
    return matched.withColumn("source", source).where(F.col("level") > 0).select("conv", "turn", "level", "words", "source")


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: Column, label: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the same group that come earlier in ``order``.

    Rows are dealt by ranges of group and order, so a group of any size is spread over many tasks. Of the groups of a range
    only the first can have rows in an earlier one: what they bring along is at most a row per range, which is broadcast.
    """
    ranged = df.withColumn("__value", value).repartitionByRange(*groups, *order).withColumn("__range", F.spark_partition_id())
    ranged = materialise(ranged, label)
    sums = ranged.groupBy("__range", *groups).agg(F.sum("__value").alias("__total"))
    carried = F.sum("__total").over(W.partitionBy(*groups).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    brought = sums.select(
        F.col("__range").alias("__at"), *(F.col(name).alias(f"__{name}") for name in groups), carried.alias("__carried")
    ).where("__carried IS NOT NULL")
    same = F.col("__range") == F.col("__at")
    for name in groups:
        same = same & F.col(name).eqNullSafe(F.col(f"__{name}"))
    inside = F.sum("__value").over(W.partitionBy("__range", *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    summed = ranged.withColumn("__inside", inside).join(F.broadcast(brought), same, "left")
    before = F.coalesce("__inside", F.lit(0)) + F.coalesce("__carried", F.lit(0))
    return summed.select(*df.columns, before.alias("before"))


def _doubled(nodes: DataFrame, step, label: str) -> DataFrame:
    """``nodes`` (conv, turn, jump, ...) after ``step(nodes, above)`` until no node has a ``jump``.

    ``above`` has the node that each one jumps to under names that end in ``_``; jumps double in every round.
    """
    spark = nodes.sparkSession
    now, where = materialise_at(nodes, label)
    for _ in range(MAX_ROUNDS):
        if now.where("jump IS NOT NULL").isEmpty():
            return now
        above = now.select(*(F.col(name).alias(name + "_") for name in now.columns))
        joined = now.join(above, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("jump") == F.col("turn_")), "left")
        after, after_where = materialise_at(step(now, joined), label)
        forget(spark, where)
        now, where = after, after_where
    raise RuntimeError(f"replies did not end in {MAX_ROUNDS} rounds")


def reply_tree(links: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, thread, depth, rank) of every message that replies or is replied to.

    ``rank`` counts from 0 in a thread: a message, its first reply, that one's replies and so on.
    """
    votes = links.where("level = 1 AND source IS NOT NULL").groupBy("conv", "turn", "source").agg(F.sum("words").alias("votes"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct("votes", "source")).alias("best"))
    replies = materialise(best.select("conv", "turn", F.col("best.source").alias("parent")), "replies")
    sources = replies.select("conv", F.col("parent").alias("turn")).distinct()
    known = replies.select(F.col("conv").alias("conv_"), F.col("turn").alias("turn_"))
    firsts = sources.join(known, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("turn") == F.col("turn_")), "left_anti")
    nodes = replies.unionByName(firsts.withColumn("parent", F.lit(None).cast("long")))

    def measure(now: DataFrame, joined: DataFrame) -> DataFrame:
        # those a jump below bring the size of their nearer part
        below = now.where("jump IS NOT NULL").groupBy(F.col("conv").alias("conv__"), F.col("jump").alias("turn__")).agg(F.sum("size").alias("gain"))
        joined = joined.join(below, F.col("conv").eqNullSafe(F.col("conv__")) & (F.col("turn") == F.col("turn__")), "left")
        return joined.select(
            "conv",
            "turn",
            "parent",
            F.col("jump_").alias("jump"),
            F.coalesce("thread_", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("depth_", F.lit(0))).alias("depth"),
            (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"),
        )

    opened = nodes.select(
        "conv",
        "turn",
        "parent",
        F.col("parent").alias("jump"),
        F.coalesce("parent", "turn").alias("thread"),
        F.col("parent").isNotNull().cast("int").alias("depth"),
        F.lit(1).cast("long").alias("size"),
    )
    measured = _doubled(opened, measure, "reply-sizes")
    siblings = running_sum(measured.where("parent IS NOT NULL"), ["conv", "parent"], ["turn"], F.col("size"), "reply-siblings")
    firsts = measured.where("parent IS NULL").withColumn("before", F.lit(-1).cast("long"))
    # a reply stands after its parent and the earlier replies to it, with all below them
    steps = siblings.unionByName(firsts).select("conv", "turn", "parent", F.col("parent").alias("jump"), "thread", "depth", (F.col("before") + 1).alias("rank"))

    def add_up(now: DataFrame, joined: DataFrame) -> DataFrame:
        return joined.select(
            "conv", "turn", "parent", F.col("jump_").alias("jump"), "thread", "depth", (F.col("rank") + F.coalesce("rank_", F.lit(0))).alias("rank")
        )

    return _doubled(steps, add_up, "reply-ranks").select("conv", "turn", F.col("parent").alias("reply_to"), "thread", "depth", "rank")


def reply_ordered(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes), reply_to, thread, depth, position, n_quotes.

    ``position`` counts from 0 in reply order, ``thread`` is the turn of the thread's first message, ``depth`` the number
    of replies above, ``n_quotes`` the number of quoted lines. A null text is empty. Messages of null conversations form one conversation. A message with a
    null turn stands first and links nothing. Rows with the same conversation and turn share their links and stand next to each other,
    ordered by role, then in no stated order. Other columns are not read, whatever their names.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"), _parsed)
    messages = conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"),
        F.monotonically_increasing_id().alias("row"),
        lines.alias("lines"),
    )
    n_quotes = F.size(F.filter("lines", lambda line: line["level"] > 0))
    messages = materialise(messages.withColumn("own", _own_text(F.col("lines"))).withColumn("n_quotes", n_quotes), "messages")
    tree = reply_tree(materialise(link_quotes(messages), "quote-links")).withColumnsRenamed({"conv": "conv_", "turn": "turn_"})
    placed = messages.join(tree, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("turn") == F.col("turn_")), "left").select(
        "conv",
        "turn",
        "role",
        "row",
        F.trim("own").alias("text"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("rank", F.lit(0)).alias("rank"),
        "n_quotes",
    )
    numbered = running_sum(placed, ["conv"], ["thread", "rank", "role", "row"], F.lit(1).cast("long"), "placed")
    return numbered.select(
        F.col("conv").alias("conv_id"), "turn", "role", "text", "reply_to", "thread", "depth", F.col("before").alias("position"), "n_quotes"
    )
