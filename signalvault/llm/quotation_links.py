"""Chat formatting by quotation linking: messages that quote each other become conversations without quotes.

1. Lines are parsed into nested quote levels (leading ``>`` signs). Lines of level 0 are the message's own, lines of
   level 1 are what it replies to, deeper ones were quoted before. Each level is normalised (quote signs, case, white
   space and line breaks) and hashed as passages: all of the level, that with the level behind it, each paragraph,
   each pair of lines and each line.
2. Every quoted passage is joined to the latest earlier message that has it as one of its own. The join is an as-of
   join in two steps, inside ranges of message ids and across them, so a line that a third of all messages share is
   spread over many tasks and makes one row for each quotation, never a row for each pair.
3. A message replies to the one whose whole text the quoted level is, if possible one that quotes what the quotation
   quotes; if there is none the quotation is partial, and paragraphs, pairs and lines vote, each with one over the number
   of messages that have it; of equals the latest. Deeper levels count where level 1 finds nothing, or nothing
   but passages that several messages have.
4. Replies point to earlier messages, so they form trees; pointers are doubled until every message knows its root
   and its depth. Positions follow from counts by depth and id range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalvault.session import cut_lineage

RANGES = 1024
_SIGNS = r"^(?:\s?>)+"
ATTRIBUTION = r"^(?:On|Am|Le|El)\b.*\b(?:wrote|schrieb|écrit|escribió)\s?:\s*$"
"""Lines that announce a quotation belong to nobody; they do so if the next line that is not blank is quoted deeper."""
_ANNOUNCED = r"(?md)^(?:On|Am|Le|El)\b[^\n]*\b(?:wrote|schrieb|écrit|escribió)\s?:[^\S\n]*(?=\n(?:\s*\n)?\s?>)"
"""The same in the own lines of a text."""


def line_level(line: Column) -> Column:
    """Quote signs before the first other character."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _SIGNS, 0), r"\s", ""))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, _SIGNS, ""), r"\s+", " ")))


def without_announcements(text: Column) -> Column:
    """The text with line feeds only and without own lines that announce a quotation."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), _ANNOUNCED, "")


def quotation_levels(messages: DataFrame) -> DataFrame:
    """(message_id, place, level, line, key) for every line that is not blank; key hashes the normalised line."""
    lines = messages.select("message_id", F.posexplode(F.split(without_announcements(F.col("text")), "\n")).alias("place", "line"))
    return lines.withColumn("level", line_level(F.col("line"))).withColumn("plain", normalised(F.col("line"))) \
        .where(F.col("plain") != "") \
        .select("message_id", "place", "level", "line", F.struct(F.xxhash64("plain"), F.hash("plain"), F.length("plain")).alias("key"))


_WHOLE, _BEHIND, _PARAGRAPH, _PAIR, _LINE = range(5)


def _passages(messages: DataFrame) -> DataFrame:
    """(message_id, level, key): distinct passages of every level; key holds their kind and hash."""
    parsed = messages.select("message_id", F.split(without_announcements(F.col("text")), "\n").alias("lines")) \
        .select("message_id", F.filter(F.transform("lines", lambda x, i: F.struct(
            i.alias("place"), line_level(x).alias("level"), normalised(x).alias("plain"),
            F.regexp_replace(x, _SIGNS + r"\s*", "").rlike(ATTRIBUTION).alias("announces"))),
            lambda r: r.plain != "").alias("rows")) \
        .select("message_id", F.filter("rows", lambda r, i: ~(r.announces & F.coalesce(F.get("rows", i + 1).level > r.level, F.lit(False)))).alias("rows"))
    levels = parsed.select("message_id", "rows", F.explode(F.array_distinct("rows.level")).alias("level")) \
        .select("message_id", "level", F.filter("rows", lambda r: r.level == F.col("level")).alias("mine"),
                F.filter("rows", lambda r: r.level == F.col("level") + 1).alias("behind"))

    def before(i: Column) -> Column:
        return F.get("mine", i - 1)

    whole, behind = F.array_join("mine.plain", " "), F.array_join("behind.plain", " ")
    runs = F.array_join(F.transform("mine", lambda r, i: F.concat(
        F.when(i == 0, "").when(before(i).place + 1 == r.place, " ").otherwise("\n"), r.plain)), "")
    pairs = F.filter(F.transform("mine", lambda r, i: F.concat(before(i).plain, F.lit("\n"), r.plain)), lambda x: x.isNotNull())

    def named(kind: int, texts: Column) -> Column:
        return F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), F.xxhash64(x).alias("h"), F.hash(x).alias("g"), F.length(x).alias("n")))

    both = F.filter(F.array(F.when(behind != "", F.concat(whole, F.lit("\n"), behind))), lambda x: x.isNotNull())
    keys = F.concat(named(_WHOLE, F.array(whole)), named(_BEHIND, both), named(_PARAGRAPH, F.split(runs, "\n")), named(_PAIR, pairs),
                    named(_LINE, F.col("mine.plain")))
    return levels.select("message_id", "level", F.explode(F.array_distinct(keys)).alias("key"))


def _latest_before(own: DataFrame, quoted: DataFrame, span: Column) -> DataFrame:
    """``quoted`` (message_id, level, key) with ``origin``, the largest smaller message_id of the key in ``own``
    (message_id, key), and ``owners``, how many have it."""
    events = own.select("key", "message_id", F.lit(0).alias("level"), F.lit(True).alias("origin")) \
        .union(quoted.select("key", "message_id", "level", F.lit(False))).withColumn("span", span)
    mine = F.when(F.col("origin"), F.col("message_id"))
    inside = Window.partitionBy("key", "span").orderBy("message_id").rangeBetween(Window.unboundedPreceding, -1)
    here = events.withColumn("near", F.max(mine).over(inside)).where(~F.col("origin"))
    across = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = events.groupBy("key", "span").agg(F.max(mine).alias("last"), F.max(~F.col("origin")).alias("asked"), F.count(mine).alias("here")) \
        .withColumn("far", F.max("last").over(across)).withColumn("owners", F.sum("here").over(Window.partitionBy("key"))) \
        .where("asked and owners > 0").select("key", "span", "far", "owners")
    return here.join(spans, ["key", "span"]).select("message_id", "level", "key", F.coalesce("near", "far").alias("origin"), "owners") \
        .where("origin is not null")


def reply_links(messages: DataFrame) -> DataFrame:
    """(message_id, reply_to) of the messages that quote an earlier one."""
    bounds = messages.agg(F.min("message_id"), F.max("message_id")).first()
    low, high = bounds[0] or 0, bounds[1] or 0
    span = F.floor((F.col("message_id") - low) / F.lit((high - low) // RANGES + 1))
    passages = cut_lineage(_passages(messages))
    found = _latest_before(passages.where("level = 0"), passages.where("level > 0"), span)
    rank = F.when(F.col("key.kind") == _BEHIND, 2).when(F.col("key.kind") == _WHOLE, 1).otherwise(0)
    votes = found.groupBy("message_id", "level", "origin").agg(
        F.max(rank).alias("rank"), F.sum((F.lit(float(1 << 40)) / F.col("owners")).cast("long")).alias("votes"), F.min("owners").alias("owners"))
    order = F.struct(((F.col("rank") > 0) | (F.col("owners") == 1)).alias("sure"), (-F.col("level")).alias("near"), "rank", "votes", "origin")
    return votes.groupBy("message_id").agg(F.max(order).alias("best")).select("message_id", F.col("best.origin").alias("reply_to"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conversation_id (the first message's id), position (from 1, by depth, then id), depth,
    message_id, reply_to (null for a first message), role, text without quotes.

    ``messages`` has message_id (long, rising with time), role and text; other columns are left behind. Rows without
    an id are left out; of rows that share one the one of the least text counts. A null or empty text is a message without lines:
    nobody can quote it. Equal texts are told apart by the nearest earlier id.
    """
    given = cut_lineage(messages.select(F.col("message_id").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
                        .where("message_id is not null").groupBy("message_id").agg(F.min(F.struct("text", "role")).alias("m"))
                        .select("message_id", "m.role", "m.text"))
    links = cut_lineage(reply_links(given))
    at = given.select("message_id").join(links, "message_id", "left") \
        .select("message_id", F.coalesce("reply_to", "message_id").alias("up"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).alias("depth"))
    at = cut_lineage(at)
    settled, open_ = at.where("depth = 0"), at.where("depth > 0")
    while open_.limit(1).count():  # only messages that do not know their first message yet look further
        above = settled.union(open_).select(F.col("message_id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        doubled = cut_lineage(open_.join(above, "up").select("message_id", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"),
                                                             (F.col("top") != F.col("up")).alias("moved")))
        settled = settled.union(doubled.where(~F.col("moved")).drop("moved"))
        open_ = doubled.where("moved").drop("moved")
    at = cut_lineage(settled)
    bounds = given.agg(F.min("message_id"), F.max("message_id")).first()
    low, high = bounds[0] or 0, bounds[1] or 0
    placed = at.withColumn("span", F.floor((F.col("message_id") - low) / F.lit((high - low) // RANGES + 1)))
    before = Window.partitionBy("up").orderBy("depth", "span").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("up", "depth", "span").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("up", "depth", "span").orderBy("message_id"))
    order = placed.withColumn("within", within).join(counts, ["up", "depth", "span"])
    line = F.split(without_announcements(F.col("text")), "\n")
    own = F.regexp_replace(F.array_join(F.filter(line, lambda x: line_level(x) == 0), "\n"), r"^\s+|\s+$", "")
    return order.join(given, "message_id").join(links, "message_id", "left").select(
        F.col("up").alias("conversation_id"), (F.col("base") + F.col("within")).alias("position"), "depth", "message_id", "reply_to", "role", own.alias("text"))
