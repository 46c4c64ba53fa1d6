"""Chat formatting: quotation linking.

1. Each message is read line by line: the number of ``>`` before a line is its quote level; neighbouring lines of a level are a
   passage. What has level 0 is the message's own text; the line that introduces a quote ("On ... wrote:") goes.
2. Passages are normalised (lower case, white space runs to one blank, trimmed) and hashed, whole and by line.
3. Quoted passages are joined to the first message of the conversation whose own text holds the same passage or
   line, if it is an earlier turn. A part of under ``MIN_PART`` characters ("ok", "thanks") counts only as a whole passage, and only if one message
   alone holds it. The message replies to one that its shallowest matching level quotes: the one with a whole
   passage in common, else with the most lines, else the latest.
4. Replies are followed up to the first message of their thread, by pointer doubling, which also gathers the way: ``reply_path`` holds
   the turns from the thread's first message to the message. Sorted by conversation and ``reply_path``, a conversation is in reply order:
   each reply comes after what it quotes and before the next branch.

All of it is built-in functions. Own passages are reduced to one row for each conversation and hash with map-side combining
before the join, which is many-to-one, so that common passages and a huge conversation are neither paired up nor gathered. A path is as long as
its chain of replies is deep.

Defined results: a null text is an empty message; a null conversation id or turn is a value of its own (turn -1, before
all others); a message without quotes, or whose quotes match nothing, starts its own thread; messages that repeat conversation, turn and text
are kept and get the same answer; two different messages of one turn quote apart, and what quotes that turn follows the later of their links; columns of
the caller come back with their values (a new column whose name is taken gets an underscore); an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.spans import let
from codeatlas.llm.arrow import free_name
from codeatlas.sources.scratch import durable

# The line before a quote, in four languages, and the marks of quotation.
INTRODUCTION = r"^(?:On|Am|Le|El) .*(?:wrote|schrieb|a écrit|escribió)\s*:\s*$"
MARKS = r"^(?:[ \t]*+>)++"
KEY = ["_conv", "_turn", "_text"]
MIN_PART = 12


def leveled_lines(text: Column) -> Column:
    """Array of (level, body), a text's lines without their quote marks."""
    return F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("body")),
    )


def _passages(lines: Column) -> Column:
    """Neighbouring lines of a level as (level, lines)."""
    at = lambda i: F.get(lines, i)
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (at(i)["level"] != at(i - 1)["level"]))

    def passage(starts, start, k):
        end = F.coalesce(F.get(starts, k + 1), F.size(lines))
        return F.struct(at(start)["level"].alias("level"), F.transform(F.slice(lines, start + 1, end - start), lambda x: x["body"]).alias("lines"))

    return let(starts, lambda s: F.transform(s, lambda start, k: passage(s, start, k)))


def _content(lines: Column) -> Column:
    """The lines of level 0 without what introduces a quote."""
    kept = lambda quoted: F.filter(lines, lambda x: (x["level"] == 0) & ~(quoted & x["body"].rlike(INTRODUCTION)))
    own = let(F.exists(lines, lambda x: x["level"] > 0), lambda quoted: F.transform(kept(quoted), lambda x: x["body"]))
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, text and others) as ``kept``, with _conv, _turn, _text, passages (level, lines) and ``content``, the text without quotes."""
    body = F.coalesce("text", F.lit(""))
    read = let(leveled_lines(body), lambda lines: F.struct(_passages(lines).alias("passages"), _content(lines).alias("content")))
    return messages.select(
        F.struct(*messages.columns).alias("kept"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("_turn"), F.md5(body).alias("_text"), read.alias("_read")
    ).select("kept", *KEY, "_read.*")


def reply_links(parsed: DataFrame) -> DataFrame:
    """(_conv, _turn, _text, reply_to) of the messages whose quotes match an earlier one."""
    part = normal(F.col("part"))
    mine = parsed.select("_conv", "_turn", F.explode(F.array_union(F.array(F.col("content")), F.split("content", "\n"))).alias("part"))
    mine = mine.filter(part != "").groupBy("_conv", F.md5(part).alias("hash")).agg(F.min("_turn").alias("first"), F.max("_turn").alias("last"))
    quotes = parsed.select(*KEY, F.explode(F.filter("passages", lambda p: p["level"] > 0)).alias("p"))
    whole = F.struct(F.lit(1).alias("whole"), F.array_join("p.lines", "\n").alias("part"))
    lines = F.transform(F.array_distinct("p.lines"), lambda x: F.struct(F.lit(0).alias("whole"), x.alias("part")))
    quotes = quotes.select(*KEY, F.col("p.level").alias("level"), F.inline(F.concat(F.array(whole), lines)))
    quotes = quotes.filter((part != "") & ((F.length(part) >= MIN_PART) | (F.col("whole") == 1)))
    quotes = quotes.select(*KEY, "level", "whole", F.md5(part).alias("hash"), (F.length(part) < MIN_PART).alias("short"))
    votes = quotes.join(mine, ["_conv", "hash"]).filter("first < _turn AND (NOT short OR first = last)")
    votes = votes.groupBy(*KEY, "level", "first").agg(F.max("whole").alias("whole"), F.count(F.lit(1)).alias("n"))
    return votes.groupBy(*KEY).agg(F.max(F.struct(-F.col("level"), "whole", "n", "first"))["first"].alias("reply_to"))


def threads(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(_conv, _turn, path): the turns from the first message of the thread to the reply."""
    first = links.groupBy("_conv", "_turn").agg(F.max("reply_to").alias("up")).withColumn("way", F.array("_turn"))
    ways = durable(first, "chat-ways")
    for _ in range(max_rounds):
        ends = ways.select("_conv", F.col("_turn").alias("up"), F.col("up").alias("further"), F.col("way").alias("before"))
        stepped = ways.join(ends, ["_conv", "up"], "left")
        if stepped.filter("further IS NOT NULL").isEmpty():
            break
        way = F.when(F.col("before").isNull(), F.col("way")).otherwise(F.concat("before", "way"))
        ways = durable(stepped.select("_conv", "_turn", F.coalesce("further", "up").alias("up"), way.alias("way")), "chat-ways")
    return ways.select("_conv", "_turn", F.concat(F.array("up"), "way").alias("path"))


def conversations(messages: DataFrame) -> DataFrame:
    """``messages`` plus content, n_quotes, reply_to, thread and reply_path; order by conv_id, reply_path for reply order."""
    names = [free_name(messages, c) for c in ("content", "n_quotes", "reply_to", "thread", "reply_path")]
    parsed = parse(messages)
    links = durable(reply_links(parsed), "chat-links")
    made = parsed.join(links, KEY, "left").join(threads(links), ["_conv", "_turn"], "left")
    path = F.when(F.col("reply_to").isNull(), F.array("_turn")).otherwise(F.coalesce("path", F.array("_turn")))
    quotes = F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long")
    new = [F.col("content"), quotes, F.col("reply_to"), F.get(path, 0), path]
    return made.select("kept.*", *[c.alias(n) for c, n in zip(new, names)])


def report(messages: DataFrame) -> DataFrame:
    found = conversations(messages.select("conv_id", "turn", "role", "text"))
    return found.select("conv_id", "turn", "role", "n_quotes", "reply_to", "thread", F.array_join("reply_path", "/").alias("reply_path"), "content")


SQL = r"""
WITH RECURSIVE m AS (SELECT *, row_number() OVER () AS rid, coalesce(CAST(conv_id AS VARCHAR), '') AS c, coalesce(turn, -1) AS t, coalesce(text, '') AS body FROM conversations),
rows_ AS (SELECT rid, c, t, i, string_split(body, chr(10))[i] AS l FROM (SELECT *, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM m)),
leveled AS (SELECT rid, c, t, i, length(regexp_replace(regexp_extract(l, '^(?:[ 	]*>)+', 0), '[^>]', '', 'g')) AS level, regexp_replace(l, '^(?:[ 	]*>)+ ?', '') AS b FROM rows_),
runs AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT *, lag(level) OVER (PARTITION BY rid ORDER BY i) AS before FROM leveled)),
passages AS (SELECT rid, c, t, run, level, string_agg(b, chr(10) ORDER BY i) AS part, list(b) AS parts FROM runs WHERE level > 0 GROUP BY rid, c, t, run, level),
own AS (SELECT m.rid, m.c, m.t, regexp_replace(coalesce(string_agg(r.b, chr(10) ORDER BY r.i) FILTER (r.level = 0 AND NOT (q.rid IS NOT NULL AND regexp_matches(r.b, '^(?:On|Am|Le|El) .*(?:wrote|schrieb|a écrit|escribió)\s*:\s*$'))), ''), '^\s+|\s+$', '', 'g') AS content
 FROM m JOIN runs r ON m.rid = r.rid LEFT JOIN (SELECT DISTINCT rid FROM passages) q ON q.rid = m.rid GROUP BY m.rid, m.c, m.t),
mine AS (SELECT c, part, min(t) AS first, max(t) AS last FROM (SELECT c, t, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) AS part FROM (SELECT c, t, unnest(list_append(string_split(content, chr(10)), content)) AS p FROM own)) WHERE part <> '' GROUP BY c, part),
quotes AS (SELECT DISTINCT rid, c, t, run, level, whole, part AS raw, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS part FROM (SELECT rid, c, t, run, level, 1 AS whole, part FROM passages UNION ALL SELECT rid, c, t, run, level, 0, unnest(parts) FROM passages)),
votes AS (SELECT q.rid, q.c, q.t, q.level, m.first, max(q.whole) AS whole, count(*) AS n FROM quotes q JOIN mine m ON q.c = m.c AND q.part = m.part
 WHERE q.part <> '' AND (length(q.part) >= 12 OR q.whole = 1) AND m.first < q.t AND (length(q.part) >= 12 OR m.first = m.last) GROUP BY ALL),
links AS (SELECT rid, c, t, arg_max(first, (-level, whole, n, first)) AS reply_to FROM votes GROUP BY rid, c, t),
ups AS (SELECT c, t, max(reply_to) AS up FROM links GROUP BY c, t),
ways(c, t, top, way) AS (SELECT c, t, up, [up, t] FROM ups UNION ALL SELECT w.c, w.t, u.up, list_prepend(u.up, w.way) FROM ways w JOIN ups u ON u.c = w.c AND u.t = w.top),
paths AS (SELECT c, t, arg_max(way, len(way)) AS way FROM ways GROUP BY c, t)
SELECT m.conv_id, m.turn, m.role, (SELECT count(*) FROM passages p WHERE p.rid = m.rid) AS n_quotes, l.reply_to, coalesce(CASE WHEN l.rid IS NOT NULL THEN w.way[1] END, m.t) AS thread,
 coalesce(CASE WHEN l.rid IS NOT NULL THEN array_to_string(w.way, '/') END, CAST(m.t AS VARCHAR)) AS reply_path, o.content
FROM m JOIN own o ON o.rid = m.rid LEFT JOIN links l ON l.rid = m.rid LEFT JOIN paths w ON w.c = m.c AND w.t = m.t
"""
