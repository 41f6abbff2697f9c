"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, neighbours of the same role are merged into one block by array
functions, and blocks are concatenated. A template marks blocks and the turns inside them; control strings inside texts
are escaped so that they can be read back. The loss mask is a list of character spans over the assistant's texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a block, between its role and first text, and between its turns. Each mark begins with <|, which no escaped
    text holds."""

    begin: str = "<|begin|>"
    text: str = "<|text|>"
    turn: str = "<|turn|>"
    end: str = "<|end|>\n"


#: Strings of this and other common templates, as what follows their first character (fixed values).
CONTROL = r"\||/?s>|/?INST\]|/?SYS>>"
#: A control string, with the backslashes that earlier escapes have put behind its first character.
PLAIN = rf"([<\[])(\\*)(?={CONTROL})"
ESCAPED = rf"([<\[])\\(\\*)(?={CONTROL})"
LEARNED = "assistant"
#: Elements of a run of running sums, and characters of a part of a text from which spans are cut.
RUN, PART = 128, 1024


def escape(text: Column) -> Column:
    """One more backslash behind the first character of every control string."""
    return F.regexp_replace(text, PLAIN, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often an inner function asks for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(widths: Column) -> Column:
    """The sum of the elements before each element. Sums are written down run by run and then of whole runs, so that a list is
    copied for each of its own RUN elements only, not for all."""
    sums = lambda xs: F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("before")),
                                  lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before")))
    run = lambda w, r: F.transform(F.sequence(r * RUN, F.least(r * RUN + RUN, F.size(w)) - 1), lambda i: F.get(w, i))
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / RUN).cast("int")), lambda r: sums(run(w, r)))
    joined = lambda rs: F.flatten(F.zip_with(rs, sums(F.transform(rs, lambda r: r["at"]))["before"], lambda r, at: F.transform(r["before"], lambda x: x + at)))
    return let(widths, lambda w: let(runs(w), joined))


def format_chats(turns: DataFrame, template: Template = Template(), learned: str = LEARNED) -> DataFrame:
    """conv_id, formatted, and loss_spans: array of (start, length) in characters from 0, one per turn of the learned role.

    Turns stand by turn number, then role, then text (nulls first in each), repeated rows side by side. Null texts and roles count as
    empty, a null conv_id is one conversation. No rows give no rows; other columns are not looked at. A conversation becomes one
    string, so it must fit a row."""
    row = F.struct(F.col("turn"), escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"),
                   (F.coalesce("role", F.lit("")) == learned).alias("learn"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    role = lambda i: F.get(F.col("t"), i)["role"]
    places = F.sequence(F.lit(0), F.size("t") - 1)
    starts = F.filter(places, lambda i: (i == 0) | (role(i) != role(i - 1)))
    merged = F.transform("starts", lambda s, k: F.struct(
        role(s).alias("role"), F.get(F.col("t"), s)["learn"].alias("learn"),
        F.transform(F.sequence(s, F.coalesce(F.get(F.col("starts"), k + 1), F.size("t")) - 1), lambda i: F.get(F.col("t"), i)["text"]).alias("texts")))
    blocks = chats.withColumn("starts", starts).select("conv_id", merged.alias("blocks"))
    block = lambda b: F.concat(F.lit(template.begin), b["role"], F.lit(template.text), F.array_join(b["texts"], template.turn), F.lit(template.end))
    written = blocks.withColumn("formatted", F.array_join(F.transform("blocks", block), ""))
    # Widths of what stands before each text: marks and role before the first of a block, else the mark between turns.
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda x, i: F.struct(
        F.when(i == 0, len(template.begin) + F.char_length(b["role"]) + len(template.text)).otherwise(len(template.turn)).alias("before"),
        F.char_length(x).alias("length"), F.when(i == F.size(b["texts"]) - 1, len(template.end)).otherwise(0).alias("after"), b["learn"].alias("learn")))))
    spans = let(pieces, lambda ps: F.filter(
        F.zip_with(ps, running(F.transform(ps, lambda p: p["before"] + p["length"] + p["after"])), lambda p, at: F.struct(
            (at + p["before"]).alias("start"), p["length"].cast("bigint").alias("length"), p["learn"].alias("learn"))), lambda s: s["learn"]))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return written.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, turns: array of (role, text) unescaped, and loss_text: what the loss spans cover, unescaped, in order."""
    quoted = lambda s: "\\Q" + s + "\\E"
    blocks = F.filter(F.split("formatted", quoted(template.begin)), lambda _, i: i > 0)
    part = lambda b: F.split(F.left(b, F.char_length(b) - len(template.end)), quoted(template.text), 2)
    told = lambda p: let(unescape(F.get(p, F.lit(0))), lambda role: F.transform(
        F.split(F.get(p, F.lit(1)), quoted(template.turn)), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"))))
    turns = F.flatten(F.transform(blocks, lambda b: let(part(b), told)))
    # A span is cut from the parts it meets, so that no search for its start goes through the whole text.
    place = lambda at: F.floor(at / PART).cast("int")
    met = lambda parts, s: F.array_join(F.transform(F.sequence(place(s["start"]), place(s["start"] + s["length"])), lambda i: F.get(parts, i)), "")
    cut = lambda parts, s: F.substring(met(parts, s), (s["start"] % PART).cast("int") + 1, s["length"].cast("int"))
    loss = let(F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)),
               lambda parts: F.array_join(F.transform("loss_spans", lambda s: unescape(cut(parts, s))), ""))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))
