r"""Chat formatting with a grammar round trip [native].

A conversation is rendered as one text, one turn after the other:

    <s>ROLE [INST] TEXT [/INST]</s>

The control strings are ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. The
parser is deterministic: a control string counts unless a backslash stands
right before it; within a role or a text ``\e`` is a backslash, a backslash
before a control string stands for nothing, and no other backslash is
allowed. So no escaped role or text ends in a backslash, and one look back
tells whether a control string counts. Rendering starts without escapes,
reparses its own output and compares the turns it recovers with the source.
Where they differ, conflicting content (backslashes and control strings) is
escaped, and the result is reparsed and compared as well; other content is
its own escape, so there is no third round. Were that result to differ, the
job would fail.

Edge cases: a null text or role is empty; a null conv_id is a conversation
of its own; turns sort by turn, then role, then text, nulls first; repeated
rows are repeated turns; an empty table gives no rows; other columns,
whatever their names, are left out. A conversation is one text and so one
row, however long; each step over it is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums

OPEN, MIDDLE, CLOSE = "<s>", " [INST] ", " [/INST]</s>"
#: As Java regular expressions.
CONTROL = r"</?s>|\[/?INST\]"
#: What stands for a backslash, and what no escaped text holds.
BACKSLASH, WRONG = r"\e", r"\\(?![e<\[])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit(BACKSLASH)), rf"(?={CONTROL})", r"\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"\\(?=[<\[])", ""), F.lit(BACKSLASH), F.lit("\\"))


def render(turns: Column, escaped: Column) -> Column:
    """turns: array<struct<turn, role, text>>."""
    def one(t: Column) -> Column:
        role, text = t["role"], t["text"]
        return F.concat(
            F.lit(OPEN), F.when(escaped, escape(role)).otherwise(role), F.lit(MIDDLE),
            F.when(escaped, escape(text)).otherwise(text), F.lit(CLOSE),
        )

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text, start, length>>: recovered turns and where each escaped text lies.

    A turn that breaks the grammar has a null text.
    """
    def turn(piece: Column, before: Column) -> Column:
        parts = F.split(piece, r"(?<!\\) \[INST\] ", -1)
        body = F.element_at(parts, 2)
        text = F.substring(body, F.lit(1), F.length(body) - len(CLOSE))
        sound = (F.size(parts) == 2) & body.endswith(CLOSE) & ~text.rlike(rf"(?<!\\)(?:{CONTROL})|{WRONG}")
        role = F.element_at(parts, 1)
        return F.when(
            sound & ~role.rlike(rf"(?<!\\)(?:{CONTROL})|{WRONG}"),
            F.struct(
                unescape(role).alias("role"), unescape(text).alias("text"),
                (before + len(OPEN) + F.length(role) + len(MIDDLE)).cast("bigint").alias("start"),
                F.length(text).cast("bigint").alias("length"),
            ),
        )

    def turns(pieces: Column) -> Column:
        ends = running_sums(F.transform(pieces, lambda p: (F.length(p) + len(OPEN)).cast("bigint")))
        return let(ends, lambda e: F.transform(pieces, lambda p, i: turn(p, F.element_at(e, i + 1) - F.length(p) - len(OPEN))))

    live = F.split(formatted, r"(?<!\\)<s>", -1)
    return F.when(F.length(formatted) == 0, F.array().cast("array<struct<role:string,text:string,start:bigint,length:bigint>>")).otherwise(
        let(F.slice(live, F.lit(2), F.greatest(F.size(live) - 1, F.lit(0))), turns)
    )


def _same(turns: Column, parsed: Column) -> Column:
    plain = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    back = F.transform(parsed, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    return plain == back


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (parsed back), loss_spans, escaped, round_trip (true, or the job fails).

    loss_spans are the code-point ranges of the assistant texts in
    ``formatted``, escapes included. All turns of a conversation meet in one
    row, since the result is one text; conversations are dealt by conv_id.
    """
    rows = conversations.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
    first = grouped.withColumn("plain", render(F.col("source"), F.lit(False)))
    tried = first.withColumn("escaped", ~F.coalesce(_same(F.col("source"), parse(F.col("plain"))), F.lit(False)))
    done = tried.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), F.lit(True))).otherwise(F.col("plain")))
    read = done.withColumn("turns", parse(F.col("formatted")))
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"),
        lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["length"]).alias("end")),
    )
    return read.select(
        "conv_id", "formatted", "turns", spans.alias("loss_spans"), "escaped",
        F.when(_same(F.col("source"), F.col("turns")), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("not read back as written: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))).alias("round_trip"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from ``formatted`` and its mask alone."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
    return formatted.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        under.alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"), "round_trip",
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "round_trip",
    )
