"""Chat formatting checked by reparsing. DataFrame functions only.

The grammar, read from left to right after a leading `<s>`; each form ends at its first end mark:

    system      <<SYS>>text<</SYS>>
    user        [INST]text[/INST]
    assistant   <<A>>text</s>
    any other   <<ROLE>>role<<TEXT>>text<</ROLE>>

A conversation is first rendered as it is, parsed again and compared with its turns. If they
differ, the turns that do not come back from their own form alone are escaped: those that hold its end mark or
an escape's code. If the whole still differs, all turns are escaped; as no escaped text holds a `<` or `[`, that
cannot fail. The parser always unescapes.

Null text and null role count as empty. Turns go by turn, then role, then text; repeated rows are
turns of their own. An empty table gives an empty result. A conversation is one row of the output,
so it is the one thing gathered in a task, very long texts too. Columns beside conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of mark and code; the backslash is escaped first and unescaped last.
CODES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))
START = "<s>"
UNIT = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<<A>>.*?</s>|<<ROLE>>.*?<<TEXT>>.*?<</ROLE>>"


def _between(s: Column, start: str, end: str) -> Column:
    return F.substr(s, F.lit(len(start) + 1), F.length(s) - (len(start) + len(end)))


def escape(text: Column) -> Column:
    for mark, code in CODES:
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for mark, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def render_turn(role: Column, text: Column) -> Column:
    return (
        F.when(role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
        .when(role == "user", F.concat(F.lit("[INST]"), text, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("<<A>>"), text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("<<ROLE>>"), escape(role), F.lit("<<TEXT>>"), text, F.lit("<</ROLE>>")))
    )


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""

    def read(u: Column) -> Column:
        other = F.instr(u, "<<TEXT>>")
        return (
            F.when(u.startswith("<<SYS>>"), _turn(F.lit("system"), unescape(_between(u, "<<SYS>>", "<</SYS>>"))))
            .when(u.startswith("[INST]"), _turn(F.lit("user"), unescape(_between(u, "[INST]", "[/INST]"))))
            .when(u.startswith("<<A>>"), _turn(F.lit("assistant"), unescape(_between(u, "<<A>>", "</s>"))))
            .otherwise(_turn(unescape(F.substr(u, F.lit(9), other - 9)), unescape(F.substr(u, other + 8, F.length(u) - other - 16))))
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(UNIT), F.lit(0)), read)


def loss_spans(formatted: Column) -> Column:
    """The loss mask: (start, length) in code points of each assistant text, as it stands in the formatted text."""
    zero = F.struct(F.lit(len(START)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(a: Column, u: Column) -> Column:
        span = F.array(F.struct((a["at"] + 5).alias("start"), (F.length(u) - 9).cast("long").alias("length")))
        return F.struct((a["at"] + F.length(u)).alias("at"), F.when(u.startswith("<<A>>"), F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(F.regexp_extract_all(formatted, F.lit(UNIT), F.lit(0)), zero, step, lambda a: a["spans"])


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation: (conv_id, formatted, level, exact). level: 0 as it was, 1 turns escaped that conflict with their form, 2 all."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("_t"))
    turns = turns.select("conv_id", F.transform("_t", lambda t: _turn(t["role"], t["text"])).alias("_turns"))

    def rendered(level: int) -> Column:
        def one(t: Column) -> Column:
            plain = render_turn(t["role"], t["text"])
            if level == 0:
                return plain
            escaped = render_turn(t["role"], escape(t["text"]))
            return escaped if level == 2 else F.when(parse(plain) == F.array(t), plain).otherwise(escaped)

        return F.concat(F.lit(START), F.array_join(F.transform("_turns", one), ""))

    def settle(df: DataFrame, level: int) -> DataFrame:
        """Render again what the level before left inexact, and compare what the parser recovers."""
        df = df.withColumns({"formatted": F.when(F.col("exact"), F.col("formatted")).otherwise(rendered(level)), "level": F.when(F.col("exact"), F.col("level")).otherwise(level)})
        return df.withColumn("exact", F.col("exact") | (parse(F.col("formatted")) == F.col("_turns")))

    out = turns.withColumns({"formatted": F.lit(""), "level": F.lit(0), "exact": F.lit(False)})
    for level in range(3):
        out = settle(out, level)
    return out.select("conv_id", "formatted", "level", "exact")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: counts and digests of turns and of the text under the loss mask."""
    back = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("_turns"))
    said = F.array_join(F.transform(F.filter("_turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), said.alias("_said"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("_said").cast("long").alias("loss_chars"), F.sha2("_said", 256).alias("loss_sha256"), "formatted_chars")
