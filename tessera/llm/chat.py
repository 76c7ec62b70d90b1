"""Chat formatting with a grammar round trip.

A turn renders as  <s>[INST] role [/INST]text</s>  and a conversation as its turns in order. Nothing is escaped at
first: the rendered text is parsed again by the deterministic grammar below, which allows no control string inside a
role or a text, so that nobody can plant turn marks. Where the recovered turns differ from the source, the texts that
hold control strings are escaped and the conversation is parsed again. Escaping puts one backslash more behind the
bracket of a control string, and the parser takes one away, so any text survives, texts that look escaped included. A
conversation that still differs raises an error instead of being written wrong.

Turns are rendered before they are gathered, and gathered in chunks of CHUNK turns first, so the task that completes a
very long conversation receives a few long strings. Its formatted text is one value and has to fit one row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Control strings of the template, without their opening bracket.
_REST = r"(/?s>|/?INST\])"
CHUNK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)" + _REST, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)\\" + _REST, "$1$2")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>[INST] "), role, F.lit(" [/INST]"), text, F.lit("</s>"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; null where it does not follow the grammar."""
    pieces = F.split(formatted, "</s>", -1)
    # One control string each where the template has one, and none elsewhere.
    free = r"(?:(?![<\[](?:/?s>|/?INST\])).)*+"
    head = rf"(?s)^<s>\[INST\] ({free.replace('*+', '*?')}) \[/INST\]({free})$"
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")),
    )
    sound = (F.get(pieces, F.size(pieces) - 1) == "") & F.forall(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: p.rlike(head))
    return F.when(sound, turns)


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, formatted, n_turns, escaped (whether escaping was needed).

    Null roles and texts count as empty, null turn numbers come first, rows of one conversation that share a turn
    number follow by role and text, repeated rows repeat the turn, and null conversation ids make one conversation.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    chunks = rows.groupBy("conv", F.floor(F.col("turn") / CHUNK).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("part")
    )
    whole = chunks.groupBy("conv").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "part"))), lambda c: c["part"])).alias("source"))
    whole = whole.withColumn("source", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    join = lambda turn: F.array_join(F.transform("source", turn), "")
    plain = whole.withColumn("plain", join(lambda t: render(t["role"], t["text"])))
    plain = plain.withColumn("conflict", ~F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))
    safe = plain.withColumn("safe", F.when(F.col("conflict"), join(lambda t: render(escape(t["role"]), escape(t["text"])))))
    wrong = F.col("conflict") & ~F.coalesce(parse(F.col("safe")) == F.col("source"), F.lit(False))
    out = F.when(wrong, F.raise_error(F.concat(F.lit("conversation does not survive formatting: "), F.col("conv").cast("string")))).otherwise(F.coalesce("safe", "plain"))
    return safe.select(F.col("conv").alias(conv_col), out.alias("formatted"), F.size("source").cast("long").alias("n_turns"), F.col("conflict").alias("escaped"))


def loss_spans(parsed: Column, loss_role: str = "assistant") -> Column:
    """Texts under the loss mask, in order."""
    return F.transform(F.filter(parsed, lambda t: t["role"] == loss_role), lambda t: t["text"])


def read_back(written_texts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The digest of each formatted conversation, all from parsing its formatted text."""
    rows = written_texts.withColumn("turns", parse(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(loss_spans(F.col("turns")), "")
    return rows.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def format_and_verify(turns: DataFrame, **columns) -> DataFrame:
    """Writes the formatted conversations to the shared folder and reads them back."""
    return read_back(written(formatted(turns, **columns), "chat"))
