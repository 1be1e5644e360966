"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation becomes a list of segments, one a turn. :func:`expand_examples` explodes each
assistant turn into an example of its own: the segments before it are its context, and only
its reply is trainable. :func:`digest` reads the examples back. The examples of a conversation
come from its one row and are digested beside it, so contexts are never shuffled.

Template: an assistant turn is ``<s>text</s>``, any other is ``[INST]role\\ntext[/INST]``.
In roles and texts ``%``, ``<``, ``[`` and, in roles, line feeds are percent-encoded, so
control strings inside a text cannot be taken for the template's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
#: What is encoded, in the order of encoding; decoding goes the other way round.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("\n", "%0A"))


def escape(text: Column, role: bool = False) -> Column:
    for char, code in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for char, code in reversed(ESCAPES if role else ESCAPES[:3]):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, segments array<string>, targets array<int>.

    ``targets`` holds the places (from 0) of the assistant turns in ``segments``:
    example i has segments[0 .. targets[i]) as context and segments[targets[i]] as reply.
    Turns go by turn, then role, then text (nulls first), so ties have one order and
    repeated rows are repeated turns. Null roles and texts count as empty; turns with a
    null conversation id make one conversation. An empty table gives an empty result;
    other columns are ignored. A conversation has to fit into one row.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    reply = role == ASSISTANT
    segment = F.when(reply, F.concat(F.lit("<s>"), escape(text), F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), escape(role, True), F.lit("\n"), escape(text), F.lit("[/INST]"))
    )
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), segment.alias("segment"))
    rows = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    places = F.filter(
        F.transform("turns", lambda t, i: F.when(t["role"] == ASSISTANT, i)),
        lambda i: i.isNotNull(),
    )
    return rows.select("conv_id", F.col("turns.segment").alias("segments"), places.alias("targets"))


def expand_examples(formatted: DataFrame) -> DataFrame:
    """Every example written out: conv_id, example, context, reply, loss_start, loss_end, last.

    The loss span is in characters of context followed by reply; it covers the reply's
    escaped text and neither its marks nor the context. Turns after the last reply, or of a
    conversation without any, are in one more row with a null reply and an empty span.
    ``last`` marks the row of each conversation that holds all its turns.
    """
    tail = F.when(F.size("segments") > F.coalesce(F.try_element_at("targets", F.lit(-1)) + 1, F.lit(0)), F.array(F.size("segments")))
    rows = formatted.select("conv_id", "segments", F.concat("targets", F.coalesce(tail, F.array().cast("array<int>"))).alias("places"))
    rows = rows.select("conv_id", "segments", F.size("places").alias("n"), F.posexplode("places").alias("example", "at"))
    rows = rows.select(
        "conv_id", "example", F.array_join(F.slice("segments", 1, F.col("at")), "").alias("context"),
        F.get("segments", F.col("at")).alias("reply"), (F.col("example") == F.col("n") - 1).alias("last"),
    )
    start = F.length("context") + F.when(F.col("reply").isNull(), 0).otherwise(len("<s>"))
    length = F.coalesce(F.length("reply") - len("<s></s>"), F.lit(0))
    return rows.select("conv_id", "example", "context", "reply", start.alias("loss_start"), (start + length).alias("loss_end"), "last")


def read_turn(segment: Column) -> tuple[Column, Column]:
    """Role and text of a segment, read back from the template."""
    body = F.regexp_extract(segment, r"(?s)^(?:<s>|\[INST\])([^<\[]*)(?:</s>|\[/INST\])$", 1)
    cut = F.instr(body, "\n")
    reply = F.startswith(segment, F.lit("<s>"))
    role = F.when(reply, F.lit(ASSISTANT)).otherwise(unescape(F.substring(body, F.lit(1), cut - 1), True))
    text = F.when(reply, body).otherwise(F.substring(body, cut + 1, F.length(body)))
    return role, unescape(text)


#: One segment; segments hold "<" and "[" in their marks only.
SEGMENT = r"<s>[^<\[]*</s>|\[INST\][^<\[]*\[/INST\]"


def digest(examples: DataFrame) -> DataFrame:
    """What the written examples hold, read back from them: one row per conversation."""

    def line(segment: Column) -> Column:
        role, text = read_turn(segment)
        return F.concat(role, F.lit("\n"), text, F.lit("\n"))

    text = F.concat("context", F.coalesce("reply", F.lit("")))
    rows = examples.select("conv_id", "example", "reply", "loss_start", "loss_end", "last", text.alias("text"))
    turns = F.when(F.col("last"), F.transform(F.regexp_extract_all("text", F.lit(SEGMENT), F.lit(0)), line))
    rows = rows.select(
        "conv_id", "example", F.col("reply").isNotNull().cast("long").alias("has_reply"), F.length("text").alias("chars"), turns.alias("turns"),
        unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss"),
    )
    read = rows.groupBy("conv_id").agg(
        F.max(F.size("turns")).cast("long").alias("n_turns"),
        F.max(F.sha2(F.array_join("turns", ""), 256)).alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.sum("has_reply").alias("n_examples"),
    )
    return read.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
