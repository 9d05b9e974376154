"""Chat formatting with Spark expressions only.

Template: a block is ``### role: text</turn>``; adjacent turns of one role share
a block, each closed by ``</turn>``; blocks are parted by a newline. Inside texts
and roles the backslash, ``###`` and ``</turn>`` are written ``\\b``, ``\\h`` and
``\\t`` (in roles also ``:`` as ``\\c``), so a control string in the output is
always markup and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
CHUNK_TURNS = 256


def escape(text: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("###", "\\h"), (END, "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in ((END, "\\t"), ("###", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Format each conversation and mark the characters that a loss should count.

    Turn structs are collected and sorted by (turn, role, text), first in chunks
    of ``CHUNK_TURNS`` turn numbers and then by chunk, so that no task sorts more
    than a chunk of a hot conversation. Returns ``conv_id, formatted,
    loss_spans`` (array of ``start, chars`` in code points, 0-based, over the
    escaped text of each ``loss_role`` turn, in order).

    Null text and null role count as empty, a null turn sorts first, rows with a
    null conversation form one conversation, ties in turn are ordered by role and
    text, repeated rows are all kept, texts of any length are taken whole. Other
    columns, whatever their names, are ignored; an empty table gives an empty
    result.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.floor(F.col(turn_col) / CHUNK_TURNS).alias("_chunk"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("_turn"),
    )
    chunks = rows.groupBy("conv_id", "_chunk").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    whole = chunks.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_chunk", "_turns"))), lambda c: c["_turns"])).alias("_turns"))

    def piece(turn: Column, i: Column) -> Column:
        fresh = (i == 0) | (turn["role"] != F.get("_turns", i - 1)["role"])
        head = F.when(fresh, F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit("\n")), F.lit(HEAD), escape_role(turn["role"]), F.lit(": "))).otherwise(F.lit(""))
        return F.struct(head.alias("head"), escape(turn["text"]).alias("text"), (turn["role"] == loss_role).alias("loss"))

    pieces = whole.select("conv_id", F.transform("_turns", piece).alias("_pieces"))

    def walk(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        span = F.struct(start.cast("long").alias("start"), F.length(p["text"]).cast("long").alias("chars"))
        return F.struct((start + F.length(p["text"]) + len(END)).cast("long").alias("at"), F.when(p["loss"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("spans"))
    # Spans are found in chunks and then moved by where their chunk begins, as appending to one array would copy it for each turn.
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"(size(_pieces) - 1) div {CHUNK_TURNS}")), lambda c: F.aggregate(F.slice("_pieces", c * CHUNK_TURNS + 1, CHUNK_TURNS), nothing, walk))
    offsets = F.aggregate("_parts", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("list")), lambda s, c: F.struct((s["at"] + c["at"]).alias("at"), F.array_append(s["list"], s["at"]).alias("list")), lambda s: s["list"])
    moved = F.zip_with("_parts", "_offsets", lambda c, o: F.transform(c["spans"], lambda s: F.struct((s["start"] + o).alias("start"), s["chars"].alias("chars"))))
    return pieces.withColumn("_parts", parts).withColumn("_offsets", offsets).select(
        "conv_id",
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "").alias("formatted"),
        F.flatten(moved).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation, one entry per turn."""
    body = F.substring(formatted, len(HEAD) + 1, F.length(formatted) - len(HEAD) - len(END))
    blocks = F.split(body, f"{END}\n{HEAD}", -1)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, ": ", 1)
        texts = F.split(F.substring(block, F.length(role) + 3, F.length(block)), END, -1)
        return F.transform(texts, lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order and with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")
