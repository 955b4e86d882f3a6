"""Chat formatting with a grammar round trip, in DataFrame functions only.

The template writes ``<|im_start|>role LF text<|im_end|> LF`` per turn. A turn is
rendered as it stands and parsed again; where the parser does not give the turn
back, its content is escaped, and the whole conversation is parsed once more to
prove that nothing changed. The escape puts a backslash before the bar of
``<|``, ``<\\|``, ``<\\\\|`` ..., and the parser takes one away, so any text survives.

Defined results: null roles and texts are empty; turns are ordered by turn, then role
and text (null turns first), repeated rows are turns of their own; a null
conversation id is a conversation; an empty table gives no rows. Other columns
are ignored. One conversation is one output row, so its rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.parsing import bind

START, END = "<|im_start|>", "<|im_end|>"
_END_LINE = r"<\|im_end\|>\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line without a bar."""
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|")))
    return F.array_join(parts, "\\")


def _frame(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """``array<struct<role,text>>`` of a formatted text; malformed turns have a null role.

    Grammar: text = turn*; turn = START role LF body END LF; neither role nor body
    holds ``<|``.
    """
    pieces = F.split(formatted, _END_LINE, -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(START) + 1, 2147483647)
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.char_length(role) + 2)
        fits = F.startswith(piece, F.lit(START)) & ~F.contains(body, F.lit("<|")) & F.contains(body, F.lit("\n"))
        return F.struct(F.when(fits, unescape_role(role)).alias("role"), F.when(fits, unescape_text(text)).alias("text"))

    return F.transform(turns, turn)


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: the formatted text and what the loss is taken over.

    ``formatted`` string; ``loss_spans`` array<struct<start,end>> in code points of
    ``formatted``; ``loss_turns`` array<int>, the masked turns by position;
    ``n_escaped`` turns that had to be escaped; ``round_trip`` is always true: a
    conversation that does not parse back raises an error.
    """
    src = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("_role", escape_role(F.col("role")))
    same = F.coalesce(parse(_frame(F.col("_role"), F.col("text"))) == F.array(F.struct("role", "text")), F.lit(False))
    src = src.withColumn("_escaped", ~same).withColumn("_text", F.when(F.col("_escaped"), escape_text(F.col("text"))).otherwise(F.col("text")))
    head = F.char_length("_role") + len(START) + 1
    size = head + F.char_length("_text") + len(END) + 1
    order = Window.partitionBy("conv_id").orderBy("_turn", "role", "text")
    src = src.withColumn("_no", F.row_number().over(order)).withColumn("_end", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.struct((F.col("_end") - size + head).alias("start"), (F.col("_end") - len(END) - 1).alias("end"))
    got = src.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("_no", _frame(F.col("_role"), F.col("_text")).alias("line"), F.struct("role", "text").alias("turn"), F.when(F.col("role") == trained, body).alias("span")))).alias("t"),
        F.sum(F.col("_escaped").cast("long")).alias("n_escaped"),
    )
    masked = F.filter("t", lambda x: x["span"].isNotNull())
    got = got.select(
        "conv_id",
        F.array_join(F.col("t.line"), "").alias("formatted"),
        F.transform(masked, lambda x: x["span"]).alias("loss_spans"),
        F.transform(masked, lambda x: x["_no"]).alias("loss_turns"),
        "n_escaped",
        F.col("t.turn").alias("_turns"),
    )
    proved = F.when(parse(F.col("formatted")) == F.col("_turns"), F.lit(True)).otherwise(F.raise_error(F.lit("a conversation does not parse back")).cast("boolean"))
    return got.withColumn("round_trip", proved).drop("_turns")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of conversations, read back from their formatted texts."""
    back = bind(formatted, _t=parse(F.col("formatted")))  # parsed once, not once a masked turn
    loss = F.array_join(F.transform("loss_turns", lambda n: F.element_at("_t", n)["text"]), "")
    joined = F.array_join(F.transform("_t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.withColumn("_loss", loss).select(
        "conv_id",
        F.size("_t").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
        "round_trip",
    )
