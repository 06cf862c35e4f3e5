"""Chat formatting from an event log (native: DataFrame functions only).

The log has conv_id, message (place of a message in its conversation), seq (order of events), role, kind and text.
Kinds: ``start`` opens a message with a text, ``delta`` adds to it, ``edit`` replaces it, ``regenerate`` empties it and takes
back the later messages that were written before. The fold is relational: of each message the last start, edit or regenerate and the deltas
after it remain, and a message goes if an earlier one was regenerated after its last event.

Template: each turn is ``<s>[role]text</s>``. Inside roles and texts ``& < [ ]`` become ``&amp; &lt; &lsqb; &rsqb;``, so no text
can hold a control string and unescaping gives the text back. The loss mask has a span per turn, in code points of the
formatted text; only assistant spans have a length.

Defined results: events of a message with the same seq and text are one event that came twice, and others with the same seq are in order of their texts; null text and role are empty; a null turn comes first; ties of turn are ordered by role and text, and repeated rows
are turns each; null conv_id is a conversation of its own; an empty table gives an empty result; extra columns are ignored.
A conversation's formatted text is one value, so a conversation has to fit one row (2 GB), and a task holds one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The escapes, in the order in which they are applied; unescaping goes the other way.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))
TURN_END = "</s>"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log of finished turns (conv_id, turn, role, text): assistant texts as two streamed deltas, others in their start."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", role, text)).cast("bigint")
    t = turns.select("conv_id", place.alias("message"), role.alias("role"), text.alias("_text"))
    half = F.floor(F.length("_text") / 2).cast("int")
    event = lambda k, kind, x: F.struct((F.col("message") * 4 + k).alias("seq"), F.lit(kind).alias("kind"), x.alias("text"))
    streamed = F.array(event(0, "start", F.lit("")), event(1, "delta", F.substr("_text", F.lit(1), half)), event(2, "delta", F.substr("_text", half + 1)))
    whole = F.array(event(0, "start", F.col("_text")))
    return t.select("conv_id", "message", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(whole)).alias("e")).select("conv_id", "message", "role", "e.seq", "e.kind", "e.text")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text of the messages that remain."""
    one = log.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("kind") != "delta", F.col("seq"))).alias("_base"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_again"),
        F.max("seq").alias("_last"),
        F.max_by(F.coalesce("role", F.lit("")), "seq").alias("role"),
        F.sort_array(F.array_distinct(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))).alias("_events"),
    )
    kept = F.filter("_events", lambda e: F.col("_base").isNull() | (e.seq >= F.col("_base")))
    one = one.select("conv_id", "message", "role", "_again", "_last", F.array_join(F.transform(kept, lambda e: e.text), "").alias("text"))
    cut = F.max("_again").over(Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1))
    return one.withColumn("_cut", cut).where("_cut is null or _last > _cut").select("conv_id", "message", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask: array of (block: where the turn starts, start, length), in code points from 0."""
    head = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]"))
    body = escape(F.col("text"))
    block = F.concat(head, body, F.lit(TURN_END))
    w = Window.partitionBy("conv_id").orderBy("message")
    rows = messages.select("conv_id", "message", "role", block.alias("_block"), F.length(head).cast("bigint").alias("_head"), F.length(body).cast("bigint").alias("_body"))
    rows = rows.withColumn("_at", F.sum(F.length("_block")).over(w) - F.length("_block"))
    length = F.when(F.col("role") == "assistant", F.col("_body")).otherwise(F.lit(0).cast("bigint"))
    span = F.struct(F.col("_at").alias("block"), (F.col("_at") + F.col("_head")).alias("start"), length.alias("length"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "_block", span.alias("span")))).alias("t"))
    return whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["_block"]), "").alias("formatted"), F.transform("t", lambda x: x["span"]).alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from formatted and loss_mask."""
    pieces = F.split("formatted", TURN_END)
    df = rendered.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"), F.slice(pieces, 1, F.size(pieces) - 1).alias("_blocks"), "loss_mask")
    inner = lambda b: F.substring_index(F.substr(b, F.lit(len("<s>[") + 1)), "]", 1)
    text = lambda b: F.substr(b, F.length(inner(b)) + len("<s>[]") + 1)
    turns = F.transform("_blocks", lambda b: F.concat(unescape(inner(b)), F.lit("\n"), unescape(text(b)), F.lit("\n")))
    masked = F.zip_with("_blocks", "loss_mask", lambda b, m: F.substr(b, (m["start"] - m["block"] + 1).cast("int"), m["length"].cast("int")))
    df = df.withColumn("_loss", unescape(F.array_join(masked, "")))
    return df.select("conv_id", F.size("_blocks").cast("bigint").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations of a table of turns, by way of their event log."""
    return render(fold(events_of_turns(turns)))
