"""Chat formatting: conversations are rebuilt from event logs, rendered with a template, and read back. SQL functions only.

Events of a message (conv_id, turn): ``delta`` adds text at the end, ``edit`` replaces the text so far, ``regenerate`` drops
it and starts again. Messages are folded first, each on its own, so a long conversation is spread over tasks until its
messages are joined into the one formatted text that it is in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import store

#: Template: OPEN role newline text CLOSE per turn. Fixed marks; no text can hold one, because every < and [ in it is escaped.
OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Replaced in this order, restored in the reverse order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
TRAINED = "assistant"
#: Column of a log that tells messages of one turn apart.
PART = "_part_of_turn"


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of events (conv_id, seq, turn, kind, role, text).

    Of a message's events in order of seq, those from the last ``edit`` or ``regenerate`` on count: the edit's text or
    nothing, and the deltas after it. Its role is the last one given. Null text adds nothing, an unknown or null kind is a
    delta. Events with equal seq are ordered by kind, role and text; an event that repeats another in every column is
    folded as often as it stands there. A null conv_id or turn is a value of its own. A log may have the column
    ``PART``: events of one turn that differ by it are messages of their own.
    """
    message = ["conv_id", "turn", *(c for c in events.columns if c == PART)]
    log = events.select(*message, "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    starts = F.col("kind").isin("edit", "regenerate")
    order = F.struct("seq", "kind", "role", "text")
    last = F.max(F.when(starts, order))
    # The start is found by an aggregate; only what follows it is gathered.
    marked = log.groupBy(*message).agg(
        last.alias("start"), F.max_by("role", F.when(F.col("role").isNotNull(), order)).alias("final_role"), F.collect_list(F.when(~starts, order)).alias("deltas")
    )
    after = F.when(F.col("start").isNull(), F.col("deltas")).otherwise(F.filter("deltas", lambda d: d > F.col("start")))
    body = F.array_join(F.transform(F.array_sort(after), lambda d: d["text"]), "")
    begun = F.when(F.col("start.kind") == "edit", F.col("start.text")).otherwise("")
    return marked.select("conv_id", "turn", F.coalesce("final_role", F.lit("")).alias("role"), F.concat(F.coalesce(begun, F.lit("")), body).alias("text"))


def render(messages: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans (start and length in code points of every ``trained`` text).

    Messages follow each other by turn, null first, then by role and text; repeated messages stay repeated.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    placed = messages.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body")).withColumn("place", F.row_number().over(order))
    sized = placed.withColumn("size", (F.char_length("head") + F.char_length("body") + len(CLOSE)).cast("long"))
    at = F.sum("size").over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    spans = sized.withColumn("start", F.coalesce(at, F.lit(0)) + F.char_length("head"))
    piece = F.struct("place", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("role") == trained, F.struct("start", F.char_length("body").cast("long").alias("length"))).alias("span"))
    gathered = spans.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.filter(F.transform("pieces", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Turns read back from (conv_id, formatted, loss_spans): conv_id, place, role, text, lost (under the loss mask)."""
    end = F.lit(CLOSE.replace("|", "\\|"))
    pieces = formatted.select("conv_id", F.posexplode(F.split("formatted", end)).alias("place", "piece")).where(F.col("piece") != "")
    at = F.sum(F.char_length("piece").cast("long") + len(CLOSE)).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    line = F.instr("piece", "\n")
    read = pieces.select(
        "conv_id", "place", (F.coalesce(at, F.lit(0)) + line).alias("start"),
        F.expr(f"substr(piece, {len(OPEN) + 1}, instr(piece, '\\n') - {len(OPEN) + 1})").alias("head"),
        F.expr("substr(piece, instr(piece, '\\n') + 1)").alias("body"),
    ).withColumn("length", F.char_length("body").cast("long"))
    spans = formatted.select("conv_id", F.explode("loss_spans").alias("span")).select(F.col("conv_id").alias("of"), F.col("span.start").alias("from"), F.col("span.length").alias("many"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("start") == F.col("from")) & (F.col("length") == F.col("many"))
    return read.join(spans, same, "left").select("conv_id", "place", _unescape_role(F.col("head")).alias("role"), unescape(F.col("body")).alias("text"), F.col("from").isNotNull().alias("lost"))


def events_of(conversations: DataFrame) -> DataFrame:
    """The log of finished conversations: each row is one delta and a message of its own.

    Rows that share a turn are told apart by their place in it, by role (null first) and text; equal rows stay repeated.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    part = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias(PART)
    return rows.select("conv_id", part, F.col("turn").alias("seq"), "turn", F.lit("delta").alias("kind"), "role", "text")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turn = F.struct("place", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), F.when(F.col("lost"), F.col("text")).otherwise("").alias("loss"))
    turns = parse(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    read = turns.select(
        F.col("conv_id").alias("of"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: t["turn"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
    )
    sizes = formatted.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"))
    return sizes.join(read, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def format_conversations(events: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Fold, render and store: conv_id, formatted, loss_spans. An empty log gives no rows."""
    return store(render(fold(events), trained), "chats")
