"""Chat formatting from event logs: fold, render, and read back. DataFrame functions only.

Events are (conv_id, seq, message, kind, role, text). By conversation and message, in
order of seq (ties: kind, role, text):

- delta: appends its text (the message is there from its first event on);
- edit: replaces the text by its own;
- regenerate: clears the text; deltas that follow write it anew.

So a message's text is what was logged from its last edit or regenerate on. Messages
are folded by (conversation, message) first, so that a long stream of deltas is one
group of its own however many messages its conversation has, and are then put together
by conversation in order of message, which must be one row as it is one formatted text.

The template of a turn is `<s>` role `\\n[INST]` text `[/INST]</s>\\n`. Within roles and
texts a backslash is doubled, and one is put after the first character of each control
string (`<s>`, `</s>`, `[INST]`, `[/INST]`), so that none occurs there and dropping the
backslash before any character restores the original. The loss mask has the spans of
assistants' escaped texts, in code points.

Edge cases: null role or text is empty; a null message sorts first; an event of another
kind, or without one, is a delta; a null conv_id is a conversation of its own; an empty
log gives no conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, BODY, CLOSE = "<s>", "\n[INST]", "[/INST]</s>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the messages as they stand after all events."""
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    rows = events.select(
        "conv_id", "message", F.struct("seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.when(kind == "regenerate", "").otherwise(F.coalesce(F.col("text"), F.lit(""))).alias("text")).alias("e")
    )
    whole = rows.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list("e")).alias("e"))
    last = F.expr("coalesce(array_max(transform(e, (x, i) -> if(x.kind in ('edit', 'regenerate'), i + 1, 1))), 1)")
    return whole.withColumn("from", last).select("conv_id", "message", F.expr("element_at(e, 1).role").alias("role"), F.expr("concat_ws('', transform(slice(e, from, size(e)), x -> x.text))").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length; from 0) of folded messages."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    turns = messages.select("conv_id", "message", (F.col("role") == "assistant").alias("loss"), F.concat(F.lit(OPEN), role, F.lit(BODY)).alias("lead"), text.alias("text"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum(F.length("lead") + F.length("text") + len(CLOSE)).over(before), F.lit(0))
    turns = turns.withColumn("start", (begun + F.length("lead")).cast("int"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "loss", "lead", "text", "start"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x.loss), lambda x: F.struct(x.start.alias("start"), F.length(x.text).alias("length")))
    return whole.select("conv_id", F.expr("concat_ws('', transform(t, x -> concat(x.lead, x.text, '[/INST]</s>\\n')))").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text, restored from the formatted text alone), loss (array of restored texts under the mask), formatted_chars.

    Spans are cut out of the piece of the text in which they begin, so that a long conversation isn't walked once a span.
    """
    split = formatted.select("conv_id", "loss_spans", F.length("formatted").cast("long").alias("formatted_chars"), F.split("formatted", r"\[/INST\]</s>\n", -1).alias("pieces"))
    pieces = split.select("conv_id", F.posexplode(F.expr("slice(pieces, 1, size(pieces) - 1)")).alias("place", "piece"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("begun", F.coalesce(F.sum(F.length("piece") + len(CLOSE)).over(before), F.lit(0)).cast("int"))
    body = F.instr("piece", BODY) + len(BODY) - 1
    pieces = pieces.select("conv_id", "place", "piece", "begun", (F.col("begun") + body).alias("start"))
    spans = split.select(F.col("conv_id").alias("own"), F.explode("loss_spans").alias("span")).select("own", F.col("span.start").alias("at"), F.col("span.length").alias("chars"))
    both = pieces.join(spans, pieces.conv_id.eqNullSafe(spans.own) & (F.col("start") == F.col("at")), "left")
    role = unescape(F.substring_index(F.substr("piece", F.lit(len(OPEN) + 1)), BODY, 1))
    text = unescape(F.substr("piece", F.col("start") - F.col("begun") + 1))
    loss = unescape(F.substr("piece", F.col("at") - F.col("begun") + 1, F.col("chars")))
    turns = both.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", role.alias("role"), text.alias("text"), loss.alias("loss")))).alias("t"))
    sizes = split.select(F.col("conv_id").alias("own"), "formatted_chars")
    rows = sizes.join(turns, turns.conv_id.eqNullSafe(sizes.own), "left")
    said = F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    masked = F.transform(F.filter("t", lambda x: x.loss.isNotNull()), lambda x: x.loss)
    return rows.select(F.col("own").alias("conv_id"), said.alias("turns"), masked.alias("loss"), "formatted_chars")


def digests(parsed: DataFrame) -> DataFrame:
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log that ends in them; rows with equal turns are messages of their own, by role and text.

    By a hash, a turn was streamed at once, streamed in two deltas, drafted and edited, or
    drafted, regenerated and streamed anew; drafts hold the text backwards.
    """
    own = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    parts = [event("delta", F.substr(text, F.lit(1), half)), event("delta", F.substr(text, half + 1))]
    draft = event("delta", F.reverse(text))
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    log = F.when(way == 0, F.array(event("delta", text))).when(way == 1, F.array(*parts)).when(way == 2, F.array(draft, event("edit", text))).otherwise(F.array(draft, event("regenerate", F.lit("")), *parts))
    rows = conversations.select("conv_id", F.struct("turn", own.alias("n")).alias("message"), "role", log.alias("log")).select("conv_id", "message", "role", F.posexplode("log").alias("step", "e"))
    return rows.select("conv_id", F.struct(F.col("message.turn").alias("turn"), F.col("message.n").alias("n"), "step").alias("seq"), "message", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))
