"""Conversations rebuilt from event logs and rendered for training.

A log row is an event: a whole message, a streamed delta, an edit or a regeneration. Events are
partitioned by conversation and turn, ordered by sequence and folded into the messages that stand at the end,
which are then rendered in one template. Windows and aggregates only; what is longest in one task is one
conversation's final text, which has to be one value anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.llm.base import bind

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that control a model or this template; inside texts they are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
#: What an event does.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put after the first character of each control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        doubled = F.replace(doubled, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return doubled


def unescape(text: Column) -> Column:
    """The text before :func:`escape`: each backslash goes, the character after it stays."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def messages_as_events(messages: DataFrame) -> DataFrame:
    """Finished ``(conv_id, turn, role, text)`` rows as events, one whole message each."""
    return messages.select(
        "conv_id", F.col("turn"), F.col("turn").alias("seq"), F.lit(MESSAGE).alias("kind"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """``(conv_id, turn, seq, role, text)`` of the messages that stand at the end.

    ``events`` has ``conv_id``, ``turn``, ``seq``, ``kind``, ``role`` and ``text``. Within a turn, by ``seq``: a
    ``message`` starts a message of its own; an ``edit`` or ``regenerate`` starts one that replaces the one
    before it; a ``delta`` is appended to the one before it, or starts one. What replaces the messages of a turn
    also drops those of later turns that came before it (the branch that was left). A null text is empty, a null
    kind a message, a null role empty; other kinds are deltas. Events of equal ``seq`` go by kind, role and text.
    Repeated events count each time. Other columns are not read. An empty log gives no rows.
    """
    rows = events.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"),
        F.coalesce("kind", F.lit(MESSAGE)).alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text")
    starts = F.col("kind").isin(MESSAGE, EDIT, REGENERATE) | (F.row_number().over(order) == 1)
    numbered = rows.withColumn("starts", starts.cast("int")).withColumn("place", F.row_number().over(order)).withColumn(
        "version", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    versions = numbered.groupBy("conv_id", "turn", "version").agg(
        F.min("seq").alias("seq"), F.min_by("kind", "place").alias("kind"), F.min_by("role", "place").alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda e: e["text"]), "").alias("text"))
    by_version = Window.partitionBy("conv_id", "turn").orderBy("version")
    replaced = F.coalesce(F.lead("kind").over(by_version).isin(EDIT, REGENERATE), F.lit(False))
    standing = versions.withColumn("replaced", replaced).filter("NOT replaced")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    branch = F.max(F.when(F.col("kind").isin(EDIT, REGENERATE), F.col("seq"))).over(earlier)
    return standing.withColumn("branch", branch).filter(F.col("branch").isNull() | (F.col("seq") > F.col("branch"))).select(
        "conv_id", "turn", "seq", "role", "text")


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_spans)`` of each conversation.

    A message is ``<|im_start|>``, its role, a newline, its escaped text, ``<|im_end|>`` and a newline, in the order of
    turn and ``seq``, then role and text. Newlines in a role are escaped. ``loss_spans`` are the spans of the
    learned role's escaped texts, in code points.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    parts = messages.select(
        "conv_id", "turn", "seq", "role", "text",
        F.concat(F.lit(BEGIN), role, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    # where a message begins in its conversation: a running total, so no conversation is folded in one row
    order = Window.partitionBy("conv_id").orderBy("turn", "seq", "role", "text")
    size = F.length("head") + F.length("body") + F.lit(len(END))
    placed = parts.withColumn("place", F.row_number().over(order)).withColumn(
        "at", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("head"))
    pieces = F.struct(
        "place", F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(F.col("role") == learned_role, F.struct(
            F.col("at").cast("long").alias("start"), (F.col("at") + F.length("body")).cast("long").alias("end"))).alias("span"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(pieces)).alias("pieces"))
    return grouped.select(
        "conv_id", F.array_join("pieces.piece", "").alias("formatted"),
        F.filter("pieces.span", lambda s: s.isNotNull()).alias("loss_spans"))


def format_conversations(events: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """Event logs to rendered conversations; see :func:`fold_events` and :func:`render`."""
    return render(fold_events(events), learned_role)


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a rendered conversation."""
    whole = F.slice(F.split(formatted, r"<\|im_end\|>\n", -1), 1, F.size(F.split(formatted, r"<\|im_end\|>\n", -1)) - 1)

    def message(piece: Column) -> Column:
        # the head ends at the first newline without a backslash before it
        head = F.regexp_extract(piece, r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*+)\n", 1)
        return F.struct(
            unescape(head).alias("role"),
            unescape(F.substr(piece, F.length(head) + len(BEGIN) + 2, F.length(piece))).alias("text"))

    return F.transform(whole, message)


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped, one after another."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(rendered: DataFrame) -> DataFrame:
    """What a rendered conversation holds, read back from the output."""
    turns = bind(parse(F.col("formatted")), lambda messages: F.struct(
        F.size(messages).cast("long").alias("n"),
        F.sha2(F.array_join(F.transform(messages, lambda m: F.concat(
            m["role"], F.lit("\n"), m["text"], F.lit("\n"))), ""), 256).alias("sha")))
    read = rendered.select(
        "conv_id", turns.alias("turns"), learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
