"""Chat formatting from event logs, in DataFrame operations only.

A log holds events of conversations: ``delta`` appends text to a message, ``edit`` replaces what the
message has so far, ``regenerate`` discards it (deltas that follow build the new answer). Logs are
partitioned by conversation and sorted by sequence; the fold keeps each message's last edit or regeneration
and the deltas after it and concatenates them. The messages are then rendered with a template
whose control strings are escaped, reversibly, wherever a text or role holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Strings that this or other chat templates read as control: ``<|``, ``[INST]``, ``[/INST]``, ``<s>``,
#: ``</s>``, ``<<SYS>>``, ``<</SYS>>``. Escaping puts one more backslash after the first character.
_TAIL = r"(\||/?INST\]|/?s>|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, message, role, text`` of the final messages.

    ``events(conv_id, seq, message, kind, role, text)``: ``message`` is the message's position in its
    conversation, ``kind`` is ``delta``, ``edit`` or ``regenerate``; null and unknown kinds are deltas. Null texts are
    empty. Events go by ``seq`` (null: before all numbers), at one ``seq`` edits, then regenerations, then deltas, then by
    role and text (nulls first). The last edit or regeneration sets the text (regenerations: to nothing) and the
    deltas after it are appended; a repeated edit counts once, repeated deltas each. The role is that of the last event that has
    one, whether its text still counts or not. A message whose last event is a regeneration is kept, empty.

    A conversation's events are partitioned once, on ``conv_id``; discarded events are dropped before a message's parts
    are gathered. Null conversation ids make one conversation.
    """
    rank = F.when(F.col("kind") == "edit", 0).when(F.col("kind") == "regenerate", 1).otherwise(2)
    e = events.select("conv_id", "message", F.struct("seq", rank.alias("rank"), "role", F.coalesce("text", F.lit("")).alias("text")).alias("event"))
    within = Window.partitionBy("conv_id", "message")
    reset = F.max(F.when(F.col("event.rank") < 2, F.col("event"))).over(within)
    role = F.max(F.when(F.col("event.role").isNotNull(), F.col("event"))).over(within)
    placed = e.repartition("conv_id").withColumn("reset", reset).withColumn("role", role["role"])
    # a delta counts if it comes after the reset; the first of all events carries the message where no delta does
    counts = (F.col("event.rank") == 2) & (F.col("reset").isNull() | (F.col("event") > F.col("reset")))
    parts = F.array_sort(F.collect_list(F.when(counts, F.struct("event.seq", "event.role", "event.text"))))
    out = placed.groupBy("conv_id", "message").agg(F.max("reset").alias("reset"), F.max("role").alias("role"), parts.alias("parts"))
    base = F.when(F.col("reset.rank") == 0, F.col("reset.text")).otherwise(F.lit(""))
    return out.select("conv_id", "message", "role", F.concat(base, F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: one row a conversation.

    ``loss_spans``: ``(start, end)`` in code points of ``formatted`` for each text of role ``learn``, in
    order. A null role is empty, a null text too. A conversation's turns come in order of ``message``.
    The row of a conversation holds all its text, since that is the output.
    """
    w = Window.partitionBy("conv_id").orderBy("message")
    head = F.concat(F.lit(START), F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    m = messages.select("conv_id", "message", (F.coalesce("role", F.lit("")) == learn).alias("loss"), head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    m = m.withColumn("start", F.sum(F.length("piece").cast("long")).over(w) - F.length("piece") + F.length("head")).withColumn("end", F.col("start") + F.length("body"))
    turns = F.array_sort(F.collect_list(F.struct("message", "piece", "loss", "start", "end")))
    c = m.groupBy("conv_id").agg(turns.alias("turns"))
    return c.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, learned``: the turns that ``formatted`` holds, unescaped.

    The string is cut at its end markers, which no escaped text holds. ``learned`` is what
    ``loss_spans`` mark of the turn (null: nothing), found by the running length of the turns.
    """
    w = Window.partitionBy("conv_id").orderBy("position")
    raw = formatted.select("conv_id", F.posexplode(F.split("formatted", r"(?<=<\|im_end\|>\n)")).alias("position", "piece")).filter("piece <> ''")
    raw = raw.withColumn("head", F.substring_index("piece", "\n", 1)).withColumn("at", F.sum(F.length("piece").cast("long")).over(w) - F.length("piece") + F.length("head") + 1)
    body = F.col("piece").substr(F.length("head") + 2, F.length("piece") - F.length("head") - 1 - len(END) - 1)
    spans = formatted.select(F.col("conv_id").alias("_conv"), F.explode("loss_spans").alias("span")).select("_conv", F.col("span.start").alias("_start"), F.col("span.end").alias("_end"))
    turns = raw.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_start")), "left")
    role = unescape(F.replace(F.expr(f"substr(head, {len(START) + 1})"), F.lit(NEWLINE), F.lit("\n")))
    learned = unescape(F.col("piece").substr(F.length("head") + 2, (F.col("_end") - F.col("_start")).cast("int")))
    return turns.select("conv_id", "position", role.alias("role"), unescape(body).alias("text"), learned.alias("learned"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as the log of an interface that streams, edits and regenerates.

    Rows go by turn, then role and text (nulls first), so ties and repeated rows keep a place of their own: the
    message's position. Its text streams in as two deltas, of which only the first names the role. Every third message
    is then edited: an edit without a role gives the first half again, a delta the rest. Every third is regenerated: what came so
    far is a draft, and the whole text follows as two deltas.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = conversations.select("conv_id", F.row_number().over(w).cast("long").alias("message"), "role", "text")
    half = F.expr("length(text) div 2")
    head, tail = F.col("text").substr(F.lit(1), half), F.expr("substring(text, length(text) div 2 + 1)")

    def event(kind: str, text: Column, role: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))

    streamed = [event("delta", head, F.col("role")), event("delta", tail)]
    edited = [*streamed, event("edit", head), event("delta", tail)]
    again = [streamed[0], event("regenerate", F.lit(None).cast("string")), event("delta", head), event("delta", tail)]
    log = F.when(F.col("message") % 3 == 0, F.array(*edited)).when(F.col("message") % 3 == 1, F.array(*again)).otherwise(F.array(*streamed))
    c = c.select("conv_id", "message", F.posexplode(log).alias("step", "event"))
    return c.select("conv_id", (F.col("message") * 4 + F.col("step")).alias("seq"), "message", "event.kind", "event.role", "event.text")


def op3_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    formatted = cut(render(fold(conversation_events(rows))))
    turns = F.array_sort(F.collect_list(F.struct("position", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "learned")))
    back = read_back(formatted).groupBy("conv_id").agg(turns.alias("turns"))
    back = back.withColumn("learned", F.array_join(F.transform("turns", lambda t: t["learned"]), ""))
    lengths = formatted.select(F.col("conv_id").alias("_conv"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.join(lengths, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: t["turn"]), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP3_SQL = """
with rows as (select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' order by turn, role nulls first, text nulls first)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), '' order by turn, role nulls first, text nulls first) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>' || coalesce(role, '') || chr(10)
    || regexp_replace(coalesce(text, ''), '([<\\[])(\\\\*)(\\||/?INST\\]|/?s>|</?SYS>>)', '\\1\\\\\\2\\3', 'g') || '<|im_end|>' || chr(10)))::bigint as formatted_chars
from rows group by conv_id
"""
