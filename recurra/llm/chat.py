"""Chat formatting from an event log, with DataFrame functions only.

A log row says what happened at one sequence number of a conversation: text streamed into a message (`delta`), a
message replaced (`edit`), or thrown away to be streamed again (`regenerate`). Messages are folded first, each from
its own events, then put in order and rendered.

* Events of equal sequence number are taken in the order regenerate, edit, delta, then by text.
* A null text is empty; a null role is an empty role; a null turn comes first; a null event is a delta.
* Repeated rows of a log are events of their own. Extra columns are ignored. An empty log gives an empty result.
* A message and a rendered conversation are single values, so their length is bounded by what a value may hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template. Texts never hold "<" once escaped, so none of them can occur in a text.
TURN_OPEN, ROLE_END, TURN_CLOSE = "<turn:", ">", "</turn>"


def escape(text: Column) -> Column:
    r"""Reversible: a backslash becomes \e, then "<" becomes \l and ">" becomes \g."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Inverse of escape: every backslash of an escaped text begins one of its codes."""
    out = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def fold_messages(log: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text) of the final messages of log(conv_id, turn, copy, seq, event, role, text).

    `copy` tells messages of one turn apart. Grouped by message, so a conversation that holds most of the log is
    spread over its messages. The last edit or regenerate decides where a text begins; deltas after it are appended.
    The role is the last one named.
    """
    kind = F.coalesce("event", F.lit("delta"))
    rank = F.when(kind == "regenerate", 0).when(kind == "edit", 1).otherwise(2)
    event = F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), "role")
    keys = ("conv_id", "turn", "copy")
    ordered = log.groupBy(*keys).agg(F.array_sort(F.collect_list(event)).alias("e"))
    reset = F.array_max(F.transform("e", lambda e, i: F.when(e["rank"] < 2, i)))
    living = ordered.select(*keys, "e", F.coalesce(reset, F.lit(0)).alias("reset"))
    rest = F.slice("e", F.col("reset") + 1, F.size("e"))
    text = F.array_join(F.transform(rest, lambda e: F.when(e["rank"] == 0, "").otherwise(e["text"])), "")
    roles = F.filter(F.transform("e", lambda e: e["role"]), lambda r: r.isNotNull())
    return living.select(*keys, F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) of messages(conv_id, turn, copy, role, text).

    loss: places (index of the turn, start, length) of the texts to learn, in code points of the turn's segment.
    """
    head = F.concat(F.lit(TURN_OPEN), escape(F.col("role")), F.lit(ROLE_END))
    body = escape(F.col("text"))
    segment = F.struct(
        "turn",
        "copy",
        F.concat(head, body, F.lit(TURN_CLOSE)).alias("segment"),
        F.when(F.col("role") == learn, F.struct(F.length(head).alias("start"), F.length(body).alias("length"))).alias("span"),
    )
    whole = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("s"))
    spans = F.transform("s", lambda s, i: F.when(
        s["span"].isNotNull(),
        F.struct(i.alias("index"), s["span"]["start"].alias("start"), s["span"]["length"].alias("length")),
    ))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("s", lambda s: s["segment"]), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, learned): roles and texts of rendered conversations, and the texts under the loss mask."""
    parts = F.split("formatted", TURN_CLOSE)
    cut = formatted.select("*", F.slice(parts, 1, F.size(parts) - 1).alias("parts"))
    at = F.length(F.lit(TURN_OPEN))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, ROLE_END, 1)
        return F.struct(
            unescape(F.substring(role, at + 1, F.length(role))).alias("role"),
            unescape(F.substring(part, F.length(role) + 2, F.length(part))).alias("text"),
        )

    def learned(span: Column) -> Column:
        return unescape(F.substring(F.get("parts", span["index"]), span["start"] + 1, span["length"]))

    return cut.select(
        "conv_id", "formatted", F.transform("parts", turn).alias("turns"), F.transform("loss", learned).alias("learned")
    )


def log_of_turns(turns: DataFrame, chunk: int = 256) -> DataFrame:
    """An event log that ends in the given rows (conv_id, turn, role, text): every text is streamed in chunks.

    Texts of assistants come after a draft that is regenerated; others replace a first version by an edit. Rows of
    equal conversation and turn stay messages of their own, ordered by role and text.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.coalesce("role", F.lit("")), text)
    twins = turns.select("conv_id", "turn", "role", text.alias("text"), key.alias("k"))
    grouped = twins.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("k", "role", "text"))).alias("r"))
    rows = grouped.select("conv_id", "turn", F.posexplode("r").alias("copy", "r"))
    rows = rows.select("conv_id", "turn", "copy", "r.role", "r.text")
    whole = F.floor((F.length("text") + chunk - 1) / chunk).cast("int")
    first = F.substring("text", 1, chunk)

    def delta(i: Column) -> Column:
        return F.struct(F.lit("delta").alias("event"), F.substring(F.col("text"), (i * chunk + 1).cast("int"), F.lit(chunk)).alias("text"))

    def event(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("event"), value.alias("text"))

    none = F.array().cast("array<struct<event:string,text:string>>")
    streamed = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), delta)).otherwise(none)
    started = F.when(whole > 1, F.transform(F.sequence(F.lit(1), whole - 1), delta)).otherwise(none)
    events = F.when(
        F.col("role") == "assistant",
        F.concat(F.array(event("delta", first), event("regenerate", F.lit(None).cast("string"))), streamed),
    ).otherwise(F.concat(F.array(event("delta", F.upper("text")), event("edit", first)), started))
    return rows.select("conv_id", "turn", "copy", "role", F.posexplode(events).alias("seq", "e")).select(
        "conv_id", "turn", "copy", "seq", "e.event", "role", "e.text"
    )


def format_conversations(log: DataFrame, learn: str = "assistant") -> DataFrame:
    """Final messages of a log, rendered: one row per conversation."""
    return render(fold_messages(log), learn)
