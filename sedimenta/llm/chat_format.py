"""Chat formatting from an event log (operator 1).

A conversation is a log of events, in any order and perhaps delivered twice:

========== =====================================================================
start      opens a message, with its role; its text, if any, is the first part
delta      a streamed piece, appended to the message
edit       the message's text is replaced
regenerate what was written is dropped; new pieces follow
delete     the message is taken back (a later event may write it again)
========== =====================================================================

Events are put to their conversation, sorted by sequence number and folded into the
final text of each message; messages follow each other in the order of their first
event, and are rendered with a template.  One shuffle, by conversation; the fold is
an expression of Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Before and after a message's text; ``{role}`` stands for the role.
TEMPLATE = ("<|im_start|>{role}\n", "<|im_end|>\n")
DELTA_CHARS = 64


def _fold(events: Column) -> Column:
    """struct(text, alive) after the events, which are in order: what stands behind the last reset, joined once."""
    resets, known = ("edit", "regenerate", "delete"), ("start", "delta", "edit", "regenerate", "delete")
    at = F.greatest(F.array_max(F.transform(events, lambda e, i: F.when(e["kind"].isin(*resets), i))), F.lit(0))
    rest = F.slice(events, at + 1, F.size(events))
    text = F.transform(rest, lambda e: F.when(e["kind"].isin("start", "delta", "edit"), F.coalesce(e["text"], F.lit(""))).otherwise(""))
    last = F.try_element_at(F.filter(events, lambda e: e["kind"].isin(*known)), F.lit(-1))
    return F.struct(F.array_join(text, "").alias("text"), F.coalesce(last["kind"] != "delete", F.lit(False)).alias("alive"))


def messages(log: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, message_id, first_seq, role, text``."""
    e = log.select("conv_id", "seq", "message_id", "kind", "role", "text").where("conv_id IS NOT NULL AND seq IS NOT NULL")
    e = e.repartition("conv_id")  # both groupings below then need no other shuffle
    order = F.struct("seq", F.col("kind").alias("kind"), F.col("text").alias("text"), F.col("role").alias("role"))
    m = e.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_set(order)).alias("events"))
    state = _fold(F.col("events"))
    role = F.filter("events", lambda x: x["role"].isNotNull())
    m = m.select("conv_id", "message_id", F.col("events")[0]["seq"].alias("first_seq"), F.coalesce(F.get(role, F.lit(0))["role"], F.lit("unknown")).alias("role"), state.alias("state"))
    return m.where("state.alive").select("conv_id", "message_id", "first_seq", "role", F.col("state.text").alias("text"))


def rendered(log: DataFrame, template: tuple[str, str] = TEMPLATE) -> DataFrame:
    """Conversations as text: ``conv_id, n_messages, rendered``.

    ``log`` has ``conv_id, seq, message_id, kind, role, text``; other columns are left
    aside.  Equal events count once.  Events of one sequence number follow by kind,
    then text.  Events without conversation or sequence number, and of other or null
    kinds, are left out; null text is empty; events without message id are one
    message.  A message's role is that of its first event that has one, else
    ``unknown``.  Control marks in a text (``<|``) are broken up, so that no text can
    open or close a message.  A conversation without a message left gives no row, an
    empty log an empty result; long texts stay whole.
    """
    before, after = template
    lead = F.replace(F.lit(before), F.lit("{role}"), F.col("role"))
    body = F.concat(lead, F.replace("text", F.lit("<|"), F.lit("< |")), F.lit(after))
    m = messages(log).select("conv_id", F.struct("first_seq", "message_id", body.alias("body")).alias("m"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return g.select("conv_id", F.size("ms").cast("long").alias("n_messages"), F.array_join(F.transform("ms", lambda x: x["body"]), "").alias("rendered"))


def event_log(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The log of a client that wrote ``conversations`` (conv_id, turn, role, text), to be folded back.

    Answers are drafted, dropped and generated anew in pieces of ``delta_chars``; what
    others say is sent, taken back or edited into its final form.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / delta_chars).cast("int")), lambda k: F.substring(text, k * delta_chars + 1, F.lit(delta_chars)))
    event = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    draft = F.substring(text, 1, 20)
    streamed = F.concat(F.array(event("start", F.lit("")), event("delta", draft), event("delta", draft), event("regenerate", F.lit(None).cast("string"))), F.transform(pieces, lambda p: event("delta", p)))
    edited = F.array(event("start", draft), event("delta", F.lit(" ...")), event("delete", F.lit(None).cast("string")), event("delta", draft), event("edit", text))
    events = F.when(F.col("role") == "assistant", streamed).otherwise(edited)
    out = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", F.posexplode(events).alias("k", "e"))
    role = F.when(F.col("e.kind") == "start", F.col("role"))
    return out.select("conv_id", (F.col("turn") * F.lit(1 << 24).cast("long") + F.col("k")).alias("seq"), F.col("turn").alias("message_id"), F.col("e.kind").alias("kind"), role.alias("role"), F.col("e.text").alias("text"))


ORACLE = """
    SELECT conv_id, count(*) AS n_messages,
           string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id
"""
