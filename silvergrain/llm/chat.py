"""Chat formatting with tool-call linking.

Messages carry tool calls (identifier, name, arguments as JSON) and may be the result of a
call. Results are joined to calls by conversation and identifier, a result is ordered after
the message that made its call however the log had them, arguments are checked against the
tool's schema, and every message is written as one line of canonical JSON: keys sorted, no
white space, no nulls, arguments sorted at every depth.

The result has one row a message. ``anchor_turn`` and ``level`` order the messages of a
conversation: a message stands at its own turn, level 0; the result of a call stands at the
later of its own turn and its call's place, a level deeper than the call if at the same turn.
Rows, not arrays, hold a conversation, so one of any length is spread over tasks.

Edge cases: a result whose call is missing is kept, not linked; of calls that share an
identifier in a conversation the first (by turn, name, arguments) is linked; calls that form
a circle or depend on one keep their own turns, and no other call is touched; null texts give
no ``content``; null identifiers link with nothing; arguments that are no JSON object, or of
a tool without a schema, are not valid; repeated rows stay repeated; other columns pass
through, and those that bear an output's name give way.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written

CALLS = "array<struct<id:string,name:string,arguments:string>>"
#: Rows that are no results are dealt to so many parts a conversation.
SALTS = 64
#: JSON types of a schema, as Spark names them in a variant.
VARIANT_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}

#: {tool: {field: (type, required)}}
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def parse_messages(messages: DataFrame, text: str = "text", role: str = "role") -> DataFrame:
    """Adds ``content``, ``calls`` and ``result_of`` from texts in JSON.

    An assistant's text may be ``{"content", "tool_calls": [{"id", "name", "arguments"}]}``, a
    tool's ``{"content", "tool_call_id"}``; any other text is plain content.
    """
    shape = f"content string, tool_calls {CALLS}, tool_call_id string"
    looks = F.ltrim(F.col(text)).startswith("{") & F.col(role).isin("assistant", "tool")
    parsed = F.when(looks, F.from_json(F.col(text), shape))
    used = (F.coalesce(parsed["tool_calls"].isNotNull(), F.lit(False))) | (F.coalesce(parsed["tool_call_id"].isNotNull(), F.lit(False)))
    return messages.withColumns({
        "content": F.when(used, parsed["content"]).otherwise(F.col(text)),
        "calls": F.when(used & (F.col(role) == "assistant"), parsed["tool_calls"]),
        "result_of": F.when(used & (F.col(role) == "tool"), parsed["tool_call_id"]),
    })


def reply_links(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role", chained: bool = False) -> DataFrame:
    """``parse_messages`` for plain chats: a user's message calls the tool ``ask``, the assistant's next turn is its result.

    If ``chained``, an assistant's message calls the tool ``wait`` as well, whose result is the
    user's next turn, so each turn hangs on the one before.
    """
    parsed = parse_messages(messages, text, role)
    name = lambda t: F.concat(F.col(conv).cast("string"), F.lit(":"), t.cast("string"))
    call = lambda tool, arguments: F.array(F.struct(name(F.col(turn)).alias("id"), F.lit(tool).alias("name"), F.to_json(F.struct(*arguments)).alias("arguments"))).cast(CALLS)
    calls = F.when(F.col(role) == "user", call("ask", [F.col(text).alias("text"), F.length(text).alias("n_chars")]))
    answers = F.when(F.col(role) == "assistant", name(F.col(turn) - 1))
    if chained:
        calls = calls.when(F.col(role) == "assistant", call("wait", [F.col(turn).alias("turn")]))
        answers = answers.when(F.col(role) == "user", name(F.col(turn) - 1))
    return parsed.withColumns({"calls": F.coalesce("calls", calls), "result_of": F.coalesce("result_of", answers)})


def logged_backwards(messages: DataFrame, turn: str = "turn", every: int = 4, name: str = "logged") -> DataFrame:
    """``messages`` with the place ``name`` they get from a log that is flushed ``every`` messages, the last first."""
    behind = F.pmod(F.col(turn), F.lit(every))
    return messages.withColumn(name, F.col(turn) - behind + (every - 1) - behind)


def valid_arguments(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the arguments are a JSON object that fits the tool's schema, without unknown fields."""
    value = F.try_parse_json(arguments)
    fields = F.map_keys(F.from_json(arguments, "map<string,string>"))
    out = F.lit(False)
    for tool, schema in schemas.items():
        fits = F.size(F.array_except(fields, F.array(*map(F.lit, schema)) if schema else F.expr("array()").cast("array<string>"))) == 0
        for field, (kind, required) in schema.items():
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            there = F.array_contains(fields, field)
            fits = fits & F.when(there, F.coalesce(got.rlike(f"^{VARIANT_TYPES[kind]}$"), F.lit(False))).otherwise(F.lit(not required))
        out = F.when(name == tool, F.coalesce(fits, F.lit(False))).otherwise(out)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), out).otherwise(F.lit(False))


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys at every depth and no white space; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(arguments))


def format_chats(messages: DataFrame, schemas: Schemas, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """``messages`` (with ``content``, ``calls``, ``result_of``) with their place and canonical JSON.

    Added: ``call_turn`` and ``linked`` for results, ``n_calls``, ``valid`` (all calls of the
    message have valid arguments), ``anchor_turn``, ``level`` and ``json``.
    """
    messages = messages.drop("call_turn", "linked", "n_calls", "valid", "anchor_turn", "level", "json")
    calls = (
        messages.where(F.size("calls") > 0)
        .select(F.col(conv).alias("__c"), F.col(turn).alias("call_turn"), "result_of", F.explode("calls").alias("call"))
        .groupBy("__c", F.col("call.id").alias("__id"))
        .agg(F.min(F.struct("call_turn", F.col("call.name"), F.col("call.arguments"), "result_of")).alias("first"))
        .select("__c", "__id", F.col("first.call_turn").alias("call_turn"), F.col("first.result_of").alias("__up"))
        .where(F.col("__id").isNotNull())
    )
    calls = _place_calls(calls)
    # rows that are no results match nothing; they are dealt by a salt, not all to one task a conversation
    none = F.when(F.col("result_of").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)) + 1).otherwise(0)
    same = (F.col(conv) == F.col("__c")) & (F.col("result_of") == F.col("__id")) & (F.col("__none") == F.col("__call_none"))
    linked = messages.withColumn("__none", none).join(calls.withColumn("__call_none", F.lit(0).cast("long")).hint("shuffle_hash"), same, "left").drop("__c", "__id", "__up", "__none", "__call_none")
    is_linked = F.col("call_turn").isNotNull()
    at = F.when(is_linked, F.greatest(F.col(turn), F.col("__at"))).otherwise(F.col(turn))
    level = F.when(is_linked & (F.col("__at") >= F.coalesce(F.col(turn), F.col("__at"))), F.col("__level") + 1).otherwise(F.lit(0))
    checked = F.transform("calls", lambda c: F.struct(canonical(c["arguments"]).alias("arguments"), c["id"].alias("id"), c["name"].alias("name"), valid_arguments(c["name"], c["arguments"], schemas).alias("valid")))
    line = F.to_json(F.struct(
        F.col("content").alias("content"),
        F.col(role).alias("role"),
        F.col("result_of").alias("tool_call_id"),
        F.transform("__calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name"))).alias("tool_calls"),
    ))
    return (
        linked.withColumn("__calls", checked)
        .withColumns({"linked": is_linked, "n_calls": F.greatest(F.size("__calls"), F.lit(0)), "valid": F.coalesce(F.forall("__calls", lambda c: c["valid"]), F.lit(True)), "anchor_turn": at, "level": level, "json": line})
        .drop("__calls", "__at", "__level")
    )


def _place_calls(calls: DataFrame) -> DataFrame:
    """Adds ``__at`` and ``__level`` of the message that makes each call.

    That is the greatest of (turn, steps up) over the call and all calls above it, found by
    pointer jumping: each round doubles the steps behind ``__jump``. Lengths of chains have no
    gaps, so when a round ends no chain the rest are circles and what depends on them.
    """
    calls = calls.withColumns({"__at": F.col("call_turn"), "__level": F.lit(0), "__jump": F.col("__up")})
    if not calls.where(F.col("__jump").isNotNull()).limit(1).count():
        return calls.drop("__jump")
    calls = written(calls, "call-places")
    ended, moving, steps, left = [calls.where(F.col("__jump").isNull())], calls.where(F.col("__jump").isNotNull()), 1, -1
    while True:
        every = reduce(DataFrame.union, [*ended, moving])
        up = every.select(F.col("__c").alias("__uc"), F.col("__id").alias("__uid"), F.col("__at").alias("__uat"), (F.col("__level") + steps).alias("__ulevel"), F.col("__jump").alias("__ujump"))
        moved = moving.join(up.hint("shuffle_hash"), (F.col("__c") == F.col("__uc")) & (F.col("__jump") == F.col("__uid")), "left")
        behind = F.col("__uid").isNotNull() & F.coalesce(F.struct(F.col("__uat").alias("a"), F.col("__ulevel").alias("l")) > F.struct(F.col("__at").alias("a"), F.col("__level").alias("l")), F.lit(False))
        now = written(moved.select("__c", "__id", "call_turn", "__up", F.when(behind, F.col("__uat")).otherwise(F.col("__at")).alias("__at"), F.when(behind, F.col("__ulevel")).otherwise(F.col("__level")).alias("__level"), F.col("__ujump").alias("__jump")), "call-places")
        ended.append(now.where(F.col("__jump").isNull()))  # chains that have come to their first call move no more
        moving, before, steps = now.where(F.col("__jump").isNotNull()), left, 2 * steps
        left = moving.count()
        if left in (0, before):
            break
    circles = moving.withColumns({"__at": F.col("call_turn"), "__level": F.lit(0)})
    return reduce(DataFrame.union, [*ended, circles]).drop("__jump")
