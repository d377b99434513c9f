"""Chat formatting with linked tool calls, in DataFrame functions only.

An assistant message may be a JSON object {"content": ..., "tool_calls": [{"id",
"name", "arguments"}]}, a message of role tool one {"tool_call_id", "content"};
any other text is plain content. Messages are parsed and calls checked once, in one
pass that is written; calls and results of a conversation are then
hash-joined by identifier.

A result depends on its call and nothing depends on a result, so the order of
dependence has two levels, and a message's place is told without its neighbours: a
result stands at the later of the two turns, after the messages of that turn, any other
message at its own turn. (order_turn, order_rank, turn, json) sorts a conversation, every
result after its call; messages of one turn and rank stand in the order of their JSON. One row is returned per message, never a whole
conversation, since a conversation has no size bound.

status: plain; call (all calls valid and answered), invalid_call (a call has no
id or name, an unknown name, or arguments that do not fit the schema),
unanswered_call; result, or unlinked_result (no call has its identifier). Of calls
that share an identifier in a conversation the first gives a result its place. Nulls in
conv_id are one conversation; a null turn gives a null place; null and empty texts are
plain. Very long texts are read whole. Repeated messages keep a row each. An empty table
gives an empty result. Extra columns are ignored.

json: all fields, in alphabetical order, without blanks, null where there is nothing;
arguments too, at every depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import written

#: Tool name -> argument -> (type, required); types: string, integer, number, boolean, array, object.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
}
#: Starts of the names that schema_of_variant gives a value of each type.
TYPES = {
    "string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"],
}


def _is(value: Column, kind: str) -> Column:
    said = F.schema_of_variant(value)
    out = F.lit(False)
    for t in TYPES[kind]:
        out = out | said.startswith(t)
    return out


def _fits(name: Column, args: Column, schemas: dict) -> Column:
    """Whether a call's arguments fit the schema of its name."""
    given = F.map_keys(F.try_variant_get(args, "$", "map<string,variant>"))
    out = F.lit(False)
    for tool, schema in schemas.items():
        ok = F.schema_of_variant(args).startswith("OBJECT") & (F.size(F.array_except(given, F.array(*map(F.lit, schema)).cast("array<string>"))) == 0)
        for arg, (kind, required) in schema.items():
            value = F.try_variant_get(args, f"$.{arg}", "variant")
            ok = ok & F.coalesce(_is(value, kind), F.lit(not required))
        out = F.when(name == tool, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _content(v: Column) -> Column:
    """The content of a parsed message: a string, or the JSON of another value."""
    content = F.try_variant_get(v, "$.content", "variant")
    return F.when(~F.is_variant_null(content), F.coalesce(F.try_variant_get(v, "$.content", "string"), F.to_json(content)))


def _object(**fields: Column) -> Column:
    """A JSON object of fields that are JSON already."""
    parts = [x for i, (name, value) in enumerate(sorted(fields.items())) for x in (F.lit(f'{"," if i else ""}"{name}":'), F.coalesce(value, F.lit("null")))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def parsed_messages(messages: DataFrame, schemas: dict, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(mid, conv_id, turn, role, content, calls, result_of): calls (call_id, name, args, ok) are null in other messages, result_of too."""
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    v = F.when(F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{"), F.try_parse_json("text"))
    rows = rows.withColumn("v", v)
    rows = rows.withColumn("given", F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>")))
    rows = rows.withColumn("result_of", F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")))

    def call(c: Column) -> Column:
        call_id, name, args = F.try_variant_get(c, "$.id", "string"), F.try_variant_get(c, "$.name", "string"), F.try_variant_get(c, "$.arguments", "variant")
        ok = call_id.isNotNull() & _fits(name, args, schemas)
        return F.struct(call_id.alias("call_id"), name.alias("name"), F.to_json(args).alias("args"), ok.alias("ok"))

    plain = F.col("given").isNull() & F.col("result_of").isNull()
    return rows.select(
        F.monotonically_increasing_id().alias("mid"), "conv_id", "turn", "role", F.when(plain, F.col("text")).otherwise(_content(F.col("v"))).alias("content"),
        F.transform("given", call).alias("calls"), "result_of",
    )


def format_chat(
    messages: DataFrame, schemas: dict | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turn, role, order_turn, order_rank, status, json) of each message."""
    rows = written(parsed_messages(messages, SCHEMAS if schemas is None else schemas, conv_col, turn_col, role_col, text_col), "messages")
    results, asking = rows.where("result_of is not null"), rows.where("calls is not null")
    each = asking.select("conv_id", "turn", F.explode("calls.call_id").alias("call_id")).where("call_id is not null")
    first_call = each.groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn")).select(F.col("conv_id").alias("conv2"), F.col("call_id").alias("id2"), "call_turn")
    answers = results.select(F.col("conv_id").alias("conv2"), F.col("result_of").alias("id2")).distinct()
    same = lambda own: F.col("conv_id").eqNullSafe(F.col("conv2")) & (F.col(own) == F.col("id2"))
    content, role = _string(F.col("content")), _string(F.col("role"))
    # the hash tables hold one row for each identifier; many results or calls of one are split by adaptive execution
    answering = results.join(first_call.hint("shuffle_hash"), same("result_of"), "left").select(
        "conv_id", "turn", "role", F.greatest("turn", "call_turn").alias("order_turn"), F.lit(1).alias("order_rank"),
        F.when(F.col("id2").isNull(), "unlinked_result").otherwise("result").alias("status"),
        _object(content=content, role=role, tool_call_id=_string(F.col("result_of"))).alias("json"),
    )
    # a message's calls part, meet their answers and are put together again
    own = ["mid", "conv_id", "turn", "role", "content"]
    call = asking.select(*own, F.posexplode_outer("calls").alias("k", "c")).select(*own, "k", "c", F.col("c.call_id").alias("call_id")).join(answers.hint("shuffle_hash"), same("call_id"), "left")
    part = F.when(F.col("c").isNotNull(), F.struct("k", "c.call_id", "c.name", "c.args", "c.ok", F.col("id2").isNotNull().alias("answered")))
    one = lambda p: _object(arguments=p["args"], id=_string(p["call_id"]), name=_string(p["name"]))
    calling = call.groupBy(*own).agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        "conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("order_rank"),
        F.when(F.exists("parts", lambda p: ~p["ok"]), "invalid_call").when(F.exists("parts", lambda p: ~p["answered"]), "unanswered_call").otherwise("call").alias("status"),
        _object(content=content, role=role, tool_calls=F.concat(F.lit("["), F.array_join(F.transform("parts", one), ","), F.lit("]"))).alias("json"),
    )
    plain = rows.where("calls is null and result_of is null").select(
        "conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("order_rank"), F.lit("plain").alias("status"),
        _object(content=content, role=role).alias("json"),
    )
    return plain.unionByName(calling).unionByName(answering)


def _string(s: Column) -> Column:
    """A JSON string, or null."""
    listed = F.to_json(F.array(s))
    return F.when(s.isNull(), F.lit("null")).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))
