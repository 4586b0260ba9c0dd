"""Tool-call linking of conversations, in DataFrame expressions alone.

Calls and results meet in a hash join by their identifier. Their order is topological: a result comes after its call, a call
after the results that it depends on, and where the transcript keeps to that, its order stays. Only what is out of order is
looked at again, so the rounds follow from the longest way by which calls are put off, not from the length of a transcript. Arguments are validated
against a schema of their tool and everything is written as canonical JSON: keys sorted, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import cut, split_hot

#: Calls that are put off, up to which they are broadcast, about 30 MB; more are joined by a shuffle.
BROADCAST_CALLS = 100_000
#: A schema that plain conversations are checked by: a user's turn is a call of `reply`, the next turn its result.
REPLY = {
    "reply": {
        "required": ["content", "turn"],
        "properties": {"content": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0, "maximum": 5}},
        "additionalProperties": False,
    }
}
# The names that Spark's variants have for the types of JSON schemas.
TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN",
    "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID",
}


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with a call's arguments, sorted; empty if nothing. A tool without a schema is itself an error."""
    value = F.try_parse_json(arguments)
    known = F.lit(False)
    checks = [F.when(value.isNull(), "arguments: not JSON"), F.when(value.isNotNull() & ~F.schema_of_variant(value).rlike("^OBJECT<"), "arguments: not an object")]
    keys = F.json_object_keys(arguments)
    for tool, schema in sorted(schemas.items()):
        own = F.coalesce(name == tool, F.lit(False))
        known = known | own
        properties = schema.get("properties", {})
        for key in schema.get("required", []):
            checks.append(F.when(own & ~F.coalesce(F.array_contains(keys, key), F.lit(False)), f"{key}: required"))
        if schema.get("additionalProperties") is False:
            more = F.array_except(keys, F.array(*map(F.lit, properties)) if properties else F.array().cast("array<string>"))
            checks.append(F.when(own & (F.size(more) > 0), F.concat(F.array_join(F.array_sort(more), " "), F.lit(": not expected"))))
        for key, rule in properties.items():
            path = f"$['{key}']"
            item = F.try_variant_get(value, path, "variant")
            there = own & item.isNotNull()
            if "type" in rule:
                pattern = "|".join(TYPES[t] for t in ([rule["type"]] if isinstance(rule["type"], str) else rule["type"]))
                checks.append(F.when(there & ~F.schema_of_variant(item).rlike(f"^({pattern})$"), f"{key}: type"))
            text, number = F.try_variant_get(value, path, "string"), F.try_variant_get(value, path, "double")
            for word, broken in (
                ("minLength", lambda x, text=text: F.length(text) < x), ("maxLength", lambda x, text=text: F.length(text) > x),
                ("minimum", lambda x, number=number: number < x), ("maximum", lambda x, number=number: number > x),
            ):
                if word in rule:
                    checks.append(F.when(there & broken(F.lit(rule[word])), f"{key}: {word}"))
            if "enum" in rule:
                checks.append(F.when(there & ~text.isin(*map(str, rule["enum"])), f"{key}: enum"))
    checks.append(F.when(~known, F.concat(F.coalesce(name, F.lit("null")), F.lit(": no such tool"))))
    return F.array_sort(F.array_compact(F.array(*checks)))


def events_of(conversations: DataFrame) -> DataFrame:
    """The events of plain conversations (conv_id, turn, role, text): kind, call_id, name, arguments, after, content.

    A user's turn is a call of `reply`, named by its turn; one of several lines is answered after the exchange that comes next,
    so it waits for that. An assistant's turn is the result of the turn before; all else is a message.
    """
    turn = F.col("turn").cast("long")
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    call_id = F.when(F.col("role") == "user", turn).when(F.col("role") == "assistant", turn - 1).cast("string")
    called = F.col("role") == "user"
    return conversations.select(
        "conv_id", turn.alias("turn"), "role", kind.alias("kind"), call_id.alias("call_id"),
        F.when(called, "reply").alias("name"),
        F.when(called, F.to_json(F.struct(F.col("text").alias("content"), turn.alias("turn")))).alias("arguments"),
        F.when(called & F.col("text").contains("\n") & turn.isNotNull(), F.array((turn + 2).cast("string"))).otherwise(F.array().cast("array<string>")).alias("after"),
        F.when(~F.coalesce(called, F.lit(False)), F.col("text")).alias("content"),
    )


def place(turn: Column, depth: Column | int) -> Column:
    """A place in the order of events: a turn, and steps after what stands at that turn."""
    return F.struct(turn.alias("turn"), (F.lit(depth) if isinstance(depth, int) else depth).cast("long").alias("depth"))


def later(at: Column) -> Column:
    return place(at["turn"], at["depth"] + 1)


def _with_few(big: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join with a table that is mostly small: by broadcast, or with the hot keys of `big` dealt to several tasks."""
    if few.count() <= BROADCAST_CALLS:
        return big.join(F.broadcast(few), key, how)
    one, other = split_hot(big, few, [key], F.monotonically_increasing_id())
    return one.join(other, [key, "salt"], how).drop("salt")


def waiting_in_cycles(waits: DataFrame, moved: DataFrame) -> DataFrame:
    """The calls (key) among `moved` that lie on cycles of `waits` (key, for), or between two of them: what is left of
    these links once those are dropped, over and over, that no link leads to or from."""
    keys = moved.select("key")
    edges = _with_few(_with_few(waits.select("key", "for"), keys, "key", "left_semi"), keys.withColumnRenamed("key", "for"), "for", "left_semi")
    edges = cut(edges.distinct(), "edges")
    n = edges.count()
    while n:
        sources = edges.select(F.col("for").alias("key")).distinct()
        targets = edges.select(F.col("key").alias("for")).distinct()
        edges = cut(_with_few(_with_few(edges, sources, "key", "left_semi"), targets, "for", "left_semi"), "edges")
        left = edges.count()
        if left == n:
            break
        n = left
    return edges.select("key").distinct()


def put_off(nodes: DataFrame, waits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calls that can't stay at their own turn: (key, call_at, result_at), the places from which they are in order; and
    those that wait for each other (key), which stay where they are.

    nodes: key, call_turn, result_turn; waits: key, for, call_turn, ready_turn (that of the result it waits for). A round puts off
    the calls that wait for what the round before put off, by a turn or by a step. A cycle would do so for ever: after 2, 4, 8 ...
    rounds the calls put off so far are searched for cycles, whose waits then don't count.
    """
    cyclic = nodes.select("key").limit(0)
    while True:
        live = cut(_with_few(waits.filter("ready_turn IS NOT NULL"), cyclic, "key", "left_anti"), "waits")
        moved = cut(nodes.limit(0).select("key", place(F.col("call_turn"), 0).alias("call_at"), place(F.col("result_turn"), 0).alias("result_at")), "moved")
        ready = live.filter("ready_turn >= call_turn").groupBy("key").agg(F.max(place(F.col("ready_turn"), 1)).alias("ready"))
        rounds, check, found = 0, 2, None
        while found is None:
            ready = cut(ready, "ready")
            own = _with_few(nodes, ready, "key").join(moved.select("key", F.col("call_at").alias("was")), "key", "left")
            was = F.coalesce("was", place(F.col("call_turn"), 0))
            result_at = F.when(F.col("result_turn").isNotNull(), F.greatest(place(F.col("result_turn"), 0), later(F.col("ready"))))
            fresh = cut(own.filter(F.col("ready") > was).select("key", F.col("ready").alias("call_at"), result_at.alias("result_at")), "moved")
            if fresh.isEmpty():
                return moved, cyclic
            moved = cut(_with_few(moved, fresh.select("key"), "key", "left_anti").union(fresh), "moved")
            rounds += 1
            if rounds == check:
                check *= 2
                cycle = cut(waiting_in_cycles(live, moved), "cyclic")
                if not cycle.isEmpty():
                    found = cycle
                    continue
            sources = fresh.filter("result_at IS NOT NULL").select(F.col("key").alias("for"), "result_at")
            ready = _with_few(live.select("key", "for"), sources, "for").groupBy("key").agg(F.max(later(F.col("result_at"))).alias("ready"))
        cyclic = cut(cyclic.union(found), "cyclic")


def link_tool_calls(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link, order, validate and serialise the events of conversations.

    events: conv_id, turn, role, kind (call, result or message), call_id, name, arguments (JSON text), after (call_ids whose
    results the call needs) and content. Returns a row for each row: conv_id, turn, kind, call_id, status, errors, ready_turn,
    depth and json. Sorting a conversation by ready_turn, depth, turn, call_id is a topological order. status: linked;
    no_result or no_call (nothing has its identifier); duplicate (of several calls or results with an identifier all but those
    of the least turn); cyclic (calls that wait for each other, and their results; they stay at their own turns); message (any other kind, null included). errors: of a call, what its arguments lack, and
    `after: ID` for calls it needs that have no result; comma-joined, empty if none. json: the event with sorted keys,
    arguments as JSON where they are that, else as the string that they are. Nulls: a null call_id links with nothing; null conversations are one
    conversation; a null turn counts as before all; null texts are left out of the JSON. Repeated rows stay repeated, each with the
    status of its row; an empty table gives none; other columns don't matter. Identifiers are joined against one row each,
    so repeated ones don't multiply.
    """
    key = F.to_json(F.struct(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").isNull().alias("n"), F.col("call_id").alias("i")))
    named = lambda i: F.to_json(F.struct(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").isNull().alias("n"), i.alias("i")))
    turn = F.coalesce(F.col("turn"), F.lit(-1))
    columns = ["conv_id", "turn", "role", "kind", "call_id", "name", "arguments", "after", "content"]
    rows = events.select(*columns, F.when(F.col("call_id").isNotNull() & F.col("kind").isin("call", "result"), key).alias("key"), turn.alias("at"))
    rows = rows.withColumn("waits", F.transform(F.coalesce("after", F.array().cast("array<string>")), named))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    nodes = cut(rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min(F.when(is_call, F.col("at"))).alias("call_turn"),
        F.min(F.when(is_result, F.col("at"))).alias("result_turn"),
        F.min_by(F.when(is_call, F.col("waits")), F.when(is_call, F.col("at"))).alias("after"),
    ), "nodes")
    spread = F.monotonically_increasing_id()
    needs = nodes.select("key", "call_turn", F.explode("after").alias("for"))
    one, other = split_hot(needs, nodes.select(F.col("key").alias("for"), F.col("result_turn").alias("ready_turn")), ["for"], spread)
    waits = cut(one.join(other, ["for", "salt"], "left").select("key", "for", "call_turn", "ready_turn"), "waits")
    missing = waits.filter("ready_turn IS NULL").groupBy("key").agg(F.collect_set(F.concat(F.lit("after: "), F.get_json_object("for", "$.i"))).alias("missing"))  # as many as a call names
    nodes = nodes.select("key", "call_turn", "result_turn")
    moved, cyclic = put_off(nodes, waits)
    places = nodes.join(moved, "key", "left").join(cyclic.withColumn("cyclic", F.lit(True)), "key", "left").join(missing, "key", "left")
    places = places.withColumns({
        "call_at": F.coalesce("call_at", place(F.col("call_turn"), 0)), "result_at": F.coalesce("result_at", place(F.col("result_turn"), 0)), "cyclic": F.coalesce("cyclic", F.lit(False)),
    })

    # Rows without an identifier need no place, and those of a hot one are dealt to several tasks.
    one, other = split_hot(rows.filter("key IS NOT NULL"), places, ["key"], spread)
    linked = one.join(other, ["key", "salt"], "left").unionByName(rows.filter("key IS NULL"), allowMissingColumns=True)
    other = F.when(is_call, F.col("result_turn")).otherwise(F.col("call_turn"))
    own = F.when(is_call, F.col("call_turn")).otherwise(F.col("result_turn"))
    at = F.when(is_call, F.col("call_at")).otherwise(F.col("result_at"))
    status = (
        F.when(~F.coalesce(is_call | is_result, F.lit(False)), "message").when(F.col("at") > own, "duplicate").when(F.col("cyclic"), "cyclic")
        .when(other.isNotNull(), "linked").when(is_call, "no_result").otherwise("no_call")
    )
    wrong = F.concat(argument_errors(F.col("name"), F.col("arguments"), schemas), F.coalesce(F.array_sort("missing"), F.array().cast("array<string>")))
    parsed = F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant"))
    whole = F.to_json(F.struct(
        parsed.alias("arguments"),
        F.col("content"), F.col("call_id").alias("id"), F.col("kind"), F.col("name"), F.col("role"),
    ))
    duplicate = status == "duplicate"
    return linked.select(
        "conv_id", "turn", "kind", "call_id", status.alias("status"),
        F.when(is_call, F.array_join(wrong, ",")).otherwise("").alias("errors"),
        F.when(duplicate | at.isNull(), F.col("at")).otherwise(at["turn"]).alias("ready_turn"),
        F.when(duplicate | at.isNull(), F.lit(0)).otherwise(at["depth"]).cast("long").alias("depth"),
        whole.alias("json"),
    )
