"""Chat formatting: tool calls are linked to results, ordered, validated and written as canonical JSON. Native.

A message's text may be a JSON object. An assistant's may hold ``tool_calls``: objects with
``id``, ``name``, ``arguments`` (an object, or a string that holds one) and ``depends_on`` (ids
of calls of the same conversation that must come first). A message of role ``tool`` holds
``tool_call_id`` and ``content``. Any other text is plain content.

Calls are joined with results, and with each other, by conversation and identifier. Nothing is
gathered by conversation: only a message's own calls meet in one row, so a conversation may be
of any length. The order is a topological level: 0 for calls that depend on nothing, else one
more than the deepest dependency. Chains of calls with one dependency each are shortened by
pointer doubling, so their depth costs its logarithm in rounds; the calls with several are then
levelled front by front, until none is left or, in a cycle, none can be.

Canonical JSON has no blanks and sorts the keys of all objects.

Defined cases: a null text has null content; invalid JSON is plain content; of several calls
with one id in a conversation the first by turn and place counts, later ones are errors; the
same holds for results; null ids, null conversations and unknown ids are errors and never link;
rows that repeat conversation and turn are messages of their own, each with its own calls alone,
and of equal calls in equal rows any one counts as the first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import drop_written, written

_CALLS = "array<struct<id: string, name: string, arguments: variant, depends_on: array<string>>>"


def canonical(value: Column) -> Column:
    """A variant as JSON without blanks, keys sorted."""
    return F.to_json(value)


def parsed(text: Column) -> Column:
    """The text as a variant if it looks like a JSON object and is one, else null."""
    return F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))


def tool_schemas(spark, schemas: dict[str, dict]) -> DataFrame:
    """JSON schemas of tools' arguments (``properties`` with a ``type``, ``required``) as rows (tool, param, type, required)."""
    rows = [(tool, name, spec.get("type", "any"), name in schema.get("required", ())) for tool, schema in schemas.items() for name, spec in schema.get("properties", {}).items()]
    rows += [(tool, None, None, False) for tool in schemas]
    return spark.createDataFrame(rows, "tool string, param string, type string, required boolean")


def _is(value: Column, kind: Column) -> Column:
    """Whether a variant has a JSON type by name."""
    found = F.schema_of_variant(value)
    whole = found.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    number = whole | found.isin("DOUBLE", "FLOAT") | found.startswith("DECIMAL")
    return (
        F.when(kind == "any", F.lit(True))
        .when(kind == "string", found == "STRING")
        .when(kind == "integer", whole)
        .when(kind == "number", number)
        .when(kind == "boolean", found == "BOOLEAN")
        .when(kind == "array", found.startswith("ARRAY"))
        .when(kind == "object", found.startswith("OBJECT"))
        .otherwise(F.lit(False))
    )


def tool_calls(messages: DataFrame) -> DataFrame:
    """A row per call: message, conv_id, turn, place, id, name, arguments (variant), depends_on, first (of its id in the conversation).

    ``messages`` has a unique ``message`` column.
    """
    held = messages.filter("role = 'assistant'").select("message", "conv_id", "turn", parsed(F.col("text")).alias("v"))
    calls = held.select("message", "conv_id", "turn", F.posexplode(F.try_variant_get("v", "$.tool_calls", _CALLS)).alias("place", "c")).select("message", "conv_id", "turn", "place", "c.*")
    text = F.try_variant_get("arguments", "$", "string")
    given = F.when(F.schema_of_variant("arguments") == "STRING", F.try_parse_json(text)).otherwise(F.col("arguments"))
    calls = written(calls.withColumn("arguments", given), "calls")
    # partial minima, so an id that very many calls repeat is no hot group
    usable = calls.filter("id is not null and conv_id is not null")
    firsts = usable.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place", "message")).alias("f")).select(F.col("f.message").alias("message"), F.col("f.place").alias("place"), F.lit(True).alias("first"))
    return calls.join(firsts, ["message", "place"], "left").withColumn("first", F.coalesce("first", F.lit(False)))


def tool_results(messages: DataFrame) -> DataFrame:
    """A row per result that counts: conv_id, id, result_turn, content (variant or string as canonical JSON)."""
    held = messages.filter("role = 'tool'").select("conv_id", "turn", parsed(F.col("text")).alias("v"))
    rows = held.select("conv_id", "turn", F.try_variant_get("v", "$.tool_call_id", "string").alias("id"), canonical(F.try_variant_get("v", "$.content", "variant")).alias("content"))
    rows = rows.filter("id is not null and conv_id is not null")
    return rows.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "content")).alias("r")).select("conv_id", "id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"))


def _chains(nodes: DataFrame) -> DataFrame:
    """(conv_id, id, to, d) of the calls with one dependency: the next call down the chain that has none or several, ``d`` steps away.

    Each round doubles the steps. A round that ends no chain is the last: what is left leads to
    a cycle or an unknown id.
    """
    single = F.size("needs") == 1
    ends = nodes.filter(~single).select("conv_id", F.col("id").alias("to"), F.lit(True).alias("done"))
    steps = nodes.filter(single).select("conv_id", "id", F.col("needs")[0].alias("to"), F.lit(1).cast("long").alias("d"))
    state = written(steps.join(ends, ["conv_id", "to"], "left").select("conv_id", "id", "to", "d", F.coalesce("done", F.lit(False)).alias("done")), "chains")
    ended = 0
    while (n := state.filter("done").count()) > ended:
        ended = n
        ahead = state.select("conv_id", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        moved = state.filter("not done").join(ahead, ["conv_id", "to"])  # what meets nothing has an unknown id ahead
        moved = moved.select("conv_id", "id", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done"))
        new = written(state.filter("done").unionByName(moved), "chains")
        drop_written(state)
        state = new
    return state.filter("done").select("conv_id", "id", "to", "d")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of the calls that count; a call in or behind a cycle, or behind an unknown id, has level -1."""
    nodes = written(calls.filter("first").select("conv_id", "id", F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("needs")), "calls")
    chains = _chains(nodes)
    # dependencies of calls with several: the call at the chain's end, and the steps there
    needs = nodes.filter("size(needs) > 1").select("conv_id", "id", F.explode("needs").alias("need"), F.size("needs").alias("total"))
    places = chains.unionByName(nodes.filter("size(needs) <> 1").select("conv_id", "id", F.col("id").alias("to"), F.lit(0).cast("long").alias("d")))
    needs = written(needs.join(places.withColumnRenamed("id", "need"), ["conv_id", "need"]).select("conv_id", "id", "total", "to", "d"), "needs")
    front = written(nodes.filter("size(needs) = 0").select("conv_id", "id", F.lit(0).cast("long").alias("level")), "levels")
    known, met = front, None
    while needs.limit(1).count() and front.limit(1).count():
        more = needs.join(front.select("conv_id", F.col("id").alias("to"), "level"), ["conv_id", "to"]).select("conv_id", "id", "total", (F.col("level") + F.col("d") + 1).alias("level"), F.lit(1).alias("n"))
        # sums over the calls that still wait: how many dependencies are levelled, and the deepest
        sums = (more if met is None else met.unionByName(more)).groupBy("conv_id", "id", "total").agg(F.sum("n").cast("int").alias("n"), F.max("level").alias("level"))
        sums = written(sums, "needs")
        front, met = sums.filter("n = total").select("conv_id", "id", "level"), sums.filter("n < total").select("conv_id", "id", "total", "level", "n")
        known = known.unionByName(front)
    along = chains.join(known.withColumnRenamed("id", "to"), ["conv_id", "to"]).select("conv_id", "id", (F.col("level") + F.col("d")).alias("level"))
    return nodes.select("conv_id", "id").join(known.unionByName(along), ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce("level", F.lit(-1)).cast("int").alias("level"))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(message, place, errors): what is wrong with the arguments of each call, sorted; no row where nothing is."""
    keys = ["message", "place"]
    specs = schemas.groupBy("tool").agg(F.collect_list(F.when(F.col("param").isNotNull(), F.struct("param", "type", "required"))).alias("specs"))
    checked = calls.select(*keys, "name", "arguments", F.try_variant_get("arguments", "$", "map<string, variant>").alias("given")).join(specs, F.col("name") == F.col("tool"), "left")
    wrong = F.filter(
        F.transform(
            "specs",
            lambda s: F.when(s["required"] & ~F.map_contains_key("given", s["param"]), F.concat(F.lit("missing "), s["param"])).when(
                F.map_contains_key("given", s["param"]) & ~_is(F.col("given")[s["param"]], s["type"]), F.concat(F.lit("not of type "), s["type"], F.lit(": "), s["param"])
            ),
        ),
        lambda e: e.isNotNull(),
    )
    extra = F.transform(F.array_except(F.map_keys("given"), F.transform("specs", lambda s: s["param"])), lambda p: F.concat(F.lit("unknown argument "), p))
    errors = (
        F.when(F.col("specs").isNull(), F.array(F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit("")))))
        .when(F.col("given").isNull(), F.array(F.lit("arguments are no object")))
        .otherwise(F.sort_array(F.concat(wrong, extra)))
    )
    return checked.select(*keys, errors.alias("errors")).filter("size(errors) > 0")


def format_chats(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, calls, linked, errors (numbers), json.

    ``json`` has role, turn and content of a plain message; of one with calls also its calls in
    topological order, each with id, name, arguments, level, errors, and the linked result with
    its turn; a tool message names the call it answers.
    """
    messages = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    messages = written(messages.withColumn("message", F.monotonically_increasing_id()), "messages")
    calls = tool_calls(messages)
    plain = F.to_json(F.struct(F.col("text").alias("content"), F.col("role"), F.col("turn")), {"ignoreNullFields": "false"})
    linked = calls.join(tool_results(messages), ["conv_id", "id"], "left").join(levels(calls), ["conv_id", "id"], "left")
    linked = linked.join(argument_errors(calls, schemas), ["message", "place"], "left")
    none = F.array().cast("array<string>")
    errors = F.concat(
        F.coalesce("errors", none),
        F.when(F.col("id").isNull(), F.array(F.lit("no id"))).when(F.col("conv_id").isNull(), F.array(F.lit("no conversation"))).when(~F.col("first"), F.array(F.lit("repeated id"))).otherwise(none),
        F.when(F.col("first") & (F.col("level") < 0), F.array(F.lit("dependencies cannot be ordered"))).otherwise(none),
        F.when(F.col("first") & F.col("result_turn").isNull(), F.array(F.lit("no result"))).otherwise(none),
    )
    counts = F.col("first") & F.col("result_turn").isNotNull()
    body = F.struct(
        canonical(F.col("arguments")).alias("arguments"), errors.alias("errors"), F.col("id"), F.coalesce("level", F.lit(-1)).alias("level"), F.col("name"),
        F.when(counts, F.col("result")).alias("result"), F.when(counts, F.col("result_turn")).alias("result_turn"),
    )
    ordered = F.struct(F.col("level").alias("_l"), F.col("place").alias("_p"), body.alias("body"), counts.alias("counts"), F.size(errors).alias("n"))
    of_message = linked.groupBy("message").agg(F.sort_array(F.collect_list(ordered)).alias("all"))
    out = messages.join(of_message, "message", "left")
    said = parsed(F.col("text"))
    with_calls = F.to_json(F.struct(F.transform("all", lambda c: c["body"]).alias("calls"), F.try_variant_get(said, "$.content", "string").alias("content"), F.col("role"), F.col("turn")), {"ignoreNullFields": "false"})
    content = F.try_variant_get(said, "$.content", "variant")
    content = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(said, "$.content", "string")).otherwise(canonical(content))
    answers = F.try_variant_get(said, "$.tool_call_id", "string")
    tool = F.to_json(F.struct(F.coalesce(content, "text").alias("content"), F.col("role"), answers.alias("tool_call_id"), F.col("turn")), {"ignoreNullFields": "false"})
    sum_of = lambda f: F.coalesce(F.aggregate("all", F.lit(0).cast("long"), lambda s, c: s + f(c)), F.lit(0).cast("long"))
    return out.select(
        "conv_id", "turn", "role",
        F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("calls"),
        sum_of(lambda c: c["counts"].cast("long")).alias("linked"),
        sum_of(lambda c: c["n"].cast("long")).alias("errors"),
        F.when(F.col("all").isNotNull(), with_calls).when(F.col("role") == "tool", tool).otherwise(plain).alias("json"),
    )


def as_tool_use(messages: DataFrame, tool: str = "search", long_text: int = 500) -> DataFrame:
    """Plain conversations as tool use: conv_id, turn, role, text.

    Each assistant message becomes a call of ``tool`` for its text, which depends on the call two
    turns before, if there is one; a user message right after an assistant's is that call's
    result. Calls for more than ``long_text`` characters give their limit as a string, which the
    schema does not allow. Null texts and texts of other roles stay.
    """
    calls = messages.filter("role = 'assistant' and text is not null").select("conv_id", "turn").distinct()
    before = calls.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("after_call"))
    deeper = calls.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("depends"))
    rows = messages.select("conv_id", "turn", "role", "text").join(before, ["conv_id", "turn"], "left").join(deeper, ["conv_id", "turn"], "left")
    name = lambda back: F.concat(F.lit("c"), F.col("turn") - back)
    call = lambda limit: F.to_json(
        F.struct(
            F.col("text").alias("content"),
            F.array(
                F.struct(
                    name(0).alias("id"), F.lit(tool).alias("name"), F.struct(limit.alias("limit"), F.col("text").alias("query")).alias("arguments"),
                    F.when(F.col("depends"), F.array(name(2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
                )
            ).alias("tool_calls"),
        )
    )
    is_call, is_result = (F.col("role") == "assistant") & F.col("text").isNotNull(), (F.col("role") == "user") & F.col("after_call") & F.col("text").isNotNull()
    text = (
        F.when(is_call & (F.length("text") > long_text), call(F.col("turn").cast("string")))
        .when(is_call, call(F.col("turn")))
        .when(is_result, F.to_json(F.struct(F.col("text").alias("content"), name(1).alias("tool_call_id"))))
        .otherwise(F.col("text"))
    )
    return rows.select("conv_id", "turn", F.when(is_result, F.lit("tool")).otherwise(F.col("role")).alias("role"), text.alias("text"))


#: The conversations as tool use, linked, levelled, validated and written; ids and turns are unique there.
ORACLE_SQL = """
WITH a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'assistant'),
l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn - 2 * rn ORDER BY turn) - 1 AS level FROM a),
r AS (SELECT u.conv_id, u.turn, u.text FROM conversations u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1 WHERE u.role = 'user'),
c AS (SELECT l.conv_id, l.turn, l.text, CAST((r.turn IS NOT NULL) AS BIGINT) AS linked,
  CASE WHEN length(l.text) > 500 THEN ['not of type integer: limit'] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN r.turn IS NULL THEN ['no result'] ELSE CAST([] AS VARCHAR[]) END AS errors,
  CASE WHEN length(l.text) > 500 THEN CAST(to_json({'limit': CAST(l.turn AS VARCHAR), 'query': l.text}) AS VARCHAR) ELSE CAST(to_json({'limit': l.turn, 'query': l.text}) AS VARCHAR) END AS arguments,
  l.level, CAST(to_json(r.text) AS VARCHAR) AS result, r.turn AS result_turn
  FROM l LEFT JOIN r ON r.conv_id = l.conv_id AND r.turn = l.turn + 1)
SELECT m.conv_id, m.turn, CASE WHEN r.turn IS NOT NULL THEN 'tool' ELSE m.role END AS role,
CAST((c.turn IS NOT NULL) AS BIGINT) AS calls, coalesce(c.linked, 0) AS linked, CAST(coalesce(len(c.errors), 0) AS BIGINT) AS errors,
CASE WHEN c.turn IS NOT NULL THEN CAST(to_json({'calls': [{'arguments': c.arguments, 'errors': c.errors, 'id': 'c' || c.turn, 'level': c.level, 'name': 'search', 'result': c.result, 'result_turn': c.result_turn}], 'content': m.text, 'role': m.role, 'turn': m.turn}) AS VARCHAR)
WHEN r.turn IS NOT NULL THEN CAST(to_json({'content': m.text, 'role': 'tool', 'tool_call_id': 'c' || (m.turn - 1), 'turn': m.turn}) AS VARCHAR)
ELSE CAST(to_json({'content': m.text, 'role': m.role, 'turn': m.turn}) AS VARCHAR) END AS json
FROM conversations m LEFT JOIN c ON c.conv_id = m.conv_id AND c.turn = m.turn LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn
"""
