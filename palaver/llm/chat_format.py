"""Operator 5: tool-call linking and canonical chat records, with DataFrame functions only.

Calls and results meet in a hash join on (conversation, identifier). Results are reduced to one row for each identifier before the join, so a
hot identifier never multiplies rows. Calls are ordered topologically by the depth of the call they depend on, found
by pointer doubling: about log2(longest chain) joins, each on keys as fine as single calls. Arguments are validated against the
tool's schema, and each exchange is written as JSON with sorted keys and no spaces.

Defined cases: a call without a result is ``unanswered``, a result without a call ``orphan``; of several results the first by turn and content
links and ``n_results`` counts all; calls that share an identifier are all kept with the error ``duplicate_id``; a dependency on an identifier
that no call has counts as none; calls on or behind a cycle have a null depth and the error ``cycle``; null identifiers link with nothing;
arguments that are null or no JSON object have the error ``not_an_object``; an unknown tool has the error ``unknown_tool``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import settle

#: By tool and field: JSON type (string, number, boolean, array or object) and whether it must be there.
SCHEMAS = {"reply": {"text": ("string", True), "turn": ("number", True)}}
#: Prefixes of variant type names by JSON type (fixed names of Spark).
KINDS = {"string": ["STRING"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def argument_errors(tool: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Array of what is wrong with the arguments (JSON text) of a call."""
    parsed = F.try_parse_json(arguments)
    whole = F.schema_of_variant(parsed).startswith("OBJECT")
    result = F.array(F.lit("unknown_tool"))
    for name, fields in schemas.items():
        found = []
        for field, (kind, required) in sorted(fields.items()):
            here = F.schema_of_variant(F.variant_get(parsed, f"$['{field}']", "variant"))
            right = F.lit(False)
            for prefix in KINDS[kind]:
                right = right | here.startswith(prefix)
            absent = here.isNull() | (here == "VOID")
            found.append(F.when(absent, F.lit(f"missing:{field}") if required else F.lit(None)).when(~right, F.lit(f"type:{field}")))
        extra = F.transform(F.array_sort(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*map(F.lit, sorted(fields))))), lambda k: F.concat(F.lit("extra:"), k))
        errors = F.concat(F.array_compact(F.array(*found)), extra)
        result = F.when(tool == name, errors).otherwise(result)
    return F.when(whole, result).otherwise(F.array(F.lit("not_an_object")))


def call_depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): calls before it in its chain; null on or behind a cycle.

    Each round replaces a pointer by that of the call pointed at, which doubles the distance. A call is done when its pointer
    leads nowhere. When a round finishes no call, those left never end.
    """
    known = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("depends_on").alias("depends_on"))
    there = known.select("conv_id", F.col("call_id").alias("depends_on"), F.lit(1).alias("_there"))
    state = settle(
        known.join(there, ["conv_id", "depends_on"], "left").select("conv_id", "call_id", F.when(F.col("_there") == 1, F.col("depends_on")).alias("up"), F.when(F.col("_there") == 1, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("far"))
    )
    left = state.filter("up IS NOT NULL").count()
    while left:
        ahead = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
        state = settle(
            state.join(ahead, ["conv_id", "up"], "left").select("conv_id", "call_id", F.when(F.col("up").isNotNull(), F.col("next")).alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        )
        now = state.filter("up IS NOT NULL").count()
        if now == left:
            break
        left = now
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("far")).alias("depth"), F.col("up").isNotNull().alias("cyclic"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row for each call and each orphaned identifier of results, with status, depth, errors and canonical JSON.

    calls: conv_id, call_id, turn, tool, arguments (JSON text), depends_on; results: conv_id, call_id, turn, content.
    """
    calls = calls.select("conv_id", "call_id", "turn", "tool", "arguments", "depends_on")
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    answers = first.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    twice = calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_calls"))
    about = twice.join(call_depths(calls), ["conv_id", "call_id"], "left")
    about = about.select(F.col("conv_id").alias("a_conv"), F.col("call_id").alias("a_call"), "n_calls", "depth", "cyclic")
    linked = (
        calls.join(about.hint("shuffle_hash"), (calls.conv_id == F.col("a_conv")) & (calls.call_id == F.col("a_call")), "left")
        .drop("a_conv", "a_call")
        .join(answers.hint("shuffle_hash"), (calls.conv_id == F.col("r_conv")) & (calls.call_id == F.col("r_call")), "full_outer")
    )
    is_call = F.col("tool").isNotNull() | F.col("turn").isNotNull()
    marks = F.array_compact(F.array(F.when(F.col("n_calls") > 1, F.lit("duplicate_id")), F.when(F.col("cyclic"), F.lit("cycle"))))
    errors = F.when(is_call, F.concat(argument_errors(F.col("tool"), F.col("arguments"), schemas), marks)).otherwise(F.array().cast("array<string>"))
    status = F.when(~is_call, F.lit("orphan")).when(F.col("n_results").isNull(), F.lit("unanswered")).otherwise(F.lit("linked"))
    rows = linked.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"),
        F.coalesce("call_id", "r_call").alias("call_id"),
        F.col("turn").alias("call_turn"),
        "result_turn",
        "depth",
        status.alias("status"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.array_join(errors, ",").alias("errors"),
        "tool",
        F.try_parse_json("arguments").alias("parsed"),
        "content",
    )
    record = F.to_json(F.struct(F.col("parsed").alias("arguments"), "call_id", "conv_id", F.col("content").alias("result"), "status", "tool"))
    return rows.select("conv_id", "call_id", "call_turn", "result_turn", "depth", "status", "n_results", "errors", record.alias("json"))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain chat as calls and results: a user turn calls ``reply``; any other turn answers the turn before it, whose number is the identifier.

    A user turn depends on the one two turns back, whose answer it has seen.
    """
    turn = F.col("turn").cast("bigint")
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    calls = rows.filter("role = 'user'").select(
        "conv_id", F.col("turn").cast("string").alias("call_id"), "turn", F.lit("reply").alias("tool"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.when(F.col("turn") >= 2, (F.col("turn") - 2).cast("string")).alias("depends_on")
    )
    results = rows.filter("role <> 'user'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def format_turns(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """``link_calls`` over plain chat turns (conv_id, turn, role, text)."""
    return link_calls(*turns_as_calls(messages), schemas)


def message_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written in the messages themselves.

    An assistant text that is JSON with ``tool_calls`` [{id, name, arguments, depends_on}] makes calls; a message of role ``tool`` with JSON {tool_call_id, content} is a result. Other texts make neither.
    """
    form = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:string>>>"
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    calls = rows.filter("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", form)["tool_calls"]).alias("c"))
    results = rows.filter("role = 'tool'").select("conv_id", "turn", F.from_json("text", "struct<tool_call_id:string,content:string>").alias("r"))
    return (
        calls.select("conv_id", F.col("c.id").alias("call_id"), "turn", F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments"), F.col("c.depends_on").alias("depends_on")),
        results.select("conv_id", F.col("r.tool_call_id").alias("call_id"), "turn", F.col("r.content").alias("content")),
    )


SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT * FROM m WHERE role = 'user'), r AS (SELECT * FROM m WHERE role <> 'user'),
d AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, d.depth + 1 FROM d JOIN c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2),
l AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, CAST(coalesce(c.turn, r.turn - 1) AS VARCHAR) AS call_id, c.turn AS call_turn, r.turn AS result_turn,
  CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, c.text AS asked, r.text AS answer
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn - 1)
SELECT l.conv_id, call_id, call_turn, result_turn, depth, status, CAST((result_turn IS NOT NULL) AS INTEGER) AS n_results, '' AS errors,
  '{' || CASE WHEN call_turn IS NOT NULL THEN '"arguments":{"text":' || to_json(asked) || ',"turn":' || call_turn || '},' ELSE '' END
  || '"call_id":"' || call_id || '","conv_id":' || l.conv_id || CASE WHEN answer IS NOT NULL THEN ',"result":' || to_json(answer) ELSE '' END
  || ',"status":"' || status || '"' || CASE WHEN call_turn IS NOT NULL THEN ',"tool":"reply"' ELSE '' END || '}' AS json
FROM l LEFT JOIN d ON l.conv_id = d.conv_id AND l.call_turn = d.turn
"""
