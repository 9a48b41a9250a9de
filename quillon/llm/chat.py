"""Chat formatting with tool calls linked to their results.

An assistant turn may be a JSON object with "tool_calls", a list of {"id", "name",
"arguments", "after"}; a tool turn is a JSON object with "tool_call_id" and "content".
Calls and results of a conversation are joined by identifier, ordered topologically
(a result comes after its call, a call after the results of the calls in its "after"),
checked against the tools' schemas and written as canonical JSON: keys sorted, no
spaces, nulls kept. Built-in functions only; no conversation is gathered into one
row, so its length does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Schemas of tools whose number is counted before they are broadcast.
BROADCAST_TOOLS = 10_000
CALLS = "array<struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:variant,after:array<string>>>>>"
RESULT = "array<struct<tool_call_id:string,content:variant>>"
TOOLS = "name string, required array<string>, types map<string,string>"


def _json_type(value: Column) -> Column:
    """JSON Schema's name for a variant's type."""
    t = F.schema_of_variant(value)
    return (
        F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer").when(t == "VOID", "null").otherwise("number")
    )


def valid_arguments(arguments: Column, required: Column, types: Column) -> Column:
    """Whether all required arguments are there and each has its declared type; undeclared ones are refused."""
    args = arguments.try_cast("map<string,variant>")

    def fits(k: Column, v: Column) -> Column:
        want, have = F.try_element_at(types, k), _json_type(v)
        return F.coalesce((want == have) | ((want == "number") & (have == "integer")), F.lit(False))

    complete = F.size(F.array_except(F.coalesce(required, F.array().cast("array<string>")), F.map_keys(args))) == 0
    return F.coalesce(complete & (F.size(F.map_filter(args, lambda k, v: ~fits(k, v))) == 0), F.lit(False))


def _canonical(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def _object(text: Column, schema: str) -> Column:
    """The JSON object that is the whole text, or null.

    Spark's parser takes the first value and passes over what follows; so the text is read
    as the one element of a list, and as a member, which a text with more cannot be both.
    """
    one = F.from_json(F.concat(F.lit("["), text, F.lit("]")), schema)
    alone = (F.size(one) == 1) & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    return F.when(F.ltrim(text).startswith("{") & alone, F.get(one, F.lit(0)))


def _placed(calls: DataFrame, answered: DataFrame) -> DataFrame:
    """(c_conv, c_id, call_turn, call_idx, place): the first call of each identifier, and its place (at_turn, level).

    place is the call's turn, or later where a call before it that is in its "after" is
    answered later: the rounds follow such chains, one for each link that moves a call.
    References to later or unknown calls count for nothing, so that there are no cycles.
    """
    firsts = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "idx", F.coalesce("after", F.array().cast("array<string>")).alias("after"))).alias("c"))
    firsts = firsts.select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id"), F.col("c.turn").alias("call_turn"), F.col("c.idx").alias("call_idx"), F.col("c.after").alias("after"))
    place = F.struct(F.col("call_turn").alias("at_turn"), F.lit(0).alias("level"))
    placed = firsts.drop("after").withColumn("place", place)
    refs = firsts.where(F.size("after") > 0).select("c_conv", "c_id", "call_turn", "call_idx", F.explode(F.array_distinct("after")).alias("ref"))
    if not refs.head(1):
        return placed
    top = shared_dir(calls.sparkSession)
    names = ["conv", "ref_id", "ref_turn", "ref_idx"]
    known = firsts.select("c_conv", "c_id", "call_turn", "call_idx").toDF(*names)
    refs = refs.join(known, (F.col("c_conv") == F.col("conv")) & (F.col("ref") == F.col("ref_id")) & (F.struct("ref_turn", "ref_idx") < F.struct("call_turn", "call_idx")))
    refs = stored(refs.join(answered, (F.col("conv") == F.col("r_conv")) & (F.col("ref_id") == F.col("r_id")), "left").select("conv", "c_id", "ref_id", "result_turn").toDF("conv", "id", "ref_id", "result_turn"), f"{top}/refs")
    placed, k = stored(placed, f"{top}/0"), 0
    while True:
        k += 1
        of = placed.select(F.col("c_conv").alias("v"), F.col("c_id").alias("d"), "place")
        # an answered call's result stands behind the call and where the result is
        after = F.struct(F.col("place.at_turn").alias("at_turn"), (F.col("place.level") + 1).alias("level"))
        result = F.greatest(after, F.struct(F.coalesce("result_turn", F.col("place.at_turn")).alias("at_turn"), F.lit(1).alias("level")))
        least = refs.join(of, (F.col("conv") == F.col("v")) & (F.col("ref_id") == F.col("d"))).groupBy("conv", "id").agg(F.max(result).alias("least"))
        moved = placed.join(least, (F.col("c_conv") == F.col("conv")) & (F.col("c_id") == F.col("id")), "left")
        behind = F.struct(F.col("least.at_turn").alias("at_turn"), (F.col("least.level") + 1).alias("level"))
        new = F.when(F.col("least").isNotNull() & (behind > F.col("place")), behind).otherwise(F.col("place"))
        moved = stored(moved.withColumn("was", F.col("place")).withColumn("place", new).select(*placed.columns, (F.col("place") != F.col("was")).alias("moved")), f"{top}/{k}")
        placed = moved.drop("moved")
        if not moved.where("moved").head(1):
            return placed


def formatted(turns: DataFrame, tools: DataFrame | None = None, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """(conv_id, at_turn, level, turn, idx, kind, call_id, linked, valid, json): a row for each message, call and result.

    Sorted by (at_turn, level, turn, idx), a conversation is in topological order: a
    result that stands before its call is moved behind it, a call behind the results that
    it is to come after. A result is linked to the first call of its identifier; a result
    without a call, or a call without a result, is kept with linked false. valid: whether a
    call's arguments fit its tool's schema; null if the tool is unknown or the row is no
    call. Each turn that is no result gives a message row, with the content that stands
    beside its calls (null if there is none). A null text counts as empty; text that is not
    one such JSON object and nothing else, or that has no calls in its list, is a plain
    message. Texts of any length are whole. Rows with null conversations are kept and never
    linked; null roles stay null in the JSON. Repeated rows are kept; other columns are not read.
    """
    spark = turns.sparkSession
    conv, turn, role, text = (turns[f"`{n}`"] for n in names)
    rows = turns.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("made", F.when(F.col("role") == "assistant", _object(F.col("text"), CALLS)))
    rows = rows.withColumn("got", F.when(F.col("role") == "tool", _object(F.col("text"), RESULT)))
    is_call, is_result = F.coalesce(F.size("made.tool_calls") > 0, F.lit(False)), F.col("got.tool_call_id").isNotNull()
    none = F.lit(None)

    plain = rows.where(~is_result).select(
        "conv_id", F.col("turn").alias("at_turn"), F.lit(0).alias("level"), "turn", F.lit(0).alias("idx"), F.lit("message").alias("kind"), none.cast("string").alias("call_id"), none.cast("boolean").alias("linked"), none.cast("boolean").alias("valid"),
        _canonical({"content": F.when(is_call, F.col("made.content")).otherwise(F.col("text")), "role": F.col("role"), "turn": F.col("turn")}).alias("json"),
    )

    calls = rows.where(is_call).select("conv_id", "turn", F.posexplode("made.tool_calls").alias("idx", "c")).select("conv_id", "turn", "idx", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    results = rows.where(is_result).select("conv_id", "turn", F.col("got.tool_call_id").alias("call_id"), F.col("got.content").alias("content"))
    answered = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn")).withColumnsRenamed({"conv_id": "r_conv", "call_id": "r_id"})
    placed = _placed(calls, answered)

    if tools is None:
        tools = spark.range(0).select(*[F.lit(None).cast(k.split(" ", 1)[1]).alias(k.split(" ", 1)[0]) for k in ("name string", "required array<string>", "types map<string,string>")])
    kinds = tools.select(F.col("name").alias("tool"), "required", "types").dropDuplicates(["tool"])
    kinds = F.broadcast(kinds) if kinds.count() <= BROADCAST_TOOLS else kinds

    calls = calls.join(answered.hint("shuffle_hash"), (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "left").join(kinds, F.col("name") == F.col("tool"), "left")
    # a later call of the same identifier stays where it is
    calls = calls.join(placed.hint("shuffle_hash"), (F.col("conv_id") == F.col("c_conv")) & (F.col("call_id") == F.col("c_id")) & (F.col("turn") == F.col("call_turn")) & (F.col("idx") == F.col("call_idx")), "left")
    valid = F.when(F.col("tool").isNotNull(), valid_arguments(F.col("arguments"), F.col("required"), F.col("types")))
    calls = calls.select(
        "conv_id", F.coalesce("place.at_turn", "turn").alias("at_turn"), F.coalesce("place.level", F.lit(0)).alias("level"), "turn", (F.col("idx") + 1).alias("idx"), F.lit("call").alias("kind"), "call_id", F.col("r_id").isNotNull().alias("linked"), valid.alias("valid"),
        _canonical({"arguments": F.col("arguments"), "id": F.col("call_id"), "name": F.col("name"), "role": F.lit("assistant"), "turn": F.col("turn")}).alias("json"),
    )
    results = results.join(placed.hint("shuffle_hash"), (F.col("conv_id") == F.col("c_conv")) & (F.col("call_id") == F.col("c_id")), "left")
    own = F.struct(F.col("turn").alias("at_turn"), F.lit(1).alias("level"))
    behind = F.struct(F.col("place.at_turn").alias("at_turn"), (F.col("place.level") + 1).alias("level"))
    results = results.withColumn("at", F.when(F.col("place").isNotNull(), F.greatest(own, behind)).otherwise(own)).select(
        "conv_id", "at.at_turn", "at.level", "turn", F.lit(0).alias("idx"), F.lit("result").alias("kind"), "call_id", F.col("c_id").isNotNull().alias("linked"), none.cast("boolean").alias("valid"),
        _canonical({"content": F.col("content"), "role": F.lit("tool"), "tool_call_id": F.col("call_id"), "turn": F.col("turn")}).alias("json"),
    )
    return plain.unionByName(calls).unionByName(results)
