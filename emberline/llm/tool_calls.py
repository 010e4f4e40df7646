"""Tool-call linking in DataFrame operations only.

Messages hold calls and results as JSON: an assistant's text ``{"tool_calls": [{"id", "name",
"arguments", "depends_on"}]}``, a tool's text ``{"tool_call_id", "content"}``. Calls and results are
hash-joined by (conversation, identifier); a result whose identifier is unknown, and a
call without a result, stay with that status. Calls are put in topological order: every
call after those it depends on, otherwise in the order of the conversation. Arguments are
checked against their tool's schema (a table of tool, field, kind, required). Each call
becomes one canonical JSON text: keys in order, no white space, null fields kept.

Order: a call is ready at the latest place of itself and all it depends on, directly or
not; calls are sorted by (ready, hops after the one that made it ready, place). Where all
dependencies point backwards, as in a conversation that happened, that is the order of
the conversation and no round is needed; otherwise rounds pass (ready, hops) on until nothing
changes. A call in a cycle, or that only a cycle makes ready, has no order (null) and status ``cycle``.

Null texts, texts that are not such JSON and null identifiers give no calls or results.
An identifier used twice in a conversation belongs to its first call; the later ones get
status ``repeated``. Results given twice link once, the first. Conversations may be of any
length: no conversation is collected, and joins are on conversation and identifier, so a
long one is spread. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import materialize

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:map<string,variant>,depends_on:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: A schema table's columns: tool, field, kind (string, integer, number, boolean, object or array), required.
PART_TURNS = 1024
SCHEMA = "tool string, field string, kind string, required boolean"


def read_calls(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, place, id, name, arguments, kinds, values, depends_on) of the calls in assistants' messages.

    By argument: its text, the kind of its JSON value (null for null) and the value as JSON with keys in order.
    """
    parsed = messages.filter("role = 'assistant'").select("conv_id", "turn", F.from_json("text", CALLS).alias("m"))

    def kind(v: Column) -> Column:
        name = F.call_function("schema_of_variant", v)
        return (F.when(name.rlike(r"^(BIGINT|DECIMAL\([0-9]+,0\))"), "integer").when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(name == "STRING", "string")
                .when(name == "BOOLEAN", "boolean").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array"))

    def text(v: Column) -> Column:
        return F.when(kind(v) == "string", F.variant_get(v, "$", "string")).when(kind(v).isNotNull(), F.to_json(v))

    def value(v: Column) -> Column:
        return F.when(kind(v) == "string", json_text(F.variant_get(v, "$", "string"))).otherwise(F.coalesce(F.to_json(v), F.lit("null")))

    def each(made) -> Column:
        return F.coalesce(F.transform_values("c.arguments", lambda _, v: made(v)), F.expr("cast(map() AS map<string,string>)"))

    return (parsed.select("conv_id", "turn", F.posexplode("m.tool_calls").alias("number", "c"))
            .filter("c.id IS NOT NULL AND c.name IS NOT NULL")
            .select("conv_id", "turn", F.struct("turn", "number").alias("place"), "c.id", "c.name",
                    each(text).alias("arguments"), each(kind).alias("kinds"), each(value).alias("values"),
                    F.coalesce("c.depends_on", F.expr("cast(array() AS array<string>)")).alias("depends_on")))


def read_results(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, id, content) of tools' messages."""
    parsed = messages.filter("role = 'tool'").select("conv_id", "turn", F.from_json("text", RESULT).alias("m"))
    return parsed.filter("m.tool_call_id IS NOT NULL").select("conv_id", "turn", F.col("m.tool_call_id").alias("id"), F.col("m.content").alias("content"))


def turn_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns as calls and results: a user's turn asks for ``respond`` and the next turn, the assistant's, is its result.

    The call depends on the one of two turns before, if that was a user's. This makes a
    linked trace of any conversation, whether it used tools or not.
    """
    keyed = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn", "role").agg(
        F.min(F.struct("text")).alias("m")).select("conv_id", "turn", "role", "m.text")

    def named(turn: Column) -> Column:
        return F.concat(F.lit("turn-"), turn.cast("string"))

    users = keyed.filter("role = 'user'")
    earlier = users.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("there"))
    calls = users.join(earlier, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.struct("turn", F.lit(0).alias("number")).alias("place"), named(F.col("turn")).alias("id"), F.lit("respond").alias("name"),
        F.map_from_arrays(F.array(F.lit("text"), F.lit("turn")), F.array(F.col("text"), F.col("turn").cast("string"))).alias("arguments"),
        F.map_from_arrays(F.array(F.lit("text"), F.lit("turn")), F.array(F.when(F.col("text").isNotNull(), "string"), F.lit("integer"))).alias("kinds"),
        F.map_from_arrays(F.array(F.lit("text"), F.lit("turn")), F.array(json_text(F.col("text")), F.col("turn").cast("string"))).alias("values"),
        F.when(F.col("there"), F.array(named(F.col("turn") - 2))).otherwise(F.expr("cast(array() AS array<string>)")).alias("depends_on"))
    results = keyed.filter("role = 'assistant'").select("conv_id", "turn", named(F.col("turn") - 1).alias("id"), F.col("text").alias("content"))
    return calls, results


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their first result (content, result_turn), and the results that no call asked for.

    status: ``linked``, ``unanswered``, ``repeated`` (the identifier was used before) or ``orphan``.
    """
    first = Window.partitionBy("conv_id", "id").orderBy("place")
    numbered = calls.withColumn("use", F.row_number().over(first))
    answers = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "content")).alias("r"))
    joined = numbered.join(answers, ["conv_id", "id"], "full")
    status = (F.when(F.col("place").isNull(), "orphan").when(F.col("use") > 1, "repeated")
              .when(F.col("r").isNull(), "unanswered").otherwise("linked"))
    kept = F.col("status").isin("linked", "orphan")
    return joined.withColumn("status", status).select(
        "conv_id", "id", "turn", "place", "name", "arguments", "kinds", "values", "depends_on", "status",
        F.when(kept, F.col("r.content")).alias("content"), F.when(kept, F.col("r.turn")).alias("result_turn"))


def topological(linked: DataFrame) -> DataFrame:
    """(conv_id, id, ready, hops): sort keys of the calls that own their identifier; both null in a cycle or made ready by one."""
    owners = linked.filter("status IN ('linked', 'unanswered')")
    nodes = owners.select("conv_id", "id", "place")
    edges = (owners.select("conv_id", "id", F.col("place").alias("own"), F.explode("depends_on").alias("needs")).distinct()
             .join(nodes.select("conv_id", F.col("id").alias("needs"), F.col("place").alias("theirs")), ["conv_id", "needs"]))
    forward = edges.filter("theirs >= own")
    start = nodes.select("conv_id", "id", F.col("place").alias("ready"), F.lit(0).alias("hops"))
    if forward.isEmpty():
        return start
    # Only conversations with a dependency on a later call need rounds.
    odd = forward.select("conv_id").distinct()
    edges = materialize(edges.join(odd, "conv_id", "left_semi"), "call-edges")
    most = nodes.join(odd, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("n"))
    now = materialize(start.join(odd, "conv_id", "left_semi").join(most, "conv_id"), "call-order")
    while True:
        above = now.select("conv_id", F.col("id").alias("needs"), F.col("ready").alias("their_ready"), F.col("hops").alias("their_hops"))
        passed = (edges.join(above, ["conv_id", "needs"]).filter("their_ready >= own")
                  .groupBy("conv_id", "id").agg(F.max(F.struct(F.col("their_ready").alias("ready"), (F.col("their_hops") + 1).alias("hops"))).alias("p")))
        # hops beyond the number of calls can only come round a cycle; they stop there
        merged = now.join(passed, ["conv_id", "id"], "left").select(
            "conv_id", "id", "n", F.greatest(F.struct("ready", "hops"), F.coalesce("p", F.struct("ready", "hops"))).alias("best"), "ready", "hops")
        after = materialize(merged.select("conv_id", "id", F.col("best.ready").alias("ready"), F.least(F.col("best.hops"), F.col("n")).alias("hops"), "n",
                                          (~F.col("best").eqNullSafe(F.struct("ready", "hops")) & (F.col("hops") < F.col("n"))).alias("moved")), "call-order")
        now = after.drop("moved")
        if after.filter("moved").isEmpty():
            break
    cyclic = F.col("hops") >= F.col("n")
    solved = now.select("conv_id", "id", F.when(~cyclic, F.col("ready")).alias("ready"), F.when(~cyclic, F.col("hops")).alias("hops"))
    return start.join(odd, "conv_id", "left_anti").unionByName(solved)


def validate(linked: DataFrame, schema: DataFrame) -> DataFrame:
    """(conv_id, id, place, errors): ``field:missing``, ``field:kind`` and ``field:unknown``, sorted; ``tool:unknown`` for a tool without schema."""
    tools = schema.groupBy(F.col("tool").alias("name")).agg(F.map_from_entries(F.collect_set(F.struct("field", F.struct("kind", "required")))).alias("fields"))
    value = F.col("arguments")

    def wrong(kind: Column, found: Column) -> Column:
        return F.when(found.isNull() | (found == kind), False).otherwise(~((kind == "number") & (found == "integer")))

    known = F.map_keys("fields")
    missing = F.transform(F.filter(known, lambda f: F.col("fields")[f]["required"] & value[f].isNull()), lambda f: F.concat(f, F.lit(":missing")))
    kinds = F.transform(F.filter(known, lambda f: wrong(F.col("fields")[f]["kind"], F.col("kinds")[f])), lambda f: F.concat(f, F.lit(":kind")))
    unknown = F.transform(F.array_except(F.map_keys(value), known), lambda f: F.concat(f, F.lit(":unknown")))
    errors = F.when(F.col("fields").isNull(), F.array(F.lit("tool:unknown"))).otherwise(F.array_sort(F.concat(missing, kinds, unknown)))
    # schemas are the callers' short table, one row for each tool
    return linked.filter("name IS NOT NULL").join(F.broadcast(tools), "name", "left").select("conv_id", "id", "place", errors.alias("errors"))


def json_text(value: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all else as it is; null for null."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(short))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def canonical(name: Column, arguments: Column, call: Column, content: Column, quoted: bool = True) -> Column:
    """{"arguments":{...},"id":...,"name":...,"result":...} with argument names in order; values are texts to be quoted, or JSON as it is."""
    entries = F.array_sort(F.map_entries(arguments))
    body = F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(e["value"]) if quoted else e["value"])), ",")
    return F.concat(F.lit('{"arguments":{'), body, F.lit('},"id":'), json_text(call), F.lit(',"name":'), json_text(name), F.lit(',"result":'), json_text(content), F.lit("}"))


def link_calls(calls: DataFrame, results: DataFrame, schema: DataFrame) -> DataFrame:
    """(conv_id, id, turn, result_turn, status, position, errors, call_json, typed_json), a row for each call and each orphan result.

    call_json has every argument as a text; typed_json keeps numbers, booleans and nested values as they are, so different calls differ.

    position numbers a conversation's calls in topological order, from 0; repeated, cyclic and orphan rows have none.
    """
    linked = link(calls, results)
    order = topological(linked)
    errors = validate(linked, schema)
    owner = F.col("status").isin("linked", "unanswered")
    joined = linked.join(order, ["conv_id", "id"], "left").join(errors, ["conv_id", "id", "place"], "left")
    ready = owner & F.col("ready").isNotNull()
    # positions by ranges of turns, so that a long conversation is numbered by many tasks
    part = F.when(ready, F.floor(F.col("ready.turn") / PART_TURNS))
    placed = joined.withColumn("part", part)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (placed.filter("part IS NOT NULL").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
             .select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("ready", "hops", "place")) - 1
    text = F.when(F.col("name").isNotNull(), canonical(F.col("name"), F.col("arguments"), F.col("id"), F.col("content")))
    typed = F.when(F.col("name").isNotNull(), canonical(F.col("name"), F.col("values"), F.col("id"), F.col("content"), quoted=False))
    return (placed.withColumn("row", place).join(bases, ["conv_id", "part"], "left").select(
        "conv_id", "id", "turn", "result_turn", F.when(owner & ~ready, "cycle").otherwise(F.col("status")).alias("status"),
        F.when(ready, F.col("row") + F.col("base")).alias("position"), "errors", text.alias("call_json"), typed.alias("typed_json")))
