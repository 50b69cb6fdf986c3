"""Chat formatting: tool calls linked to their results, ordered, validated and serialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from frameprobe.llm.tables import settled

#: For each tool, for each argument: type, whether it is required, least length of a string.
Schemas = dict[str, dict[str, tuple[str, bool, int]]]

#: Types of a schema, and what an argument's value is called.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN",
         "array": "ARRAY<.*", "object": "OBJECT<.*"}


def valid_arguments(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the parsed arguments (variant) are an object with what the schema of the tool asks for.

    An argument of null counts as missing; arguments beyond the schema are allowed; a tool without
    a schema, or arguments that are not JSON, are invalid.
    """
    result = F.lit(False)
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    for tool, fields in schemas.items():
        ok = is_object
        for field, (kind, required, least) in fields.items():
            value = F.try_variant_get(arguments, f"$['{field}']", "variant")
            found = F.schema_of_variant(value)
            missing = found.isNull() | (found == "VOID")
            fits = found.rlike(f"^(?:{TYPES[kind]})$")
            if kind == "integer":  # 1.0 and 1e0 are whole numbers, and so are those beyond 64 bits
                number = F.try_variant_get(arguments, f"$['{field}']", "double")
                fits = fits | (found.rlike(f"^(?:{TYPES['number']})$") & (number == F.rint(number)))
            if kind == "string" and least:
                fits = fits & (F.length(F.try_variant_get(arguments, f"$['{field}']", "string")) >= least)
            ok = ok & F.when(missing, F.lit(not required)).otherwise(fits)
        result = F.when(name == tool, ok).otherwise(result)
    return F.coalesce(result, F.lit(False))


#: A string of a JSON text, or a number without a fraction that is written with one.
_POINT_ZERO = r'("(?:[^"\\]++|\\.)*+")|(-?[0-9]+)\.0+(?=[,}\]])'


def canonical(json: Column) -> Column:
    """JSON text with whole numbers in one form: 1.0 and 1e0 are written as 1.

    Keys are in order and blanks gone already. Doubles from 10^7 on keep their exponent.
    """
    return F.when(json.contains(".0"), F.regexp_replace(json, _POINT_ZERO, "$1$2")).otherwise(json)


def _ordered(calls: DataFrame) -> DataFrame:
    """Adds ``level``: 0 where a conversation's calls only wait for earlier ones, so that their
    positions order them; else the length of the longest chain of calls before a call, null on a
    cycle and behind one. Calls that wait for an unknown call do not wait.
    """
    known = calls.select("conv_id", F.col("call_id").alias("dep"), F.col("position").alias("dep_position"))
    waits = (calls.select("conv_id", "call_id", "position", F.explode("after").alias("dep"))
             .join(known, ["conv_id", "dep"]).select("conv_id", "call_id", "position", "dep", "dep_position"))
    waits = settled(waits.distinct())
    odd = settled(waits.where("dep_position >= position").select("conv_id").distinct())
    plain = calls.join(odd, "conv_id", "left_anti").withColumn("level", F.lit(0))
    if odd.isEmpty():
        return plain
    waits = settled(waits.join(odd, "conv_id", "left_semi"))
    rest = calls.join(odd, "conv_id", "left_semi")
    placed = settled(rest.select("conv_id", "call_id").distinct()
                     .join(waits, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    level, more = 0, True
    while more:
        level += 1
        free = (waits.join(placed.select("conv_id", F.col("call_id").alias("dep"), F.lit(1).alias("ready")),
                           ["conv_id", "dep"], "left")
                .groupBy("conv_id", "call_id").agg(F.min(F.coalesce("ready", F.lit(0))).alias("ready"))
                .where("ready = 1").join(placed, ["conv_id", "call_id"], "left_anti")
                .select("conv_id", "call_id", F.lit(level).alias("level")))
        free = settled(free)
        more = not free.isEmpty()
        placed = settled(placed.unionByName(free))
    return plain.unionByName(rest.join(placed, ["conv_id", "call_id"], "left"))


def linked(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call, and for each result without a call: conv_id, call_id, position, seq,
    result_position, status, valid, json.

    ``calls`` has conv_id, call_id, position, name, arguments (JSON) and after (ids of calls that
    must come first); ``results`` has conv_id, call_id, position and content. They meet in a hash
    join by conv_id and call_id. Of several results the first by position counts (then by
    content), of equal calls each is linked. ``seq`` numbers the calls of a conversation in an order
    that respects ``after`` (position, then call_id, among calls that may come next); calls on a
    cycle have none and status cyclic. Other states: linked, unanswered, orphan (a result that
    no call asked for, or without an id). ``json`` has its keys in order, no blanks and whole numbers
    without a fraction; null fields are left out. Arguments that are not JSON, or repeat a key, are
    invalid and stay in ``json`` as text under ``raw``. Very long texts are linked whole; extra
    columns are not read; tables without rows give none.
    """
    first = (results.where("call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "call_id")
             .agg(F.min(F.struct("position", "content")).alias("r")))
    keyed = _ordered(calls.withColumn("call_id", F.coalesce("call_id", F.lit(""))))
    met = keyed.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    order = Window.partitionBy("conv_id").orderBy("level", "position", "call_id")
    seq = F.when(F.col("level").isNotNull(),
                 F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(
                     order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parsed = F.try_parse_json("arguments")
    status = (F.when(F.col("level").isNull(), "cyclic").when(F.col("r").isNull(), "unanswered").otherwise("linked"))
    rows = met.select(
        "conv_id", "call_id", "position", seq.alias("seq"), F.col("r.position").alias("result_position"),
        status.alias("status"), valid_arguments(F.col("name"), parsed, schemas).alias("valid"),
        canonical(F.to_json(F.struct(
            parsed.alias("arguments"), F.col("call_id").alias("id"), F.col("name"),
            F.when(parsed.isNull(), F.col("arguments")).alias("raw"), F.col("r.content").alias("result")))).alias("json"))
    ids = calls.select("conv_id", "call_id").where("call_id IS NOT NULL").distinct()
    orphans = results.join(ids, ["conv_id", "call_id"], "left_anti").select(
        "conv_id", "call_id", F.lit(None).cast("long").alias("position"), F.lit(None).cast("int").alias("seq"),
        F.col("position").alias("result_position"), F.lit("orphan").alias("status"), F.lit(False).alias("valid"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("json"))
    return rows.unionByName(orphans)


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results: a user turn calls ``reply`` with its text and waits for
    the one before it; an assistant turn is the result of the last user turn before it."""
    text = turns.select("conv_id", "turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    own = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.col("turn").cast("string"))
    last = F.last(F.when(F.col("role") == "user", own), ignorenulls=True).over(before)
    named = text.withColumn("last", last)
    calls = named.where("role = 'user'").select(
        "conv_id", own.alias("call_id"), F.col("turn").alias("position"), F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"),
        F.filter(F.array("last"), lambda x: x.isNotNull()).alias("after"))
    results = named.where("role = 'assistant'").select(
        "conv_id", F.col("last").alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return calls, results


def repeated(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results that ``linked`` passes over, as rows of its columns with status duplicate: all but
    the first (by position, then content) of those that answer one call."""
    asked = calls.select("conv_id", "call_id").where("call_id IS NOT NULL").distinct()
    nth = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("position", "content"))
    more = results.join(asked, ["conv_id", "call_id"], "left_semi").withColumn("nth", nth).where("nth > 1")
    return more.select(
        "conv_id", "call_id", F.lit(None).cast("long").alias("position"), F.lit(None).cast("int").alias("seq"),
        F.col("position").alias("result_position"), F.lit("duplicate").alias("status"), F.lit(False).alias("valid"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("json"))


def every_turn(turns: DataFrame) -> DataFrame:
    """Each turn of plain conversations in one row: ``linked`` for user turns and their first answers,
    further answers as duplicate, and turns of other roles at their position with status system or
    other, role and text in ``json``. Null roles are other; a null conversation is one of its own; very
    long texts stay whole; extra columns are not read; a table without rows gives none."""
    calls, results = turns_as_calls(turns)
    others = turns.where("role IS NULL OR role NOT IN ('user', 'assistant')").select(
        "conv_id", F.lit(None).cast("string").alias("call_id"), F.col("turn").cast("long").alias("position"),
        F.lit(None).cast("int").alias("seq"), F.lit(None).cast("long").alias("result_position"),
        F.when(F.col("role") == "system", "system").otherwise("other").alias("status"), F.lit(False).alias("valid"),
        F.to_json(F.struct("role", "text")).alias("json"))
    return linked(calls, results, REPLY).unionByName(repeated(calls, results)).unionByName(others)


#: What the calls of plain conversations must hold.
REPLY: Schemas = {"reply": {"text": ("string", True, 1), "turn": ("integer", True, 0)}}
