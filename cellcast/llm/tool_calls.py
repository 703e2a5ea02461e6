"""Tool-call linking for chat formatting.

Calls and results meet in a hash join on conversation and call id. A call may name one
that it comes after; calls are put in topological order by doubling the distance to a call
before, one join a round, about log2 of the longest chain in all. Arguments are checked against the tools' schemas, and each call is written with its
result as canonical JSON: sorted keys, no blanks, numbers as JSON writes them.

Everything is DataFrame expressions. A conversation is never brought together: the result
has one row per call, with its level, so that a conversation of any length is spread by its
call ids; ``(topo_level, turn, call_id)`` orders the rows of a conversation.

Of calls with the same id the first (by turn, then content) counts and is marked
``duplicate id``; of results the first likewise. A call without a result is kept with a
null result; a result without a call is left out of the calls and returned by
``unclaimed_results``. A call that names an unknown one is marked ``unknown predecessor``
and stands at level 0; calls on or behind a cycle have a null level and are marked
``cycle``. Null or malformed arguments are marked ``no JSON``, arguments that are no
object ``no object``, unknown tools ``unknown tool``. Rows with a null conversation or
call id are left out. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.llm.components import stored
from cellcast.session import scratch_dir

KEY = ["conv_id", "call_id"]
SCHEMA_COLUMNS = "name string, param string, type string, required boolean, choices array<string>, low double, high double"

# JSON types by the names that schema_of_variant gives them.
_TYPES = [("string", "^STRING$"), ("integer", r"^BIGINT$"), ("number", r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"),
          ("boolean", "^BOOLEAN$"), ("array", "^ARRAY.*"), ("object", "^OBJECT.*")]


def first_of(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per call id: the least by ``columns``, and how many there were."""
    keyed = rows.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    return (keyed.groupBy(*KEY).agg(F.min(F.struct(*columns)).alias("r"), F.count(F.lit(1)).alias("n"))
            .select(*KEY, "r.*", "n"))


def levels(calls: DataFrame, folder: str) -> DataFrame:
    """``(conv_id, call_id, topo_level, dangling)``: the number of calls before each on its chain.

    Each call points to one before it and knows how far that is. A round lets it point to
    where its target points, so distances double and a chain of n calls takes about log2(n)
    rounds. A call whose target is settled is settled itself. In a round that settles none
    every open call lies on or behind a cycle, as each chain has calls of all levels.
    """
    calls = stored(calls.select(*KEY, "after"), f"{folder}/calls")
    ids = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    linked = stored(calls.join(ids, ["conv_id", "after"], "left"), f"{folder}/linked")
    settled = linked.filter(F.col("known").isNull()).select(
        *KEY, F.lit(0).alias("topo_level"), F.col("after").isNotNull().alias("dangling"))
    waiting = linked.filter("known").select(*KEY, F.col("after").alias("target"), F.lit(1).alias("steps"))
    kind, rounds = dict(calls.dtypes)["after"], 0
    while not waiting.isEmpty():
        rounds += 1
        ahead = (settled.select(*KEY, F.lit(None).cast(kind).alias("next"), F.col("topo_level").alias("more"))
                 .unionByName(waiting.select(*KEY, F.col("target").alias("next"), F.col("steps").alias("more")))
                 .withColumnRenamed("call_id", "target"))
        step = stored(waiting.join(ahead, ["conv_id", "target"])
                      .select(*KEY, F.col("next").alias("target"), (F.col("steps") + F.col("more")).alias("steps")),
                      f"{folder}/{rounds}")
        done = step.filter(F.col("target").isNull())
        if done.isEmpty():
            break
        settled = settled.unionByName(done.select(*KEY, F.col("steps").alias("topo_level"), F.lit(False).alias("dangling")))
        waiting = step.filter(F.col("target").isNotNull())
    return settled


def _value_error(p: Column, args: Column) -> Column:
    """What is wrong with one parameter, null if nothing."""
    value = F.element_at(args, p["param"])
    kind = F.schema_of_variant(value)
    right = F.lit(False)
    for name, pattern in _TYPES:
        right = right | ((p["type"] == name) & kind.rlike(pattern))
    number = F.try_variant_get(value, "$", "double")
    # An absent bound and an absent value both compare as null, which is no error.
    wrong_choice = p["choices"].isNotNull() & ~F.array_contains(p["choices"], F.try_variant_get(value, "$", "string"))
    return (F.when(~F.map_contains_key(args, p["param"]), F.when(p["required"], F.concat(F.lit("missing "), p["param"])))
            .when(~right, F.concat(F.lit("type of "), p["param"]))
            .when(wrong_choice, F.concat(F.lit("choice of "), p["param"]))
            .when((number < p["low"]) | (number > p["high"]), F.concat(F.lit("range of "), p["param"])))


def argument_errors(params: Column, variant: Column) -> Column:
    """Sorted findings on a call's arguments (a variant) against its tool's parameters."""
    args = F.try_variant_get(variant, "$", "map<string,variant>")
    known = F.transform(params, lambda p: p["param"])
    unknown = F.transform(F.array_except(F.map_keys(args), known), lambda k: F.concat(F.lit("unknown "), k))
    found = F.concat(F.transform(params, lambda p: _value_error(p, args)), unknown)
    return (F.when(variant.isNull(), F.array(F.lit("no JSON")))
            .when(~F.schema_of_variant(variant).startswith("OBJECT"), F.array(F.lit("no object")))
            .when(params.isNull(), F.array(F.lit("unknown tool")))
            .otherwise(F.array_sort(F.filter(found, lambda x: x.isNotNull()))))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per call: its level, what is wrong with it, and call and result as canonical JSON.

    ``calls`` has ``conv_id, call_id, turn, name, arguments`` (JSON text) and ``after`` (a call
    id or null); ``results`` has ``conv_id, call_id, turn, content``; ``schemas`` has
    ``SCHEMA_COLUMNS``, a handful of rows per tool.
    """
    folder = folder or scratch_dir(calls.sparkSession, "tool-calls")
    calls = stored(first_of(calls, "turn", "name", "arguments", "after"), f"{folder}/first")
    answers = first_of(results, "turn", "content").select(*KEY, F.col("content").alias("result"))
    tools = schemas.groupBy("name").agg(F.collect_list(F.struct(
        "param", "type", F.coalesce("required", F.lit(False)).alias("required"), "choices", "low", "high")).alias("params"))
    order = levels(calls, f"{folder}/levels")
    variant = F.try_parse_json("arguments")
    linked = (calls.join(answers.hint("shuffle_hash"), KEY, "left").join(order.hint("shuffle_hash"), KEY, "left")
              .join(tools, "name", "left").withColumn("variant", variant))
    errors = F.concat(
        argument_errors(F.col("params"), F.col("variant")),
        F.when(F.col("n") > 1, F.array(F.lit("duplicate id"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("topo_level").isNull(), F.array(F.lit("cycle")))
        .when(F.col("dangling"), F.array(F.lit("unknown predecessor"))).otherwise(F.array().cast("array<string>")))
    message = F.to_json(F.struct(F.col("variant").alias("arguments"), F.col("call_id").alias("id"), "name", "result"),
                        {"ignoreNullFields": "false"})
    return linked.select("conv_id", "call_id", "turn", "name", "topo_level", F.col("result").isNotNull().alias("has_result"),
                         F.array_join(errors, "; ").alias("errors"), message.alias("message"))


def unclaimed_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that no call asked for, one per id."""
    return first_of(results, "turn", "content").drop("n").join(
        calls.select(*KEY).distinct().hint("shuffle_hash"), KEY, "left_anti")
