"""Queries of this subpackage over the given tables, with production parameters.

``QUERIES`` maps names to callables ``(spark, sf_dir) -> DataFrame``, ``ORACLE_SQL`` to
DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import (
    bpe, chunk_dedup, decontaminate, filter_audit, html_blocks, lexical_search, near_dup, order_minhash, quality, sharding,
    token_counts, tool_calls, toxicity)
from cellcast.llm.oracle import ORACLE_SQL  # noqa: F401
from cellcast.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

VOCABULARY = "byte_bpe_50k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_bpe(spark, sf_dir):
    """Encode and decode every document; counts and digests."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op2_quality_rules(spark, sf_dir):
    """Rule statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op4_sharding(spark, sf_dir):
    """Shard and position of every document, by bytes; and its shard once the map is edited for one more."""
    folder = scratch_dir(spark, "shards")
    # Ids, sizes and checksums are written once: two passes follow, neither reads text.
    sharding.records(table(spark, sf_dir, "documents")).write.parquet(f"{folder}/records")
    rows = spark.read.parquet(f"{folder}/records")
    stored = sharding.store_map(sharding.first_map(sharding.slot_bytes(rows)), f"{folder}/map")
    grown = sharding.store_map(sharding.grow_map(sharding.latest(stored), sharding.N_SHARDS), f"{folder}/map")
    return sharding.place_rows(rows, grown.filter("version = 1"), sharding.latest(grown))


@query
def op6_token_counts(spark, sf_dir):
    """Token counts of every document through a digest cache."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op3_chunk_dedup(spark, sf_dir):
    """Every document without passages that stood in an earlier document."""
    out = chunk_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_chars", "removed", (F.size("removed") > 0).alias("has_repeat"))


@query
def op9_decontamination(spark, sf_dir):
    """Pairs of a document and a benchmark item that it holds."""
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_jaccard_join(spark, sf_dir):
    """Class and number of near-duplicates of every document."""
    return near_dup.jaccard_classes(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op5_main_text(spark, sf_dir):
    """Main text of every page."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


#: The tools that the conversations are read as calling: name, param, type, required, choices, low, high.
TOOLS = [
    ("search", "query", "string", True, None, None, None),
    ("search", "limit", "integer", True, None, 1.0, 50.0),
    ("translate", "text", "string", True, None, None, None),
    ("translate", "target", "string", True, ["en", "de", "fr", "es"], None, None),
    ("count", "text", "string", True, None, None, None),
    ("count", "unit", "string", False, ["chars", "words"], None, None),
]


def tool_traffic(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off the turns: a user's turn calls a tool, and the assistant's
    turn after it is the result. Some arguments break the tools' schemas, by rule."""
    def call_id(turn):
        return F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)

    text, turn, n = F.col("text"), F.col("turn"), F.length("text")
    tool = F.col("conv_id") % 3
    arguments = (
        F.when(tool == 0, F.to_json(F.struct(text.alias("query"), (n % 60).alias("limit"))))
        .when(tool == 1, F.to_json(F.struct(text.alias("text"), F.element_at(
            F.array(*map(F.lit, ["en", "de", "fr", "es", "xx"])), (turn % 5 + 1).cast("int")).alias("target"))))
        .otherwise(F.to_json(F.struct(F.lit("words").alias("unit"), F.when(n % 7 != 0, text).alias("text")))))
    calls = conversations.filter(F.col("role") == "user").select(
        "conv_id", call_id(turn).alias("call_id"), "turn",
        F.element_at(F.array(*map(F.lit, ["search", "translate", "count"])), (tool + 1).cast("int")).alias("name"),
        arguments.alias("arguments"),
        F.when((turn >= 2) & (F.expr("turn div 2") % 4 != 0), call_id(turn - 2)).alias("after"))
    results = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", call_id(turn - 1).alias("call_id"), "turn", text.alias("content"))
    return calls, results


@query
def op7_tool_calls(spark, sf_dir):
    """Every tool call with its result, in topological levels, checked and as canonical JSON."""
    calls, results = tool_traffic(table(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(calls, results, spark.createDataFrame(TOOLS, tool_calls.SCHEMA_COLUMNS))


@query
def op11_filter_audit(spark, sf_dir):
    """What each of five filters removes in every order, by source."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_order_minhash(spark, sf_dir):
    """Fingerprint of every document, of its edited text, and their likenesses."""
    return order_minhash.edited_documents(table(spark, sf_dir, "documents"))


@query
def op13_lexical_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
