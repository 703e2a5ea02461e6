"""Document fingerprints by order MinHash.

A text is a sequence of tokens; its k-mers are numbered by their occurrence in the text, so
that repeats count. Each of ``SIZE`` orders of the numbered k-mers selects the ``PICKED``
least ones; these are put back into text order and hashed together. Two texts agree in a
value only if they hold the same selected k-mers in the same order, so that the share of
equal values falls with the edit distance, also where blocks are only moved about. The
orders are turns of one ring of hashes: the ring is sorted once, and every order starts at
another point of it (the k-mers that follow the point are its least).

Everything is a Column expression over arrays of longs, linear in the text but for the two
sorts. ``edited_documents`` pairs every document with the next one by ascending id: ids are
cut into ranges of bounded size, the first document of each range is sent to the range
before it as well, and one window per range looks ahead. Texts are shuffled once. The driver
gets the least key of each range only, at most ``MAX_RANGES`` pairs of numbers.

Tokens are runs without white space; characters of scripts without blanks (South East
Asian ones, and all from U+2E80 on) are a token each. A text of fewer than ``K`` tokens has
one k-mer of all of them; one without tokens, or a null one, has the empty fingerprint. The
likeness of two texts is the share of equal values, 1 if both have the empty fingerprint
and 0 if one has. Null ids come first, as the least number does. Documents with the same id are ordered by the hash
of their text. Rows with equal id and text are one document, whose result is returned for
each of them. The document after the last is the first, so a single one is followed by
itself. An empty table gives an empty result; columns beyond ``doc_id`` and ``text`` are not
read. Texts may have up to 2**28 tokens.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.llm.components import stored
from cellcast.session import scratch_dir

K = 2
PICKED = 2
SIZE = 64
RANGE_BYTES = 32 << 20
MAX_RANGES = 1 << 16
#: Where a null id stands among ids.
NULL_ID = -(1 << 63)
#: Repeats of one row are collapsed before the shuffle from so many on; at most so many kinds of them.
REPEATS, MAX_REPEATED = 1000, 100_000

_POS_BITS = 28
_POS = (1 << _POS_BITS) - 1
_UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{10FFFF}"
TOKEN = rf"[{_UNSPACED}]|[^\x20\x09-\x0D{_UNSPACED}]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(n: Column) -> Column:
    """``0 .. n - 1``."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def numbered_kmers(tokens: Column, k: int = K) -> Column:
    """The k-mers of a sequence of token hashes, numbered by occurrence: a sorted array with
    the hash of k-mer and number in the high bits of each value and its place in the low ones."""
    def kmer(i: Column) -> Column:
        h = F.xxhash64(*[F.get(tokens, i + j) for j in range(k)])
        return h.bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long"))

    n = F.size(tokens)
    kmers = F.sort_array(F.transform(indices(F.when(n > 0, F.greatest(n - k + 1, F.lit(1))).otherwise(0)), kmer))

    def runs(s: Column) -> Column:
        """Equal k-mers stand next to each other in text order; a run's places are their numbers."""
        def begins(i: Column) -> Column:
            return (i == 0) | (F.shiftright(F.get(s, i), _POS_BITS) != F.shiftright(F.get(s, i - 1), _POS_BITS))

        def number(x: Column, nth: Column) -> Column:
            h = F.xxhash64(F.shiftright(x, _POS_BITS), nth)
            return h.bitwiseAND(F.lit(~_POS)).bitwiseOR(x.bitwiseAND(F.lit(_POS)))

        def run(at: Column) -> Column:
            end = F.coalesce(F.get(at["starts"], at["j"] + 1), F.size(s))
            start = F.get(at["starts"], at["j"])
            return F.transform(F.slice(s, start + 1, end - start), number)

        return bind(F.filter(indices(F.size(s)), begins), lambda starts: F.flatten(F.transform(
            indices(F.size(starts)), lambda j: run({"starts": starts, "j": j}))))

    return F.sort_array(bind(kmers, runs))


def first_from(ring: Column, point: Column) -> Column:
    """Index of the first value of a sorted array that is not below a point; 0 after the last."""
    n = F.size(ring)
    bits = F.ceil(F.log2(n + 1)).cast("int")

    def halve(below: Column, bit: Column) -> Column:
        further = below + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((further <= n) & (F.get(ring, further - 1) < point), further).otherwise(below)

    return F.aggregate(F.sequence(bits, F.lit(0), F.lit(-1)), F.lit(0), halve) % n


def fingerprint(text: Column, k: int = K, picked: int = PICKED, size: int = SIZE) -> Column:
    """``size`` values of 32 bits as an array of longs; empty for a text without tokens."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))

    def value(ring: Column, start: Column) -> Column:
        n = F.size(ring)
        # Place above hash, so that sorting restores the order in the text.
        def turned(step: Column) -> Column:
            return bind(F.get(ring, (start + step) % n), lambda x: F.shiftleft(x, 64 - _POS_BITS).bitwiseOR(
                F.shiftrightunsigned(x, _POS_BITS)))

        chosen = F.sort_array(F.transform(F.sequence(F.lit(0), F.least(F.lit(picked), n) - 1), turned))
        return F.xxhash64(F.transform(chosen, lambda x: x.bitwiseAND(F.lit((1 << (64 - _POS_BITS)) - 1)))).bitwiseAND(F.lit(0xFFFFFFFF))

    def signature(ring: Column) -> Column:
        points = F.array(*[F.lit(-(1 << 63) + j * ((1 << 64) // size)) for j in range(size)])
        return F.when(F.size(ring) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(points, lambda p: bind(first_from(ring, p), lambda start: value(ring, start))))

    return bind(tokens, lambda t: bind(numbered_kmers(t, k), signature))


def hex_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal values of two fingerprints."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        F.coalesce(equal, F.lit(0)) / F.greatest(F.size(a), F.size(b), F.lit(1))).cast("double")


def range_bounds(keys: DataFrame, ranges: int) -> tuple[Column, Column]:
    """The least ``(id, hash)`` of each range of keys, as two constant arrays in ascending order."""
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "h")).alias("key")
    dealt = keys.select("doc_id", "h").repartitionByRange(ranges, "doc_id", "h")
    found = sorted((r.key.doc_id, r.key.h) for r in dealt.groupBy(F.spark_partition_id()).agg(least).collect()) or [(0, 0)]
    ids, hashes = (F.split(F.lit(" ".join(map(str, x))), " ").cast("array<bigint>") for x in zip(*found, strict=True))
    return ids, hashes


def _collapsed(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """Rows with their number: one row for those that are repeated very often, others as they are."""
    often = keys.filter(F.col("n") > max(REPEATS, total // MAX_REPEATED)).select(
        F.col("doc_id").alias("key_id"), F.col("h").alias("key_h"))
    one = rows.withColumn("n", F.lit(1).cast("long"))
    if often.isEmpty():
        return one
    hot = F.broadcast(often)  # at most MAX_REPEATED rows
    same = (F.col("h") == F.col("key_h")) & F.col("doc_id").eqNullSafe(F.col("key_id"))
    once = rows.join(hot, same, "left_semi").groupBy("doc_id", "h").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    return one.join(hot, same, "left_anti").unionByName(once)


def edited_documents(docs: DataFrame, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every document with its fingerprint, that of its edited text and their likenesses."""
    folder = folder or scratch_dir(docs.sparkSession, "fingerprints")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    keys = stored(rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text").cast("long")).alias("bytes")),
                  f"{folder}/keys")
    total, size = keys.agg(F.sum("n"), F.sum("bytes")).first()
    bounds = range_bounds(keys, min(MAX_RANGES, max(1, math.ceil((size or 0) / range_bytes))))
    place, h = F.coalesce("doc_id", F.lit(NULL_ID)), F.col("h")

    def at_or_after(k: Column) -> Column:
        return (F.get(bounds[0], k) < place) | ((F.get(bounds[0], k) == place) & (F.get(bounds[1], k) <= h))

    def range_of(below: Column, bit: Column) -> Column:
        further = below + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((further <= F.size(bounds[0])) & at_or_after(further - 1), further).otherwise(below)

    number = F.aggregate(F.sequence(F.lit(MAX_RANGES.bit_length()), F.lit(0), F.lit(-1)), F.lit(0), range_of)
    found = (_collapsed(rows, keys, total or 0).select("*", fingerprint(F.col("text")).alias("print"), number.alias("range")))
    # The first document of each range is a guest behind the last one of the range before.
    before = F.when(F.col("range") == 1, F.size(bounds[0])).otherwise(F.col("range") - 1)
    is_first = (F.get(bounds[0], F.col("range") - 1) == place) & (F.get(bounds[1], F.col("range") - 1) == h)
    homes = F.when(is_first, F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")),
                                     F.struct(before.alias("at"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest"))))
    placed = found.withColumn("home", F.explode(homes)).select(
        F.col("home.at").alias("at"), F.col("home.guest").alias("guest"), "doc_id", "h", "text", "print", "n")
    order = ["at", "guest", "doc_id", "h"]  # null ids first
    once = placed.repartition(F.col("at")).groupBy(*order).agg(
        F.first("text").alias("text"), F.first("print").alias("print"), F.sum("n").alias("n"))
    ahead = Window.partitionBy("at").orderBy(*order[1:])
    pairs = (once.withColumn("next", F.lead("text").over(ahead)).withColumn("next_print", F.lead("print").over(ahead))
             .filter(~F.col("guest")))
    n_chars = F.length("text")
    cut = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - cut), F.substring("next", F.lit(1), cut))
    done = (pairs.select("doc_id", "n", n_chars.cast("long").alias("n_chars"), "print", "next_print", edited.alias("edited"))
            .select("*", fingerprint(F.col("edited")).alias("edited_print")))
    out = done.select(
        "doc_id", "n", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hex_text(F.col("print")).alias("fingerprint"),
        hex_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))
    # Repeats are listed again, REPEATS at a time.
    last = F.col("n") - 1
    return (out.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(REPEATS).cast("long"))))
            .withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(last, F.col("from") + REPEATS - 1))))
            .drop("n", "from", "copy"))
