"""Reproducible shuffle and sharding by a Feistel permutation of row numbers.

Every row gets a global row number (its place in the order of id, content hash,
size), a keyed Feistel network with cycle walking permutes ``[0, n)``, and shard
and slot follow from the permuted number by division. Given ``n`` and the key, the
shard and slot of any row number can be computed without the data, and inverted.

All of it is Catalyst expressions: no Python runs on the executors.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Modulus, multipliers and increments of the round function (fixed values).
PRIME = 2147483647
ROUND_KEYS = [(48271, 11), (69621, 101), (16807, 1009), (39373, 10007), (742938285, 100003), (950706376, 1000003)]
#: Steps of cycle walking that an expression unrolls; see :func:`permuted`.
WALK = 64


def halves(n: int) -> tuple[int, int]:
    """Sizes a >= b of the two halves: the least a*b >= n near a square."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def round_value(value, factor, plus, seed: int):
    """The round function, for integers and for Columns; no product passes 2**62."""
    t = (value % PRIME * factor + plus + seed) % PRIME
    return (t * t + value % PRIME + plus) % PRIME


def permuted_int(row: int, n: int, seed: int) -> int:
    """:func:`permuted` for one number, without Spark."""
    a, b = halves(n)
    while True:
        left, right = row // b, row % b
        for k in range(0, len(ROUND_KEYS), 2):
            left = (left + round_value(right, *ROUND_KEYS[k], seed)) % a
            right = (right + round_value(left, *ROUND_KEYS[k + 1], seed)) % b
        row = left * b + right
        if row < n:
            return row


def permuted(row: Column, n: int, seed: int) -> Column:
    """The place of row number ``row`` among ``n``, as an expression.

    The halves live in ``Z_a`` and ``Z_b``, so ``a*b`` is barely above ``n``; a number
    that the network takes outside ``[0, n)`` is put in again (cycle walking). Since
    ``a*b - n < a``, a walk ends after ``a*b - n + 1`` steps at most. Where that exceeds
    WALK, one step fails with probability under ``1/isqrt(n)`` (n > 4096), WALK steps
    with one under 2**-384, and then the query raises rather than give a wrong place.
    """
    a, b = halves(n)
    wide = lambda x: F.lit(x).cast("long")
    keys = [ROUND_KEYS[k] + ROUND_KEYS[k + 1] for k in range(0, len(ROUND_KEYS), 2)]
    rounds = F.array(*[F.struct(*[wide(v).alias(name) for v, name in zip(k, ("f1", "p1", "f2", "p2"), strict=True)]) for k in keys])

    def one_round(s: Column, k: Column) -> Column:
        left = (s["l"] + round_value(s["r"], k["f1"], k["p1"], seed)) % wide(a)
        return F.struct(left.alias("l"), ((s["r"] + round_value(left, k["f2"], k["p2"], seed)) % wide(b)).alias("r"))

    def step(x: Column) -> Column:
        start = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % wide(b)).alias("r"))
        return F.aggregate(rounds, start, one_round, lambda s: s["l"] * wide(b) + s["r"])

    limit = min(WALK, max(0, a * b - n))
    if limit == 0:
        return step(row)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(limit + 1)), row * -1 - 1, lambda x, _: F.when((x >= 0) & (x < n), x).otherwise(step(F.when(x < 0, x * -1 - 1).otherwise(x))))
    return F.when(walk.between(0, n - 1), walk).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` long, gapless from 0 in the given order, and their count.

    A range shuffle sorts them; each partition then numbers its own rows and a table of
    one count per partition shifts them, so no task ever sees all rows. Repeated rows
    are told apart by their place in the input, so they spread over partitions too.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = rows.withColumn("__tie", F.monotonically_increasing_id())
    placed = tie.repartitionByRange(parts, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    fixed = materialise(placed, "numbered")
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition of the shuffle: that count, not the data, bounds what is collected.
    counts = sorted((r["part"], r["n"]) for r in fixed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    shift, total = {}, 0
    for p, n in counts:
        shift[p] = total
        total += n
    if not shift:
        return fixed.select(*rows.columns, F.lit(0).cast("long").alias("row_number")), 0
    starts = spark.createDataFrame([(p, s) for p, s in shift.items()], "__part int, __start long")
    out = fixed.withColumn("__part", part.cast("int")).join(F.broadcast(starts), "__part")
    return out.select(*rows.columns, (local + F.col("__start")).alias("row_number")), total


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 20240) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard,
    row_number, place.

    Law ``rows``: place ``p`` goes to shard ``p % shards``, slot ``p div shards``, so the
    counts of two shards differ by one at most and slots are gapless. ``grown_shard`` is
    null, as it is for every law but ``key``.

    Edge cases: a null text has no bytes (size 16, checksum 0); null ids sort first;
    repeated rows get places of their own; an empty table gives no rows; more shards
    than rows leave the last shards empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    by_number, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    place = by_number.withColumn("place", permuted(F.col("row_number"), max(n, 1), seed))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        ((F.col("place") - F.col("place") % shards) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "place",
    )


def shard_of(row_number: int, n: int, shards: int = 40, seed: int = 20240) -> tuple[int, int]:
    """Shard and slot of a row number, computed without the data."""
    place = permuted_int(row_number, n, seed)
    return place % shards, place // shards


def read_shard(assigned: DataFrame, docs: DataFrame, shard: int) -> DataFrame:
    """The documents of one shard in slot order (ids must be unique for this join)."""
    own = assigned.where(F.col("shard") == shard).select(F.col("doc_id").alias("__id"), F.col("slot").alias("__slot"))
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("__id"))).orderBy("__slot").drop("__id", "__slot")
