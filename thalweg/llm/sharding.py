"""Sharding by rendezvous hashing over weighted shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import whole_text

#: Hex digits of a digest that make one fraction: 52 bits, exact in a double.
DIGITS = 13


def fraction(key: Column, shard: Column) -> Column:
    """A number in (0, 1] that only the key and the shard's number decide."""
    digest = F.substring(F.md5(F.concat_ws(":", key, shard.cast("string")).cast("binary")), 1, DIGITS)
    return (F.conv(digest, 16, 10).cast("double") + 1) / float(16**DIGITS)


def offer(key: Column, shard: int, weight: float) -> Column:
    """The shard's bid for a key: the highest bid wins, in proportion to the weights.

    The bid falls with ``-ln(fraction) / weight``; a bid carries the shard's
    number negated, so that of equal bids the smallest number wins.
    """
    bid = F.log(fraction(key, F.lit(shard))) / float(weight)
    return F.struct(bid.alias("bid"), F.lit(-shard).alias("minus"))


def winner(key: Column, weights: list[float], first: int = 0) -> Column:
    offers = [offer(key, first + i, w) for i, w in enumerate(weights)]
    return offers[0] if len(offers) == 1 else F.greatest(*offers)


def assign(docs: DataFrame, key: Column, weights: list[float], grown: float | None = 1.0) -> DataFrame:
    """Add ``shard`` and ``grown_shard``, the shard once one more shard of weight ``grown`` is there.

    Each shard bids on its own, so a new shard can only take rows into itself
    and a removed shard's rows spread over the others by weight.  A null key
    bids as the text ``null``.  Columns of these names are replaced.
    """
    if not weights or min(weights) <= 0 or (grown is not None and grown <= 0):
        raise ValueError("weights must be positive")
    safe = F.coalesce(key.cast("string"), F.lit("null"))
    made = docs.withColumn("__best", winner(safe, weights)).withColumn("shard", (-F.col("__best.minus")).cast("int"))
    if grown is not None:
        more = F.greatest(F.col("__best"), offer(safe, len(weights), grown))
        made = made.withColumn("grown_shard", (-more["minus"]).cast("int"))
    return made.drop("__best")


def slotted(rows: DataFrame, group: str, order: list[str], rows_per_task: int = 500_000) -> DataFrame:
    """Add ``slot``, gapless from 0 within each ``group``, in the order of ``order``.

    Rows are range partitioned by group and order, the last key being the row's
    place in the input, so a group or a key of any size spreads over tasks.
    Counts per partition and group are summed up to offsets; no task sees more
    than its range.  The ranges are stored first: numbers stay the same when a
    task is repeated.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / rows_per_task))
    keys = [group, *order, "__place"]
    placed = stored(
        rows.withColumn("__place", F.monotonically_increasing_id())
        .repartitionByRange(tasks, *keys)
        .withColumn("__range", F.spark_partition_id()),
        "slots",
    )
    counts = placed.groupBy(group, "__range").count()
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("__group"),
        F.col("__range").alias("__part"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"),
    )
    within = Window.partitionBy("__range", group).orderBy(*order, "__place")
    return (
        placed.withColumn("__n", F.row_number().over(within))
        .join(offsets, (F.col("__range") == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group")))
        .withColumn("slot", (F.col("__offset") + F.col("__n") - 1).cast("long"))
        .drop("__place", "__range", "__n", "__part", "__group", "__offset")
    )


def shard_documents(docs: DataFrame, shards: int = 40, weights: list[float] | None = None) -> DataFrame:
    """Where each document goes: one row per input row under the law ``key``.

    ``doc_id`` and the number of shards alone decide, so equal ids meet in one
    shard, whatever their texts, and one more shard takes rows only into
    itself.  Null text counts no bytes (size 16, checksum 0); rows with a null
    id share a shard; repeated rows get a slot each.  Slots follow ``doc_id``,
    then checksum and size.  An empty table gives no rows.  Only id and text
    are read.
    """
    text = whole_text()
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    dealt = assign(plain, F.col("doc_id"), weights or [1.0] * shards)
    placed = slotted(dealt, "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
