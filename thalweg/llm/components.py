"""Connected components of a stored list of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or smaller) neighbours under its smallest one.

    The minimum is taken with partial sums and joined back, one row per node,
    so a node with very many links is never gathered in one task.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
    side = both.where("b > a") if large else both
    hung = side.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        hung = hung.unionByName(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return hung.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node that has a link; links are two longs ``a`` and ``b``.

    Each round never makes more links than it takes, is stored in the shared
    folder, and the number of rounds grows with the logarithm of the longest
    chain.  The root is the smallest node of the component.  Null ends and
    links of a node to itself are not links.
    """
    now = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = _digest(now)
    while seen[0]:
        now = stored(_stars(_stars(now, True), False), "links")
        before, seen = seen, _digest(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
