"""River network traversal over an edge table ``comid, tocomid, length_km``.

Reach ``comid`` flows into reach ``tocomid``.  The distance of a reach from the
start is the length of all reaches on the shortest way, without the start's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .reach_labels import Labels, label_network, upstream_of, upstream_of_one

__all__ = ["MAX_KM", "Labels", "Ways", "label_network", "network_role", "network_scope", "network_ways", "upstream", "upstream_many"]

MAX_KM = 999.0


def _with_way(known: DataFrame, ways: DataFrame, max_km: float) -> DataFrame:
    """Known reaches, and those one way further upstream.

    ``ways`` has a way of no length from each reach to itself, so ``known`` is
    read once and the plan stays linear over the rounds; and the join is an
    inner one, of which adaptive execution can split either side.
    """
    k, w = known.alias("k"), ways.alias("w")
    return (
        k.join(w, F.col("k.comid") == F.col("w.tocomid"))
        .select("k.start", "w.comid", (F.col("k.distance_km") + F.col("w.km")).alias("distance_km"))
        .where(F.col("distance_km") <= max_km)
        .groupBy("start", "comid")
        .agg(F.min("distance_km").alias("distance_km"))
    )


@dataclass(frozen=True)
class Ways:
    """Stored ways of 1, 2, 4, ... steps between reaches, and the reaches, for any number of searches."""

    levels: tuple[DataFrame, ...]
    reaches: DataFrame
    max_km: float


def network_ways(edges: DataFrame, max_km: float = MAX_KM) -> Ways:
    """The ways of a network of up to ``max_km``, built and stored once.

    Ways of 1, 2, 4, ... steps are each built from two halves, until none is
    left; every number of steps is a sum of these, so a river of ten thousand
    reaches takes fourteen rounds instead of ten thousand.  Parallel channels
    keep the shortest way.  An unknown length (null or NaN) counts as none: the
    reach and the river above it are kept.  A negative one fails the job.  So
    the shortest way never repeats a reach and has fewer steps than there are
    edges: that ends the search in data that runs in circles.  The ways between
    members of a loop can be as many as its pairs within ``max_km``; the limit
    is what bounds them.
    """
    km = F.coalesce(F.nanvl(F.col("length_km").cast("double"), F.lit(0.0)), F.lit(0.0))
    km = F.when(km < 0, F.raise_error(F.lit("negative length_km"))).otherwise(km)
    jumps = stored(
        edges.where("comid IS NOT NULL AND tocomid IS NOT NULL")
        .groupBy("comid", "tocomid")
        .agg(F.min(km).alias("km"))
        .where(F.col("km") <= max_km),
        "jumps",
    )
    reaches = edges.select("comid").unionByName(edges.select(F.col("tocomid").alias("comid")))
    reaches = stored(reaches.where("comid IS NOT NULL").distinct(), "reaches")
    longest = left = jumps.count()
    levels = []
    while left and 2 ** len(levels) <= longest:
        levels.append(jumps)
        a, b = jumps.alias("a"), jumps.alias("b")
        jumps = stored(
            a.join(b, F.col("a.tocomid") == F.col("b.comid"))
            .select(F.col("a.comid"), F.col("b.tocomid"), (F.col("a.km") + F.col("b.km")).alias("km"))
            .where(F.col("km") <= max_km)
            .groupBy("comid", "tocomid")
            .agg(F.min("km").alias("km")),
            "jumps",
        )
        left = jumps.count()
    return Ways(tuple(levels), reaches, max_km)


def upstream_many(edges: DataFrame | Ways | Labels, starts: DataFrame, max_km: float | None = None) -> DataFrame:
    """All reaches that drain to each start within ``max_km``: ``start, comid, distance_km``.

    The limit is 999 km, or that of the ways given, if none is named.  Takes
    the network's edges; or the labels that ``label_network`` has stored for
    them, which answer any question by ranges of numbers and read each start's
    whole range; or the ways of ``network_ways``, which suit very many starts
    with a short limit, and serve searches of no greater distance.
    """
    if isinstance(edges, Labels):
        return upstream_of(edges, starts, MAX_KM if max_km is None else max_km)
    ways = edges if isinstance(edges, Ways) else network_ways(edges, MAX_KM if max_km is None else max_km)
    max_km = ways.max_km if max_km is None else max_km
    if ways.max_km < max_km:
        raise ValueError(f"the ways end at {ways.max_km} km")
    begin = starts.select(F.col("comid").alias("start")).where("start IS NOT NULL").distinct()
    known = begin.select("start", F.col("start").alias("comid"), F.lit(0.0).alias("distance_km"))
    reaches = ways.reaches.unionByName(begin.select(F.col("start").alias("comid"))).distinct()
    stay = stored(reaches.select("comid", F.col("comid").alias("tocomid"), F.lit(0.0).alias("km")), "stay")
    for jumps in ways.levels:
        known = _with_way(known, jumps.unionByName(stay), max_km)
    return known


def upstream(edges: DataFrame | Ways | Labels, start: int, max_km: float | None = None) -> DataFrame:
    """The start and all reaches that drain to it within ``max_km``: ``comid, distance_km``.

    Of a labelled network without side arms it is one filtered scan.
    """
    if isinstance(edges, Labels):
        return upstream_of_one(edges, start, MAX_KM if max_km is None else max_km)
    # A range keeps the start a column: as a literal it would turn the first join into a filter and a broadcast.
    spark = (edges.reaches if isinstance(edges, Ways) else edges).sparkSession
    first = spark.range(start, start + 1)
    return upstream_many(edges, first.select(F.col("id").alias("comid")), max_km).select("comid", "distance_km")


def network_scope(selected: DataFrame, tributaries: DataFrame, watershed: DataFrame) -> DataFrame:
    """Each reach once with ``is_upstream``: selected and tributary reaches, then the watershed's others."""
    up = selected.select("comid").unionByName(tributaries.select("comid")).withColumn("is_upstream", F.lit(True))
    rest = watershed.select("comid").withColumn("is_upstream", F.lit(False))
    return up.unionByName(rest).where("comid IS NOT NULL").groupBy("comid").agg(
        F.max("is_upstream").alias("is_upstream")
    )


def network_role(reaches: DataFrame, selected: DataFrame, tributaries: DataFrame) -> DataFrame:
    """Add ``role``: selected, upstream or other."""
    marks = (
        selected.select("comid", F.lit(2).alias("rank"))
        .unionByName(tributaries.select("comid", F.lit(1).alias("rank")))
        .groupBy("comid")
        .agg(F.max("rank").alias("rank"))
    )
    role = F.when(F.col("rank") == 2, "selected").when(F.col("rank") == 1, "upstream").otherwise("other")
    return reaches.join(marks, "comid", "left").withColumn("role", role).drop("rank")
