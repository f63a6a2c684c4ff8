"""Labels that turn "upstream of" into a range: a river network numbered once, for any number of questions.

Every reach drains by one chosen way, so the ways make a forest.  Its reaches
are numbered so that all above a reach have the numbers from its ``first`` to
its ``last``; ``depth_km`` is the length of the way to the outlet.  What lies
upstream of a reach is a range of numbers, its distance a difference.  Channels
beyond the forest (side arms, loops) are a small table of gates.

Numbers come from rounds of joins that double the distance they look ahead, so
their count is the logarithm of the river's depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stored

#: Children of a reach that are numbered in one task.
SIBLINGS = 10_000
#: A way counts as shorter if it is by more than this share: sums of lengths differ in their last digits.
_SHORTER = 1e-9
#: Width of a block of numbers over that of its parts.
_STEP = 4


@dataclass(frozen=True)
class Labels:
    """Stored labels ``comid, tree, first, last, depth_km``, and gates: channels that the forest doesn't hold."""

    reaches: DataFrame
    gates: DataFrame | None


def _climbed(forest: DataFrame, value: str, sizes: bool = False) -> DataFrame:
    """Per reach its ``tree`` and the total of ``value`` down to the outlet, and if wanted its ``size`` with all above.

    ``forest`` has ``comid, parent`` and the value, parent null at an outlet.
    After round k a row has looked 2**k reaches ahead; where it still sees one,
    the next round adds what that one has gathered.  Reaches that run in a
    circle never see an outlet: they come back with ``up`` set.
    """
    state = forest.select("comid", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.col("comid")).alias("tree"),
                          F.col(value).alias("total"), F.col("comid").alias("least"), F.lit(1).cast("long").alias("size"))
    state = stored(state, "climb")
    count, ahead = state.count(), 1
    while ahead <= count and state.where("up IS NOT NULL").limit(1).count():
        next_ = state.select(F.col("comid").alias("at"), F.col("up").alias("next_up"), F.col("tree").alias("next_tree"),
                             F.col("total").alias("next_total"), F.col("least").alias("next_least"))
        joined = state.join(next_, F.col("up") == F.col("at"), "left")
        total = F.col("total") + F.coalesce("next_total", F.lit(0).cast(state.schema["total"].dataType))
        size = F.col("size")
        if sizes:
            above = state.where("up IS NOT NULL").groupBy(F.col("up").alias("below")).agg(F.sum("size").alias("more"))
            joined = joined.join(above, F.col("comid") == F.col("below"), "left")
            size = size + F.coalesce("more", F.lit(0))
        state = stored(
            joined.select(
                "comid", F.col("next_up").alias("up"), F.coalesce("tree", "next_tree").alias("tree"), total.alias("total"),
                F.least("least", "next_least").alias("least"), size.alias("size"),
            ),
            "climb",
        )
        ahead *= 2
    return state


def _without_circles(forest: DataFrame, climbed: DataFrame) -> DataFrame:
    """The forest with every circle cut below its reach of the smallest id, which becomes an outlet."""
    # who is seen from further away than there are reaches is part of a circle
    circle = climbed.where("up IS NOT NULL").select(F.col("up").alias("comid")).distinct()
    cut = climbed.where("up IS NOT NULL AND comid = least").select("comid").join(circle, "comid", "left_semi")
    marked = forest.join(cut.select(F.col("comid").alias("cut_at")), F.col("comid") == F.col("cut_at"), "left")
    outlet = F.col("cut_at").isNotNull()
    parent = F.when(~outlet, F.col("parent"))
    return stored(marked.select("comid", parent.alias("parent"), F.when(outlet, 0.0).otherwise(F.col("km")).alias("km")), "forest")


def _shortest(channels: DataFrame, forest: DataFrame, climbed: DataFrame) -> DataFrame:
    """The forest in which every reach takes its shortest way to an outlet: reaches change over while any gains by it.

    All that gain change at once.  Every change makes a way shorter, so the
    result is a forest again and the rounds end; a few are usual.
    """
    while True:
        depths = climbed.select(F.col("comid").alias("at"), F.col("total").alias("depth"))
        offers = (
            channels.join(depths, F.col("tocomid") == F.col("at"))
            .select("comid", F.struct((F.col("depth") + F.col("km")).alias("way"), "tocomid", "km").alias("offer"))
            .groupBy("comid")
            .agg(F.min("offer").alias("offer"))
        )
        # an outlet has nothing to gain; who has no channel to a known reach keeps what it has
        now = forest.where("parent IS NOT NULL").join(depths, F.col("comid") == F.col("at"))
        gains = F.col("offer.way") < F.col("depth") * (1 - _SHORTER)
        better = now.join(offers, "comid").where(gains).select(F.col("comid").alias("changed"), F.col("offer.tocomid").alias("to"), F.col("offer.km").alias("to_km"))
        better = stored(better, "better")
        if not better.limit(1).count():
            return forest
        changed = F.col("to").isNotNull()
        forest = stored(
            forest.join(better, F.col("comid") == F.col("changed"), "left").select(
                "comid", F.coalesce("to", "parent").alias("parent"), F.when(changed, F.col("to_km")).otherwise(F.col("km")).alias("km")
            ),
            "forest",
        )
        climbed = _climbed(forest, "km")


def _numbered(forest: DataFrame, sizes: DataFrame) -> DataFrame:
    """``comid, parent, step``: by how much a reach's number is above that of the reach below it.

    Children follow each other by bucket and id.  A reach with very many
    children has many buckets, so no task holds them all.
    """
    rows = forest.where("parent IS NOT NULL").join(sizes.select("comid", "size"), "comid")
    buckets = rows.groupBy("parent").agg(F.ceil(F.count(F.lit(1)) / F.lit(SIBLINGS)).alias("buckets"))
    dealt = stored(rows.join(buckets, "parent").withColumn("bucket", F.pmod(F.xxhash64("comid"), F.col("buckets"))), "siblings")
    before = lambda *by, order: F.coalesce(
        F.sum("size").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = dealt.groupBy("parent", "bucket").agg(F.sum("size").alias("size"))
    starts = starts.select("parent", "bucket", before("parent", order="bucket").alias("start"))
    within = dealt.select("comid", "parent", "bucket", before("parent", "bucket", order="comid").alias("place"))
    stepped = within.join(starts, ["parent", "bucket"]).select("comid", "parent", (1 + F.col("start") + F.col("place")).alias("step"))
    outlets = forest.where("parent IS NULL").select("comid", "parent", F.lit(0).cast("long").alias("step"))
    return stepped.unionByName(outlets)


def label_network(edges: DataFrame) -> Labels:
    """Labels of a network ``comid, tocomid, length_km``, built and stored once.

    A reach with several channels is numbered along its shortest way; the
    others become gates, as does the channel that closes a circle.  An unknown
    length (null or NaN) counts as none, a negative one fails the job; parallel
    channels to one reach keep the shortest.
    """
    km = F.coalesce(F.nanvl(F.col("length_km").cast("double"), F.lit(0.0)), F.lit(0.0))
    km = F.when(km < 0, F.raise_error(F.lit("negative length_km"))).otherwise(km)
    whole = edges.where("comid IS NOT NULL AND tocomid IS NOT NULL").where("comid <> tocomid")
    channels = stored(whole.groupBy("comid", "tocomid").agg(F.min(km).alias("km")), "channels")
    ids = edges.select("comid").unionByName(edges.select(F.col("tocomid").alias("comid"))).where("comid IS NOT NULL").distinct()
    chosen = channels.groupBy(F.col("comid").alias("from")).agg(F.min(F.struct("km", "tocomid")).alias("by"))
    forest = ids.join(chosen, F.col("comid") == F.col("from"), "left").select(
        "comid", F.col("by.tocomid").alias("parent"), F.coalesce("by.km", F.lit(0.0)).alias("km")
    )
    forest = stored(forest, "forest")
    several = channels.count() > forest.where("parent IS NOT NULL").count()
    measured = _climbed(forest, "km", sizes=True)
    if measured.where("up IS NOT NULL").limit(1).count():
        forest = _without_circles(forest, measured)
        measured = _climbed(forest, "km", sizes=True)
    if several:
        shortest = _shortest(channels, forest, measured)
        measured = measured if shortest is forest else _climbed(shortest, "km", sizes=True)
        forest = shortest
    placed = _climbed(_numbered(forest, measured), "step")
    labels = measured.select("comid", "tree", F.col("total").alias("depth_km"), "size").join(
        placed.select(F.col("comid").alias("placed"), F.col("total").alias("first")), F.col("comid") == F.col("placed")
    )
    labels = labels.select("comid", "tree", "first", (F.col("first") + F.col("size") - 1).alias("last"), "depth_km")
    # sorted by number, so a range of numbers is a range of files
    tasks = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    labels = stored(labels.repartitionByRange(tasks, "tree", "first").sortWithinPartitions("tree", "first"), "labels")
    gates = stored(_gates(channels, forest, labels), "gates")
    return Labels(labels, gates if gates.limit(1).count() else None)


def _gates(channels: DataFrame, forest: DataFrame, labels: DataFrame) -> DataFrame:
    """Channels outside the forest, with the labels of the reach they leave and of the reach they enter."""
    used = forest.where("parent IS NOT NULL").select("comid", F.col("parent").alias("tocomid"))
    extra = channels.join(used, ["comid", "tocomid"], "left_anti")
    named = lambda p: labels.select(*[F.col(c).alias(f"{p}_{c}") for c in labels.columns])
    leaves = extra.join(named("from"), F.col("comid") == F.col("from_comid"))
    return leaves.join(named("to"), F.col("tocomid") == F.col("to_comid")).select(
        "km", "from_comid", "from_tree", "from_first", "from_last", "from_depth_km", "to_tree", "to_first", "to_depth_km"
    )


def _block(number: Column, level: Column) -> Column:
    return F.floor(number / F.pow(F.lit(float(_STEP)), level.cast("double"))).cast("long")


def _within(points: DataFrame, tree: str, number: str, entries: DataFrame) -> DataFrame:
    """Points joined to the entries in whose range their number lies.

    A range is listed in the one or two blocks of numbers, as wide as itself,
    that it touches; points look up their block of each width that occurs.
    """
    level = F.ceil(F.log(float(_STEP), (F.col("last") - F.col("first") + 1).cast("double"))).cast("int")
    ranges = entries.withColumn("level", level)
    levels = sorted(r.level for r in ranges.select("level").distinct().collect())  # at most a few dozen
    at = F.col("level")
    ranges = ranges.withColumn("block", F.explode(F.sequence(_block(F.col("first"), at), _block(F.col("last"), at))))
    ranges = ranges.withColumnsRenamed({"tree": "range_tree", "level": "range_level", "block": "range_block"})
    looked = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    looked = looked.withColumn("block", _block(F.col(number), at))
    met = looked.join(
        broadcast_if_small(ranges),
        (F.col(tree) == F.col("range_tree")) & (at == F.col("range_level")) & (F.col("block") == F.col("range_block")) & F.col(number).between(F.col("first"), F.col("last")),
    )
    return met.drop("range_tree", "range_level", "range_block", "level", "block")


_ENTRY = ("start", "comid", "tree", "first", "last", "depth_km", "at_km")


def _entries(labels: Labels, begin: DataFrame, max_km: float) -> DataFrame:
    """Reaches whose range is upstream of a start, with the shortest way to them: the start, and what gates open.

    Distances within a range are shortest already, so a gate matters only if
    it leaves a reach outside the range that it enters.  Rounds go on while a
    gate opens or shortens something: chains of side arms are short.
    """
    starts = labels.reaches.join(broadcast_if_small(begin), F.col("comid") == F.col("start")).withColumn("at_km", F.lit(0.0))
    known = new = stored(starts.select(*_ENTRY), "entries")
    while labels.gates is not None:
        # the gate's own columns carry the names of an entry's, so the range it enters goes by others
        met = _within(labels.gates, "to_tree", "to_first", new.withColumnsRenamed({"comid": "by", "depth_km": "by_depth"}).select("start", "by", "tree", "first", "last", "by_depth", "at_km", F.col("tree").alias("by_tree")))
        inside = (F.col("from_tree") == F.col("by_tree")) & F.col("from_first").between(F.col("first"), F.col("last"))
        at_km = F.col("at_km") + F.col("to_depth_km") - F.col("by_depth") + F.col("km")
        opened = met.where(~inside & (at_km <= max_km)).select(
            "start", F.col("from_comid").alias("comid"), F.col("from_tree").alias("tree"), F.col("from_first").alias("first"),
            F.col("from_last").alias("last"), F.col("from_depth_km").alias("depth_km"), at_km.alias("at_km"),
        )
        nearest = opened.groupBy(*_ENTRY[:-1]).agg(F.min("at_km").alias("at_km"))
        before = known.select(F.col("start").alias("s"), F.col("comid").alias("c"), F.col("at_km").alias("before"))
        fresh = nearest.join(before, (F.col("start") == F.col("s")) & (F.col("comid") == F.col("c")), "left")
        new = stored(fresh.where("before IS NULL OR at_km < before").select(*_ENTRY), "entries")
        if not new.limit(1).count():
            break
        known = stored(known.unionByName(new).groupBy(*_ENTRY[:-1]).agg(F.min("at_km").alias("at_km")), "entries")
    return known


def upstream_of(labels: Labels, starts: DataFrame, max_km: float) -> DataFrame:
    """All reaches that drain to each start within ``max_km``: ``start, comid, distance_km``.

    A start that the network doesn't have is upstream of itself alone.
    """
    begin = stored(starts.select(F.col("comid").alias("start")).where("start IS NOT NULL").distinct(), "starts")
    entries = _entries(labels, begin, max_km)
    points = labels.reaches.select(F.col("comid").alias("reach"), F.col("tree").alias("reach_tree"), F.col("first").alias("number"), F.col("depth_km").alias("reach_km"))
    met = _within(points, "reach_tree", "number", entries.drop("comid"))
    distance = F.col("at_km") + F.col("reach_km") - F.col("depth_km")
    found = met.select("start", F.col("reach").alias("comid"), distance.alias("distance_km")).where(F.col("distance_km") <= max_km)
    if labels.gates is not None:
        found = found.groupBy("start", "comid").agg(F.min("distance_km").alias("distance_km"))
    missing = begin.join(entries.select("start"), "start", "left_anti").select("start", F.col("start").alias("comid"), F.lit(0.0).alias("distance_km"))
    return found.unionByName(missing)


def upstream_of_one(labels: Labels, start: int, max_km: float) -> DataFrame:
    """The start and all reaches that drain to it within ``max_km``: ``comid, distance_km``; without gates, one filtered scan."""
    spark = labels.reaches.sparkSession
    own = labels.reaches.where(F.col("comid") == start).first()
    if own is None or labels.gates is not None:
        first = spark.range(start, start + 1).select(F.col("id").alias("comid"))
        return upstream_of(labels, first, max_km).select("comid", "distance_km")
    distance = (F.col("depth_km") - F.lit(own["depth_km"])).alias("distance_km")
    near = (F.col("tree") == own["tree"]) & F.col("first").between(own["first"], own["last"])
    return labels.reaches.where(near).select("comid", distance).where(F.col("distance_km") <= max_km)
