"""Valley-segment metrics rolled up by watershed, state, flow type and owner.

Segment metrics are long-form rows ``dgo_id, metric_id, metric_value``.  A
segment with several matching state or owner rows counts once per match, and a
code listed by several lookup rows feeds each of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_all_if_small
from ..sources.lookups import explode_codes

OWNER_METRIC = 1
STATE_METRIC = 2

LENGTH_WEIGHTED_AVG = "length_weighted_avg"
AREA_WEIGHTED_AVG = "area_weighted_avg"
SUM_METRIC = "sum_metric_value"
MULTIPLIED_BY_LENGTH = "multiplied_by_length"
MULTIPLIED_BY_AREA = "multiplied_by_area"
SUM_AREA_ZERO_COUNT = "sum_area_zero_count"
# Names of the summaries.
METHODS = (
    LENGTH_WEIGHTED_AVG,
    AREA_WEIGHTED_AVG,
    SUM_METRIC,
    MULTIPLIED_BY_LENGTH,
    MULTIPLIED_BY_AREA,
    SUM_AREA_ZERO_COUNT,
)


@dataclass(frozen=True)
class MetricDef:
    """One output column: which metric, summarised how."""

    metric_id: int
    method: str
    output: str


# The metrics rolled up by default.
METRIC_DEFS = (
    MetricDef(4, LENGTH_WEIGHTED_AVG, "channel_gradient"),
    MetricDef(5, LENGTH_WEIGHTED_AVG, "valley_gradient"),
    MetricDef(16, SUM_METRIC, "channel_length"),
    MetricDef(19, SUM_METRIC, "low_lying_area"),
    MetricDef(20, SUM_METRIC, "elevated_area"),
    MetricDef(21, SUM_METRIC, "channel_area"),
    MetricDef(23, LENGTH_WEIGHTED_AVG, "valley_width"),
    MetricDef(35, MULTIPLIED_BY_LENGTH, "road_length"),
    MetricDef(36, MULTIPLIED_BY_LENGTH, "rail_length"),
    MetricDef(37, AREA_WEIGHTED_AVG, "land_use_intensity"),
    MetricDef(38, MULTIPLIED_BY_AREA, "accessible_floodplain_area"),
    MetricDef(39, MULTIPLIED_BY_AREA, "riparian_area"),
    MetricDef(40, AREA_WEIGHTED_AVG, "riparian_departure"),
    MetricDef(41, MULTIPLIED_BY_AREA, "riparian_ag_conv_area"),
    MetricDef(42, MULTIPLIED_BY_AREA, "riparian_developed_area"),
    MetricDef(37, SUM_AREA_ZERO_COUNT, "lui_zero_area"),
)

# Square metres to acres and metres to miles.
ACRES_PER_SQUARE_METRE = 0.000247105
MILES_PER_METRE = 0.000621371


def counted_rows(eav: DataFrame, metric_ids: Sequence[int], lookups: Sequence[int]) -> DataFrame:
    """Metric rows counted per segment, metric and code, from one scan: value sum ``v``, rows ``n`` and zeros ``z``.

    Only lookup metrics have a code, their value as a number.  Rows are counted
    before anything is joined, so a segment with very many rows is reduced
    where it is read.  Rows whose value is null still count, as they do in the
    weighted averages.
    """
    value, metric = F.col("metric_value"), F.col("metric_id")
    code = F.when(metric.isin(*lookups), value.cast("string").try_cast("double"))
    return (
        eav.where(metric.isin(sorted({*metric_ids, *lookups})))
        .groupBy("dgo_id", "metric_id", code.alias("code"))
        .agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("n"), F.count(F.when(value == 0, F.lit(1))).alias("z"))
    )


def segment_rows(counted: DataFrame, metric_ids: Sequence[int]) -> DataFrame:
    """One row per segment: ``facts``, its counted metrics, and the codes of its states and owners with their rows.

    The lists are as long as the metrics and codes of one segment.
    """
    metric = F.col("metric_id")
    codes = lambda which: F.collect_list(F.when((metric == which) & F.col("code").isNotNull(), F.struct("code", "n")))
    return counted.groupBy("dgo_id").agg(
        F.collect_list(F.when(metric.isin(sorted(set(metric_ids))), F.struct("metric_id", "v", "n", "z"))).alias("facts"),
        codes(STATE_METRIC).alias("state_codes"),
        codes(OWNER_METRIC).alias("owner_codes"),
    )


def _numeric_codes(lookup: DataFrame, name: str) -> DataFrame:
    codes = explode_codes(lookup).select(F.col("id").alias(f"{name}_id"), F.col("code").try_cast("double").alias("code"))
    return codes.where("code IS NOT NULL").distinct()


def weighted_segments(segments: DataFrame, states: DataFrame, flows: DataFrame, owners: DataFrame | None) -> DataFrame:
    """A row per segment and group with the segment's ``weight`` there; ``owner_id`` is null in the group of all owners.

    A segment counts once per matching state row and, in the groups that have
    an owner, per matching owner row.  Codes and values meet as numbers; sums
    are linear in the counts, so codes of one lookup row need not be added up
    first.  Every lookup is met by a broadcast where it is short.
    """
    flow_codes = explode_codes(flows).select(F.col("id").alias("flow_id"), F.col("code").alias("FCode")).distinct()
    listed = [flow_codes, _numeric_codes(states, "state")]
    if owners is not None:
        # the group of all owners is one more code of every segment, and one more row of the lookup
        codes = _numeric_codes(owners, "owner")
        nobody = [F.lit(None).cast(codes.schema[c].dataType).alias(c) for c in codes.columns]
        listed.append(codes.unionByName(codes.sparkSession.range(1).select(*nobody)))
    flow_codes, state_codes, *owner_codes = broadcast_all_if_small(*listed)
    stated = segments.join(flow_codes, "FCode").withColumn("state", F.explode("state_codes"))
    stated = stated.join(state_codes, F.col("state.code") == F.col("code")).drop("code")
    if not owner_codes:
        return stated.select("*", F.lit(None).cast("int").alias("owner_id"), F.col("state.n").alias("weight"))
    everyone = F.struct(F.lit(None).cast("double").alias("code"), F.lit(1).cast("long").alias("n"))
    each = stated.withColumn("owner", F.explode(F.array_prepend("owner_codes", everyone)))
    met = each.join(owner_codes[0], F.col("owner.code").eqNullSafe(F.col("code")))
    return met.withColumn("weight", F.col("state.n") * F.col("owner.n"))


def group_sums(
    dgos: DataFrame, eav: DataFrame, states: DataFrame, flows: DataFrame, owners: DataFrame | None, metric_ids: Sequence[int], by: Sequence[str]
) -> DataFrame:
    """A row per group: counts, length, area, and ``sums``, a map from metric to the sums that the summaries need.

    The metric rows are read and shuffled once, to their segments.  A fact
    without a metric stands for the segment itself and gives the group's totals.
    """
    counted = counted_rows(eav, metric_ids, (STATE_METRIC, OWNER_METRIC))
    facts = segment_rows(counted, metric_ids)
    segments = dgos.select(
        *by, F.col("fid").alias("dgo_id"), F.col("FCode").cast("string").alias("FCode"),
        F.col("centerline_length").alias("length"), F.col("segment_area").alias("area"),
    )
    groups = weighted_segments(segments.join(facts, "dgo_id"), states, flows, owners)
    values = {"metric_id": None, "v": None, "n": 1, "z": 0}
    own = F.struct(*[F.lit(x).cast(counted.schema[c].dataType).alias(c) for c, x in values.items()])
    keys = [*by, "state_id", "flow_id", "owner_id"]
    each = groups.select(*keys, "length", "area", "weight", F.inline(F.array_prepend("facts", own)))
    length, area, w = F.col("length"), F.col("area"), F.col("weight")
    summed = each.groupBy(*keys, "metric_id").agg(
        F.sum(w).alias("count"),
        F.sum(F.col("v") * w).alias("v"),
        F.sum(F.col("v") * length * w).alias("v_length"),
        F.sum(length * F.col("n") * w).alias("length"),
        F.sum(F.col("v") * area * w).alias("v_area"),
        F.sum(area * F.col("n") * w).alias("area"),
        F.sum(area * F.col("z") * w).alias("zero_area"),
    )
    sums = F.struct("v", "v_length", "length", "v_area", "area", "zero_area")
    total = lambda c: F.max(F.when(F.col("metric_id").isNull(), F.col(c)))
    entry = F.when(F.col("metric_id").isNotNull(), F.struct("metric_id", sums.alias("sums")))
    return summed.groupBy(*keys).agg(
        total("count").alias("dgo_count"),
        F.coalesce(total("length"), F.lit(0.0)).alias("riverscape_length"),
        F.coalesce(total("area"), F.lit(0.0)).alias("riverscape_area"),
        F.map_from_entries(F.collect_list(entry)).alias("sums"),
    )


def _summary(method: str, sums: Column) -> Column:
    if method == LENGTH_WEIGHTED_AVG:
        return F.try_divide(sums["v_length"], sums["length"])
    if method == AREA_WEIGHTED_AVG:
        return F.try_divide(sums["v_area"], sums["area"])
    if method == SUM_METRIC:
        return sums["v"]
    if method == MULTIPLIED_BY_LENGTH:
        return sums["v_length"]
    if method == MULTIPLIED_BY_AREA:
        return sums["v_area"]
    if method == SUM_AREA_ZERO_COUNT:
        return F.coalesce(sums["zero_area"], F.lit(0.0))
    raise ValueError(f"unknown summary method {method!r}")


def dgo_rollup(
    dgos: DataFrame,
    eav: DataFrame,
    states: DataFrame,
    flows: DataFrame,
    owners: DataFrame | None,
    metric_defs: Sequence[MetricDef] = METRIC_DEFS,
    by: Sequence[str] = ("huc10",),
) -> DataFrame:
    """Counts, lengths, areas and metric summaries by state and flow, without and with owner.

    The metric rows are read once and meet each segment's weights by one key;
    they are summed per group and metric, and only the finished sums are laid
    out in columns, so the plan is as short for many metrics as for one.  Without ``owners`` there are only the groups of all.
    """
    groups = group_sums(dgos, eav, states, flows, owners, [d.metric_id for d in metric_defs], by)
    return groups.select(
        *by, "state_id", "flow_id", "owner_id", "dgo_count", "riverscape_length", "riverscape_area",
        *[_summary(d.method, F.col("sums")[d.metric_id]).alias(d.output) for d in metric_defs],
    )


def metric_summaries(
    dgos: DataFrame, eav: DataFrame, states: DataFrame, flows: DataFrame, metric_ids: Sequence[int]
) -> DataFrame:
    """All six summaries of each metric by watershed, state and flow, one row per metric."""
    groups = group_sums(dgos, eav, states, flows, None, metric_ids, ("huc10",))
    each = groups.select("huc10", "state_id", "flow_id", "sums", F.explode(F.array(*map(F.lit, metric_ids))).alias("metric_id"))
    own = F.try_element_at("sums", F.col("metric_id"))
    return each.select("huc10", "state_id", "flow_id", "metric_id", *[_summary(m, own).alias(m) for m in METHODS])


def secondary_metrics(rollup: DataFrame) -> DataFrame:
    """Seven ratios derived from the summed metrics; a zero divisor gives null."""
    c = F.col
    return rollup.withColumns(
        {
            "hist_riparian_area": F.try_divide(c("riparian_area"), 1 - c("riparian_departure")),
            "relative_flow_length": F.try_divide(c("channel_length"), c("riverscape_length")),
            "acres_vb_per_mile": F.try_divide(
                c("riverscape_area") * ACRES_PER_SQUARE_METRE, c("riverscape_length") * MILES_PER_METRE
            ),
            "road_density": F.try_divide(c("road_length"), c("riverscape_length")),
            "rail_density": F.try_divide(c("rail_length"), c("riverscape_length")),
            "riparian_ag_conversion_proportion": F.try_divide(c("riparian_ag_conv_area"), c("riverscape_area")),
            "riparian_developed_proportion": F.try_divide(c("riparian_developed_area"), c("riverscape_area")),
        }
    )
