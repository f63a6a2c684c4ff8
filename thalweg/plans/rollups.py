"""Queries: valley metrics rolled up, and raster summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, raster, raster_tiles, rollup
from ..operators.rollup import MetricDef
from ..session import fresh_folder
from ..sources.lookups import explode_codes
from ..sources.sinks import read_committed, write_metrics
from .inputs import Inputs
from .registry import ORACLES, QUERIES, query

DEFS = (
    MetricDef(3, rollup.LENGTH_WEIGHTED_AVG, "channel_gradient"),
    MetricDef(4, rollup.AREA_WEIGHTED_AVG, "riparian_departure"),
    MetricDef(5, rollup.SUM_METRIC, "channel_length"),
    MetricDef(6, rollup.MULTIPLIED_BY_LENGTH, "road_length"),
    MetricDef(7, rollup.MULTIPLIED_BY_AREA, "riparian_area"),
    MetricDef(3, rollup.MULTIPLIED_BY_LENGTH, "rail_length"),
    MetricDef(4, rollup.MULTIPLIED_BY_AREA, "riparian_ag_conv_area"),
    MetricDef(5, rollup.MULTIPLIED_BY_AREA, "riparian_developed_area"),
    MetricDef(6, rollup.SUM_AREA_ZERO_COUNT, "lui_zero_area"),
)
SUMMARY_SQL = {
    rollup.LENGTH_WEIGHTED_AVG: "sum(v * len) / nullif(sum(len), 0)",
    rollup.AREA_WEIGHTED_AVG: "sum(v * area) / nullif(sum(area), 0)",
    rollup.SUM_METRIC: "sum(v)",
    rollup.MULTIPLIED_BY_LENGTH: "sum(v * len)",
    rollup.MULTIPLIED_BY_AREA: "sum(v * area)",
    rollup.SUM_AREA_ZERO_COUNT: "coalesce(sum(area) FILTER (WHERE v = 0), 0)",
}


def _codes(table: str) -> str:
    return f"(SELECT DISTINCT id, unnest(string_split(where_clause, ',')) AS code FROM {table})"


# The rollup as written against the long table: every matching row joined, then summed.
FANNED = f"""s AS {_codes('us_states')}, f AS {_codes('flows')}, o AS {_codes('owners')},
    base AS (SELECT d.fid, d.huc10, s.id AS state_id, f.id AS flow_id, d.centerline_length AS len, d.segment_area AS area
        FROM dgos d JOIN dgo_metric_values ms ON ms.dgo_id = d.fid AND ms.metric_id = 2
        JOIN s ON CAST(s.code AS DOUBLE) = ms.metric_value JOIN f ON f.code = d.FCode),
    owned AS (SELECT base.*, o.id AS owner_id FROM base
        JOIN dgo_metric_values mo ON mo.dgo_id = base.fid AND mo.metric_id = 1
        JOIN o ON CAST(o.code AS DOUBLE) = mo.metric_value),
    fanned AS (SELECT fid, huc10, state_id, flow_id, NULL AS owner_id, len, area FROM base
        UNION ALL SELECT fid, huc10, state_id, flow_id, owner_id, len, area FROM owned),
    counts AS (SELECT huc10, state_id, flow_id, owner_id, count(*) AS dgo_count, sum(len) AS riverscape_length,
        sum(area) AS riverscape_area FROM fanned GROUP BY ALL)"""


def _metric(d: MetricDef) -> str:
    return f"""(SELECT huc10, state_id, flow_id, owner_id, {SUMMARY_SQL[d.method]} AS x
        FROM (SELECT n.*, m.metric_value AS v FROM fanned n
              JOIN dgo_metric_values m ON m.dgo_id = n.fid AND m.metric_id = {d.metric_id}) GROUP BY ALL)"""


def _joined(defs) -> str:
    joins = "".join(
        f" LEFT JOIN {_metric(d)} m{k} ON m{k}.huc10 = c.huc10 AND m{k}.state_id = c.state_id AND m{k}.flow_id = c.flow_id"
        f" AND m{k}.owner_id IS NOT DISTINCT FROM c.owner_id"
        for k, d in enumerate(defs)
    )
    # A count of zeros over no rows is zero; the other summaries of no rows are null.
    cell = lambda k, d: f"coalesce(m{k}.x, 0)" if d.method == rollup.SUM_AREA_ZERO_COUNT else f"m{k}.x"
    columns = ", ".join(f"{cell(k, d)} AS {d.output}" for k, d in enumerate(defs))
    return f"rolled AS (SELECT c.*, {columns} FROM counts c{joins})"


KEYS = ("huc10", "state_id", "flow_id", "owner_id")
EXACT = ("dgo_count",)
AVERAGES = ("channel_gradient", "riparian_departure")


def _digits(name: str) -> int:
    return 4 if name in AVERAGES else 2


ROLLED_COLUMNS = [*KEYS, *EXACT, "riverscape_length", "riverscape_area", *[d.output for d in DEFS]]
ROLLED_SQL = ", ".join(
    c if c in KEYS or c in EXACT else f"round({c}, {_digits(c)}) AS {c}" for c in ROLLED_COLUMNS
)


def _rolled(i: Inputs):
    return rollup.dgo_rollup(i.dgos, i.dgo_metric_values, i.us_states, i.flows, i.owners, DEFS)


def _rounded(df):
    return df.select(
        *[F.col(c) if c in KEYS or c in EXACT else F.round(c, _digits(c)).alias(c) for c in ROLLED_COLUMNS]
    )


@query("lookup_bridge", "SELECT 'flow' AS lookup, id, code FROM (SELECT id, unnest(string_split(where_clause, ',')) AS code"
       " FROM flows) WHERE code IN (SELECT o_orderpriority FROM orders)")
def lookup_bridge(spark, folder):
    """Flow codes that segments really carry."""
    i = Inputs(spark, folder)
    codes = explode_codes(i.flows).select(F.lit("flow").alias("lookup"), "id", "code")
    # few codes on very many segments: each is met once, not as often as it is carried
    carried = i.dgos.select(F.col("FCode").alias("code")).distinct()
    return codes.join(carried, "code", "left_semi").select("lookup", "id", "code")


@query("dgo_rollup", f"WITH {FANNED}, {_joined(DEFS)} SELECT {ROLLED_SQL} FROM rolled")
def dgo_rollup(spark, folder):
    return _rounded(_rolled(Inputs(spark, folder)))


SUMMARY_IDS = (3, 4, 5, 6, 7)


def _summary_sql() -> str:
    cells = ", ".join(
        f"round({sql}, {4 if 'avg' in method else 2}) AS {method}" for method, sql in SUMMARY_SQL.items()
    )
    return f"""WITH s AS {_codes('us_states')}, f AS {_codes('flows')},
    base AS (SELECT d.fid, d.huc10, s.id AS state_id, f.id AS flow_id, d.centerline_length AS len, d.segment_area AS area
        FROM dgos d JOIN dgo_metric_values ms ON ms.dgo_id = d.fid AND ms.metric_id = 2
        JOIN s ON CAST(s.code AS DOUBLE) = ms.metric_value JOIN f ON f.code = d.FCode)
    SELECT huc10, state_id, flow_id, metric_id, {cells} FROM (
        SELECT b.huc10, b.state_id, b.flow_id, k.metric_id, m.metric_value AS v,
            CASE WHEN m.dgo_id IS NOT NULL THEN b.len END AS len, CASE WHEN m.dgo_id IS NOT NULL THEN b.area END AS area
        FROM base b CROSS JOIN (SELECT unnest([{', '.join(map(str, SUMMARY_IDS))}]) AS metric_id) k
        LEFT JOIN dgo_metric_values m ON m.dgo_id = b.fid AND m.metric_id = k.metric_id)
    GROUP BY huc10, state_id, flow_id, metric_id"""


@query("metric_summaries", _summary_sql())
def metric_summaries(spark, folder):
    i = Inputs(spark, folder)
    table = rollup.metric_summaries(i.dgos, i.dgo_metric_values, i.us_states, i.flows, SUMMARY_IDS)
    return table.select(
        "huc10", "state_id", "flow_id", "metric_id",
        *[F.round(m, 4 if "avg" in m else 2).alias(m) for m in rollup.METHODS],
    )


SECONDARY = {
    "hist_riparian_area": "riparian_area / nullif(1 - riparian_departure, 0)",
    "relative_flow_length": "channel_length / nullif(riverscape_length, 0)",
    "acres_vb_per_mile": "(riverscape_area * CAST(0.000247105 AS DOUBLE))"
                         " / nullif(riverscape_length * CAST(0.000621371 AS DOUBLE), 0)",
    "road_density": "road_length / nullif(riverscape_length, 0)",
    "rail_density": "rail_length / nullif(riverscape_length, 0)",
    "riparian_ag_conversion_proportion": "riparian_ag_conv_area / nullif(riverscape_area, 0)",
    "riparian_developed_proportion": "riparian_developed_area / nullif(riverscape_area, 0)",
}


@query(
    "secondary_metrics",
    f"WITH {FANNED}, {_joined(DEFS)} SELECT {', '.join(KEYS)}, "
    + ", ".join(f"round({sql}, 4) AS {name}" for name, sql in SECONDARY.items())
    + " FROM rolled",
)
def secondary_metrics(spark, folder):
    table = rollup.secondary_metrics(_rolled(Inputs(spark, folder)))
    return table.select(*KEYS, *[F.round(name, 4).alias(name) for name in SECONDARY])


@query(
    "skip_processed",
    "SELECT fid, huc10 FROM dgos WHERE huc10 NOT IN (SELECT lpad(CAST(r_regionkey AS STRING), 10, '0') FROM region)",
)
def skip_processed(spark, folder):
    i = Inputs(spark, folder)
    ledger = i.region.select(F.lpad(F.col("r_regionkey").cast("string"), 10, "0").alias("huc10"))
    return filters.skip_processed(i.dgos, ledger).select("fid", "huc10")


@query("write_metrics", f"WITH {FANNED} SELECT {', '.join(KEYS)}, dgo_count FROM counts")
def write_metrics_query(spark, folder):
    """Appended metrics read back, for the watersheds in the ledger; the same job run again changes nothing."""
    root = fresh_folder(spark, "metrics")
    metrics, ledger = f"{root}/metrics", f"{root}/hucs"
    rolled = _rolled(Inputs(spark, folder))
    for _ in range(2):
        write_metrics(rolled, metrics, ledger, "first")
    # Watershed codes are text: partition values must not be read as numbers.
    written = read_committed(spark, metrics, metrics, rolled.schema)
    done = read_committed(spark, ledger, metrics, "huc10 string")
    return written.join(done, "huc10", "left_semi").select(*KEYS, "dgo_count")


# --- rasters -----------------------------------------------------------------

VALID = "valid AS (SELECT c.raster_id, CAST(c.value AS FLOAT) AS v FROM raster_cells c JOIN rasters r" \
        " ON c.raster_id = r.raster_id WHERE CAST(c.value AS FLOAT) <> CAST(r.nodata AS FLOAT))"


@query(
    "raster_categories",
    f"WITH {VALID} SELECT raster_id, CAST(CAST(trunc(v) AS BIGINT) AS VARCHAR) AS category, count(*) AS cell_count"
    " FROM valid GROUP BY 1, 2",
)
def raster_categories(spark, folder):
    i = Inputs(spark, folder)
    return raster.raster_categories(i.raster_cells, i.rasters)


@query(
    "raster_summary",
    f"WITH {VALID} SELECT raster_id, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max,"
    " count(*) AS value_count FROM valid GROUP BY 1",
)
def raster_summary(spark, folder):
    i = Inputs(spark, folder)
    return raster.raster_summary(i.raster_cells, i.rasters)


@query(
    "raster_histogram",
    f"""WITH {VALID}, ends AS (SELECT raster_id, CAST(floor(min(CAST(v AS DOUBLE)) / 7) AS BIGINT) AS a,
        CAST(ceil(max(CAST(v AS DOUBLE)) / 7) AS BIGINT) AS b FROM valid GROUP BY 1),
    bins AS (SELECT raster_id, a, b, unnest(range(a, b)) AS i FROM ends)
    SELECT k.raster_id, k.i * 7 AS bin, count(v.v) AS cell_count FROM bins k LEFT JOIN valid v
    ON v.raster_id = k.raster_id AND v.v >= k.i * 7 AND (v.v < (k.i + 1) * 7 OR (k.i = k.b - 1 AND v.v = k.b * 7))
    GROUP BY k.raster_id, k.i""",
)
def raster_histogram(spark, folder):
    i = Inputs(spark, folder)
    return raster.raster_histogram(i.raster_cells, i.rasters, bin_size=7)


@query(
    "raster_stats",
    """WITH c AS (SELECT c.raster_id, CAST(c.value AS FLOAT) AS v, CAST(r.nodata AS FLOAT) AS nd,
        min(CAST(c.value AS FLOAT)) OVER (PARTITION BY c.raster_id) AS lo
        FROM raster_cells c JOIN rasters r ON c.raster_id = r.raster_id),
    m AS (SELECT raster_id, v, v = CASE WHEN abs(CAST(lo AS DOUBLE) - nd) <= 0.001 * greatest(abs(CAST(lo AS DOUBLE)), abs(nd))
        THEN lo ELSE nd END AS masked FROM c)
    SELECT raster_id, CAST(min(CASE WHEN NOT masked THEN v END) AS DOUBLE) AS min,
        CAST(max(CASE WHEN NOT masked THEN v END) AS DOUBLE) AS max,
        count(CASE WHEN NOT masked THEN 1 END) AS valid_cells, count(CASE WHEN masked THEN 1 END) AS masked_cells
    FROM m GROUP BY raster_id""",
)
def raster_stats(spark, folder):
    i = Inputs(spark, folder)
    return raster.raster_stats(i.raster_cells, i.rasters)


@query(
    "raster_sample",
    """SELECT p.point_id, p.raster_id, p.x, p.y,
        CASE WHEN abs(c.value - r.nodata) > 0.0000001 * greatest(abs(c.value), abs(r.nodata)) THEN c.value END AS value
    FROM sample_points p JOIN rasters r ON p.raster_id = r.raster_id LEFT JOIN raster_cells c
    ON c.raster_id = p.raster_id AND c.cell_col = CAST(trunc((p.x - r."left") / r.cell_width) AS BIGINT)
    AND c.cell_row = CAST(trunc((p.y - r.top) / r.cell_height) AS BIGINT)""",
)
def raster_sample(spark, folder):
    i = Inputs(spark, folder)
    return raster.raster_sample(i.sample_points, i.raster_cells, i.rasters)


CORNERS = (("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom"), ("left", "top"))


@query(
    "raster_extent",
    f"""WITH e AS (SELECT raster_id, "left", top, "left" + cell_width * cols AS "right", top + cell_height * "rows" AS bottom,
        cell_width * cols AS width, -cell_height * "rows" AS height FROM rasters)
    SELECT raster_id, "right", bottom, width, height, place, x, y FROM (
        {" UNION ALL ".join(f'SELECT *, {i} AS place, "{x}" AS x, "{y}" AS y FROM e' for i, (x, y) in enumerate(CORNERS))})""",
)
def raster_extent(spark, folder):
    """Extents with a row for each corner of the boundary ring, in order."""
    extent = raster.raster_extent(Inputs(spark, folder).rasters)
    placed = extent.select("raster_id", "right", "bottom", "width", "height", F.posexplode("boundary").alias("place", "corner"))
    return placed.select("raster_id", "right", "bottom", "width", "height", "place", "corner.x", "corner.y")


@query(
    "in_bounds",
    """SELECT p.point_id, p.raster_id, r."left" < p.x AND r.top + r.cell_height * r."rows" < p.y AND r."left" + r.cell_width * r.cols > p.x
        AND r.top > p.y AS inside FROM sample_points p JOIN rasters r ON p.raster_id = r.raster_id""",
)
def in_bounds(spark, folder):
    """Points strictly inside the extent of their raster; those on its edge are not."""
    i = Inputs(spark, folder)
    extent = raster.raster_extent(i.rasters).select("raster_id", F.col("left").alias("west"), F.col("bottom").alias("south"),
                                                    F.col("right").alias("east"), F.col("top").alias("north"))
    inside = raster.in_bounds(*map(F.col, ("x", "y", "west", "south", "east", "north")))
    return i.sample_points.join(extent, "raster_id").select("point_id", "raster_id", inside.alias("inside"))


# --- the same over tiles -------------------------------------------------------


def _tiles(i: Inputs):
    path = fresh_folder(i.spark, "tiles")
    raster_tiles.write_tiles(i.raster_cells, path)
    return i.spark.read.parquet(path)


def _over_tiles(name: str, run):
    """A query over stored tiles with the SQL of the one over cells."""

    def over(spark, folder):
        i = Inputs(spark, folder)
        return run(i, _tiles(i))

    over.__doc__ = f"``{name}`` over tiles."
    QUERIES[f"{name}_tiles"], ORACLES[f"{name}_tiles"] = over, ORACLES[name]


_over_tiles("raster_categories", lambda i, tiles: raster_tiles.tile_categories(tiles, i.rasters))
_over_tiles("raster_summary", lambda i, tiles: raster_tiles.tile_summary(tiles, i.rasters))
_over_tiles("raster_histogram", lambda i, tiles: raster_tiles.tile_histogram(tiles, i.rasters, bin_size=7))
_over_tiles("raster_stats", lambda i, tiles: raster_tiles.tile_stats(tiles, i.rasters))
_over_tiles("raster_sample", lambda i, tiles: raster_tiles.tile_sample(i.sample_points, tiles, i.rasters))
