"""Queries: readings, seasons, growth, river network, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import DECADE as DECADE_LENGTH
from ..functions.calendar import season, window_bounds
from ..functions.growth import CHINOOK_SALMON, RED_BAND_TROUT, growth, growth_by_species, growth_curve_table
from ..operators import filters, fitting, network, reach_stats, season_store, seasonal, spatial
from ..session import fresh_folder, stored
from ..sources.curves import read_growth_curves
from ..sources.geopackage import read_gpkg_layer, with_project
from ..sources.readings import read_daily_temp
from .inputs import Inputs
from .registry import growth_sql, query

DECADE = 1995
YEAR = 1996
HUC12 = "000000000018"
REACH = 2
SEASONS = ("winter", "spring", "summer", "autumn")

DECADE_SQL = "date BETWEEN TIMESTAMP '1995-09-21' AND TIMESTAMP '2005-09-09'"
YEAR_SQL = "date BETWEEN TIMESTAMP '1996-09-21' AND TIMESTAMP '1997-09-21'"
SEASON_SQL = """CASE WHEN dayofyear(date) >= 355 OR dayofyear(date) <= 79 THEN 'winter'
    WHEN dayofyear(date) BETWEEN 80 AND 171 THEN 'spring'
    WHEN dayofyear(date) BETWEEN 172 AND 263 THEN 'summer' ELSE 'autumn' END"""
DAY_SQL = "CAST(CAST(date AS DATE) AS VARCHAR) AS date"
RED = RED_BAND_TROUT.coefficients
CHI = CHINOOK_SALMON.coefficients


def _day(column: str = "date"):
    return F.col(column).cast("date").cast("string").alias(column)


def _means(by: str, source: str) -> str:
    cells = ", ".join(f"avg(CASE WHEN season = '{s}' THEN stream_temp END) AS {s}_avg" for s in SEASONS)
    return f"SELECT {by}, {cells} FROM ({source}) GROUP BY {by}"


DECADE_ROWS = f"SELECT *, {SEASON_SQL} AS season FROM daily_temp WHERE {DECADE_SQL} AND stream_temp <> -999"
REACH_MEANS = _means("project, comid", DECADE_ROWS)
HUC_MEANS = _means(
    "project, HUC12",
    f"SELECT d.*, a.HUC12 FROM ({DECADE_ROWS}) d LEFT JOIN contributing_area a "
    "ON d.project = a.project AND d.comid = a.featureid",
)


def _rounded_means(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{s}_avg, 6) AS {s}_avg" for s in SEASONS)


def _rounded_growth(coefficients) -> str:
    return ", ".join(f"round({growth_sql(f'{s}_avg', coefficients)}, 6) AS {s}_fish_avg" for s in SEASONS)


def _round(df):
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# --- sources ---------------------------------------------------------------


@query("scan_daily_temp", f"SELECT project, comid, {DAY_SQL}, stream_temp FROM daily_temp")
def scan_daily_temp(spark, folder):
    """A tree of project folders, written from the readings, read back in one scan."""
    root = fresh_folder(spark, "readings")
    readings = Inputs(spark, folder).daily_temp
    readings.write.partitionBy("project").option("compression", "gzip").parquet(root)
    found = read_daily_temp(spark, root, "*.gz.parquet")
    return found.select(
        F.regexp_replace("project", "^project=", "").alias("project"), "comid", _day(), "stream_temp"
    )


@query(
    "gpkg_layer",
    "SELECT project, featureid, HUC12, CAST(featureid % 10 AS DOUBLE) AS min_x,"
    " CAST(featureid // 10 + 1 AS DOUBLE) AS max_y FROM contributing_area",
)
def gpkg_layer(spark, folder):
    from ..functions.wkb import wkb_box

    root = Inputs(spark, folder).written_geopackages()
    layer = with_project(read_gpkg_layer(spark, root, "contributing_area"), root)
    boxed = layer.withColumn("box", wkb_box("geom"))
    return boxed.select(
        "project", "featureid", "HUC12", F.col("box.min_x").alias("min_x"), F.col("box.max_y").alias("max_y")
    )


@query("growth_points", "SELECT p_type AS species, CAST(p_size AS DOUBLE) AS temperature, p_retailprice AS growth_rate FROM part")
def growth_points(spark, folder):
    """Curve files, written per species from the parts, read back."""
    root = fresh_folder(spark, "curves")
    parts = Inputs(spark, folder).part.select(
        "p_type", F.col("p_size").alias("Temperature.C"), F.col("p_retailprice").alias("Specific.Growth.Rate.g.g.d")
    )
    parts.write.partitionBy("p_type").option("header", "true").csv(root)
    # one folder per species: the few names come from the written folders, not from the rows
    folders = spark.read.text(root, wholetext=True).select("p_type").distinct().collect()
    return read_growth_curves(spark, {r[0]: f"{root}/p_type={r[0]}" for r in folders})


# --- filters ---------------------------------------------------------------


@query("decade_window", f"SELECT project, comid, {DAY_SQL}, stream_temp FROM daily_temp WHERE {DECADE_SQL}")
def decade_window(spark, folder):
    return filters.decade_window(Inputs(spark, folder).daily_temp, DECADE).withColumn("date", _day())


@query("water_year_window", f"SELECT project, comid, {DAY_SQL}, stream_temp FROM daily_temp WHERE {YEAR_SQL}")
def water_year_window(spark, folder):
    return filters.water_year_window(Inputs(spark, folder).daily_temp, YEAR).withColumn("date", _day())


@query(
    "drop_nodata",
    f"SELECT 'sentinel' AS mode, comid, {DAY_SQL}, stream_temp FROM daily_temp WHERE stream_temp <> -999"
    f" UNION ALL SELECT 'floor', comid, {DAY_SQL}, stream_temp FROM daily_temp WHERE stream_temp > -50",
)
def drop_nodata(spark, folder):
    readings = Inputs(spark, folder).daily_temp
    both = [
        filters.drop_nodata(readings, mode).select(F.lit(mode).alias("mode"), "comid", _day(), "stream_temp")
        for mode in ("sentinel", "floor")
    ]
    return both[0].unionByName(both[1])


@query("season_of", f"SELECT comid, {DAY_SQL}, {SEASON_SQL} AS season FROM daily_temp")
def season_of(spark, folder):
    return Inputs(spark, folder).daily_temp.select("comid", _day(), season("date").alias("season"))


@query(
    "select_feature",
    f"""SELECT d.project, d.comid, {DAY_SQL.replace('date AS DATE', 'd.date AS DATE')}, d.stream_temp FROM daily_temp d
    WHERE EXISTS (SELECT 1 FROM contributing_area a WHERE a.project = d.project AND a.featureid = d.comid
                  AND (a.HUC12 = '{HUC12}' OR (CAST(a.featureid AS VARCHAR) = '{HUC12}' AND NOT EXISTS
                       (SELECT 1 FROM contributing_area b WHERE b.project = a.project AND b.HUC12 = '{HUC12}'))))
    UNION ALL
    SELECT d.project, d.comid, {DAY_SQL.replace('date AS DATE', 'd.date AS DATE')}, d.stream_temp FROM daily_temp d
    WHERE d.comid = 7""",
)
def select_feature(spark, folder):
    """Readings of a watershed, and of a reach."""
    i = Inputs(spark, folder)
    by_huc = filters.select_feature(i.daily_temp, i.contributing_area, HUC12)
    by_reach = filters.select_feature(i.daily_temp, i.contributing_area, " 7 ")
    both = by_huc.unionByName(by_reach)
    return both.select("project", "comid", _day(), "stream_temp")


@query("filter_huc12", f"SELECT project, featureid, HUC12 FROM contributing_area WHERE HUC12 = '{HUC12}'")
def filter_huc12(spark, folder):
    return filters.filter_huc12(Inputs(spark, folder).contributing_area, HUC12)


LONG_SQL = "\nUNION ALL\n".join(
    f"SELECT project, comid, '{s.capitalize()}' AS season, '{metric}' AS metric, {column} AS value FROM g"
    for s in SEASONS
    for metric, column in (("Temperature", f"{s}_avg"), ("Growth", f"{s}_fish_avg"))
)


@query(
    "season_metric_long",
    f"WITH m AS ({REACH_MEANS}), g AS (SELECT project, comid, {_rounded_means()}, {_rounded_growth(RED)} FROM m) {LONG_SQL}",
)
def season_metric_long(spark, folder):
    table = seasonal.seasonal_growth_reach(Inputs(spark, folder).daily_temp, DECADE, RED_BAND_TROUT)
    return seasonal.season_metric_long(_round(table))


@query(
    "parse_ids",
    "SELECT event_id, CAST(trunc(TRY_CAST(value AS DOUBLE)) AS BIGINT) AS comid FROM"
    " (SELECT event_id, CAST(value AS VARCHAR) AS value FROM events UNION ALL"
    "  SELECT event_id, event_type AS value FROM events) WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL",
)
def parse_ids(spark, folder):
    events = Inputs(spark, folder).events
    texts = events.select("event_id", F.col("value").cast("string").alias("raw")).unionByName(
        events.select("event_id", F.col("event_type").alias("raw"))
    )
    return filters.parsed_ids(texts, "raw").select("event_id", "comid")


# --- seasons ---------------------------------------------------------------


@query("seasonal_by_reach", f"WITH m AS ({REACH_MEANS}) SELECT project, comid, {_rounded_means()} FROM m")
def seasonal_by_reach(spark, folder):
    readings = seasonal.decade_readings(Inputs(spark, folder).daily_temp, DECADE)
    return _round(seasonal.seasonal_means(readings))


@query("seasonal_by_huc12", f"WITH m AS ({HUC_MEANS}) SELECT project, HUC12, {_rounded_means()} FROM m")
def seasonal_by_huc12(spark, folder):
    i = Inputs(spark, folder)
    return _round(seasonal.seasonal_means_huc12(seasonal.decade_readings(i.daily_temp, DECADE), i.contributing_area))


def _decades_sql(means: str, keys: str, years: tuple[int, ...]) -> str:
    """The means of several decades, each from its own scan."""
    parts = []
    for year in years:
        first, last = window_bounds(year, DECADE_LENGTH)
        window = f"date BETWEEN TIMESTAMP '{first}' AND TIMESTAMP '{last}'"
        parts.append(f"SELECT {year} AS decade, {keys}, {_rounded_means()} FROM ({means.replace(DECADE_SQL, window)})")
    return " UNION ALL ".join(parts)


STORED_DECADES = (1987, 1990, 1995)


@query("seasonal_decades_reach", _decades_sql(REACH_MEANS, "project, comid", STORED_DECADES))
def seasonal_decades_reach(spark, folder):
    """Three decades from one store of yearly sums."""
    path = fresh_folder(spark, "season-store")
    season_store.write_season_store(Inputs(spark, folder).daily_temp, path)
    store = season_store.read_season_store(spark, path)
    tables = [_round(season_store.stored_means(store, year)).select(F.lit(year).alias("decade"), "*") for year in STORED_DECADES]
    return seasonal.union_projects(*tables)


@query("seasonal_decades_huc12", _decades_sql(HUC_MEANS, "project, HUC12", STORED_DECADES))
def seasonal_decades_huc12(spark, folder):
    """The same for sub-watersheds."""
    path, i = fresh_folder(spark, "season-store"), Inputs(spark, folder)
    season_store.write_season_store(i.daily_temp, path)
    store = season_store.read_season_store(spark, path)
    sums = [(year, seasonal.means_of_sums_huc12(season_store.decade_sums(store, year), i.contributing_area)) for year in STORED_DECADES]
    return seasonal.union_projects(*[_round(table).select(F.lit(year).alias("decade"), "*") for year, table in sums])


@query(
    "seasonal_growth_reach",
    f"WITH m AS ({REACH_MEANS}) SELECT project, comid, {_rounded_means()}, {_rounded_growth(RED)} FROM m",
)
def seasonal_growth_reach(spark, folder):
    return _round(seasonal.seasonal_growth_reach(Inputs(spark, folder).daily_temp, DECADE, RED_BAND_TROUT))


@query(
    "seasonal_growth_huc12",
    f"WITH m AS ({HUC_MEANS}) SELECT project, HUC12, {_rounded_means()}, {_rounded_growth(CHI)} FROM m",
)
def seasonal_growth_huc12(spark, folder):
    i = Inputs(spark, folder)
    return _round(seasonal.seasonal_growth_huc12(i.daily_temp, i.contributing_area, DECADE, CHINOOK_SALMON))


@query(
    "feature_export",
    f"""WITH m AS ({REACH_MEANS}) SELECT project, comid, {_rounded_means()}, {_rounded_growth(RED)} FROM m
    WHERE EXISTS (SELECT 1 FROM contributing_area a WHERE a.project = m.project AND a.featureid = m.comid
                  AND a.HUC12 = '{HUC12}')""",
)
def feature_export(spark, folder):
    """CSV export of a watershed, read back."""
    from ..sources.sinks import write_csv

    i = Inputs(spark, folder)
    table = _round(seasonal.feature_export(i.daily_temp, i.contributing_area, HUC12, DECADE, RED_BAND_TROUT))
    path = fresh_folder(spark, "export")
    write_csv(table, path)
    return spark.read.schema(table.schema).option("header", "true").csv(path)


@query(
    "reach_map_table",
    f"""WITH m AS ({REACH_MEANS}) SELECT a.project, a.featureid AS comid, a.HUC12, {_rounded_means('m.')}
    FROM contributing_area a LEFT JOIN m ON a.project = m.project AND a.featureid = m.comid""",
)
def reach_map_table(spark, folder):
    i = Inputs(spark, folder)
    means = seasonal.seasonal_means(seasonal.decade_readings(i.daily_temp, DECADE))
    return _round(seasonal.reach_map_table(i.contributing_area, means))


@query(
    "huc12_tagged",
    f"""SELECT d.project, d.comid, {DAY_SQL.replace('date AS DATE', 'd.date AS DATE')}, d.stream_temp, a.HUC12
    FROM daily_temp d LEFT JOIN contributing_area a ON d.project = a.project AND d.comid = a.featureid""",
)
def huc12_tagged(spark, folder):
    i = Inputs(spark, folder)
    return seasonal.huc12_tagged(i.daily_temp, i.contributing_area).withColumn("date", _day())


@query(
    "huc12_map_table",
    f"""WITH m AS ({HUC_MEANS}) SELECT b.project, b.HUC12, b.name, {_rounded_means('m.')}
    FROM huc12_boundaries b LEFT JOIN m ON b.project = m.project AND b.HUC12 IS NOT DISTINCT FROM m.HUC12""",
)
def huc12_map_table(spark, folder):
    i = Inputs(spark, folder)
    means = seasonal.seasonal_means_huc12(seasonal.decade_readings(i.daily_temp, DECADE), i.contributing_area)
    return _round(seasonal.huc12_map_table(i.huc12_boundaries, means))


@query(
    "union_projects",
    "SELECT project, featureid, HUC12, CAST(NULL AS VARCHAR) AS name FROM contributing_area"
    " UNION ALL SELECT project, NULL, HUC12, name FROM huc12_boundaries",
)
def union_projects(spark, folder):
    i = Inputs(spark, folder)
    return seasonal.union_projects(i.contributing_area, i.huc12_boundaries)


# --- growth ----------------------------------------------------------------


@query(
    "growth_daily",
    f"""SELECT project, comid, {DAY_SQL}, round({growth_sql('stream_temp', RED)}, 6) AS red_band,
    round({growth_sql('stream_temp', CHI)}, 6) AS chinook,
    CASE WHEN project = 'p0' THEN round({growth_sql('stream_temp', RED)}, 6)
         WHEN project = 'p1' THEN round({growth_sql('stream_temp', CHI)}, 6) END AS by_species
    FROM daily_temp WHERE stream_temp <> -999""",
)
def growth_daily(spark, folder):
    readings = filters.drop_nodata(Inputs(spark, folder).daily_temp)
    species = F.when(F.col("project") == "p0", RED_BAND_TROUT.species).when(
        F.col("project") == "p1", CHINOOK_SALMON.species
    ).otherwise("unknown")
    return readings.select(
        "project", "comid", _day(),
        F.round(growth("stream_temp", RED_BAND_TROUT), 6).alias("red_band"),
        F.round(growth("stream_temp", CHINOOK_SALMON), 6).alias("chinook"),
        F.round(growth_by_species("stream_temp", species), 6).alias("by_species"),
    )


@query(
    "growth_curve",
    f"""WITH d AS (SELECT project AS species, min(stream_temp) AS low, max(stream_temp) AS high FROM daily_temp
        WHERE stream_temp <> -999 GROUP BY 1),
    x AS (SELECT species, CAST(i AS INT) AS point, low + (high - low) * i / 99 AS temperature FROM d, range(100) t(i))
    SELECT species, point, round(temperature, 6) AS temperature,
           round(({growth_sql('temperature', RED).split('ELSE 1000 * ')[1].removesuffix(' END')}) * 1000, 6) AS growth_rate FROM x""",
)
def growth_curve(spark, folder):
    """The trout curve drawn over the temperature range of each project."""
    readings = filters.drop_nodata(Inputs(spark, folder).daily_temp)
    curves = readings.groupBy(F.col("project").alias("species")).agg(
        F.min("stream_temp").alias("low"), F.max("stream_temp").alias("high")
    ).withColumn("coefficients", F.array(*[F.lit(c) for c in RED]))
    table = growth_curve_table(curves)
    return table.select(
        "species", "point", F.round("temperature", 6).alias("temperature"),
        F.round(F.col("growth_rate") * 1000, 6).alias("growth_rate"),
    )


@query(
    "fit_growth",
    """SELECT l_returnflag AS species, round(min(l_quantity) * 0.6, 6) AS low, round(max(l_quantity) * 0.6, 6) AS high, power,
        CAST(0 AS DOUBLE) AS rest FROM lineitem CROSS JOIN (SELECT unnest(range(0, 7)) AS power) GROUP BY l_returnflag, power""",
)
def fit_growth(spark, folder):
    """A curve per return flag through discount against temperature.

    The fit is the least squares one exactly if what it leaves of the rates has
    no part along any power of the temperature: each such sum is compared with zero.
    """
    points = Inputs(spark, folder).lineitem.select(
        F.col("l_returnflag").alias("species"),
        (F.col("l_quantity") * 0.6).alias("temperature"),
        F.col("l_discount").alias("growth_rate"),
    )
    fits = fitting.fit_growth_curve(points)
    u = (2 * F.col("temperature") - F.col("low") - F.col("high")) / (F.col("high") - F.col("low"))
    left = points.join(F.broadcast(fits), "species").withColumn("u", u)
    fitted = F.aggregate(F.reverse("scaled_coefficients"), F.lit(0.0), lambda total, c: total * F.col("u") + c)
    left = left.withColumn("left", F.col("growth_rate") - fitted)
    powers = F.array(*[F.sum(F.pow("u", F.lit(k)) * F.col("left")) for k in range(7)])
    sums = left.groupBy("species", "low", "high").agg(powers.alias("sums"))
    return sums.select("species", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"),
                       F.posexplode("sums").alias("power", "rest")).withColumn("rest", F.round("rest", 6) + F.lit(0.0))


# --- one year, one network ---------------------------------------------------

HUC_REACHES = f"SELECT featureid AS comid FROM contributing_area WHERE HUC12 = '{HUC12}'"
UP_SQL = f"""up AS (SELECT CAST({REACH} AS BIGINT) AS comid, CAST(0 AS DOUBLE) AS distance_km
    UNION ALL SELECT e.comid, coalesce(e.length_km, 0) + up.distance_km FROM flow_edges e JOIN up ON e.tocomid = up.comid)"""
NEAR_SQL = "near AS (SELECT comid, distance_km FROM up WHERE distance_km <= 999)"
SCOPE_SQL = f"""scope AS (SELECT comid, bool_or(is_upstream) AS is_upstream FROM (
    SELECT comid, TRUE AS is_upstream FROM near UNION ALL SELECT comid, FALSE FROM ({HUC_REACHES}))
    GROUP BY comid)"""
DAILY_SQL = f"""daily AS (SELECT d.project, s.is_upstream, d.date, avg({growth_sql('d.stream_temp', RED)}) AS daily_fish_growth
    FROM daily_temp d JOIN scope s ON d.comid = s.comid WHERE {YEAR_SQL.replace('date', 'd.date', 1)}
    AND d.stream_temp > -50 GROUP BY 1, 2, 3)"""


def _huc_reaches(i: Inputs):
    return filters.standardise_ids(filters.filter_huc12(i.contributing_area, HUC12))


def _start(i: Inputs):
    return i.supplier.where(F.col("s_suppkey") == REACH).select(F.col("s_suppkey").alias("comid"))


def _scope(i: Inputs):
    # The network is read by several branches of a plan, so it is stored once.
    tributaries = network.upstream(i.flow_edges, REACH)
    return stored(network.network_scope(_start(i), tributaries, _huc_reaches(i)), "scope")


@query(
    "reach_semi",
    f"SELECT project, comid, {DAY_SQL}, stream_temp FROM daily_temp"
    f" WHERE (project, comid) IN (SELECT (project, featureid) FROM contributing_area WHERE HUC12 = '{HUC12}')",
)
def reach_semi(spark, folder):
    i = Inputs(spark, folder)
    found = reach_stats.reach_semi(i.daily_temp, _huc_reaches(i))
    return found.select("project", "comid", _day(), "stream_temp")


def _label(value: str) -> str:
    text = f"CAST(CAST(round({value}, 5) AS DECIMAL(38, 5)) AS VARCHAR)"
    short = f"regexp_replace(regexp_replace({text}, '0+$', ''), '[.]$', '.0')"
    return f"CASE WHEN {value} IS NULL THEN 'N/A' ELSE {short} END"


@query(
    "reach_stats",
    f"""WITH s AS (SELECT project, comid, avg(g) AS m, var_samp(g) AS v FROM (
        SELECT project, comid, {growth_sql('stream_temp', RED)} AS g FROM daily_temp
        WHERE {YEAR_SQL} AND stream_temp <> -999) GROUP BY project, comid)
    SELECT a.featureid AS comid, a.project, a.HUC12, round(m, 6) AS Growth_Mean, round(v, 6) AS Growth_Var,
           {_label('m')} AS Growth_Mean_text, {_label('v')} AS Growth_Var_text
    FROM contributing_area a LEFT JOIN s ON a.featureid = s.comid AND a.project = s.project""",
)
def reach_stats_query(spark, folder):
    i = Inputs(spark, folder)
    catchments = filters.standardise_ids(i.contributing_area)
    stats = reach_stats.reach_growth_stats(i.daily_temp, catchments, YEAR, RED_BAND_TROUT)
    return _round(reach_stats.reach_stats_table(catchments, stats))


@query("upstream", f"WITH RECURSIVE {UP_SQL}, {NEAR_SQL} SELECT comid, distance_km FROM near")
def upstream(spark, folder):
    """One question to a labelled network."""
    return network.upstream(network.label_network(Inputs(spark, folder).flow_edges), REACH)


MANY_SQL = """WITH RECURSIVE up AS (SELECT s_suppkey AS start, s_suppkey AS comid, CAST(0 AS DOUBLE) AS distance_km FROM supplier
    UNION ALL SELECT up.start, e.comid, coalesce(e.length_km, 0) + up.distance_km FROM flow_edges e
    JOIN up ON e.tocomid = up.comid WHERE coalesce(e.length_km, 0) + up.distance_km <= 40) SELECT start, comid, distance_km FROM up"""


@query("upstream_many", MANY_SQL)
def upstream_many(spark, folder):
    i = Inputs(spark, folder)
    starts = i.supplier.select(F.col("s_suppkey").alias("comid"))
    return network.upstream_many(i.flow_edges, starts, max_km=40.0)


@query("upstream_labelled", MANY_SQL)
def upstream_labelled(spark, folder):
    """Every reach as a start, asked of a labelled network."""
    i = Inputs(spark, folder)
    starts = i.supplier.select(F.col("s_suppkey").alias("comid"))
    return network.upstream_many(network.label_network(i.flow_edges), starts, max_km=40.0)


@query(
    "upstream_braided",
    """WITH RECURSIVE arms AS (SELECT comid, tocomid, length_km FROM flow_edges
        UNION ALL SELECT s_suppkey, s_suppkey - 7, CAST(2 AS DOUBLE) FROM supplier WHERE s_suppkey % 5 = 4 AND s_suppkey >= 7),
    up AS (SELECT CAST(3 AS BIGINT) AS comid, CAST(0 AS DOUBLE) AS km UNION
        SELECT e.comid, coalesce(e.length_km, 0) + up.km FROM arms e JOIN up ON e.tocomid = up.comid WHERE coalesce(e.length_km, 0) + up.km <= 60)
    SELECT comid, min(km) AS distance_km FROM up GROUP BY comid""",
)
def upstream_braided(spark, folder):
    """A network in which every fifth reach has a side arm to another valley."""
    i = Inputs(spark, folder)
    arms = i.supplier.where("s_suppkey % 5 = 4 AND s_suppkey >= 7").selectExpr("s_suppkey AS comid", "s_suppkey - 7 AS tocomid", "CAST(2 AS DOUBLE) AS length_km")
    return network.upstream(network.label_network(i.flow_edges.unionByName(arms)), 3, max_km=60.0)


@query("network_scope", f"WITH RECURSIVE {UP_SQL}, {NEAR_SQL}, {SCOPE_SQL} SELECT comid, is_upstream FROM scope")
def network_scope(spark, folder):
    return _scope(Inputs(spark, folder))


@query(
    "network_role",
    f"""WITH RECURSIVE {UP_SQL}, {NEAR_SQL} SELECT a.project, a.featureid AS comid, a.HUC12,
    CASE WHEN a.featureid = {REACH} THEN 'selected' WHEN n.comid IS NOT NULL THEN 'upstream' ELSE 'other' END AS role
    FROM contributing_area a LEFT JOIN near n ON a.featureid = n.comid""",
)
def network_role(spark, folder):
    i = Inputs(spark, folder)
    reaches = filters.standardise_ids(i.contributing_area)
    found = network.network_role(reaches, _start(i), network.upstream(i.flow_edges, REACH))
    return found.select("project", "comid", "HUC12", "role")


@query(
    "network_daily",
    f"""WITH RECURSIVE {UP_SQL}, {NEAR_SQL}, {SCOPE_SQL}, {DAILY_SQL}
    SELECT project, is_upstream, {DAY_SQL}, round(daily_fish_growth, 6) AS daily_fish_growth FROM daily""",
)
def network_daily(spark, folder):
    i = Inputs(spark, folder)
    daily = reach_stats.network_daily_growth(i.daily_temp, _scope(i), YEAR, RED_BAND_TROUT)
    return _round(daily.withColumn("date", _day()))


@query(
    "network_summary",
    f"""WITH RECURSIVE {UP_SQL}, {NEAR_SQL}, {SCOPE_SQL}, {DAILY_SQL}
    SELECT p.project, f.flag AS is_upstream, round(coalesce(avg(daily_fish_growth), 0), 6) AS growth_mean,
           round(coalesce(var_samp(daily_fish_growth), 0), 6) AS growth_var
    FROM (SELECT DISTINCT project FROM daily) p CROSS JOIN (VALUES (TRUE), (FALSE)) f(flag)
    LEFT JOIN daily ON daily.is_upstream = f.flag AND daily.project = p.project GROUP BY p.project, f.flag""",
)
def network_summary(spark, folder):
    i = Inputs(spark, folder)
    daily = reach_stats.network_daily_growth(i.daily_temp, _scope(i), YEAR, RED_BAND_TROUT)
    return _round(reach_stats.network_growth_summary(daily))


# --- geometry ----------------------------------------------------------------


@query(
    "layer_bounds",
    """SELECT HUC12, CAST(min(featureid % 10) AS DOUBLE) AS min_x, CAST(min(featureid // 10) AS DOUBLE) AS min_y,
    CAST(max(featureid % 10) + 1 AS DOUBLE) AS max_x, CAST(max(featureid // 10) + 1 AS DOUBLE) AS max_y,
    (min(featureid % 10) + max(featureid % 10) + 1) / 2 AS center_x,
    (min(featureid // 10) + max(featureid // 10) + 1) / 2 AS center_y
    FROM contributing_area GROUP BY HUC12""",
)
def layer_bounds(spark, folder):
    return spatial.layer_bounds(Inputs(spark, folder).catchments, "HUC12")


@query(
    "clip_flowlines",
    """WITH e AS (SELECT comid, comid % 10 + 0.5 AS px, comid // 10 + 0.25 AS py, tocomid % 10 + 0.375 AS qx,
              tocomid // 10 + 0.5 AS qy FROM flow_edges WHERE tocomid IS NOT NULL),
    seg AS (SELECT comid, CAST(px AS DOUBLE) AS x1, CAST(py AS DOUBLE) AS y1, CAST((px + qx) / 2 AS DOUBLE) AS x2,
                   CAST((py + qy) / 2 AS DOUBLE) AS y2 FROM e
            UNION ALL SELECT comid, (px + qx) / 2, (py + qy) / 2, qx, qy FROM e),
    box AS (SELECT HUC12, CAST(featureid % 10 AS DOUBLE) AS w, CAST(featureid // 10 AS DOUBLE) AS s FROM contributing_area),
    t AS (SELECT HUC12, comid, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len,
        greatest(0, CASE WHEN x2 = x1 THEN CASE WHEN x1 BETWEEN w AND w + 1 THEN 0 ELSE 2 END
                         ELSE least((w - x1) / (x2 - x1), (w + 1 - x1) / (x2 - x1)) END,
                 CASE WHEN y2 = y1 THEN CASE WHEN y1 BETWEEN s AND s + 1 THEN 0 ELSE 2 END
                      ELSE least((s - y1) / (y2 - y1), (s + 1 - y1) / (y2 - y1)) END) AS t0,
        least(1, CASE WHEN x2 = x1 THEN 1 ELSE greatest((w - x1) / (x2 - x1), (w + 1 - x1) / (x2 - x1)) END,
              CASE WHEN y2 = y1 THEN 1 ELSE greatest((s - y1) / (y2 - y1), (s + 1 - y1) / (y2 - y1)) END) AS t1
        FROM seg JOIN box ON greatest(x1, x2) >= w AND least(x1, x2) <= w + 1
                         AND greatest(y1, y2) >= s AND least(y1, y2) <= s + 1)
    SELECT HUC12, comid, round(sum((t1 - t0) * len), 6) AS length FROM t WHERE t1 > t0 GROUP BY HUC12, comid""",
)
def clip_flowlines(spark, folder):
    i = Inputs(spark, folder)
    clipped = spatial.clip_flowlines(i.flowlines, i.catchments)
    return clipped.select("HUC12", "comid", F.round("length", 6).alias("length"))


