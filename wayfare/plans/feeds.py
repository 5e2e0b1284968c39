"""Queries that write feeds, GeoJSON and saved elements of the tables, read them back, and clean them; with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import display
from wayfare.operators import access, graph, stations, streets, viewport
from wayfare.operators.tables import MODES, work_root
from wayfare.plans.catalog import ACTIVE, BY_MODE, UNSCHEDULED, _streets, lines, query, with_groups
from wayfare.plans.journeys import ACTIVE_SQL, LATER, TILES
from wayfare.plans.synth import view
from wayfare.sources import geojson, gtfs, sidecars, tile_archive


def folder(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- feeds ---

STOPS = """select concat('p', s_suppkey) as stop_id, concat(case when s_suppkey % 4 = 0 then 'Gare "Nord", ' else 'Parada ' end, s_suppkey) as stop_name,
  case when s_suppkey % 17 = 3 then 'x' else cast(19 + s_suppkey/8 as varchar(40)) end as stop_lat, cast(s_suppkey/16 - 99 as varchar(40)) as stop_lon,
  case s_suppkey % 5 when 0 then '1' when 1 then '2' when 2 then '' else '0' end as location_type, case when s_suppkey % 3 = 1 then concat('p', s_suppkey - s_suppkey % 5) else '' end as parent_station from supplier"""
PLACED = f"""stops as ({STOPS}), placed as (select *, try_cast(stop_lat as double) as lat, try_cast(stop_lon as double) as lon from stops),
rows_ as (select * from placed where lat is not null and lon is not null and (location_type = '1' or stop_id in (select parent_station from stops) or (parent_station = '' and location_type not in ('2', '3', '4'))))"""


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STOPS.replace("from supplier", "from {supplier}"), supplier=view(spark, sf_dir, "supplier"))


def _read_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "feed")
    gtfs.write_table(_stops(spark, sf_dir), path, "stops")
    return gtfs.read_table(spark, path, "stops")


@query(f"with {PLACED} select stop_id, stop_name, lat, lon from rows_")
def feed_stop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of a feed that was written as CSV and read by its header."""
    return gtfs.stop_rows(_read_stops(spark, sf_dir)).select("stop_id", "stop_name", "lat", "lon")


@query(f"with {PLACED} select s.stop_id, coalesce(r.stop_id, s.stop_id) as station_id from stops s left join rows_ r on r.stop_id = s.parent_station")
def feed_stop_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = _read_stops(spark, sf_dir)
    return gtfs.station_of_stop(stops, gtfs.stop_rows(stops))


@query(f"{STOPS.replace(' as varchar(40)', ' as varchar')}")
def feed_zip_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table out of zip files."""
    own, path = _stops(spark, sf_dir), folder(spark, "zips")
    gtfs.write_zips(own.repartition(4), path, "stops")
    return gtfs.read_zip(spark, f"{path}/*.zip", "stops").select(*own.columns)


ROUTES = """select distinct concat('R', o_custkey % 20) as route_id, case o_custkey % 20 % 5 when 0 then 'METRO' when 1 then 'TROLE' when 2 then 'SUB' when 3 then 'MB' else 'X' end as agency_id,
  cast(o_custkey % 20 as varchar(9)) as route_short_name, case o_custkey % 20 % 3 when 0 then '0' when 1 then '900' else '3' end as route_type from orders"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ROUTES.replace("from orders", "from {orders}"), orders=view(spark, sf_dir, "orders"))


@query(f"select route_id, case agency_id when 'METRO' then 'subway' when 'SUB' then 'commuter_rail' when 'MB' then 'brt' when 'TROLE' then case when route_short_name in ('10', '11', '12', '13') then 'brt' end end as mode from ({ROUTES})")
def feed_agency_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gtfs.agency_mode(_routes(spark, sf_dir)).select("route_id", "mode")


@query(f"""with r as ({ROUTES}) select station_id as stop_id, min(case when route_type in ('0', '900') then 'light_rail' else 'commuter_rail' end) as mode
from {{timed}} t join r on r.route_id = regexp_replace(service_key, '/[^/]*$', '') where station_id is not null group by 1""")
def feed_stop_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commuter rail stands before light rail at stops of both."""
    timed = view(spark, sf_dir, "timed").where("station_id is not null")
    trips = timed.select("trip_id", F.regexp_replace("service_key", "/[^/]*$", "").alias("route_id")).distinct()
    return gtfs.stop_modes(_routes(spark, sf_dir), trips, timed.select("trip_id", F.col("station_id").alias("stop_id")))


@query("select event_id, cast(isodow(ts - interval 6 hour) - 1 as int) as weekday, cast(hour(ts - interval 6 hour)*60 + minute(ts - interval 6 hour) as int) as minute from events")
def departure_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the clock of a zone six hours behind UTC."""
    weekday, minute = display.departure(F.col("ts"), "America/Mexico_City")
    return view(spark, sf_dir, "events").select("event_id", weekday.alias("weekday"), minute.cast("int").alias("minute"))


# --- GeoJSON ---

LINES = "select street_id, count(*) as points, min(lon) as west, max(lat) as north from {vertices} group by 1"


@query(LINES)
def geojson_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets as one collection, read back in ranges of its bytes."""
    path = folder(spark, "streets")
    geojson.write_collection(lines(spark, sf_dir), path, ["street_id"], line=True)
    rows = geojson.read_features(spark, geojson.single(path), "street_id bigint", line=True, range_bytes=1 << 18)
    return _extent(rows)


def _extent(rows: DataFrame) -> DataFrame:
    return rows.select("street_id", F.size("pts").cast("long").alias("points"), F.array_min(F.transform("pts", lambda p: p["lon"])).alias("west"), F.array_max(F.transform("pts", lambda p: p["lat"])).alias("north"))


@query(LINES)
def feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets as a feature a line."""
    path = folder(spark, "lines")
    geojson.write_features(lines(spark, sf_dir), path, ["street_id"], line=True)
    rows = spark.read.schema("geometry struct<coordinates: array<array<double>>>, properties struct<street_id: bigint>").json(path)
    return _extent(rows.select("properties.street_id", F.transform("geometry.coordinates", lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"))).alias("pts")))


@query("select p_partkey as id, 2 + p_partkey % 3 as points, concat('h', p_partkey % 4) as h from part")
def streets_as_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets out of a collection as elements again."""
    path = folder(spark, "streets")
    own = lines(spark, sf_dir).withColumn("h", F.concat(F.lit("h"), (F.col("street_id") % 4).cast("string")))
    geojson.write_collection(own, path, ["street_id", "h"], line=True)
    rows = geojson.read_features(spark, geojson.single(path), "street_id bigint, h string", line=True)
    made = geojson.as_elements(rows.drop("ord").withColumnRenamed("street_id", "ord"), ["h"])
    return made.where("type = 'way'").select("id", F.size("geometry").cast("long").alias("points"), F.col("tags")["h"].alias("h"))


@query("""with v as (select street_id, i, case when (street_id + i) % 5 = 0 then null else lon end as lon, case when (street_id*3 + i) % 7 = 0 then cast('nan' as double) else lat end as lat from {vertices})
select street_id, count(*) as points from v where lon is not null and not isnan(lat) group by 1 having count(*) >= 2""")
def valid_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets without points that are no coordinates, if two are left."""
    own = lines(spark, sf_dir)
    spoilt = F.transform("pts", lambda p, i: F.struct(F.when((F.col("street_id") + i) % 5 != 0, p["lon"]).alias("lon"), F.when((F.col("street_id") * 3 + i) % 7 == 0, float("nan")).otherwise(p["lat"]).alias("lat")))
    return streets.valid(own.withColumn("pts", spoilt)).select("street_id", F.size("pts").cast("long").alias("points"))


@query("""select street_id, case street_id % 4 when 0 then 8 when 1 then 10 when 2 then 13 else 13 end as minzoom, min(lon) filter (i = 0) as lon, min(lat) filter (i = 0) as lat from {vertices}
group by 1, 2 having case street_id % 4 when 0 then 8 when 1 then 10 else 13 end <= 10 and floor(min(lon) filter (i = 0)/0.05e0) between -1984 and -1981 and floor(min(lat) filter (i = 0)/0.05e0) between 386 and 387""")
def tile_viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets by the tile of their first point in an archive, and those of a viewport's tiles up to its zoom."""
    path = folder(spark, "tiles")
    first = F.element_at("pts", 1)
    zoom = F.element_at(F.array(*map(F.lit, (8, 10, 13, 13))), (F.col("street_id") % 4 + 1).cast("int"))
    tile_archive.write(lines(spark, sf_dir).select("street_id", zoom.alias("minzoom"), first["lon"].alias("lon"), first["lat"].alias("lat")), path)
    return tile_archive.viewport(spark, path, 10, -99.19, 19.32, -99.01, 19.39).select("street_id", "minzoom", "lon", "lat")


# --- saved elements ---

ELEMENTS = """select case when s_suppkey % 7 = 6 then 'way' else 'node' end as type, s_suppkey as id, concat('Stop ', s_suppkey % 40) as name,
  case when s_suppkey % 7 = 6 then null else -99 + s_suppkey % 40/1024 + 0.00001 end as lon, case when s_suppkey % 7 = 6 then null else 19 + s_suppkey % 40/512 end as lat,
  case when s_suppkey % 7 = 6 and s_suppkey % 2 = 0 then -99 - s_suppkey % 40/1024 end as clon, case when s_suppkey % 7 = 6 and s_suppkey % 2 = 0 then 19 + s_suppkey % 40/256 end as clat,
  case s_suppkey % 6 when 0 then 'platform' when 1 then 'stop_position' when 2 then 'other' else 'station' end as kind, case when s_suppkey % 6 = 1 and s_suppkey % 4 = 1 then '' else concat('Stop ', s_suppkey % 40) end as label from supplier"""


def _elements(spark: SparkSession, sf_dir: str, change: str = "") -> DataFrame:
    own = spark.sql(ELEMENTS.replace("from supplier", "from {supplier}"), supplier=view(spark, sf_dir, "supplier"))
    tags = F.map_from_arrays(F.array(*map(F.lit, ("name", "station", "public_transport"))), F.array(F.concat("label", F.lit(change)), F.lit("subway"), F.col("kind")))
    centre = F.when(F.col("clon").isNotNull(), F.struct(F.col("clon").alias("lon"), F.col("clat").alias("lat")))
    return own.select("type", "id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), centre.cast("struct<lon: double, lat: double>").alias("center"), tags.alias("tags"))


def _saved(spark: SparkSession, *responses: DataFrame) -> DataFrame:
    paths = [folder(spark, "elements") for _ in responses]
    for df, path in zip(responses, paths, strict=True):
        geojson.write_elements(df, path)
    return geojson.read_elements(spark, [geojson.single(p) for p in paths], range_bytes=1 << 18)


@query(f"with e as ({ELEMENTS}) select type, id, label || case when id % 3 = 0 then ' new' else '' end as name, case when id % 3 = 0 then 1 else 0 end as tile from e")
def saved_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saved responses that overlap; the later one's elements count."""
    rows = _saved(spark, _elements(spark, sf_dir), _elements(spark, sf_dir, " new").where("id % 3 = 0"))
    return rows.select("type", "id", F.col("tags")["name"].alias("name"), F.shiftright("ord", 40).cast("int").alias("tile"))


@query(f"""with e as ({ELEMENTS}), s as (select type || '/' || id as id, label as name, round(coalesce(lon, clon)::double, 4) as lon, round(coalesce(lat, clat)::double, 4) as lat, row_number() over (partition by round(coalesce(lon, clon)::double, 4), round(coalesce(lat, clat)::double, 4), label order by e.id) as r
  from e where coalesce(lon, clon) is not null and kind <> 'other' and not (label = '' and kind = 'stop_position')) select id, name, lon, lat from s where r = 1""")
def element_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of tagged elements: those with a place, their own or the centre's, that are like stations and have a name where they must."""
    own = _saved(spark, _elements(spark, sf_dir).orderBy("id")).withColumn("ord", F.col("id"))
    return stations.from_elements(own, F.lit("2026-07-21").cast("date")).where("mode = 'subway'").select("id", "name", "lon", "lat")


RELATIONS = """select l_orderkey as relation, l_suppkey as member, case l_orderkey % 3 when 0 then 'Metrobús' when 1 then 'Mexibús' else 'Metrobus Línea' end as network, concat('L', l_orderkey % 6) as ref,
  case when l_orderkey % 4 = 0 then 'Operadora' else '' end as operator, l_linenumber % 3 as role from lineitem"""


@query(f"""with r as ({RELATIONS}), m as (select relation, member, network, ref, case when operator <> '' then operator when relation % 3 = 1 then 'Mexibús' else 'Metrobús' end as operator from r where role > 0),
v as (select member, 'n' as c, network as x, min(relation) as k from m group by all union all select member, 'o', operator, min(relation) from m group by all union all select member, 'r', ref, min(relation) from m group by all)
select member as id, string_agg(x, ';' order by k) filter (c = 'n') as network, string_agg(x, ';' order by k) filter (c = 'o') as operator, string_agg(x, ';' order by k) filter (c = 'r') as route_ref from v group by 1""")
def route_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops inherit of the routes that they are members of, in the order of the routes."""
    own = spark.sql(RELATIONS.replace("from lineitem", "from {lineitem}"), lineitem=view(spark, sf_dir, "lineitem"))
    tags = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("network", "ref", "operator"))), F.array("network", "ref", "operator")), lambda k, v: v != "")
    role = F.element_at(F.array(*map(F.lit, ("", "stop", "platform_entry"))), (F.col("role") + 1).cast("int"))
    members = F.collect_list(F.struct(F.lit("node").alias("type"), F.col("member").alias("ref"), role.alias("role")))
    routes = own.groupBy(F.col("relation").alias("id"), tags.alias("tags").cast("string").alias("__key")).agg(F.first(tags).alias("tags"), members.alias("members"))
    nothing = F.lit(None).cast("double")
    elements = routes.select(F.lit("relation").alias("type"), "id", nothing.alias("lon"), nothing.alias("lat"), F.lit(None).cast("struct<lon: double, lat: double>").alias("center"), "tags", "members")
    found = stations.route_contexts(elements)
    return found.select("id", *(F.col("ctx")[c].alias(c) for c in ("network", "operator", "route_ref")))


@query("""with c as (select (select count(*) from supplier) as stations, (select count(*) from part) as streets, (select count(*) from orders) as trips)
select k as key, v as value, 'a,b,c' as sources from (select 'stations' as k, cast(stations as varchar) as v from c union all select 'streets', cast(streets*2 as varchar) from c union all select 'trips', cast(trips as varchar) from c)""")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values over old ones, and the sources of both."""
    n = lambda t: view(spark, sf_dir, t).agg(F.count(F.lit(1)).cast("string").alias("n"))
    row = lambda df, names, sources: df.select(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*df.columns)).alias("meta"), F.array(*map(F.lit, sources)).alias("sources"))
    old = row(n("supplier").toDF("a").crossJoin(n("part").toDF("b")), ["stations", "streets"], ["a", "b"])
    twice = view(spark, sf_dir, "part").agg((F.count(F.lit(1)) * 2).cast("string").alias("b"))
    new = row(twice.crossJoin(n("orders").toDF("c")), ["streets", "trips"], ["b", "c"])
    got = geojson.merged_metadata(old, new)
    return got.select(F.explode("meta").alias("key", "value"), F.array_join("sources", ",").alias("sources"))


# --- both pools ---


@query(f"""with {BY_MODE}, {LATER}, d as (select street_id, min(least(dist_m, 5001)) as dist_m from (select street_id, mode, dist_m from by_mode union all select street_id, mode, dist_m from f_by_mode) where mode in {ACTIVE_SQL} group by 1)
select street_id, coalesce(dist_m, 5000) as dist_m from (select distinct street_id from {{edges}}) left join d using (street_id)""")
def active_distance_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With stations that aren't open yet."""
    own = lines(spark, sf_dir)
    near = lambda name: access.nearest(own, view(spark, sf_dir, name), 1, by_mode=True)
    return access.active_distance(near("open_stations"), own, ACTIVE, future=near("future_stations"))


@query(UNSCHEDULED.replace("{open_stations}", "{stations}"))
def transit_times_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unscheduled times with stations that aren't open yet."""
    nodes = with_groups(access.included(view(spark, sf_dir, "stations"), True))
    dest = spark.createDataFrame([(0, 0)], "dest int, station_id long")
    return graph.transit_times(dest, nodes, graph.unscheduled_graph(nodes), station_waits=view(spark, sf_dir, "waits")).select("station_id", F.round("minutes", 6).alias("minutes"))


SELECTION = "array_to_string(list_filter([" + ", ".join(f"case when pick & {1 << b} <> 0 then '{m}' end" for b, m, *_ in MODES) + "], lambda x: x is not null), ',')"
BIT_OF = "case mode " + " ".join(f"when '{m}' then {1 << b}" for b, m, *_ in MODES) + " else 0 end"


@query("with " + TILES.replace("{edges}", "seg_edges") + f""", near0 as (select sid, min(dist_m) as d from both_pools where pool = 'open' group by 1), seg_ids as (select distinct sid from seg_points),
bars as (select s.sid, coalesce(d, 5001) as d from seg_ids s left join near0 using (sid)), masks as (select s.sid, coalesce(bit_or({BIT_OF}), 0) as mask from seg_ids s left join (select * from both_pools where pool = 'open' and dist_m <= 2500) b using (sid) group by 1)
select 'histogram' as kind, key, n from (select 'under_500' as key, count(*) filter (d <= 500) as n from bars union all select 'under_1000', count(*) filter (d <= 1000) from bars union all select 'under_2500', count(*) filter (d <= 2500) from bars union all select 'under_5000', count(*) filter (d <= 5000) from bars union all select 'over_5000', count(*) filter (d > 5000) from bars)
union all select 'near', {SELECTION}, (select count(*) from masks where mask & pick <> 0) from (select cast(range as int) as pick from range(128))
union all select 'count', 'segments', count(*) from seg_ids union all select 'count', 'source_streets', count(distinct sid // 1000) from seg_ids""")
def tile_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.tile_statistics(access.tile_segments(_streets(spark, sf_dir, 3)), view(spark, sf_dir, "stations"))


@query(f"""with {BY_MODE}, {LATER} select street_id, 'open' as pool, m.mode, least(dist_m, 5001) as dist_m, case when dist_m > 5000 then -1 else s.ord end as station_ord from by_mode m join {{stations}} s on s.id = station_id
union all select street_id, 'future', m.mode, least(dist_m, 5001), case when dist_m > 5000 then -1 else s.ord end from f_by_mode m join {{stations}} s on s.id = station_id""")
def sidecar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """street_features() as columns by the street's number, read back."""
    own, path = lines(spark, sf_dir), folder(spark, "sidecars")
    numbers = streets.numbered(own.select("street_id", F.lit(0).alias("seg_no")))
    sidecars.write(access.street_features(own, view(spark, sf_dir, "stations")), numbers, path)
    return sidecars.read(spark, path).join(numbers.select("street_id", "i"), "i").select("street_id", "pool", "mode", "dist_m", "station_ord")


@query("""with b as (select p_partkey as box_id, -99.25e0 + (p_partkey*7 % 50)/200e0 as west, 19.25e0 + (p_partkey*11 % 50)/200e0 as south, (p_partkey % 13)/100e0 as w, (p_partkey % 17)/80e0 as h from part)
select box_id, count(s.id) as n from b left join {open_stations} s on s.lon between west and west + w and s.lat between south and south + h group by 1""")
def viewport_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open stations in many boxes at once."""
    k = F.col("p_partkey")
    boxes = view(spark, sf_dir, "part").select(k.alias("box_id"), (-99.25 + (k * 7 % 50) / 200).alias("west"), (19.25 + (k * 11 % 50) / 200).alias("south"), (k % 13 / 100).alias("w"), (k % 17 / 80).alias("h"))
    boxes = boxes.select("box_id", "west", "south", (F.col("west") + F.col("w")).alias("east"), (F.col("south") + F.col("h")).alias("north"))
    return viewport.counts(view(spark, sf_dir, "open_stations"), boxes)
