"""The queries by name, over views of the standard tables, and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import display, text
from wayfare.operators import access, graph, names, schedule, stations, streets
from wayfare.operators.tables import MODES
from wayfare.plans.synth import VIEWS, duckdb, view
from wayfare.sources.curated import curated, rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BOX = (-99.18, 19.31, -99.12, 19.37)
ACTIVE = ["subway", "brt", "cable_car"]
DESTINATIONS = (0, 12)
YELLOW = 15
TODAY = "2026-07-21"

# --- SQL in common ---
HAVERSINE = "2*6371008.8e0*asin(least(1e0, sqrt(sin(radians({lat2}-{lat1})/2)*sin(radians({lat2}-{lat1})/2)+cos(radians({lat1}))*cos(radians({lat2}))*sin(radians({lon2}-{lon1})/2)*sin(radians({lon2}-{lon1})/2))))"


def hav(a: str, b: str) -> str:
    for n, x in (("lat1", f"{a}.lat"), ("lon1", f"{a}.lon"), ("lat2", f"{b}.lat"), ("lon2", f"{b}.lon")):
        out = (out if n != "lat1" else HAVERSINE).replace("{" + n + "}", x)
    return out


def norm(x: str) -> str:
    return f"trim(lower(strip_accents({x})))"


def norm_name(x: str) -> str:
    bare = f"lower(strip_accents({x}))"
    for words in (text.GENERIC_WORDS, text.COMPASS_WORDS):
        bare = f"regexp_replace({bare}, '\\b({words})\\b', ' ', 'g')"
    return f"trim(regexp_replace({bare}, '[^a-z0-9]+', ' ', 'g'))"


def case_mode(values: list[float], other: float, mode: str = "mode") -> str:
    return f"case {mode} " + " ".join(f"when '{m}' then {v}e0" for (_, m, *_), v in zip(MODES, values, strict=True)) + f" else {other}e0 end"


MATCHED = f"(x <> '' and y <> '' and (x = y or (length(x) >= 5 and (contains(x, y) or contains(y, x))) or (case when least(len(wx), len(wy)) > 0 then len(list_intersect(wx, wy))/least(len(wx), len(wy)) >= 0.6 else false end)))"
SPEED, LINK = case_mode([m[3] for m in MODES], 22, "{m}"), case_mode([m[4] for m in MODES], 3000, "{m}")
XY = "6371008.8e0*radians({p}.lon{k})*cos(radians(r.ref)) as {q}x{k}, 6371008.8e0*radians({p}.lat{k}) as {q}y{k}"
#: Least distance of each street from each open station.
DISTANCES = f"""
ref as (select avg(lat) as ref from {{open_stations}}),
sxy as (select s.id, s.ord, s.mode, {XY.format(p="s", q="s", k="")} from {{open_stations}} s cross join ref r),
exy as (select e.street_id, {XY.format(p="e", q="", k="1")}, {XY.format(p="e", q="", k="2")} from {{edges}} e cross join ref r),
exy2 as (select *, x2-x1 as dx, y2-y1 as dy from exy),
shares as (select street_id, id, ord, mode, sx, sy, x1, y1, dx, dy, case when dx*dx+dy*dy > 0 then greatest(0e0, least(1e0, ((sx-x1)*dx+(sy-y1)*dy)/(dx*dx+dy*dy))) else 0e0 end as t from exy2 cross join sxy),
dist as (select street_id, id, ord, mode, min((sx-(x1+t*dx))*(sx-(x1+t*dx)) + (sy-(y1+t*dy))*(sy-(y1+t*dy))) as d2 from shares group by all)"""
BY_MODE = DISTANCES + ", by_mode as (select street_id, mode, id as station_id, cast(floor(sqrt(d2)+5e-1) as int) as dist_m from (select *, row_number() over (partition by street_id, mode order by d2, ord) as r from dist) where r = 1)"
TOP5 = DISTANCES + ", top5 as (select street_id, rank, id as station_id, ord, cast(floor(sqrt(d2)+5e-1) as int) as dist_m from (select *, cast(row_number() over (partition by street_id order by d2, ord) as int) as rank from dist) where rank <= 5)"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = duckdb(oracle)
        return f

    return put


# --- stations ---


@query("select coalesce(nullif(mode, ''), 'unknown') as value, count(*) as n from {stations} group by 1")
def station_counts_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.counts_by(view(spark, sf_dir, "stations"), "mode")


@query(f"select id, mode, lon, lat from {{stations}} where status = 'open' and mode in ('subway', 'brt', 'cable_car') and lon between {BOX[0]} and {BOX[2]} and lat between {BOX[1]} and {BOX[3]}")
def open_station_filter_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.in_box(view(spark, sf_dir, "stations"), *BOX, ACTIVE).select("id", "mode", "lon", "lat")


@query(f"select a.id as a, b.id as b, round({hav('a', 'b')}, 3) as metres from {{open_stations}} a join {{open_stations}} b on a.ord < b.ord where {hav('a', 'b')} <= 900e0")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.near_pairs(view(spark, sf_dir, "open_stations").select("id", "ord", "lon", "lat"), 900.0)
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round("metres", 3).alias("metres"))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "tagged")
    names = ("name", "network", "railway", "station", "opening_date", "trolleybus")
    return rows.select("id", "ord", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names)).alias("tags"))


CONTEXT = "trim(concat(lower(strip_accents(network)), ' ', lower(strip_accents(name))))"


@query(f"""with c as (select *, {CONTEXT} as ctx, lower(strip_accents(network)) as provider from {{tagged}})
select id, case
  when station = 'subway' or regexp_matches(ctx, '{stations.SUBWAY}') then 'subway'
  when station = 'light_rail' or regexp_matches(ctx, '{stations.LIGHT_RAIL}') then 'light_rail'
  when station = 'monorail' then 'monorail'
  when regexp_matches(ctx, '{stations.CABLE}') then 'cable_car'
  when regexp_matches(ctx, '{stations.BRT}') or ((trolleybus = 'yes' or regexp_matches(ctx, '{stations.TROLLEY}')) and regexp_matches(ctx, '{stations.CORRIDOR}')) then 'brt'
  when regexp_matches(provider, '{stations.COMMUTER_PROVIDER}') or (railway in ('station', 'halt', 'stop') and regexp_matches(ctx, '{stations.COMMUTER}')) then 'commuter_rail'
  when regexp_matches(ctx, '{stations.REGIONAL}') then 'regional_rail' else 'excluded' end as mode,
  regexp_matches(lower(strip_accents(name)), '^plaza maguey$') as false_positive from c""")
def classify_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).select("id", stations.classify().alias("mode"), stations.is_false_positive(stations.tag("name")).alias("false_positive"))


@query(f"""with c as (select *, {CONTEXT} as ctx, case length(opening_date) when 4 then opening_date > '2026' when 7 then opening_date > '2026-07' when 10 then opening_date > '{TODAY}' end as later from {{tagged}})
select id, case when regexp_matches(ctx, 'mexicable linea 3') then 'future' when later then 'future' when not later then 'open' when railway in ('proposed', 'construction') then 'future' else 'open' end as status,
  case when regexp_matches(ctx, 'mexicable linea 3') then concat('Under construction', case when opening_date <> '' then concat('; opening ', opening_date) else '' end)
    when later then concat('Opening ', opening_date) when not later then 'Open' when railway = 'proposed' then 'Planned' when railway = 'construction' then 'Under construction' else 'Open' end as status_detail from c""")
def station_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).withColumn("s", stations.status(F.lit(TODAY).cast("date"))).select("id", "s.status", "s.status_detail")


@query("""with d as (select *, round(lon, 2) as k_lon, round(lat, 2) as k_lat, row_number() over (partition by round(lon, 2), round(lat, 2), mode order by case when status = 'open' then 0 else 1 end, ord) as r, min(ord) over (partition by round(lon, 2), round(lat, 2), mode) as first_ord from {stations})
select id, first_ord as ord, status from d where r = 1""")
def dedupe_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = view(spark, sf_dir, "stations").withColumn("k_lon", F.round("lon", 2)).withColumn("k_lat", F.round("lat", 2))
    return stations.deduplicate(rows_, ["k_lon", "k_lat", "mode"]).select("id", "ord", "status")


CURATED_SQL = "c as (select * from (values " + ", ".join(f"('{i}', '{n}', {lon}e0, {lat}e0, '{m}', '{r}')" for i, _, n, lon, lat, m, _, _, _, r, *_ in rows()) + ") as t(id, name, lon, lat, mode, route_ref))"
PLANAR = "sqrt(power((c.lon4 - s.lon)*111320e0*cos(radians((c.lat4 + s.lat)/2)), 2) + power((c.lat4 - s.lat)*111320e0, 2))"


@query(f"""with {CURATED_SQL}, c4 as (select *, round(lon, 4) as lon4, round(lat, 4) as lat4 from c)
select id, mode from {{curated_like}} s where not exists (select 1 from c4 c where c.mode = s.mode and ({norm('c.name')} = {norm('s.name')} or (s.mode = 'brt' and list_contains(string_split(s.route_ref, ';'), c.route_ref))) and {PLANAR} <= 3000)
union all select id, mode from c""")
def curated_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = view(spark, sf_dir, "curated_like").select("id", F.col("ord").cast("int").alias("ord"), "name", "lon", "lat", "mode", F.lit("open").alias("status"), *(F.lit("").alias(c) for c in ("network", "operator")), "route_ref", *(F.lit("").alias(c) for c in ("route_name", "opening_date")))
    return stations.reconcile(own, curated(spark)).select("id", "mode")


@query(f"""with p as (select s.id, t.stop_id, {hav('s', 't')} as m, {norm_name('s.name')} as x, {norm_name('t.name')} as y from {{stations}} s join {{stops}} t on s.mode = t.mode and abs(s.lat - t.lat) < 0.01),
t as (select *, list_distinct(list_filter(string_split(x, ' '), lambda w: length(w) > 2)) as wx, list_distinct(list_filter(string_split(y, ' '), lambda w: length(w) > 2)) as wy from p where m <= 650)
select id, stop_id, {MATCHED} as matched from t""")
def name_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the names of stations and stops of one mode within 650 m match, of all such pairs."""
    pairs = schedule.near_stops(view(spark, sf_dir, "stations"), view(spark, sf_dir, "stops"))
    return pairs.select(F.col("station_id").alias("id"), "stop_id", "matched")


# --- streets and access ---


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streets of the view vertices, a row each."""
    place = re.search(r"cast\(-99.*(?= as lon)", VIEWS["vertices"])[0], re.search(r"cast\(19.*(?= as lat)", VIEWS["vertices"])[0]
    pts = f"transform(sequence(0, cast(1 + p_partkey % 3 as int)), i -> named_struct('lon', {place[0]}, 'lat', {place[1]}))"
    return view(spark, sf_dir, "part").selectExpr("p_partkey as street_id", f"{pts} as pts")


@query(f"with {TOP5} select street_id, station_id, dist_m from top5 where rank = 1")
def segment_nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.nearest(lines(spark, sf_dir), view(spark, sf_dir, "open_stations"), 1).select("street_id", "station_id", "dist_m")


def _top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.nearest(lines(spark, sf_dir), view(spark, sf_dir, "open_stations"), 5)


def _by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.nearest(lines(spark, sf_dir), view(spark, sf_dir, "open_stations"), 1, by_mode=True)


@query(f"with {TOP5} select street_id, rank, station_id, dist_m from top5")
def segment_top5_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top5(spark, sf_dir)


@query(f"with {BY_MODE} select street_id, mode, station_id, dist_m from by_mode")
def segment_nearest_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_mode(spark, sf_dir).select("street_id", "mode", "station_id", "dist_m")


HISTOGRAM = "select " + ", ".join(f"count(*) filter (dist_m <= {m}) as under_{m}" for m in (500, 1000, 2500, 5000)) + ", count(*) filter (dist_m > 5000) as over_5000, count(*) as streets"


@query(f"with {TOP5} {HISTOGRAM} from top5 where rank = 1")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.distance_histogram(segment_nearest_station(spark, sf_dir))


MASKS = BY_MODE + ", masks as (select coalesce(mask, 0) as mask, count(*) as streets from (select distinct street_id from {edges}) left join (select street_id, cast(bit_or(" + case_mode([1 << b for b, *_ in MODES], 0).replace("e0", "") + ") as int) as mask from by_mode where dist_m <= 2500 group by 1) using (street_id) group by 1)"


@query(f"with {MASKS} select mask, streets from masks")
def proximity_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.proximity_masks(_by_mode(spark, sf_dir), lines(spark, sf_dir))


@query(f"with {MASKS}, p as (select cast(range as int) as pick from range(128)) select array_to_string(list_filter([" + ", ".join(f"case when pick & {1 << b} <> 0 then '{m}' end" for b, m, *_ in MODES) + "], lambda x: x is not null), ',') as selection, cast(coalesce((select sum(streets) from masks where mask & pick <> 0), 0) as bigint) as near from p")
def subset_near_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.subset_near_counts(proximity_masks(spark, sf_dir))


@query("select p_partkey as street_id, case when p_partkey*7 % 6500 > 5000 then 5001 else cast(floor((p_partkey*7 % 6500)/25e0 + 5e-1)*25 as int) end as dist_m, case when p_partkey*7 % 6500 > 5000 then 1 end as over, case p_partkey % 4 when 0 then 8 when 1 then 10 when 2 then 13 else 13 end as minzoom from part")
def tile_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = view(spark, sf_dir, "part")
    own = part.select(F.col("p_partkey").alias("street_id"), (F.col("p_partkey") * 7 % 6500).cast("int").alias("dist_m"))
    h = F.element_at(F.array(*map(F.lit, ("motorway", "primary", "residential", "path"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return streets.tile_rows(own, part.select(F.col("p_partkey").alias("street_id"), h.alias("h")))


def ramp_sql(value: str, stops: list[str]) -> str:
    parts = []
    for k in range(3):
        out = f"{display.RAMP[0][k]}e0"
        for n in range(6):
            a, b = display.RAMP[n][k], display.RAMP[n + 1][k]
            out = f"case when {value} >= {stops[n]} then {a}e0 + ({value} - {stops[n]})/({stops[n + 1]} - {stops[n]})*({b - a}e0) else {out} end"
        out = f"case when {value} >= {stops[6]} then {display.RAMP[6][k]}e0 else {out} end"
        parts.append(f"lpad(lower(to_hex(cast(floor({out} + 5e-1) as bigint))), 2, '0')")
    return "concat('#', " + ", ".join(parts) + ")"


@query("with v as (select p_partkey as street_id, cast(p_partkey*7 % 6500 as double) as d from part) select street_id, " + ramp_sql("d", [f"{s}e0" for s in display.DISTANCE_STOPS]) + " as color from v")
def distance_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part").select(F.col("p_partkey").alias("street_id"), display.distance_color((F.col("p_partkey") * 7 % 6500).cast("double")).alias("color"))


@query(f"with {BY_MODE} select street_id, coalesce(min(least(dist_m, 5001)) filter (mode in ('subway', 'brt', 'cable_car')), 5000) as dist_m from (select distinct street_id from {{edges}}) left join by_mode using (street_id) group by 1")
def active_mode_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.active_distance(_by_mode(spark, sf_dir), lines(spark, sf_dir), ACTIVE)


def _streets(spark: SparkSession, sf_dir: str, decimals: int | None = None) -> DataFrame:
    at = lambda c: F.round(c, decimals) if decimals is not None else F.col(c)
    points = view(spark, sf_dir, "vertices").select("street_id", "i", at("lon").alias("lon"), at("lat").alias("lat"))
    return points.groupBy("street_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lon", "lat"))), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("pts"))


@query("select lon, lat, count(distinct street_id) as streets from (select street_id, round(lon, 3) as lon, round(lat, 3) as lat from {vertices}) group by 1, 2 having count(distinct street_id) > 1")
def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.junctions(_streets(spark, sf_dir, 3))


HAV_XY = HAVERSINE.replace("{lat1}", "a_lat").replace("{lat2}", "lat").replace("{lon1}", "a_lon").replace("{lon2}", "lon")
SEGMENTS = f"""pts as (select street_id, i, round(lon, 3) as lon, round(lat, 3) as lat from {{vertices}}),
crossings as (select lon, lat from pts group by 1, 2 having count(distinct street_id) > 1),
lagged as (select *, lag(lon) over w as a_lon, lag(lat) over w as a_lat from pts window w as (partition by street_id order by i)),
line as (select *, coalesce(sum(case when a_lon is null then 0e0 else {HAV_XY} end) over (partition by street_id order by i rows unbounded preceding), 0e0) as place from lagged where a_lon is null or a_lon <> lon or a_lat <> lat),
ends as (select street_id, place from (select l.*, row_number() over (partition by street_id order by i) as k, count(*) over (partition by street_id) as n from line l) x where n > 1 and (k = 1 or k = n or exists (select 1 from crossings c where c.lon = x.lon and c.lat = x.lat))),
stretches as (select street_id, place as s, lead(place) over (partition by street_id order by place) as e from ends),
breaks as (select street_id, s + k*200e0 as place from stretches, range(0, 10000) r(k) where e is not null and (k = 0 or s + k*200e0 < e - 1e-6) union select street_id, max(place) from ends group by 1),
segs as (select street_id, place as p, lead(place) over (partition by street_id order by place) as q, cast(row_number() over (partition by street_id order by place) - 1 as int) as seg_no from breaks),
spans as (select l.street_id, l.place as p0, lead(l.place) over w as p1, l.lon as x0, l.lat as y0, lead(l.lon) over w as x1, lead(l.lat) over w as y1 from line l window w as (partition by l.street_id order by l.i)),
spot as (select b.street_id, b.place, x0 + (x1 - x0)*((b.place - p0)/(p1 - p0)) as lon, y0 + (y1 - y0)*((b.place - p0)/(p1 - p0)) as lat, row_number() over (partition by b.street_id, b.place order by p0) as r from breaks b join spans s on s.street_id = b.street_id and b.place >= p0 and b.place <= p1)"""


@query(f"""with {SEGMENTS} select g.street_id, seg_no, 2 + (select count(*) from line l where l.street_id = g.street_id and l.place > p and l.place < q) as points,
  round(a.lon, 6) as lon1, round(a.lat, 6) as lat1, round(b.lon, 6) as lon2, round(b.lat, 6) as lat2
from segs g join spot a on a.street_id = g.street_id and a.place = p and a.r = 1 join spot b on b.street_id = g.street_id and b.place = q and b.r = 1 where q is not null""")
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _streets(spark, sf_dir, 3)
    at = lambda k, c: F.round(F.element_at("pts", k)[c], 6)
    return streets.split(own, streets.junctions(own)).select("street_id", "seg_no", F.size("pts").cast("long").alias("points"), at(1, "lon").alias("lon1"), at(1, "lat").alias("lat1"), at(-1, "lon").alias("lon2"), at(-1, "lat").alias("lat2"))


# --- schedules ---


@query("select o_orderkey, case when o_custkey % 10 = 0 then null else cast(o_orderkey % 30 as double)*60 + o_custkey % 60 + (o_orderkey % 60)/60e0 end as minutes from orders")
def gtfs_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.when(F.col("o_custkey") % 10 == 0, F.lit("soon")).otherwise(F.format_string("%d:%02d:%02d", F.col("o_orderkey") % 30, F.col("o_custkey") % 60, F.col("o_orderkey") % 60))
    return view(spark, sf_dir, "orders").select("o_orderkey", text.gtfs_minutes(clock, strict=True).alias("minutes"))


DAY_FLAGS = " union ".join(f"select service_id, {k} as weekday from {{calendar}} where {d} = '1'" for k, d in enumerate(schedule.DAYS))


@query(f"{DAY_FLAGS} union select service_id, cast(isodow(strptime(date, '%Y%m%d')) - 1 as int) from {{calendar_dates}} where exception_type = '1'")
def service_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.service_weekdays(view(spark, sf_dir, "calendar"), view(spark, sf_dir, "calendar_dates"))


@query(f"{DAY_FLAGS} union select service_id, cast(isodow(strptime(date, '%Y%m%d')) - 1 as int) from {{calendar_dates}} where exception_type = '1'".replace("{calendar", "{all_calendar"))
def service_weekdays_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.service_weekdays(view(spark, sf_dir, "all_calendar"), view(spark, sf_dir, "all_calendar_dates"))


@query("""with t as (select distinct user_id, weekday, minute as t from {departures} where minute is not null),
g as (select *, t - lag(t) over (partition by user_id, weekday order by t) as gap from t),
y as (select user_id, weekday, count(*) as n, greatest(1e0, median(gap)) as typical from g group by 1, 2),
m as (select g.*, n, typical, case when gap > greatest(60e0, 4*typical) then 1 else 0 end as fresh from g join y using (user_id, weekday)),
s as (select *, sum(fresh) over (partition by user_id, weekday order by t rows unbounded preceding) as stretch from m),
p as (select user_id, weekday, stretch, min(t) as start_min, max(t) as last, case when any_value(n) = 1 then 8e0 else greatest(1e0, coalesce(median(gap) filter (fresh = 0), any_value(typical))) end as h from s group by 1, 2, 3)
select user_id, weekday, start_min, floor((last + h)*100 + 5e-1)/100 as end_min, floor(h*100 + 5e-1)/100 as headway_min from p""")
def departure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.departure_windows(view(spark, sf_dir, "departures"), ["user_id", "weekday"])


@query("select trip_id, start_min + offset_min + k*headway_min as minute from {frequencies}, range(0, 200) r(k) where start_min + k*headway_min < end_min")
def frequency_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.expand_frequencies(view(spark, sf_dir, "frequencies"), ["trip_id"])


@query("select trip_id, start_min + offset_min + k*headway_min as minute from {all_frequencies}, range(0, 200) r(k) where start_min + k*headway_min < end_min")
def frequency_expand_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.expand_frequencies(view(spark, sf_dir, "all_frequencies"), ["trip_id"])


WAIT = """select q.station_id, q.service_key, min(case when o*1440 + end_min > minute then greatest(0e0, case when minute < o*1440 + start_min then o*1440 + start_min - minute else least(headway_min/2, o*1440 + end_min - minute) end) end) as wait
from {wait_queries} q cross join range(-1, 8) r(o) join {windows} w on w.station_id = q.station_id and w.weekday = ((q.weekday + o) % 7 + 7) % 7 and """


@query(f"with w0 as ({WAIT} w.service_key is null group by all) select q.station_id, q.weekday, q.minute, coalesce(wait, 4e0) as wait_min, wait is not null as scheduled from {{wait_queries}} q left join w0 using (station_id)")
def station_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.station_wait(view(spark, sf_dir, "windows"), view(spark, sf_dir, "wait_queries"))


@query(f"""with w0 as ({WAIT} w.service_key is null group by all), w1 as ({WAIT} w.service_key = q.service_key group by all), has as (select distinct station_id, service_key, true as has from {{windows}} where service_key is not null)
select q.station_id, q.service_key, q.weekday, q.minute, coalesce(case when has then w1.wait else w0.wait end, 4e0) as wait_min from {{wait_queries}} q left join has using (station_id, service_key) left join w1 using (station_id, service_key) left join w0 on w0.station_id = q.station_id""")
def service_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.service_wait(view(spark, sf_dir, "windows"), view(spark, sf_dir, "wait_queries"))


@query("""with m as (select *, lag(station_id) over w as b, lag(departure) over w as dep from {timed} where station_id is not null window w as (partition by trip_id order by seq))
select b as src, station_id as dst, service_key, floor(median(arrival - dep)*100 + 5e-1)/100 as minutes from m where b <> station_id and arrival - dep > 0 and arrival - dep <= 180 group by 1, 2, 3""")
def ride_edge_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.ride_edges(view(spark, sf_dir, "timed"))


@query(f"""with p as (select s.id, s.ord, t.stop_id, {hav('s', 't')} as m, {norm_name('s.name')} as x, {norm_name('t.name')} as y from {{stations}} s join {{stops}} t on s.mode = t.mode and abs(s.lat - t.lat) < 0.01),
w as (select *, list_distinct(list_filter(string_split(x, ' '), lambda w: length(w) > 2)) as wx, list_distinct(list_filter(string_split(y, ' '), lambda w: length(w) > 2)) as wy from p where m <= 650),
k as (select * from w where m <= 140 or {MATCHED}), c as (select *, greatest(180e0, min(m) over (partition by id) + 120) as cut from k)
select stop_id, id as station_id, round(m, 3) as metres from (select *, row_number() over (partition by stop_id order by m, ord) as r from c where m <= cut) where r = 1""")
def stop_station_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.match_stops(view(spark, sf_dir, "stations"), view(spark, sf_dir, "stops")).withColumn("metres", F.round("metres", 3))


@query(f"""with a as (select id, {norm_name('name')} as x from {{stations}}), b as (select stop_id, {norm_name('name')} as y from {{stops}}),
t as (select *, list_distinct(list_filter(string_split(x, ' '), lambda w: length(w) > 2)) as wx, list_distinct(list_filter(string_split(y, ' '), lambda w: length(w) > 2)) as wy from a cross join b)
select id, stop_id from t where {MATCHED}""")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stations against all stops; the pairs that don't match are left out."""
    return names.match_names(view(spark, sf_dir, "stations"), view(spark, sf_dir, "stops"))


@query(f"with w0 as ({WAIT} w.service_key is null group by all) select count(distinct q.station_id) as stations, count(distinct q.station_id) filter (wait is not null) as scheduled from {{wait_queries}} q left join w0 using (station_id)")
def schedule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.schedule_coverage(station_wait(spark, sf_dir))


# --- graph ---


def walks_sql(close: int) -> str:
    return f"""walks as (select a.id as src, b.id as dst, {hav('a', 'b')} as m, {norm('a.name')} = {norm('b.name')} as same from {{open_stations}} a join {{open_stations}} b on a.ord < b.ord and abs(a.lat - b.lat) < 0.01),
walk1 as (select src, dst, case when same and m <= 900 then greatest(35e-2, m/80e0) else 3e0 + m/80e0 end as minutes from walks where (same and m <= 900) or m <= {close})"""


GROUPS = "list_distinct(list_filter(list_transform(string_split(concat(route_ref, ';', route_name, ';', case when regexp_matches(" + norm("network") + f", '{text.GENERIC_NETWORKS}') then '' else network end), ';'), lambda x: {norm('x')}), lambda x: x <> ''))"
RIDES = f"""nodes as (select *, {GROUPS} as groups from {{open_stations}}),
rp as (select a.id as src, a.mode, b.id as dst, b.ord, {hav('a', 'b')} as m, (len(a.groups) = 0 or len(b.groups) = 0 or list_has_any(a.groups, b.groups)) as shares from nodes a join nodes b on a.id <> b.id and a.mode = b.mode),
rk as (select *, bool_or(shares) over (partition by src) as sharing from rp where m > 300 and m <= {LINK.replace('{m}', 'mode')}),
links as (select src, dst, rank, m, m/({SPEED.replace('{m}', 'mode')}*1000/60) + 55e-2 as minutes from (select *, cast(row_number() over (partition by src order by m, ord) as int) as rank from rk where shares or not sharing) where rank <= 3)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_groups(view(spark, sf_dir, "open_stations"))


def with_groups(own: DataFrame) -> DataFrame:
    return own.withColumn("groups", text.route_groups(F.col("route_ref"), F.col("route_name"), F.col("network")))


@query(f"with {walks_sql(250)} select src, dst, round(min(minutes), 6) as minutes from (select src, dst, minutes from walk1 union all select dst, src, minutes from walk1) group by 1, 2")
def transfer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transfer_edges(view(spark, sf_dir, "open_stations")).withColumn("minutes", F.round("minutes", 6))


@query(f"with {RIDES} select src, dst, rank, round(m, 3) as metres, round(minutes, 6) as minutes from links")
def ride_links_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ride_links(_nodes(spark, sf_dir)).select("src", "dst", "rank", F.round("metres", 3).alias("metres"), F.round("minutes", 6).alias("minutes"))


def _times_sql(edges: str, targets: tuple[int, ...], start: str = "id") -> str:
    """Least minutes by rounds of relaxation; a row for each node and its best so far."""
    seeds = " union all ".join(f"select cast({t} as bigint) as node, '' as svc, 0e0 as minutes" for t in targets)
    return f"""best(node, svc, minutes) using key (node, svc) as ({seeds} union
  select n.src, n.ssvc, n.m from (select e.src, e.ssvc, min(b.minutes + e.minutes) as m from best b join {edges} e on e.dst = b.node and e.dsvc = b.svc group by 1, 2) n
  left join recurring.best r on r.node = n.src and r.svc = n.ssvc where r.minutes is null or n.m < r.minutes)"""


UNSCHEDULED = f"""/*recursive*/with {walks_sql(300)}, {RIDES}, one as (select src, dst, minutes from walk1 union all select src, dst, minutes from links),
sym as (select src, '' as ssvc, dst, '' as dsvc, min(minutes) as minutes from (select src, dst, minutes from one union all select dst, src, minutes from one) group by 1, 3),
{_times_sql('sym', (0,))}
select id as station_id, round(case when b.minutes is null then 90e0 when b.minutes > 0 then b.minutes + coalesce(w.wait_min, 4e0) else 0e0 end, 6) as minutes
from {{open_stations}} left join best b on b.node = id left join {{waits}} w on w.station_id = id"""


@query(UNSCHEDULED)
def transit_times_unscheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    dest = spark.createDataFrame([(0, 0)], "dest int, station_id long")
    return graph.transit_times(dest, nodes, graph.unscheduled_graph(nodes), station_waits=view(spark, sf_dir, "waits")).select("station_id", F.round("minutes", 6).alias("minutes"))


STATES = """rides2 as (select * from {rides} where minutes > 0), services as (select src as s, service_key as k from rides2 union select dst, service_key from rides2),
steps as (select s as src, k as ssvc, s as dst, '' as dsvc, 0e0 as minutes from services
  union all select s, '', s, k, coalesce(w.wait_min, 4e0) from services left join {waits} w on w.station_id = s and w.service_key = k
  union all select src, service_key, dst, service_key, minutes from rides2
  union all select src, '', dst, '', minutes from (select src, dst, minutes from walk1 union all select dst, src, minutes from walk1))"""


def scheduled_sql(targets: tuple[int, ...]) -> str:
    return f"""/*recursive*/with {walks_sql(250)}, {STATES}, {_times_sql('steps', targets)}
select id as station_id, round(coalesce(b.minutes, 90e0), 6) as minutes from {{open_stations}} left join best b on b.node = id and b.svc = ''"""


def _scheduled(spark: SparkSession, sf_dir: str, targets: tuple[int, ...]) -> dict[str, DataFrame]:
    own = view(spark, sf_dir, "open_stations")
    dest = spark.createDataFrame([(0, t) for t in targets], "dest int, station_id long")
    return {"destinations": dest, "stations": own, "edges": graph.transfer_edges(own), "service_waits": view(spark, sf_dir, "waits"), "rides": view(spark, sf_dir, "rides")}


@query(scheduled_sql((0,)))
def transit_times_scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transit_times(**_scheduled(spark, sf_dir, (0,))).select("station_id", F.round("minutes", 6).alias("minutes"))


@query(scheduled_sql(DESTINATIONS))
def transit_times_multi_dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transit_times(**_scheduled(spark, sf_dir, DESTINATIONS)).select("station_id", F.round("minutes", 6).alias("minutes"))


@query(scheduled_sql(DESTINATIONS))
def transit_times_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins, as for a network of any size."""
    return graph.transit_times(**_scheduled(spark, sf_dir, DESTINATIONS), graph_rows=0).select("station_id", F.round("minutes", 6).alias("minutes"))


KINDS = """rides2 as (select * from {rides} where minutes > 0), services2 as (select src as s, service_key as k from rides2 union select dst, service_key from rides2),
steps as (select s as src, k as ssvc, s as dst, '' as dsvc, 0e0 as minutes, 'alight' as kind from services2
  union all select s, '', s, k, coalesce(w.wait_min, 4e0), 'wait' from services2 left join {waits} w on w.station_id = s and w.service_key = k
  union all select src, service_key, dst, service_key, minutes, 'ride' from rides2
  union all select src, '', dst, '', min(minutes), 'transfer' from (select src, dst, minutes from walk1 union all select dst, src, minutes from walk1) group by 1, 3)"""


def legs_sql(target: int) -> str:
    """Of the steps that lead on in the same time the first by kind, station and service; rides of one service and mode that follow each other are one leg."""
    return f"""{walks_sql(250)}, {KINDS}, {_times_sql('steps', (target,))},
tried as (select s.*, row_number() over (partition by s.src, s.ssvc order by s.kind, s.dst, s.dsvc, s.minutes) as r from steps s join best a on a.node = s.src and a.svc = s.ssvc join best b on b.node = s.dst and b.svc = s.dsvc
  where (b.minutes < a.minutes or s.kind = 'alight') and b.minutes + s.minutes <= a.minutes + 1e-9 and not (s.src = {target} and s.ssvc = '')),
taken as (select * from tried where r = 1),
way(station_id, nth, kind, src, dst, service_key, minutes, node, svc) as (
  select b.node, 0, t.kind, t.src, t.dst, case when t.dsvc <> '' then t.dsvc else t.ssvc end, t.minutes, t.dst, t.dsvc from best b join taken t on t.src = b.node and t.ssvc = '' where b.svc = '' and b.minutes < 90
  union all select w.station_id, nth + 1, t.kind, t.src, t.dst, case when t.dsvc <> '' then t.dsvc else t.ssvc end, t.minutes, t.dst, t.dsvc from way w join taken t on t.src = w.node and t.ssvc = w.svc),
told as (select station_id, nth, kind as type, w.src, w.dst, case when kind <> 'transfer' then service_key end as service_key, case when kind <> 'wait' then s.mode end as mode, minutes from way w join {{open_stations}} s on s.id = w.src where kind <> 'alight'),
met as (select *, case when type = 'ride' and lag(type) over o = 'ride' and lag(service_key) over o is not distinct from service_key and lag(mode) over o is not distinct from mode and lag(dst) over o = src then 0 else 1 end as fresh from told window o as (partition by station_id order by nth)),
run as (select *, cast(sum(fresh) over (partition by station_id order by nth rows unbounded preceding) - 1 as int) as leg_no from met),
legs as (select station_id, leg_no, arg_min(type, nth) as type, arg_min(src, nth) as src, arg_max(dst, nth) as dst, any_value(service_key) as service_key, any_value(mode) as mode, sum(minutes) as minutes from run group by 1, 2)"""


@query(f"/*recursive*/with {legs_sql(0)} select station_id, leg_no, type, src, dst, service_key, mode, round(minutes, 6) as minutes from legs")
def route_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.routes(**_scheduled(spark, sf_dir, (0,))).drop("dest").withColumn("minutes", F.round("minutes", 6))


@query(f"/*recursive*/with {legs_sql(0)} select station_id, leg_no, type, src, dst, service_key, mode, round(minutes, 6) as minutes from legs")
def route_legs_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins, as for a network of any size."""
    return graph.routes(**_scheduled(spark, sf_dir, (0,)), graph_rows=0).drop("dest").withColumn("minutes", F.round("minutes", 6))


TIMES = "times as (select id as station_id, cast(id*7 % 110 as double) as minutes from {open_stations} where id % 6 <> 2)"
BEST = TOP5 + ", " + TIMES + """, best as (select * from (select street_id, station_id, dist_m, dist_m/80e0 as walk_min, coalesce(minutes, 90e0) as transit_min, dist_m/80e0 + coalesce(minutes, 90e0) as total_min,
  row_number() over (partition by street_id order by dist_m/80e0 + coalesce(minutes, 90e0), ord) as r from (select t.*, m.minutes from top5 t left join times m using (station_id))) where r = 1)"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = view(spark, sf_dir, "open_stations")
    times = own.where("id % 6 <> 2").select(F.col("id").alias("station_id"), (F.col("id") * 7 % 110).cast("double").alias("minutes"))
    return access.best_access(_top5(spark, sf_dir).join(own.select(F.col("id").alias("station_id"), "ord"), "station_id"), times)


@query(f"with {BEST} select street_id, station_id, dist_m, walk_min, transit_min, total_min from best")
def best_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


@query("with v as (select p_partkey as street_id, cast(p_partkey*3 % 80 as double) as t from part) select street_id, " + ramp_sql("t", [f"{x}e0" for x in (0, YELLOW / 2, YELLOW * 0.75, YELLOW, YELLOW * 2, YELLOW * 3, YELLOW * 4)]) + " as color from v")
def time_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part").select(F.col("p_partkey").alias("street_id"), display.time_color((F.col("p_partkey") * 3 % 80).cast("double"), F.lit(YELLOW)).alias("color"))


@query(f"with {BEST} select (select count(*) from {{stations}} where status = 'open' and lon between {BOX[0]} and {BOX[2]} and lat between {BOX[1]} and {BOX[3]}) as stations, count(distinct street_id) as streets, count(*) filter (total_min <= {2 * YELLOW}) as near from best")
def viewport_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.viewport_counts(view(spark, sf_dir, "stations"), _best(spark, sf_dir), BOX, 2 * YELLOW)


@query(f"""/*recursive*/with pairs as (select a.id as x, b.id as y from {{open_stations}} a join {{open_stations}} b on a.mode = b.mode and {norm('a.name')} = {norm('b.name')} and a.id <> b.id and {hav('a', 'b')} <= 180
  union select id, id + 9 from {{open_stations}} where id % 4 = 1 and id + 9 in (select id from {{open_stations}}) union select id + 9, id from {{open_stations}} where id % 4 = 1 and id + 9 in (select id from {{open_stations}})),
reach(src, node) as (select id, id from {{open_stations}} union select r.src, p.y from reach r join pairs p on p.x = r.node)
select src as station_id, arg_min(node, row(name, node)) as complex_id from reach join {{open_stations}} on id = node group by 1""")
def station_complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = view(spark, sf_dir, "stations")
    return graph.complexes(own, own.where("id % 4 = 1").select(F.col("id").alias("src"), (F.col("id") + 9).alias("dst")))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many streets are within reach of transit: nearest stations, then the histogram."""
    return access.distance_histogram(segment_nearest_station(spark, sf_dir))
