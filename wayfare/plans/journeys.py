"""Further queries by name: what a street can reach, routes as tables, GTFS schedules, lists and clean-up; with their DuckDB counterparts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import display, geo
from wayfare.operators import access, graph, schedule, stations, streets
from wayfare.operators.tables import MODES
from wayfare.plans.catalog import ACTIVE, BOX, BY_MODE, DAY_FLAGS, DISTANCES, SEGMENTS, STATES, TOP5, YELLOW, _scheduled, _streets, case_mode, legs_sql, lines, query, ramp_sql, walks_sql
from wayfare.plans.synth import view
from wayfare.sources import gtfs

BOTH = TOP5 + BY_MODE[len(DISTANCES) :]
LATER = BY_MODE.replace("{open_stations}", "{future_stations}")
for _name in ("ref", "sxy", "exy2", "exy", "shares", "dist", "by_mode"):
    LATER = re.sub(rf"\b{_name}\b", f"f_{_name}", LATER)
ACTIVE_SQL = "(" + ", ".join(f"'{m}'" for m in ACTIVE) + ")"
BIT = case_mode([b for b, *_ in MODES], 0, "{m}").replace("e0", "")
CANDIDATES = f"""{BOTH}, {LATER},
candidates as (select street_id, station_id, s.mode, dist_m, rank as ord from top5 t join {{open_stations}} s on s.id = t.station_id where s.mode in {ACTIVE_SQL}
  union all select street_id, station_id, mode, least(dist_m, 5001), 10 + {BIT.replace('{m}', 'mode')} from by_mode where mode in {ACTIVE_SQL}
  union all select street_id, station_id, mode, least(dist_m, 5001), 20 + {BIT.replace('{m}', 'mode')} from f_by_mode where mode in {ACTIVE_SQL})"""


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return lines(spark, sf_dir), view(spark, sf_dir, "stations")


# --- streets and access ---


@query(f"""with {BY_MODE}, {LATER} select street_id, 'open' as pool, m.mode, least(dist_m, 5001) as dist_m, case when dist_m > 5000 then -1 else s.ord end as station_ord from by_mode m join {{stations}} s on s.id = station_id
union all select street_id, 'future', m.mode, least(dist_m, 5001), case when dist_m > 5000 then -1 else s.ord end from f_by_mode m join {{stations}} s on s.id = station_id""")
def street_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.street_features(*_all(spark, sf_dir))


@query(f"with {CANDIDATES} select * from candidates")
def street_access_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.street_candidates(*_all(spark, sf_dir), ACTIVE, include_future=True)


@query(f"select station_id, case when mode in {ACTIVE_SQL} then minutes else 90e0 end as minutes from {{station_times}} join {{stations}} on id = station_id")
def active_transit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.active_times(view(spark, sf_dir, "station_times"), view(spark, sf_dir, "stations"), ACTIVE)


@query(f"""with {CANDIDATES}, t as (select c.*, c.dist_m/80e0 as walk_min, coalesce(case when s.mode in {ACTIVE_SQL} then m.minutes else 90e0 end, 90e0) as transit_min from candidates c join {{stations}} s on s.id = c.station_id left join {{station_times}} m on m.station_id = c.station_id)
select street_id, station_id, dist_m, walk_min, transit_min, walk_min + transit_min as total_min from (select *, row_number() over (partition by street_id order by walk_min + transit_min, ord) as r from t) where r = 1""")
def street_travel_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = access.active_times(view(spark, sf_dir, "station_times"), view(spark, sf_dir, "stations"), ACTIVE)
    return access.best_access(access.street_candidates(*_all(spark, sf_dir), ACTIVE, include_future=True), times)


MINUTES = "coalesce(floor(minutes*100 + 5e-1)/100, 90e0)"
TOTAL = f"""d as (select street_id, min(dist_m/80e0 + {MINUTES}) as m, count(*) as n from top5 left join {{station_times}} using (station_id) group by 1),
e as (select street_id, min(least(dist_m, 5001)/80e0 + {MINUTES}) as m, count(*) as n from by_mode left join {{station_times}} using (station_id) where mode in {ACTIVE_SQL} group by 1),
total as (select street_id, least(d.m, coalesce(e.m, 1e9), case when d.n < 5 then 180e0 else 1e9 end, case when coalesce(e.n, 0) < {len(ACTIVE)} then 1525e-1 else 1e9 end) as total_min from d left join e using (street_id))"""


@query(f"with {BOTH}, {TOTAL} select street_id, total_min, " + ramp_sql("total_min", [f"{x}e0" for x in (0, YELLOW / 2, YELLOW * 0.75, YELLOW, YELLOW * 2, YELLOW * 3, YELLOW * 4)]) + " as color from total")
def time_street_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.time_colors(*_all(spark, sf_dir), view(spark, sf_dir, "station_times"), ACTIVE, YELLOW)


@query(f"with {BY_MODE} select street_id, " + ", ".join(f"max(dist_m) filter (mode = '{m}') as {m}" for _, m, *_ in MODES) + " from by_mode group by 1")
def wide_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.wide(access.nearest(lines(spark, sf_dir), view(spark, sf_dir, "open_stations"), 1, by_mode=True))


SEGMENT_EDGES = f"""{SEGMENTS},
seg_points as (select g.street_id*1000 + seg_no as sid, a.place, a.lon, a.lat from segs g join spot a on a.street_id = g.street_id and a.place = p and a.r = 1 where q is not null
  union all select g.street_id*1000 + seg_no, a.place, a.lon, a.lat from segs g join spot a on a.street_id = g.street_id and a.place = q and a.r = 1 where q is not null
  union all select g.street_id*1000 + seg_no, l.place, l.lon, l.lat from segs g join line l on l.street_id = g.street_id and l.place > p and l.place < q where q is not null),
seg_edges as (select * from (select sid as street_id, lon as lon1, lat as lat1, lead(lon) over w as lon2, lead(lat) over w as lat2 from seg_points window w as (partition by sid order by place)) where lon2 is not null)"""
TILE = "case when {d} > 5000 then 5001 else cast(floor({d}/25e0 + 5e-1)*25 as int) end"
TILES = f"""{SEGMENT_EDGES}, {BY_MODE}, {LATER},
both_pools as (select street_id as sid, 'open' as pool, m.mode, least(dist_m, 5001) as dist_m, case when dist_m > 5000 then -1 else s.ord end as station_ord from by_mode m join {{stations}} s on s.id = station_id
  union all select street_id, 'future', m.mode, least(dist_m, 5001), case when dist_m > 5000 then -1 else s.ord end from f_by_mode m join {{stations}} s on s.id = station_id),
nearest as (select sid, min(dist_m) as n from both_pools where pool = 'open' group by 1)"""


@query("with " + TILES.replace("{edges}", "seg_edges") + f""" select sid // 1000 as street_id, cast(sid % 1000 as int) as seg_no, pool, mode, {TILE.format(d='dist_m')} as dist_m, station_ord, {TILE.format(d='n')} as nearest_m, case when n > 5000 then 1 end as over,
  case sid // 1000 % 4 when 0 then 8 when 1 then 10 else 13 end as minzoom from both_pools join nearest using (sid)""")
def tile_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.element_at(F.array(*map(F.lit, ("motorway", "primary", "residential", "path"))), (F.col("street_id") % 4 + 1).cast("int"))
    return access.tile_features(_streets(spark, sf_dir, 3).withColumn("h", h), view(spark, sf_dir, "stations"))


@query("select ord, class, i from (select *, row_number() over (partition by coalesce('i' || cast(i as varchar), 'f' || feature_id) order by ord) as r from {roads} where i is not null or feature_id is not null) where r = 1")
def rendered_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.rendered_once(view(spark, sf_dir, "roads")).select("ord", "class", "i")


@query("select distinct class, brunnel, x from {roads} where class in ('motorway', 'primary', 'street') and regexp_matches(layer, 'road|street|transport')")
def live_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads with two points, that differ by class, bridge and place."""
    point = lambda d: F.struct((F.col("x") + d).alias("lon"), F.col("x").alias("lat"))
    roads = view(spark, sf_dir, "roads").withColumn("pts", F.array(point(0.0), point(1.0)))
    return streets.live(roads, ["motorway", "primary", "street"])[0].select("class", "brunnel", "x")


@query(f"with {SEGMENTS} select street_id, seg_no, row_number() over (order by street_id, seg_no) - 1 as i from segs where q is not null")
def numbered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _streets(spark, sf_dir, 3)
    return streets.numbered(streets.split(own, streets.junctions(own))).select("street_id", "seg_no", "i")


# --- schedules ---

TIMED_TRIPS = "t as (select timed.trip_id, seq, station_id as stop_id, arrival, coalesce(departure, arrival) as left_at, departure, service_key, o_orderpriority as service_id from {timed} timed join orders on o_orderkey = timed.trip_id where station_id is not null)"
WEEKDAYS = f"days as ({DAY_FLAGS} union select service_id, cast(isodow(strptime(date, '%Y%m%d')) - 1 as int) from {{calendar_dates}} where exception_type = '1')"
WINDOWS = f"""{TIMED_TRIPS}, {WEEKDAYS}, first as (select trip_id, arg_min(departure, seq) as f from t where departure is not null group by 1),
own as (select distinct t.stop_id, t.service_key, d.weekday, floor((q.start_min + (t.left_at - f))*100 + 5e-1)/100 as start_min, floor((q.end_min + (t.left_at - f))*100 + 5e-1)/100 as end_min, floor(q.headway_min*100 + 5e-1)/100 as headway_min
  from t join first using (trip_id) join {{frequencies}} q using (trip_id) join days d using (service_id)),
windows2 as (select * from own union all select distinct stop_id, cast(null as varchar), weekday, start_min, end_min, headway_min from own)"""


def _trips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    timed = view(spark, sf_dir, "timed").where("station_id is not null")
    orders = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_orderpriority").alias("service_id"))
    trips = timed.select("trip_id", "service_key").distinct().join(orders, "trip_id")
    days = schedule.service_weekdays(view(spark, sf_dir, "calendar"), view(spark, sf_dir, "calendar_dates"))
    return timed.select("trip_id", F.col("seq").alias("stop_sequence"), F.col("station_id").alias("stop_id"), "arrival", "departure"), trips, days


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.frequency_schedules(*_trips(spark, sf_dir), view(spark, sf_dir, "frequencies"))


@query(f"with {WINDOWS} select * from windows2")
def gtfs_frequency_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)


def _stretches(keys: str) -> str:
    """Departure windows of left2 for the keys, as CTEs whose names end in the first key's number of letters."""
    n = len(keys)
    return f"""t{n} as (select distinct {keys}, round(minute, 2) as t from left2 where minute is not null),
g{n} as (select *, t - lag(t) over (partition by {keys} order by t) as gap from t{n}),
y{n} as (select {keys}, count(*) as n, greatest(1e0, median(gap)) as typical from g{n} group by all),
m{n} as (select g{n}.*, n, typical, case when gap > greatest(60e0, 4*typical) then 1 else 0 end as fresh from g{n} join y{n} using ({keys})),
s{n} as (select *, sum(fresh) over (partition by {keys} order by t rows unbounded preceding) as stretch from m{n}),
p{n} as (select {keys}, stretch, min(t) as start_min, max(t) as last, case when any_value(n) = 1 then 8e0 else greatest(1e0, coalesce(median(gap) filter (fresh = 0), any_value(typical))) end as h from s{n} group by {keys}, stretch)"""


WHOLE, OF_SERVICE = "stop_id, weekday", "stop_id, service_key, weekday"
WINDOW = "weekday, start_min, floor((last + h)*100 + 5e-1)/100 as end_min, floor(h*100 + 5e-1)/100 as headway_min"


@query(f"""with {TIMED_TRIPS}, {WEEKDAYS}, days2 as (select * from days where service_id <> '5-LOW' union all select service_id, cast(k as int) from (select distinct service_id from t where service_id = '5-LOW'), range(0, 5) r(k)),
left2 as (select stop_id, service_key, weekday, left_at as minute from t join days2 using (service_id)), {_stretches(WHOLE)}, {_stretches(OF_SERVICE)}
select stop_id, service_key, {WINDOW} from p{len(OF_SERVICE)} union all select stop_id, cast(null as varchar), {WINDOW} from p{len(WHOLE)}""")
def gtfs_timetable_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One service has no calendar, and runs Monday to Friday."""
    times, trips, days = _trips(spark, sf_dir)
    known = view(spark, sf_dir, "calendar").where("service_id <> '5-LOW'").select("service_id").distinct()
    return schedule.timetable_schedules(times, trips, days.where("service_id <> '5-LOW'"), known)


@query(f"""with {WINDOWS}, day as (select stop_id, service_key, weekday, count(*) as n, string_agg(concat(cast(cast(round(start_min*100) as bigint) as varchar), '-', cast(cast(round(end_min*100) as bigint) as varchar)), ';' order by start_min, headway_min, end_min) as w from windows2 group by all)
select stop_id as station_id, count(*) as days, cast(sum(n) as bigint) as windows, string_agg(w, '|' order by service_key nulls first, weekday) as listed, (select string_agg(r, ',' order by r) from (select distinct regexp_replace(service_key, '/[^/]*$', '') as r from t where t.stop_id = day.stop_id)) as routes from day group by stop_id""")
def station_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each station: its routes, and its windows in order."""
    times, trips, _ = _trips(spark, sf_dir)
    routes = times.select("trip_id", "stop_id").join(trips, "trip_id").select(F.col("stop_id").alias("station_id"), F.regexp_replace("service_key", "/[^/]*$", "").alias("route_id")).distinct()
    made = schedule.assemble(_windows(spark, sf_dir).withColumnRenamed("stop_id", "station_id"), routes).where("days is not null")
    hundredths = lambda x: F.round(x * 100).cast("long").cast("string")
    of_day = lambda d: F.array_join(F.transform(d["windows"], lambda w: F.concat(hundredths(w["start_min"]), F.lit("-"), hundredths(w["end_min"]))), ";")
    return made.select("station_id", F.size("days").cast("long").alias("days"), F.aggregate("days", F.lit(0).cast("long"), lambda a, d: a + F.size(d["windows"])).alias("windows"), F.array_join(F.transform("days", of_day), "|").alias("listed"), F.array_join("routes", ",").alias("routes"))


@query("""select a.station_id as src, b.station_id as dst, min(case when try_cast(min_transfer_time as double) > 0 then try_cast(min_transfer_time as double)/60 else 3e0 end) as minutes
from {transfers} join {stop_station} a on a.stop_id = from_stop_id join {stop_station} b on b.stop_id = to_stop_id where transfer_type <> '3' and a.station_id <> b.station_id group by 1, 2""")
def published_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.published_transfers(view(spark, sf_dir, "transfers"), view(spark, sf_dir, "stop_station"))


# --- stations ---


@query("select id, ord from (select *, row_number() over (partition by round(lon, 4), round(lat, 4), lower(trim(name)) order by ord) as r from (select id, ord, name, lon, lat from {stations} union all select id + 100000, ord + 100000, upper(name), lon, lat from {stations} where id % 2 = 0)) where r = 1")
def dedupe_feed_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = view(spark, sf_dir, "stations").select("id", "ord", "name", "lon", "lat")
    again = own.where("id % 2 = 0").select((F.col("id") + 100000).alias("id"), (F.col("ord") + 100000).alias("ord"), F.upper("name").alias("name"), "lon", "lat")
    return stations.deduplicate(stations.place_keys(own.unionByName(again)), ["k_lon", "k_lat", "k_name"], prefer_open=False).select("id", "ord")


@query(f"select r.src, r.dst, r.minutes, r.service_key from {{rides}} r join {{stations}} a on a.id = r.src join {{stations}} b on b.id = r.dst where a.lon between {BOX[0]} and {BOX[2]} and a.lat between {BOX[1]} and {BOX[3]} and b.lon between {BOX[0]} and {BOX[2]} and b.lat between {BOX[1]} and {BOX[3]}")
def metro_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gtfs.in_metro(view(spark, sf_dir, "stations"), view(spark, sf_dir, "rides"), BOX)[1]


@query("select mode, count(*) as n, row_number() over (order by count(*) desc, " + BIT.replace("{m}", "mode") + ") - 1 as place from {open_stations} group by 1")
def mode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.mode_list(view(spark, sf_dir, "open_stations"))


@query("select id, row_number() over (order by strip_accents(name), name, id) - 1 as place from {open_stations} where name <> ''")
def station_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.by_name(view(spark, sf_dir, "open_stations")).select("id", "place")


@query("select station_id, r.ord from {station_times} t join (select id, cast(row_number() over (order by ord) - 1 as int) as ord from {open_stations}) r on r.id = t.station_id")
def station_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.ordinals(view(spark, sf_dir, "station_times"), view(spark, sf_dir, "open_stations"))


# --- routes ---


def minutes_sql(x: str) -> str:
    shown = f"cast(case when {x} < 10 then floor({x} + 5e-1) else floor({x}/5 + 5e-1)*5 end as int)"
    return f"case when {x} >= 90 then concat({shown} // 60, ' hr', case when {shown} % 60 > 0 then concat(' ', {shown} % 60, ' min') else '' end) else concat({shown}, ' min') end"


LABEL = "case coalesce(v.mode, r_mode) " + " ".join(f"when '{m}' then '{label}'" for _, m, label, *_ in MODES) + " else 'Transit' end"
TABLE = f"""parts as (select *, coalesce(sum(case when type = 'ride' then 1 else 0 end) over (partition by station_id order by leg_no rows between unbounded preceding and 1 preceding), 0) as part from legs),
per as (select station_id, part, sum(minutes) filter (type = 'transfer') as moved, arg_min(src, leg_no) filter (type = 'transfer') as t_src, arg_max(dst, leg_no) filter (type = 'transfer') as t_dst,
  arg_max(minutes, leg_no) filter (type = 'wait') as wait, arg_max(src, leg_no) filter (type = 'wait') as w_src, max(src) filter (type = 'ride') as r_src, max(dst) filter (type = 'ride') as r_dst,
  max(service_key) filter (type = 'ride') as r_key, max(mode) filter (type = 'ride') as r_mode, max(minutes) filter (type = 'ride') as r_minutes from parts group by 1, 2),
named as (select p.*, a.name as ts, b.name as td, c.name as ws, d.name as rs, e.name as rd, {LABEL} || coalesce(' ' || nullif(v.name, ''), '') as what,
  coalesce(lag(case when r_minutes is not null then r_key end) over (partition by p.station_id order by part) <> r_key, false) as changed, r_minutes is not null as boards
  from per p left join {{open_stations}} a on a.id = t_src left join {{open_stations}} b on b.id = t_dst left join {{open_stations}} c on c.id = w_src left join {{open_stations}} d on d.id = r_src left join {{open_stations}} e on e.id = r_dst
  left join {{services}} v on v.route_id = regexp_replace(r_key, '/[^/]*$', '')),
table_rows as (
  select station_id, part + 1 as part, 0 as k, 'Transfer' as label, case when ts = td then concat('At ', td) else concat(ts, ' → ', td) end || case when boards and changed then ' · to ' || what else '' end || case when boards and wait is not null then ' · ' || {minutes_sql('wait')} || ' wait' else '' end as detail, moved + case when boards then coalesce(wait, 0e0) else 0e0 end as minutes from named where moved is not null
  union all select station_id, part + 1, 0, 'Transfer', 'At ' || rs || ' · to ' || what, coalesce(wait, 0e0) from named where moved is null and boards and changed
  union all select station_id, part + 1, 1, what, rs || ' → ' || rd || case when moved is null and not changed and wait > 0 then ' · ' || {minutes_sql('wait')} || ' wait' else '' end, r_minutes + case when moved is null and not changed then coalesce(wait, 0e0) else 0e0 end from named where boards
  union all select station_id, part + 1, 2, 'Wait', 'At ' || ws, wait from named where not boards and wait is not null
  union all select s.id, 0, 0, 'Walk', 'To ' || s.name || ' · ' || case when s.id*13 % 2000 < 950 then concat(s.id*13 % 2000, ' m') else printf('%.1f km', (s.id*13 % 2000)/1000e0) end, (s.id*13 % 2000)/80e0 from {{open_stations}} s where s.id in (select station_id from legs))"""


@query(f"/*recursive*/with {legs_sql(0)}, {TABLE} select station_id, cast(row_number() over (partition by station_id order by part, k) - 1 as int) as row_no, label, detail, round(minutes, 6) as minutes from table_rows")
def route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _scheduled(spark, sf_dir, (0,))
    own = net["stations"]
    walk = own.select(F.col("id").alias("station_id"), (F.col("id") * 13 % 2000).alias("dist_m"))
    rows = graph.route_rows(graph.routes(**net), walk, own, view(spark, sf_dir, "services"))
    return rows.drop("dest").withColumn("minutes", F.round("minutes", 6))


@query(f"/*recursive*/with {legs_sql(0)} select b.node as station_id, round(b.minutes, 6) as minutes, case when t.kind = 'wait' then t.dsvc end as service_key from best b left join taken t on t.src = b.node and t.ssvc = '' where b.svc = ''")
def boarding_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is boarded at each station that the destination can be reached from."""
    found = graph.transit_times(**_scheduled(spark, sf_dir, (0,))).where("minutes <> 90")
    return found.select("station_id", F.round("minutes", 6).alias("minutes"), "service_key")


@query(f"select id as station_id, concat('#', id, ' ', {minutes_sql('(id*7 % 130 + 0e0)')}, ' ', lpad(cast(id % 24 as varchar), 2, '0'), ':', lpad(cast(id*7 % 60 as varchar), 2, '0')) as label from {{stations}}")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return view(spark, sf_dir, "stations").select(i.alias("station_id"), F.concat(F.lit("#"), i.cast("string"), F.lit(" "), display.format_minutes((i * 7 % 130).cast("double")), F.lit(" "), display.format_clock(i % 24 * 60 + i * 7 % 60)).alias("label"))


@query("""with v as (select p_partkey as k, -99.2e0 + p_partkey % 97*0.003e0 as lon, 19.3e0 + p_partkey % 89*0.002e0 as lat, p_partkey % 11/10e0 as t, p_partkey*7 % 6500 as d from part)
select k, round((lon - (-99.1e0))*111320e0*cos(radians(19.4e0)), 3) as x, round((lat - 19.4e0)*111320e0, 3) as y, round(lon + (-99.1e0 - lon)*t, 6) as mid_lon, round(lat + (19.4e0 - lat)*t, 6) as mid_lat,
  least(d, 5000) as clamped, case when d > 5000 then 1 end as over, case when d >= 1000 then concat(d // 1000, ',', lpad(cast(d % 1000 as varchar), 3, '0')) else cast(d as varchar) end as shown from v""")
def street_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    own = view(spark, sf_dir, "part").select(k.alias("k"), (-99.2 + k % 97 * 0.003).alias("lon"), (19.3 + k % 89 * 0.002).alias("lat"), (k % 11 / 10).alias("t"), (k * 7 % 6500).alias("d"))
    x, y = geo.project_planar(F.col("lon"), F.col("lat"), F.lit(-99.1), F.lit(19.4))
    mid = geo.interpolate(F.col("lon"), F.lit(-99.1), F.col("t")), geo.interpolate(F.col("lat"), F.lit(19.4), F.col("t"))
    clamped, over = display.clamped_distance(F.col("d"))
    return own.select("k", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(mid[0], 6).alias("mid_lon"), F.round(mid[1], 6).alias("mid_lat"), clamped.alias("clamped"), over.alias("over"), display.format_integer(F.col("d")).alias("shown"))


@query("""with b as (select min(lon) as w, max(lon) as e, min(lat) as s, max(lat) as n from {open_stations}), d as (select *, 500e0/111320e0 as dy, 500e0/(111320e0*cos(radians((s + n)/2))) as dx from b)
select round(w - dx, 6) as west, round(s - dy, 6) as south, round(e + dx, 6) as east, round(n + dy, 6) as north from d""")
def station_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "open_stations").agg(*geo.bounds(F.col("lon"), F.col("lat"), 6, 500.0))


@query(f"""/*recursive*/with {walks_sql(250)}, {STATES},
best(dest, node, svc, minutes) using key (dest, node, svc) as (select id as dest, id as node, '' as svc, 0e0 as minutes from {{open_stations}} union
  select n.dest, n.src, n.ssvc, n.m from (select b.dest, e.src, e.ssvc, min(b.minutes + e.minutes) as m from best b join steps e on e.dst = b.node and e.dsvc = b.svc group by 1, 2, 3) n
  left join recurring.best r on r.dest = n.dest and r.node = n.src and r.svc = n.ssvc where r.minutes is null or n.m < r.minutes)
select d.id as dest, s.id as station_id, round(coalesce(b.minutes, 90e0), 6) as minutes from {{open_stations}} d cross join {{open_stations}} s left join best b on b.dest = d.id and b.node = s.id and b.svc = ''""")
def transit_times_every_dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each station to each other."""
    net = _scheduled(spark, sf_dir, (0,))
    net["destinations"] = net["stations"].select(F.col("id").alias("dest"), F.col("id").alias("station_id"))
    return graph.transit_times(**net).select("dest", "station_id", F.round("minutes", 6).alias("minutes"))
