"""Transit views of the standard tables, in SQL that Spark and DuckDB both run.

{D} stands for whole division; {name} for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MODE_NAME = "case {m} when 0 then 'subway' when 1 then 'brt' when 2 then 'light_rail' when 3 then 'cable_car' when 4 then 'commuter_rail' when 5 then 'regional_rail' else 'monorail' end"

VIEWS = {
    "stations": f"""
select s_suppkey as id, cast(s_suppkey as int) as ord, concat('Estación ', cast(s_suppkey {{D}} 3 as string)) as name,
  {MODE_NAME.format(m="(s_suppkey*5 {D} 3) % 7")} as mode,
  case when s_suppkey % 11 = 5 then 'future' else 'open' end as status,
  cast(-99.20 as double) + (((s_suppkey {{D}} 3)*919) % 1009)/cast(10090 as double) + (s_suppkey % 3)*cast(0.0021 as double) as lon,
  cast(19.30 as double) + (((s_suppkey {{D}} 3)*729) % 1013)/cast(10130 as double) + (s_suppkey % 3)*cast(0.0013 as double) as lat,
  case when s_suppkey % 5 = 4 then '' else concat('L', cast(s_suppkey % 4 as string)) end as route_ref,
  case when s_suppkey % 6 = 1 then concat('Ruta ', cast(s_suppkey % 4 as string), ';L', cast((s_suppkey + 1) % 4 as string)) else '' end as route_name,
  case when s_suppkey % 2 = 0 then 'Metrobús' else concat('Red ', cast(s_suppkey % 9 as string)) end as network
from {{supplier}}""",
    "open_stations": "select * from {stations} where status = 'open'",
    "future_stations": "select * from {stations} where status <> 'open'",
    "station_times": "select id as station_id, cast(id*7 % 110 as double) + cast(0.255 as double) as minutes from {stations} where id % 6 <> 2",
    "services": "select * from (values ('S0', 'subway', '1'), ('S1', 'brt', ''), ('S3', 'tram', '3'), ('X', 'cable_car', 'X')) as v(route_id, mode, name)",
    "transfers": """
select concat('t', cast(s_suppkey as string)) as from_stop_id, concat('t', cast((s_suppkey*7 + s_suppkey % 3) % 11 as string)) as to_stop_id,
  case s_suppkey % 4 when 0 then '3' when 1 then '' else '2' end as transfer_type, case s_suppkey % 5 when 0 then '' when 1 then '0' else cast(s_suppkey*10 % 400 as string) end as min_transfer_time
from {supplier}""",
    "stop_station": "select concat('t', cast(s_suppkey as string)) as stop_id, s_suppkey {D} 2 as station_id from {supplier}",
    "roads": """
select p_partkey as ord, case p_partkey % 5 when 0 then 'motorway' when 1 then 'primary' when 2 then 'path' when 3 then 'street' else 'rail' end as class,
  case p_partkey % 3 when 0 then '' else 'bridge' end as brunnel, case p_partkey % 4 when 0 then 'road_major' when 1 then 'transport' else 'water' end as layer,
  case when p_partkey % 13 = 7 then null else cast(p_partkey*17 % 300 as bigint) end as i, case when p_partkey % 26 = 7 then null else concat('f', cast(p_partkey % 40 as string)) end as feature_id,
  cast(p_partkey % 50 as double) as x
from {part}""",
    "vertices": """
select p_partkey as street_id, i,
  cast(-99.21 as double) + ((p_partkey*613) % 1009)/cast(9000 as double) + i*((p_partkey % 5) - 2)*cast(0.0011 as double) as lon,
  cast(19.29 as double) + ((p_partkey*419) % 1013)/cast(9000 as double) + i*((p_partkey % 7) - 3)*cast(0.0009 as double) as lat
from {part} cross join (values (0), (1), (2), (3)) as v(i) where i < 2 + p_partkey % 3""",
    "edges": """
select a.street_id, b.i as e, a.lon as lon1, a.lat as lat1, b.lon as lon2, b.lat as lat2
from {vertices} a join {vertices} b on a.street_id = b.street_id and b.i = a.i + 1""",
    "windows": """
select id as station_id, cast(null as string) as service_key, wd as weekday, cast(300 + id*7 % 60 as double) as start_min,
  cast(600 + id*13 % 900 as double) as end_min, cast(4 + id % 12 as double) as headway_min
from {stations} cross join (values (0), (1), (2), (3), (4), (5), (6)) as w(wd) where (id + wd) % 3 <> 0 and id % 10 <> 9
union all
select id, concat('S', cast(id % 5 as string)), wd, cast(330 + id*11 % 90 as double), cast(700 + id*17 % 800 as double), cast(6 + id % 9 as double)
from {stations} cross join (values (0), (1), (2), (3), (4), (5), (6)) as w(wd) where (id*2 + wd) % 4 <> 0 and id % 3 <> 2""",
    "wait_queries": """
select id as station_id, concat('S', cast(id % 5 as string)) as service_key, cast(id % 7 as int) as weekday, cast((id*97) % 1440 as double) as minute from {stations}""",
    "departures": """
select user_id, event_type, {WEEKDAY} as weekday, round(hour(ts)*60 + minute(ts) + {SECOND}/cast(60 as double), 2) as minute from {events}""",
    "stop_times": """
select l_orderkey as trip_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as int) as seq,
  case when l_suppkey % 17 = 3 then null else l_suppkey % 50 end as station_id, l_partkey as pk
from {lineitem}""",
    "timed": """
select t.trip_id, t.seq, t.station_id, cast(300 + t.trip_id % 600 + t.seq*4 + t.pk % 3 as double) as arrival,
  cast(300 + t.trip_id % 600 + t.seq*4 + t.pk % 3 as double) + (t.pk % 2)*cast(0.5 as double) as departure,
  concat('R', cast(o_custkey % 20 as string), '/', cast(o_orderkey % 2 as string)) as service_key
from {stop_times} t join {orders} on o_orderkey = t.trip_id""",
    "rides": """
select a.id as src, b.id as dst, cast(2 + a.id % 4 as double) + (a.id % 3)*cast(0.25 as double) as minutes, concat('S', cast(a.id % 5 as string)) as service_key
from {open_stations} a join {open_stations} b on b.id = a.id + 5
union all
select b.id, a.id, cast(3 + a.id % 4 as double), concat('S', cast(a.id % 5 as string)) from {open_stations} a join {open_stations} b on b.id = a.id + 5
union all
select a.id, b.id, cast(4 + a.id % 3 as double), 'X/0' from {open_stations} a join {open_stations} b on b.id = a.id + 7 where a.id % 2 = 0""",
    "waits": "select id as station_id, service_key, cast(2 + id % 7 as double) + (id % 2)*cast(0.5 as double) as wait_min from (select id, concat('S', cast(id % 5 as string)) as service_key from {open_stations} where id % 3 <> 1)",
    "stops": """
select s_suppkey as stop_id, concat('Metro Estación ', cast(s_suppkey {D} 3 as string), ' Norte') as name,
  case when s_suppkey % 13 = 7 then 'monorail' else mode end as mode,
  lon + ((s_suppkey*37) % 11 - 5)*cast(0.0005 as double) as lon, lat + ((s_suppkey*53) % 13 - 6)*cast(0.0004 as double) as lat
from {supplier} join {stations} on id = s_suppkey""",
    "calendar": """
select distinct o_orderpriority as service_id, cast(o_custkey % 2 as string) as monday, cast(length(o_orderpriority) % 2 as string) as tuesday, '1' as wednesday, '0' as thursday,
  cast(o_custkey % 3 {D} 2 as string) as friday, '0' as saturday, '0' as sunday from {orders}""",
    "calendar_dates": """
select distinct o_orderpriority as service_id, concat('2024', substr('010203040506070809101112', cast(1 + 2*(o_orderkey % 12) as int), 2), substr('0611162126', cast(1 + 2*(o_custkey % 5) as int), 2)) as date,
  cast(1 + o_orderkey % 2 as string) as exception_type from {orders}""",
    "frequencies": """
select o_orderkey as trip_id, cast(300 + o_custkey % 200 as double) as start_min, cast(300 + o_custkey % 200 + 30 + o_orderkey % 90 as double) as end_min,
  cast(5 + o_orderkey % 8 as double) as headway_min, cast(o_custkey % 4 as double) as offset_min from {orders}""",
    "tagged": """
select s_suppkey as id, cast(s_suppkey as int) as ord,
  case s_suppkey % 12 when 0 then 'Plaza Maguey' when 1 then 'Lechería' when 2 then 'Cantil' else concat('Parada ', cast(s_suppkey as string)) end as name,
  case s_suppkey % 9 when 0 then 'STC Metro' when 1 then 'Metrobús' when 2 then 'Trolebús Línea 12' when 3 then 'Suburbano' when 4 then 'Cablebús' when 5 then 'Tren Ligero' when 6 then 'El Insurgente' when 7 then 'Mexicable Línea 3' else 'Autobuses' end as network,
  case s_suppkey % 5 when 0 then 'station' when 1 then 'halt' when 2 then 'proposed' when 3 then 'construction' else '' end as railway,
  case s_suppkey % 7 when 0 then 'subway' when 1 then 'light_rail' when 2 then 'monorail' else '' end as station,
  case s_suppkey % 8 when 0 then '2030' when 1 then '2020-05' when 2 then '2026-12-31' when 3 then '2020-01-01' when 4 then '2026-05' else '' end as opening_date,
  case when s_suppkey % 4 = 0 then 'yes' else '' end as trolleybus
from {supplier}""",
    "curated_like": """
select s_suppkey as ord, concat('node/', cast(s_suppkey as string)) as id, case s_suppkey % 4 when 0 then 'TEOTONGO' when 1 then 'Xaltocan' when 2 then 'Otra' else 'Cantil' end as name,
  case when s_suppkey % 4 = 1 then 'commuter_rail' else 'brt' end as mode, case when s_suppkey % 4 = 2 then '9;11' else '' end as route_ref,
  case s_suppkey % 4 when 0 then cast(-98.974564 as double) when 1 then cast(-99.0575 as double) when 2 then cast(-98.9079 as double) else cast(-99.154391 as double) end + (s_suppkey % 23 - 11)*cast(0.004 as double) as lon,
  case s_suppkey % 4 when 0 then cast(19.337368 as double) when 1 then cast(19.7236 as double) when 2 then cast(19.2731 as double) else cast(19.329607 as double) end + (s_suppkey % 19 - 9)*cast(0.003 as double) as lat
from {supplier}""",
}
#: The same under names that queries had for all orders.
VIEWS |= {f"all_{n}": VIEWS[n] for n in ("calendar", "calendar_dates", "frequencies")}
TABLES = ("supplier", "part", "lineitem", "orders", "events", "nation", "customer", "region")
WORDS = {"spark": {"D": "div", "WEEKDAY": "weekday(ts)", "SECOND": "floor(second(ts))"}, "duckdb": {"D": "//", "WEEKDAY": "cast(isodow(ts) - 1 as int)", "SECOND": "second(ts)"}}


def needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in VIEWS]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a frame; the scans below read only what it takes."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    for word, text in WORDS["spark"].items():
        sql = sql.replace("{" + word + "}", text)
    own = {n: view(spark, sf_dir, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **own)


def duckdb(query: str) -> str:
    """A query over {views} as DuckDB SQL, with the views it takes before it."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for n in needs(sql):
            if n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(query)
    recursive = "recursive " if "/*recursive*/" in query else ""
    ctes = [f"{n} as ({VIEWS[n]})" for n in order]
    text = query.replace("/*recursive*/", "")
    head = text.lstrip()
    if head.startswith("with "):
        sql = f"with {recursive}" + ", ".join([*ctes, head[5:]])
    else:
        sql = (f"with {recursive}" + ", ".join(ctes) + " " if ctes else "") + head
    for word, w in WORDS["duckdb"].items():
        sql = sql.replace("{" + word + "}", w)
    return re.sub(r"\{(\w+)\}", r"\1", sql)
