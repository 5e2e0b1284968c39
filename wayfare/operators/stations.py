"""Stations from tagged elements: classification, status, route context, de-duplication, curated replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import geo
from wayfare.functions.text import normalize
from wayfare.operators.tables import MODES, small, stored

TAGS = "map<string, string>"

# fixed values: names that are no stations
FALSE_NAMES = (
    "^plaza maguey$",
    "(?:transportes?|servicios) urbanos y suburbanos xinantecatl",
    "transporte colectivo urbano y suburbano de pasajeros en autobuses de ruta fija",
)
# fixed values: networks that are not open yet, with status detail and source
FUTURE_NETWORKS = (
    ("mexicable linea 3", "Under construction", "Mexicable Line 3 is not yet open"),
    ("tren ligero texcoco-la paz", "Planned", "Tagged as proposed in OSM"),
)
# fixed values: patterns of operators and lines
SUBWAY = r"\bstc metro\b|\bmetro cdmx\b|sistema de transporte colectivo"
LIGHT_RAIL = "tren ligero|ste tren ligero"
CABLE = "cablebus|mexicable"
BRT = "metrobus|mexibus"
TROLLEY = "trolebus|trolebus elevado"
CORRIDOR = r"trolebus elevado|linea\s*(?:10|11|12)|\bl(?:10|11|12)\b|chalco|santa marta|teotongo|\bxico\b|avenida aztecas|tasquena|taxquena|perisur"
COMMUTER_PROVIDER = r"\bsuburbano\b|ferrocarriles suburbanos|tren felipe angeles"
COMMUTER = "fc suburbano|tren suburbano|tren felipe angeles"
REGIONAL = "tren interurbano|el insurgente"
CONTEXT_TAGS = ("network", "operator", "brand", "network:short", "operator:short", "local_ref", "route_ref", "ref", "name")
PROVIDER_TAGS = CONTEXT_TAGS[:5]
INHERITED = ("network", "operator", "route_ref", "route_name", "route_relation")
CURATED_M = 3000.0


def tag(name: str, tags: str | Column = "tags") -> Column:
    return F.try_element_at(F.col(tags) if isinstance(tags, str) else tags, F.lit(name))


def bare(name: str) -> Column:
    return normalize(tag(name), trim=False)


def context(names: tuple[str, ...] = CONTEXT_TAGS) -> Column:
    """The normalised values of these tags, those that aren't empty, in a line."""
    return F.concat_ws(" ", F.filter(F.array(*map(bare, names)), lambda x: x != ""))


def has_prefix(prefix: str, tags: str = "tags") -> Column:
    """Whether any tag's name begins so."""
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: k.startswith(prefix)), F.lit(False))


def is_false_positive(name: Column) -> Column:
    return reduce(lambda a, b: a | b, (normalize(name, trim=False).rlike(p) for p in FALSE_NAMES))


def is_brt_trolleybus(around: Column) -> Column:
    trolley = (bare("trolleybus") == "yes") | (bare("route") == "trolleybus") | around.rlike(TROLLEY)
    return trolley & around.rlike(CORRIDOR)


def classify() -> Column:
    """The mode of a tag map named tags, or excluded; rules go in order."""
    around, provider, railway, station = context(), context(PROVIDER_TAGS), bare("railway"), bare("station")
    return (
        F.when((station == "subway") | around.rlike(SUBWAY) | ((bare("operator") == "stc") & (railway == "station")), "subway")
        .when((station == "light_rail") | around.rlike(LIGHT_RAIL), "light_rail")
        .when(station == "monorail", "monorail")
        .when(around.rlike(CABLE), "cable_car")
        .when(around.rlike(BRT) | is_brt_trolleybus(around), "brt")
        .when(provider.rlike(COMMUTER_PROVIDER) | (railway.isin("station", "halt", "stop") & around.rlike(COMMUTER)), "commuter_rail")
        .when(around.rlike(REGIONAL), "regional_rail")
        .otherwise("excluded")
    )


def system(mode: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for _, m, label, *_ in MODES for x in (m, label)]), mode), F.lit("Excluded"))


def opening_is_future(opening: Column, today: Column) -> Column:
    """Compared at the precision of the date, year, month or day; null for other text and dates that don't exist."""
    at = F.trim(opening)
    return (
        F.when(at.rlike(r"^\d{4}$"), at.try_cast("int") > F.year(today))
        .when(at.rlike(r"^\d{4}-\d{2}$") & F.try_to_date(F.concat(at, F.lit("-01")), "yyyy-MM-dd").isNotNull(), at > F.date_format(today, "yyyy-MM"))
        .when(at.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(at, "yyyy-MM-dd") > today)
    )


def status(today: Column) -> Column:
    """A struct of status, status_detail and status_source of a tag map named tags; rules go in order."""
    made = lambda s, detail, source: F.struct(F.lit(s).alias("status"), detail.alias("status_detail"), F.lit(source).alias("status_source"))
    opening, around = tag("opening_date"), context()
    has = F.coalesce(opening, F.lit("")) != ""
    future = opening_is_future(opening, today)
    railway, building = bare("railway"), bare("construction")
    proposed = (bare("proposed") == "yes") | has_prefix("proposed:") | railway.isin("proposed", "prpopsed")
    rules = [(around.rlike(p), made("future", F.when(has, F.concat(F.lit(f"{detail}; opening "), opening)).otherwise(detail), why)) for p, detail, why in FUTURE_NETWORKS]
    rules += [
        (has & F.coalesce(future, F.lit(False)), made("future", F.concat(F.lit("Opening "), opening), "OSM opening_date is in the future")),
        (has & future.isNotNull(), made("open", F.lit("Open"), "OSM opening_date is not in the future")),
        (proposed, made("future", F.lit("Planned"), "OSM proposed lifecycle tags")),
        ((railway == "construction") | building.isin("yes", "construction"), made("future", F.lit("Under construction"), "OSM construction lifecycle tags")),
    ]
    out = made("open", F.lit("Open"), "No future/construction lifecycle tags")
    for when, then in reversed(rules):
        out = F.when(when, then).otherwise(out)
    return out


def is_station_like() -> Column:
    return (
        bare("public_transport").isin("station", "platform", "stop_position")
        | (bare("highway") == "bus_stop")
        | (bare("amenity") == "bus_station")
        | bare("railway").isin("station", "halt", "tram_stop")
    )


def coordinate() -> Column:
    """A struct of lon and lat: a node's own, else the element's center; null without both."""
    own = F.when(geo.is_coordinate(F.col("lon"), F.col("lat")), F.struct("lon", "lat"))
    centre = F.when(geo.is_coordinate(F.col("center.lon"), F.col("center.lat")), F.struct(F.col("center.lon").alias("lon"), F.col("center.lat").alias("lat")))
    return F.coalesce(own, centre)


def route_contexts(elements: DataFrame) -> DataFrame:
    """(type, id, ctx): what members of BRT route relations inherit, distinct values joined by ; in the order of relation ids.

    elements: type, id, lon, lat, center, tags, members (type, ref, role).
    """
    first = lambda *c: F.coalesce(*(F.when(x != "", x) for x in c), F.lit(""))
    around = context()
    operator = first(tag("operator"), F.when(around.contains("mexibus"), F.lit("Mexibús")).when(around.contains("metrobus"), F.lit("Metrobús")).when(around.contains("trolebus"), F.lit("Servicio de Transportes Eléctricos")).otherwise(F.lit("")))
    routes = elements.where((F.col("type") == "relation") & (classify() == "brt")).select(
        F.col("id").alias("relation"),
        F.explode("members").alias("m"),
        first(tag("network"), tag("ref"), tag("name"), F.lit("BRT")).alias("network"),
        operator.alias("operator"),
        first(tag("ref")).alias("route_ref"),
        first(tag("name")).alias("route_name"),
        F.concat(F.lit("relation/"), F.col("id").cast("string")).alias("route_relation"),
    )
    like = elements.where(is_station_like()).select(F.col("type").alias("mt"), F.col("id").alias("mi"), F.lit(True).alias("like")).distinct()
    members = routes.withColumn("mt", F.col("m.type")).withColumn("mi", F.col("m.ref")).join(like, ["mt", "mi"], "left")
    members = members.where(normalize(F.col("m.role"), trim=False).rlike("stop|platform|station") | F.coalesce("like", F.lit(False)))
    got = members.groupBy("mt", "mi").agg(F.array_sort(F.collect_list(F.struct("relation", *INHERITED))).alias("all"))
    merged = lambda c: F.array_join(F.array_distinct(F.filter(F.transform("all", lambda x: x[c]), lambda v: v != "")), ";")
    return got.select(F.col("mt").alias("type"), F.col("mi").alias("id"), F.map_from_arrays(F.array(*map(F.lit, INHERITED)), F.array(*map(merged, INHERITED))).alias("ctx"))


def from_elements(elements: DataFrame, today: Column, decimals: int = 4) -> DataFrame:
    """Station rows of tagged elements: filtered, classified, with status, one for each place and name.

    elements as for route_contexts, with ord, their order. A place's first row stays, but an open one
    replaces it if it isn't open; the row keeps the first's ord.
    """
    own = elements.join(route_contexts(elements), ["type", "id"], "left").withColumn("at", coordinate()).where("at is not null")
    missing = F.map_filter("ctx", lambda k, v: (v != "") & (F.coalesce(F.try_element_at("tags", k), F.lit("")) == ""))
    kept = F.map_filter("tags", lambda k, v: ~F.array_contains(F.map_keys(missing), k))
    own = own.withColumn("tags", F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    own = own.withColumn("tags", F.when(F.col("ctx").isNotNull(), F.map_concat(kept, missing)).otherwise(F.col("tags")))
    own = own.where(~is_false_positive(tag("name")) & (is_station_like() | F.col("ctx").isNotNull()))
    own = own.where(~((F.coalesce(tag("name"), F.lit("")) == "") & (bare("public_transport") == "stop_position")))
    own = own.withColumn("mode", classify()).where("mode <> 'excluded'").withColumn("s", status(today))
    text = lambda c: F.coalesce(tag(c), F.lit("")).alias(c)
    own = own.select(
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("id"), "ord", F.round("at.lon", decimals).alias("lon"), F.round("at.lat", decimals).alias("lat"),
        text("name"), "mode", system(F.col("mode")).alias("system"), "s.*", text("network"), text("operator"), text("opening_date"), text("route_ref"), text("route_name"), text("route_relation"),
    )
    return deduplicate(own, ["lon", "lat", "name"])


def deduplicate(stations: DataFrame, keys: list[str], prefer_open: bool = True) -> DataFrame:
    """One row for each key: the first by ord, the first open one where the first isn't; with the first's ord."""
    w = Window.partitionBy(*keys)
    order = [F.col("ord")] if not prefer_open else [F.when(F.col("status") == "open", 0).otherwise(1), F.col("ord")]
    rows = stations.withColumn("__first", F.min("ord").over(w)).withColumn("__r", F.row_number().over(w.orderBy(*order))).where("__r = 1")
    return rows.withColumn("ord", F.col("__first")).drop("__first", "__r")


def place_keys(stations: DataFrame) -> DataFrame:
    """With the keys of feed stations: coordinates at 4 decimals and the trimmed lower-case name."""
    return stations.withColumn("k_lon", F.round("lon", 4)).withColumn("k_lat", F.round("lat", 4)).withColumn("k_name", F.lower(F.trim("name")))


def reconcile(stations: DataFrame, curated: DataFrame) -> DataFrame:
    """Stations without those that a curated one replaces, and the curated ones. Doing it again changes nothing.

    Replaced: of the same mode within 3 km, and of the same name, or a BRT stop
    with the curated line among its route_ref. Earlier curated rows and false
    positives go too. Columns: those of curated.
    """
    refs = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: normalize(x, trim=False))
    own = stations.where(~F.col("id").startswith("official/") & ~is_false_positive(F.col("name")))
    c = curated.select(F.col("mode").alias("c_mode"), normalize(F.col("name"), trim=False).alias("c_name"), normalize(F.col("route_ref"), trim=False).alias("c_ref"), F.round("lon", 4).alias("c_lon"), F.round("lat", 4).alias("c_lat"))
    same = (F.col("mode") == F.col("c_mode")) & ((normalize(F.col("name"), trim=False) == F.col("c_name")) | ((F.col("mode") == "brt") & F.array_contains(refs(F.col("route_ref")), F.col("c_ref"))))
    near = geo.planar_distance(F.col("c_lon"), F.col("c_lat"), F.col("lon"), F.col("lat")) <= CURATED_M
    left = own.join(small(c), same & near, "left_anti")
    return left.select(*curated.columns).unionByName(curated)


def counts_by(stations: DataFrame, column: str) -> DataFrame:
    """(value, n): rows of each value; null and empty as unknown."""
    value = F.coalesce(F.when(F.col(column).cast("string") != "", F.col(column).cast("string")), F.lit("unknown"))
    return stations.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def in_box(stations: DataFrame, west: float, south: float, east: float, north: float, modes: list | None = None, status: str | None = "open") -> DataFrame:
    """Stations of the status and modes within the box, its edges included; no mode, no station."""
    rows = stations.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    rows = rows.where(F.col("status") == status) if status else rows
    return rows if modes is None else rows.where(F.col("mode").isin(modes) if modes else F.lit(False))


def mode_list(stations: DataFrame) -> DataFrame:
    """(mode, n, place): the modes with most stations first, equal ones in the order of the modes. A row for each mode."""
    bit = F.try_element_at(F.create_map(*[F.lit(x) for b, m, *_ in MODES for x in (m, b)]), F.col("mode"))
    per = stations.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), bit)) - 1)


def by_name(stations: DataFrame, collation: str = "es") -> DataFrame:
    """Stations with a name and their place in the collation's order, then by id: the list that a user chooses from.

    The order is dealt into ranges of names, each counted first.
    """
    own = stations.where("name <> ''").withColumn("__key", F.collate("name", collation))
    spark = stations.sparkSession
    dealt = stored(own.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "__key", "id").withColumn("__range", F.spark_partition_id()).drop("__key"), "by-name")
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    order = Window.partitionBy("__range").orderBy(F.collate("name", collation), "id")
    return dealt.join(before, "__range").withColumn("place", F.col("__before") + F.row_number().over(order) - 1).drop("__range", "__before")


def ordinals(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """(station_id, ord): the place of each row's station among the stations (id, ord), as access indexes have it; rows of others don't count.

    stations are one pool of a city, whose places are counted in one task.
    """
    places = stations.select(F.col("id").alias("station_id"), (F.row_number().over(Window.orderBy("ord")) - 1).alias("ord"))
    return rows.select("station_id").join(places, "station_id")
