"""GTFS tables: every cell a string, a missing one empty."""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import text

COLUMNS = {
    "routes": "route_id agency_id route_short_name route_long_name route_type route_desc",
    "calendar": "service_id monday tuesday wednesday thursday friday saturday sunday",
    "calendar_dates": "service_id date exception_type",
    "trips": "trip_id route_id service_id direction_id",
    "frequencies": "trip_id start_time end_time headway_secs",
    "stop_times": "trip_id stop_id stop_sequence arrival_time departure_time",
    "stops": "stop_id stop_name stop_lat stop_lon location_type parent_station stop_code wheelchair_boarding",
    "transfers": "from_stop_id to_stop_id transfer_type min_transfer_time",
}


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of an extracted feed by its header; columns that the file lacks are empty.

    A file is read in as many splits as it has, unless a quoted cell goes over a line's end: then it is one task's.
    """
    path = f"{folder}/{table}.txt"
    open_ = spark.read.text(path).where((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1).limit(1).count()
    raw = spark.read.csv(path, header=True, multiLine=bool(open_), escape='"', inferSchema=False)
    raw = raw.toDF(*(c.strip().lstrip("\ufeff") for c in raw.columns))
    return raw.select(*((F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in raw.columns else F.lit("")).alias(c) for c in COLUMNS[table].split())).where(F.concat(*COLUMNS[table].split()) != "")


def read_zip(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The same from zip files (a folder or pattern too), a file to a task, which streams the member from where it lies; without the member no rows."""
    names = COLUMNS[table].split()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for place in pdf["path"]:
                fs, own = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", place))
                with fs.open_input_file(own) as f, zipfile.ZipFile(f) as z:
                    if f"{table}.txt" not in z.namelist():
                        continue
                    rows = csv.DictReader(io.TextIOWrapper(z.open(f"{table}.txt"), "utf-8-sig", newline=""))
                    while chunk := [[(r.get(n) or "") for n in names] for r in islice(rows, 50_000)]:
                        yield pd.DataFrame([r for r in chunk if any(r)], columns=names, dtype=str)

    files = spark.read.format("binaryFile").load(path).select("path")  # their content isn't read here
    return files.mapInPandas(run, ", ".join(f"{n} string" for n in names))


def write_table(df: DataFrame, folder: str, table: str) -> None:
    """A table of a feed in a folder, under its name; a file for each partition, each with the header."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{folder}/{table}.txt")


def write_zips(df: DataFrame, folder: str, table: str) -> None:
    """A table in zip files, one for each partition that has rows."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in batches for r in pdf.fillna("").itertuples(index=False)]
        if rows:
            fs, own = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
            fs.create_dir(own, recursive=True)
            with fs.open_output_stream(f"{own}/feed-{uuid.uuid4().hex}.zip") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"{table}.txt", "w") as t:
                with io.TextIOWrapper(t, "utf-8", newline="") as out:
                    csv.writer(out).writerows([names, *rows])
        yield pd.DataFrame({"n": [len(rows)]})

    df.mapInPandas(run, "n long").agg(F.sum("n")).first()


def stop_rows(stops: DataFrame) -> DataFrame:
    """Rows that are stations: finite places; stations and parents, and what has no parent and is no entrance or node."""
    parents = stops.where("parent_station <> ''").select(F.col("parent_station").alias("p")).distinct()
    lat, lon = (F.coalesce(F.nullif(F.trim(c), F.lit("")).try_cast("double"), F.when(F.trim(c) == "", F.lit(0.0))) for c in ("stop_lat", "stop_lon"))
    rows = stops.withColumn("lat", lat).withColumn("lon", lon).where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    rows = rows.join(parents, F.col("stop_id") == F.col("p"), "left")
    return rows.where((F.col("location_type") == "1") | F.col("p").isNotNull() | ((F.col("parent_station") == "") & ~F.col("location_type").isin("2", "3", "4"))).drop("p")


def station_of_stop(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """(stop_id, station_id): a stop's parent if that is a station, else itself."""
    ids = stations.select(F.col("stop_id").alias("parent")).distinct()
    rows = stops.join(ids, stops["parent_station"] == F.col("parent"), "left")
    return rows.select("stop_id", F.coalesce("parent", "stop_id").alias("station_id"))


def timed_stops(stop_times: DataFrame, trips: DataFrame, strict: bool = False) -> DataFrame:
    """(trip_id, seq, stop_id, arrival, departure, service_id, service_key): stop times of known trips in minutes; rows without a time have null."""
    own = trips.select("trip_id", "service_id", text.service_key(F.col("route_id"), F.col("direction_id")).alias("service_key"))
    rows = stop_times.join(own, "trip_id")
    return rows.select("trip_id", F.col("stop_sequence").try_cast("int").alias("seq"), "stop_id", text.gtfs_minutes(F.col("arrival_time"), strict).alias("arrival"), text.gtfs_minutes(F.col("departure_time"), strict).alias("departure"), "service_id", "service_key")


def frequency_windows(frequencies: DataFrame) -> DataFrame:
    """(trip_id, start_min, end_min, headway_min): those with a positive headway."""
    rows = frequencies.select("trip_id", text.gtfs_minutes(F.col("start_time")).alias("start_min"), text.gtfs_minutes(F.col("end_time")).alias("end_min"), (F.col("headway_secs").try_cast("double") / 60).alias("headway_min"))
    return rows.where("headway_min > 0 and start_min is not null and end_min is not null")


# fixed values: modes of the agencies of the capital's feed; of the trolleybus only its BRT lines count
AGENCY_MODES = {"METRO": "subway", "MB": "brt", "TL": "light_rail", "SUB": "commuter_rail", "CBB": "cable_car", "INTERURBANO": "regional_rail"}
TROLLEY_AGENCY, TROLLEY_LINES = "TROLE", "^(10|11|12|13)$"
METRO_BOX = (-74.8, 40.0, -71.8, 41.9)


def agency_mode(routes: DataFrame) -> DataFrame:
    """routes with mode by agency; null where none is known."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in AGENCY_MODES.items() for x in pair]), F.col("agency_id"))
    brt = F.when(F.col("route_short_name").rlike(TROLLEY_LINES), F.lit("brt"))
    return routes.withColumn("mode", F.when(F.col("agency_id") == TROLLEY_AGENCY, brt).otherwise(known))


def stop_modes(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, feed_mode: str | None = None) -> DataFrame:
    """(stop_id, mode): the feed's mode if it has one; else commuter rail where any of the stop's routes is, before light rail (types 0 and 900)."""
    if feed_mode:
        return stop_times.select("stop_id").distinct().withColumn("mode", F.lit(feed_mode))
    kinds = routes.select("route_id", F.when(F.col("route_type").isin("0", "900"), "light_rail").otherwise("commuter_rail").alias("mode"))
    met = stop_times.select("trip_id", "stop_id").join(trips.select("trip_id", "route_id"), "trip_id").join(kinds, "route_id")
    return met.groupBy("stop_id").agg(F.min("mode").alias("mode"))  # commuter_rail stands before light_rail


def route_metadata(routes: DataFrame, feed: str, agency: str, feed_mode: str | None = None) -> DataFrame:
    """(route_id, agency, mode, name, description) under the feed's prefix; here type 0 alone is light rail."""
    mode = F.lit(feed_mode) if feed_mode else F.when(F.col("route_type") == "0", "light_rail").otherwise("commuter_rail")
    name = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("route_short_name", "route_long_name", "route_id")))
    return routes.select(F.concat_ws("/", F.lit(feed), "route_id").alias("route_id"), F.lit(agency).alias("agency"), mode.alias("mode"), name.alias("name"), F.col("route_desc").alias("description"))


def in_metro(stations: DataFrame, edges: DataFrame, box: tuple[float, float, float, float] = METRO_BOX) -> tuple[DataFrame, DataFrame]:
    """Stations in the box, its edges included, and the edges (src, dst) between them."""
    west, south, east, north = box
    own = stations.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    ids = own.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return own, inside.select(*edges.columns)
