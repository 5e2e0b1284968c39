"""GeoJSON, saved Overpass JSON and tile partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.streets import POINTS
from wayfare.sources.json_ranges import RANGE_BYTES, objects_of, opened

ELEMENT = "type string, id bigint, lon double, lat double, center struct<lon: double, lat: double>, tags map<string, string>, geometry array<struct<lon: double, lat: double>>, members array<struct<type: string, ref: bigint, role: string>>"


def read_elements(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Elements of saved responses, one for each (type, id): that of the last path; ord is their order by path and place. A file is read in ranges of its bytes."""
    frames = [objects_of(spark, p, "elements", range_bytes).select(F.lit(k).alias("tile"), "pos", F.from_json("value", ELEMENT).alias("e")) for k, p in enumerate(paths)]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    last = rows.groupBy(F.col("e.type").alias("t"), F.col("e.id").alias("i")).agg(F.max_by(F.struct("tile", "pos", "e"), F.struct("tile", "pos")).alias("last"))
    return last.select("last.e.*", (F.col("last.tile") * F.lit(1 << 40) + F.col("last.pos")).alias("ord"))


def _nested(ddl: str) -> str:
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += c
    return ", ".join(out)


def read_features(spark: SparkSession, path: str, properties: str, line: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Features of a collection: their order, the properties (as DDL), and lon and lat, or the pts of lines. A file is read in ranges of its bytes."""
    kind = "array<array<double>>" if line else "array<double>"
    shape = f"geometry struct<type: string, coordinates: {kind}>, properties struct<{_nested(properties)}>"
    rows = objects_of(spark, path, "features", range_bytes).select(F.col("pos").alias("ord"), F.from_json("value", shape).alias("f"))
    if line:
        return rows.select("ord", "f.properties.*", F.transform("f.geometry.coordinates", lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"))).alias("pts"))
    return rows.select("ord", "f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


def as_elements(lines: DataFrame, tags: list[str]) -> DataFrame:
    """Lines as elements again, for a rebuild: geometry of points, tags as a map."""
    return lines.select(F.lit("way").alias("type"), F.col("ord").cast("bigint").alias("id"), F.col("pts").cast(POINTS).alias("geometry"), F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*(F.col(t).cast("string") for t in tags))).alias("tags"))


def _as_features(df: DataFrame, properties: list[str], line: bool) -> DataFrame:
    coordinates = F.transform("pts", lambda p: F.array(p["lon"], p["lat"])) if line else F.array("lon", "lat")
    geometry = F.struct(F.lit("LineString" if line else "Point").alias("type"), coordinates.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_features(df: DataFrame, path: str, properties: list[str], line: bool = False) -> None:
    """One GeoJSON feature a line (newline-delimited), by as many writers as there are partitions."""
    _as_features(df, properties, line).write.mode("overwrite").text(path)


def write_collection(df: DataFrame, path: str, properties: list[str], line: bool = False) -> None:
    """One FeatureCollection in the order of df: a single file, as the format asks for, so for what a map loads whole; its writer streams the features. Without features there is no file."""
    write_array(_as_features(df, properties, line), path, '{"type":"FeatureCollection","features":[')


def write_elements(elements: DataFrame, path: str) -> None:
    """Elements (see ELEMENT) as a saved response, a single file in their order."""
    write_array(elements.select(F.to_json(F.struct(*elements.columns)).alias("value")), path, '{"elements":[')


def write_array(values: DataFrame, path: str, head: str) -> None:
    """One object whose last key has an array of the values (value: JSON)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        first = True
        for pdf in batches:
            if len(pdf):
                rows = "," + pdf["value"]
                yield pd.DataFrame({"value": [rows.iloc[0][first:], *rows.iloc[1:]]})
                first = False
        yield pd.DataFrame({"value": ["]}"]})

    values.coalesce(1).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def single(path: str) -> str:
    """The file that write_collection() or write_elements() has made in its folder."""
    fs, own = opened(path)
    return next(f"{path}/{f.base_name}" for f in fs.get_file_info(pa.fs.FileSelector(own)) if f.base_name.startswith("part-"))


def write_tiles(segments: DataFrame, path: str, degrees: float = 0.05) -> None:
    """Segments by first zoom and cell, so a viewport reads the folders that it meets. segments: minzoom, pts and others."""
    first = F.element_at("pts", 1)
    cells = segments.withColumn("cx", F.floor(first["lon"] / degrees).cast("int")).withColumn("cy", F.floor(first["lat"] / degrees).cast("int"))
    cells.repartition("minzoom", "cx", "cy").write.mode("overwrite").partitionBy("minzoom", "cx", "cy").parquet(path)


def read_tiles(spark: SparkSession, path: str, zoom: int, west: float, south: float, east: float, north: float, degrees: float = 0.05) -> DataFrame:
    """The segments of the cells that meet the box, up to the zoom."""
    at = lambda x: int(x // degrees)
    return spark.read.parquet(path).where((F.col("minzoom") <= zoom) & F.col("cx").between(at(west), at(east)) & F.col("cy").between(at(south), at(north)))


def merged_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (meta map<string, string>, sources array<string>): new values over old ones, sources of both."""
    a, b = old.select(F.col("meta").alias("m0"), F.col("sources").alias("s0")), new.select(F.col("meta").alias("m1"), F.col("sources").alias("s1"))
    rows = a.crossJoin(F.broadcast(b))  # one row each
    kept = F.map_filter("m0", lambda k, v: ~F.array_contains(F.map_keys("m1"), k))
    return rows.select(F.map_concat(kept, "m1").alias("meta"), F.array_union("s0", "s1").alias("sources"))
