"""Streets: junctions, segments, live roads, tile rows."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import display, geo
from wayfare.operators.tables import MODES, lookup, stored

# fixed values: first zoom of road classes
MIN_ZOOM = {
    "motorway": 8, "trunk": 8, "motorway_link": 9, "trunk_link": 9, "primary": 10, "primary_link": 10,
    "secondary": 10, "secondary_link": 10, "tertiary": 10, "tertiary_link": 10, "busway": 10,
    "residential": 13, "unclassified": 13, "living_street": 13, "service": 14, "pedestrian": 14, "track": 14,
}
OTHER_ZOOM = 13
POINTS = "array<struct<lon: double, lat: double>>"


def valid(streets: DataFrame) -> DataFrame:
    """Streets (pts) without points that are no coordinates; those with two points at least."""
    return streets.withColumn("pts", F.filter("pts", lambda p: geo.is_coordinate(p["lon"], p["lat"]))).where(F.size("pts") >= 2)


def junctions(streets: DataFrame) -> DataFrame:
    """(lon, lat, streets): points of more than one street; a point that a street has twice counts once."""
    points = streets.select("street_id", F.explode(F.array_distinct("pts")).alias("p")).select("street_id", "p.lon", "p.lat").distinct()
    return points.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("streets")).where("streets > 1")


def cut(points: list[tuple[float, float]], at: set[tuple[float, float]], cap: float) -> list[list[tuple[float, float]]]:
    """A polyline in segments: at inner junctions, and in each stretch between them wherever a multiple of the cap is reached.

    Places are lengths along the line. A break within a micrometre of a vertex is that vertex.
    """
    line = [p for k, p in enumerate(points) if not k or p != points[k - 1]]
    if len(line) < 2:
        return []
    place = [0.0, *accumulate(geo.haversine_py(*a, *b) for a, b in pairwise(line))]
    inner = [place[k] for k in range(1, len(line) - 1) if line[k] in at]
    breaks = [0.0]
    for a, b in pairwise([0.0, *inner, place[-1]]):
        breaks += [a + cap * k for k in range(1, math.ceil((b - a - 1e-6) / cap))] if cap < math.inf else []
        breaks.append(b)

    def corner(x: float) -> tuple[float, tuple[float, float]]:
        k = min(bisect_right(place, x), len(place) - 1)
        for near in (k - 1, k):
            if abs(place[near] - x) <= 1e-6:
                return place[near], line[near]
        share = (x - place[k - 1]) / (place[k] - place[k - 1])
        return x, tuple(u + (v - u) * share for u, v in zip(line[k - 1], line[k], strict=True))

    corners = list(map(corner, breaks))
    return [[a, *line[bisect_right(place, p) : bisect_left(place, q)], b] for (p, a), (q, b) in pairwise(corners)]


def split(streets: DataFrame, crossings: DataFrame | None = None, max_length_m: float | None = 200.0) -> DataFrame:
    """(street_id, seg_no, pts): streets in segments of at most max_length_m, cut at inner junctions too.

    crossings: junctions(). No cap if max_length_m is None, 0 or less. Each
    street meets its own crossings by an equi-join on the point.
    """
    cap = max_length_m if max_length_m and 0 < max_length_m < float("inf") else float("inf")
    lines = valid(streets).select("street_id", "pts")
    if crossings is not None:
        points = lines.select("street_id", F.explode(F.array_distinct("pts")).alias("p")).select("street_id", "p.lon", "p.lat")
        hits = points.join(crossings.select("lon", "lat"), ["lon", "lat"]).groupBy("street_id").agg(F.collect_set(F.struct("lon", "lat")).alias("at"))
        lines = lines.join(hits, "street_id", "left")
    else:
        lines = lines.withColumn("at", F.lit(None).cast(POINTS))
    kind = lines.schema["street_id"].dataType.simpleString()
    def listed(column: pa.ListArray) -> list[list[tuple[float, float]]]:
        flat = column.flatten()
        points = list(zip(*(flat.field(k).to_numpy().tolist() for k in (0, 1)), strict=True))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()).tolist()
        return [points[a:b] for a, b in pairwise([0, *ends])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, nos, sizes, out = [], [], [], []
            for k, (p, at) in enumerate(zip(listed(b.column(1)), listed(b.column(2)), strict=True)):
                for no, seg in enumerate(cut(p, set(at), cap)):
                    who.append(k)
                    nos.append(no)
                    sizes.append(len(seg))
                    out += seg
            xy = np.array(out, float).reshape(-1, 2)
            points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["lon", "lat"])
            pts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), points)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(nos, pa.int32()), pts], names=["street_id", "seg_no", "pts"])

    return lines.select("street_id", "pts", "at").mapInArrow(run, f"street_id {kind}, seg_no int, pts {POINTS}")


def numbered(segments: DataFrame) -> DataFrame:
    """With the running index i in the order of street_id and seg_no.

    The segments are dealt into ranges of the order, each counted first; what stands before
    a range is summed over a row for each range.
    """
    spark = segments.sparkSession
    ranges = stored(segments.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "street_id", "seg_no").withColumn("range", F.spark_partition_id()), "segments")
    counts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    order = Window.partitionBy("range").orderBy("street_id", "seg_no")
    return ranges.join(before, "range").withColumn("i", F.col("before") + F.row_number().over(order) - 1).drop("range", "before")


def live(roads: DataFrame, classes: list[str], layer: str = "road|street|transport", zoom: float = 14) -> tuple[DataFrame, float]:
    """Distinct rendered roads of the classes and layers with two points at least, and the segment cap at the zoom."""
    own = roads.where(F.col("class").isin(classes) & F.col("layer").rlike(layer) & (F.size("pts") >= 2)).dropDuplicates(["class", "brunnel", "pts"])
    return own, 400.0 if zoom < 12 else 200.0


def tile_rows(access: DataFrame, highway: DataFrame) -> DataFrame:
    """(street_id, dist_m, over, minzoom): distances as tiles keep them. access: street_id, dist_m; highway: street_id, h."""
    zoom = lookup(MIN_ZOOM, F.coalesce("h", F.lit("")), OTHER_ZOOM)
    return access.join(highway, "street_id", "left").select("street_id", display.tile_distance(F.col("dist_m")).alias("dist_m"), F.when(F.col("dist_m") > display.MAX_DISTANCE_M, 1).alias("over"), zoom.cast("int").alias("minzoom"))


def wide(by_mode: DataFrame) -> DataFrame:
    """(street_id, one column for each mode): the long form as the sidecars have it."""
    return by_mode.groupBy("street_id").pivot("mode", [m for _, m, *_ in MODES]).agg(F.first("dist_m"))
