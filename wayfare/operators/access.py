"""What builds on the nearest stations of streets: masks, candidates, best access, colours, tile features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import display, geo
from wayfare.operators.nearest import PER_RANGE, candidates
from wayfare.operators.streets import MIN_ZOOM, OTHER_ZOOM, junctions, split
from wayfare.operators.tables import MODES, UNREACHABLE_MIN, lookup, small, stored

#: What the time map takes for a missing distance of one of the five nearest, and of a mode's nearest.
FAR_DIRECT_M, FAR_MODE_M = 7200, 5000


def nearest(streets: DataFrame, stations: DataFrame, k: int = 1, by_mode: bool = False, per_range: int = PER_RANGE) -> DataFrame:
    """(street_id[, mode], rank, station_id, dist_m): exactly the k nearest stations of each street, of each mode if by_mode. See candidates()."""
    return candidates(streets, stations, 0, k, per_range) if by_mode else candidates(streets, stations, k, 0, per_range).drop("mode")


def distance_histogram(distances: DataFrame) -> DataFrame:
    """One row: streets up to 500, 1000, 2500, 5000 m (each with those before), and beyond. distances: dist_m."""
    d = F.col("dist_m")
    return distances.agg(*(F.count_if(d <= m).alias(f"under_{m}") for m in (500, 1000, 2500, 5000)), F.count_if(d > 5000).alias("over_5000"), F.count(F.lit(1)).alias("streets"))


def proximity_masks(by_mode: DataFrame, streets: DataFrame, near_m: int = 2500) -> DataFrame:
    """(mask, streets): streets by the set of modes within near_m, bit by mode order. by_mode: street_id, mode, dist_m."""
    bits = F.create_map(*[F.lit(x) for b, m, *_ in MODES for x in (m, 1 << b)])
    masks = by_mode.where(F.col("dist_m") <= near_m).groupBy("street_id").agg(F.bit_or(F.try_element_at(bits, F.col("mode"))).alias("mask"))
    every = streets.select("street_id").distinct().join(masks, "street_id", "left")
    return every.groupBy(F.coalesce("mask", F.lit(0)).alias("mask")).agg(F.count(F.lit(1)).alias("streets"))


def subset_near_counts(masks: DataFrame) -> DataFrame:
    """(selection, near): for each of the 128 selections of modes, streets near any of them. masks: at most 128 rows."""
    spark = masks.sparkSession
    picks = spark.range(1 << len(MODES)).select(F.col("id").cast("int").alias("pick"))
    names = F.array_join(F.filter(F.array(*[F.when(F.col("pick").bitwiseAND(1 << b) != 0, F.lit(m)) for b, m, *_ in MODES]), lambda x: x.isNotNull()), ",")
    hits = picks.join(F.broadcast(masks), F.col("pick").bitwiseAND(F.col("mask")) != 0, "left")
    return hits.groupBy("pick").agg(F.coalesce(F.sum("streets"), F.lit(0)).alias("near")).select(names.alias("selection"), "near")


def active_distance(by_mode: DataFrame, streets: DataFrame, active: list[str], most: int = 5000, future: DataFrame | None = None) -> DataFrame:
    """(street_id, dist_m): the least distance to the active modes; over-range ones count as most + 1, none as most.

    by_mode: the nearest open station of each mode; future: the nearest of those that aren't open, where they count too.
    """
    d = F.when(F.col("dist_m") > most, most + 1).otherwise(F.col("dist_m"))
    found = by_mode.select("street_id", "mode", "dist_m")
    found = found if future is None else found.unionByName(future.select("street_id", "mode", "dist_m"))
    rows = found.where(F.col("mode").isin(active) if active else F.lit(False)).groupBy("street_id").agg(F.min(d).alias("dist_m"))
    return streets.select("street_id").distinct().join(rows, "street_id", "left").select("street_id", F.coalesce("dist_m", F.lit(most)).cast("int").alias("dist_m"))


def street_features(streets: DataFrame, stations: DataFrame, most: int = 5000) -> DataFrame:
    """(street_id, pool, mode, dist_m, station_ord): the nearest open and the nearest future station of each mode that the pool has.

    stations: id, ord, mode, lon, lat, status. Beyond ``most`` metres dist_m is most + 1 and station_ord -1.
    """
    out = []
    for pool, which in (("open", F.col("status") == "open"), ("future", F.col("status") != "open")):
        own = stations.where(which)
        found = nearest(streets, own, 1, by_mode=True).join(own.select(F.col("id").alias("station_id"), F.col("ord").cast("int").alias("ord")), "station_id")
        over = F.col("dist_m") > most
        out.append(found.select("street_id", F.lit(pool).alias("pool"), "mode", F.when(over, most + 1).otherwise(F.col("dist_m")).alias("dist_m"), F.when(over, -1).otherwise(F.col("ord")).alias("station_ord")))
    return out[0].unionByName(out[1])


def tile_segments(streets: DataFrame, max_length_m: float = 200.0) -> DataFrame:
    """(street_id, seg_no, pts), stored: streets (street_id, pts) cut at junctions and at max_length_m."""
    return stored(split(streets, junctions(streets), max_length_m), "segments")


def segment_features(segments: DataFrame, stations: DataFrame, most: int = 5000) -> DataFrame:
    """street_features() of segments, whose street_id is (street_id, seg_no), with nearest, the least distance to an open station."""
    found = street_features(segments.select(F.struct("street_id", "seg_no").alias("street_id"), "pts"), stations, most)
    return found.withColumn("nearest", F.min(F.when(F.col("pool") == "open", F.col("dist_m"))).over(Window.partitionBy("street_id")))


def tile_features(streets: DataFrame, stations: DataFrame, max_length_m: float = 200.0, most: int = 5000) -> DataFrame:
    """(street_id, seg_no, pool, mode, dist_m, station_ord, nearest_m, over, minzoom): streets as tiles have them.

    Streets (street_id, pts, h) are cut at junctions and at max_length_m; each segment has the nearest open and
    future station of each mode, distances to 25 m, most + 1 beyond. nearest_m: the least to an open
    station, over: 1 where that is beyond; minzoom: the first zoom of the road's class.
    """
    found = segment_features(tile_segments(streets, max_length_m), stations, most)
    rows = found.select("street_id.*", "pool", "mode", display.tile_distance(F.col("dist_m"), most=most).alias("dist_m"), "station_ord", display.tile_distance(F.col("nearest"), most=most).alias("nearest_m"), F.when(F.col("nearest") > most, 1).alias("over"))
    zoom = lookup(MIN_ZOOM, F.coalesce("h", F.lit("")), OTHER_ZOOM).cast("int").alias("minzoom")
    return rows.join(streets.select("street_id", zoom).distinct(), "street_id").select("street_id", "seg_no", "pool", "mode", "dist_m", "station_ord", "nearest_m", "over", "minzoom")


def tile_statistics(segments: DataFrame, stations: DataFrame, most: int = 5000) -> DataFrame:
    """(kind, key, n): what the metadata of tiles has of their segments, before distances are rounded.

    histogram: segments within each distance of an open station, and beyond (over_5000); near: segments within 2,500 m of any of a
    selection's modes, for each selection; count: segments, source_streets. segments: tile_segments().
    """
    found = segment_features(segments, stations, most).where("pool = 'open'")
    nearest_ = segments.select(F.struct("street_id", "seg_no").alias("street_id")).join(found.groupBy("street_id").agg(F.min("dist_m").alias("dist_m")), "street_id", "left").withColumn("dist_m", F.coalesce("dist_m", F.lit(most + 1)))
    bars = distance_histogram(nearest_).select(F.explode(F.create_map(*[x for c in ("under_500", "under_1000", "under_2500", "under_5000", "over_5000") for x in (F.lit(c), F.col(c))])).alias("key", "n"))
    near = subset_near_counts(proximity_masks(found, nearest_)).select(F.lit("near").alias("kind"), F.col("selection").alias("key"), F.col("near").alias("n"))
    counts = segments.agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("street_id").alias("source_streets")).select(F.explode(F.create_map(F.lit("segments"), F.col("segments"), F.lit("source_streets"), F.col("source_streets"))).alias("key", "n"))
    return bars.select(F.lit("histogram").alias("kind"), "key", "n").unionByName(near).unionByName(counts.select(F.lit("count").alias("kind"), "key", "n"))


def included(stations: DataFrame, include_future: bool = False) -> DataFrame:
    """Open stations, and all with include_future."""
    return stations if include_future else stations.where("status = 'open'")


def street_candidates(streets: DataFrame, stations: DataFrame, active: list[str], include_future: bool = False, most: int = 5000) -> DataFrame:
    """(street_id, station_id, mode, dist_m, ord): what a street can reach: its five nearest open stations as far as their modes are
    active, the nearest open station of each active mode, and with include_future the nearest future ones.

    A mode's nearest beyond ``most`` metres is taken at most + 1. ord: the order of equal candidates. stations: id, ord, mode, lon, lat, status.
    """
    if not active:
        return candidates(streets, stations, 1, 0).limit(0).select("street_id", "station_id", "mode", "dist_m", F.col("rank").alias("ord"))
    bit = F.try_element_at(F.create_map(*[F.lit(x) for b, m, *_ in MODES for x in (m, b)]), F.col("mode"))
    own = stations.where("status = 'open'")
    found = candidates(streets, own, 5, 1)
    modes = own.select(F.col("id").alias("station_id"), F.col("mode").alias("own"))
    capped = F.when(F.col("dist_m") > most, most + 1).otherwise(F.col("dist_m")).alias("dist_m")
    rows = found.join(modes, "station_id").where(F.col("own").isin(active))
    rows = rows.select("street_id", "station_id", F.col("own").alias("mode"), F.when(F.col("mode").isNull(), F.col("dist_m")).otherwise(capped).alias("dist_m"), F.when(F.col("mode").isNull(), F.col("rank")).otherwise(10 + bit).cast("int").alias("ord"))
    if include_future:
        later = nearest(streets, stations.where("status <> 'open'"), 1, by_mode=True).where(F.col("mode").isin(active))
        rows = rows.unionByName(later.select("street_id", "station_id", "mode", capped, (20 + bit).cast("int").alias("ord")))
    return rows


def active_times(times: DataFrame, stations: DataFrame, active: list[str]) -> DataFrame:
    """(station_id, minutes): times (station_id, minutes), 90 for stations (id, mode) whose mode isn't active."""
    modes = stations.select(F.col("id").alias("station_id"), "mode")
    on = F.col("mode").isin(active) if active else F.lit(False)
    return times.join(modes, "station_id", "left").select("station_id", F.when(F.coalesce(on, F.lit(False)), F.col("minutes")).otherwise(UNREACHABLE_MIN).alias("minutes"))


def time_colors(streets: DataFrame, stations: DataFrame, times: DataFrame, active: list[str], yellow: int = display.DEFAULT_YELLOW_MIN, most: int = 5000) -> DataFrame:
    """(street_id, total_min, color): the least walk and ride of a street, as the time map has it, and its colour.

    Of the five nearest open stations all count, whatever their mode, and a missing one as 7,200 m away; of each
    active mode the nearest counts, at 5,000 m without one. Minutes have two decimals, 90 where a station has none.
    """
    own = stations.where("status = 'open'")
    minutes = times.select("station_id", (F.floor(F.col("minutes") * 100 + 0.5) / 100).alias("minutes"))
    found = candidates(streets, own, 5, 1).where(F.col("mode").isNull() | (F.col("mode").isin(active) if active else F.lit(False)))
    metres = F.when(F.col("mode").isNotNull() & (F.col("dist_m") > most), most + 1).otherwise(F.col("dist_m"))
    rows = found.join(small(minutes), "station_id", "left").withColumn("total", geo.walking_minutes(metres.cast("double")) + F.coalesce("minutes", F.lit(UNREACHABLE_MIN)))
    per = rows.groupBy("street_id").agg(F.min("total").alias("total"), F.count_if(F.col("mode").isNull()).alias("direct"), F.count_if(F.col("mode").isNotNull()).alias("modes"))
    absent = lambda short, far: F.when(short, F.lit(far / geo.WALKING_M_PER_MIN + UNREACHABLE_MIN))
    total = F.least("total", absent(F.col("direct") < 5, FAR_DIRECT_M), absent(F.col("modes") < len(set(active)), FAR_MODE_M))
    return per.select("street_id", total.alias("total_min"), display.time_color(total, F.lit(yellow)).alias("color"))


def rendered_once(features: DataFrame) -> DataFrame:
    """Of features (i, feature_id, ord and others) that share their index i, or without one their feature_id, the first by ord; those with neither don't count."""
    key = F.coalesce(F.concat(F.lit("i"), F.col("i").cast("string")), F.concat(F.lit("f"), F.col("feature_id").cast("string")))
    whole = F.struct(*features.columns)
    return features.withColumn("__key", key).where("__key is not null").groupBy("__key").agg(F.min_by(whole, "ord").alias("__first")).select("__first.*")


def best_access(candidates: DataFrame, times: DataFrame) -> DataFrame:
    """(street_id, station_id, dist_m, walk_min, transit_min, total_min): the candidate with the least walk and transit.

    candidates: street_id, station_id, dist_m, ord; times: station_id, minutes; a
    station without a time takes 90 minutes. Equal totals go to the smaller ord.
    """
    rows = candidates.where(F.col("station_id").isNotNull() & F.col("dist_m").isNotNull()).join(small(times.select("station_id", "minutes")), "station_id", "left")
    walk, transit = geo.walking_minutes(F.col("dist_m").cast("double")), F.coalesce("minutes", F.lit(UNREACHABLE_MIN))
    rows = rows.select("street_id", "ord", F.struct("station_id", "dist_m", walk.alias("walk_min"), transit.alias("transit_min"), (walk + transit).alias("total_min")).alias("best"))
    return rows.groupBy("street_id").agg(F.min_by("best", F.struct(F.col("best.total_min"), F.col("ord"))).alias("best")).select("street_id", "best.*")


def viewport_counts(stations: DataFrame, street_totals: DataFrame, box: tuple[float, float, float, float], orange_min: float) -> DataFrame:
    """One row: open stations in the box (west, south, east, north), distinct streets, and those within orange_min. street_totals: street_id, total_min."""
    west, south, east, north = box
    inside = stations.where((F.col("status") == "open") & F.col("lon").between(west, east) & F.col("lat").between(south, north)).agg(F.count(F.lit(1)).alias("stations"))
    once = street_totals.groupBy("street_id").agg(F.min("total_min").alias("total_min"))
    streets = once.agg(F.count(F.lit(1)).alias("streets"), F.count_if(F.col("total_min") <= orange_min).alias("near"))
    return inside.crossJoin(streets)
