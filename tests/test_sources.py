from __future__ import annotations

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import schedule
from wayfare.sources import geojson, gtfs, json_ranges, sidecars, tile_archive
from wayfare.streaming import departures


def test_gtfs(spark, tmp_path):
    stops = 'stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station\np,"Big ""A"", hall",19.4,-99.1,1,\nq,Platform,19.4,-99.1,0,p\nr,Door,19.4,-99.1,2,\ns,Alone,19.5,-99.2,,\nt,Bad,x,-99.2,,\n'
    (tmp_path / "stops.txt").write_text(stops)
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("stops.txt", stops)
    table = gtfs.read_table(spark, str(tmp_path), "stops")
    assert table.count() == 5 and table.first().stop_name == 'Big "A", hall' and table.first().stop_code == ""
    assert gtfs.read_zip(spark, str(tmp_path / "feed.zip"), "stops").collect() == table.collect()
    assert gtfs.read_zip(spark, str(tmp_path / "feed.zip"), "transfers").count() == 0
    (tmp_path / "routes.txt").write_text('route_id,route_desc\n1,"two\nlines"\n2,x\n')
    assert [(r.route_id, r.route_desc) for r in gtfs.read_table(spark, str(tmp_path), "routes").collect()] == [("1", "two\nlines"), ("2", "x")]
    rows = gtfs.stop_rows(table)
    assert sorted(r.stop_id for r in rows.collect()) == ["p", "s"]
    assert {r.stop_id: r.station_id for r in gtfs.station_of_stop(table, rows).collect()}["q"] == "p"


def test_transfers(spark):
    t = spark.createDataFrame([("q", "s", "2", "120"), ("q", "s", "0", ""), ("s", "q", "3", "60"), ("q", "q", "0", "60")], "from_stop_id string, to_stop_id string, transfer_type string, min_transfer_time string")
    m = spark.createDataFrame([("q", "A"), ("s", "B")], "stop_id string, station_id string")
    assert [tuple(r) for r in schedule.published_transfers(t, m).collect()] == [("A", "B", 2.0)]


def test_geojson(spark, tmp_path):
    doc = {"features": [{"geometry": {"type": "LineString", "coordinates": [[-99.1, 19.4], [-99.2, 19.5]]}, "properties": {"h": "primary", "n": "Uno"}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    lines = geojson.read_features(spark, str(tmp_path / "a.json"), "h string, n string", line=True)
    assert lines.first().pts[1].lon == -99.2 and geojson.as_elements(lines, ["h", "n"]).first().tags["h"] == "primary"
    geojson.write_features(lines, str(tmp_path / "out"), ["h", "n"], line=True)
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["geometry"]["coordinates"][0] == [-99.1, 19.4]
    for n, some in ((1, lines), (2, lines.unionByName(lines))):
        geojson.write_collection(some, str(tmp_path / f"c{n}"), ["h", "n"], line=True)
        whole = json.loads("".join(r[0] for r in spark.read.text(str(tmp_path / f"c{n}")).collect()))
        assert whole["type"] == "FeatureCollection" and [f["properties"]["n"] for f in whole["features"]] == ["Uno"] * n
    geojson.write_tiles(lines.withColumn("minzoom", F.lit(10)), str(tmp_path / "tiles"))
    assert geojson.read_tiles(spark, str(tmp_path / "tiles"), 12, -99.2, 19.3, -99.0, 19.5).count() == 1
    assert geojson.read_tiles(spark, str(tmp_path / "tiles"), 9, -99.2, 19.3, -99.0, 19.5).count() == 0


def test_elements(spark, tmp_path):
    for k, name in enumerate(("Old", "New")):
        (tmp_path / f"{k}.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lon": 1.0, "lat": 2.0, "tags": {"name": name}}]}))
    rows = geojson.read_elements(spark, [str(tmp_path / "0.json"), str(tmp_path / "1.json")]).collect()
    assert len(rows) == 1 and rows[0].tags["name"] == "New"


def test_metadata(spark):
    df = lambda m, s: spark.createDataFrame([(m, s)], "meta map<string, string>, sources array<string>")
    r = geojson.merged_metadata(df({"a": "1", "b": "2"}, ["x"]), df({"b": "3"}, ["x", "y"])).first()
    assert r.meta == {"a": "1", "b": "3"} and r.sources == ["x", "y"]


def test_stream(spark, tmp_path):
    events = spark.sql("select id, timestamp'2024-01-01 08:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int) * 10) as ts, id % 2 as user_id from range(12)")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = departures.start(departures.departures_of(stream), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    assert any(p.name.startswith("bucket=") for p in (tmp_path / "store").glob("batch=*/*"))
    got = departures.latest(spark, str(tmp_path / "out")).orderBy("user_id").collect()
    assert [(r.user_id, r.start_min, r.headway_min) for r in got] == [(0, 480.0, 20.0), (1, 490.0, 20.0)]


def test_modes(spark):
    routes = spark.createDataFrame([("1", "METRO", "1", "", "1", "d"), ("2", "TROLE", "10", "", "3", ""), ("3", "TROLE", "4", "Long", "0", ""), ("4", "X", "", "", "900", "")], "route_id string, agency_id string, route_short_name string, route_long_name string, route_type string, route_desc string")
    assert [r["mode"] for r in gtfs.agency_mode(routes).orderBy("route_id").collect()] == ["subway", "brt", None, None]
    trips = spark.createDataFrame([("t1", "1"), ("t3", "3"), ("t4", "4")], "trip_id string, route_id string")
    times = spark.createDataFrame([("t1", "A"), ("t3", "A"), ("t4", "B")], "trip_id string, stop_id string")
    assert {r.stop_id: r["mode"] for r in gtfs.stop_modes(routes, trips, times).collect()} == {"A": "commuter_rail", "B": "light_rail"}
    meta = {r.route_id: (r["mode"], r.name) for r in gtfs.route_metadata(routes, "f", "Feed").collect()}
    assert meta["f/3"] == ("light_rail", "4") and meta["f/4"] == ("commuter_rail", "4")


def test_metro_box(spark):
    s = spark.createDataFrame([("a", -74.0, 40.7), ("b", -73.9, 41.9), ("c", -70.0, 40.7)], "id string, lon double, lat double")
    e = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    own, edges = gtfs.in_metro(s, e)
    assert own.count() == 2 and [tuple(r) for r in edges.collect()] == [("a", "b")]


def tricky(rng):
    return "".join(rng.choice(['a', 'é', '"', "\\", "{", "}", "[", "]", '"features":[{', "\n", ","]) for _ in range(rng.randint(0, 20)))


@pytest.mark.parametrize("range_bytes", [61, 300, 1 << 20])
def test_file_in_ranges(spark, tmp_path, range_bytes):
    """Objects with quotes, escapes and brackets in their strings, at any cut, by several tasks; other arrays and nested keys of the name don't count."""
    rng = random.Random(range_bytes)
    rows = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [k / 7, -k]}, "properties": {"n": tricky(rng), "features": [{"x": tricky(rng)}]}} for k in range(30)]
    doc = {"meta": {"features": [{"n": 1}], "s": tricky(rng)}, "other": [{"a": 1}], "features": rows, "after": [{"b": tricky(rng)}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, ensure_ascii=bool(range_bytes % 2)))
    got = json_ranges.objects_of(spark, str(tmp_path / "a.json"), "features", range_bytes)
    assert [json.loads(r.value) for r in got.orderBy("pos").collect()] == rows and [r.pos for r in got.orderBy("pos").collect()] == list(range(30))
    assert (got.rdd.getNumPartitions() > 10) == (range_bytes == 61)
    points = geojson.read_features(spark, str(tmp_path / "a.json"), "n string", range_bytes=range_bytes)
    assert [(r.ord, r.n, r.lon, r.lat) for r in points.orderBy("ord").collect()] == [(k, f["properties"]["n"], *f["geometry"]["coordinates"]) for k, f in enumerate(rows)]
    for text in ('{"features": []}', "{}", "", '{"x": "\\"features\\": ["}'):
        (tmp_path / "b.json").write_text(text)
        assert json_ranges.objects_of(spark, str(tmp_path / "b.json"), "features", range_bytes).count() == 0


def test_tile_archive(spark, tmp_path):
    """A viewport gives what a filter over all rows gives, and reads few of the bytes."""
    rng = random.Random(4)
    rows = [(k, rng.choice([8, 10, 13, 14]), rng.uniform(-99.6, -98.6), rng.uniform(19.0, 20.0), "n" * rng.randint(0, 9)) for k in range(20_000)]
    own = spark.createDataFrame([*rows, (-1, 10, float("nan"), 19.0, ""), (-2, 10, None, 19.0, ""), (-3, None, -99.0, 19.0, ""), (-4, 10, -200.0, 19.0, "")], "id long, minzoom int, lon double, lat double, name string")
    path = str(tmp_path / "tiles")
    tile_archive.write(own, path, tasks=3)
    every = tile_archive.read(spark, path)
    assert sorted(tuple(r)[:5] for r in every.collect()) == sorted(rows)
    for zoom, box in ((10, (-99.2, 19.3, -99.1, 19.4)), (14, (-98.9, 19.9, -98.61, 20.3)), (7, (-99.2, 19.3, -99.1, 19.4))):
        found = tile_archive.viewport(spark, path, zoom, *box)
        cell = lambda x: int(x // tile_archive.DEGREES)
        want = {r[0] for r in rows if r[1] <= zoom and cell(box[0]) <= cell(r[2]) <= cell(box[2]) and cell(box[1]) <= cell(r[3]) <= cell(box[3])}
        assert {r.id for r in found.collect()} == want

    class Counting:
        def __init__(self, f):
            self.f, self.bytes = f, 0

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read(self, n):
            self.bytes += n
            return self.f.read(n)

    reader = tile_archive.Reader(path)
    names = [("minzoom", tile_archive.LessThanOrEqual, 10), ("cx", tile_archive.GreaterThanOrEqual, -1984), ("cx", tile_archive.LessThanOrEqual, -1982), ("cy", tile_archive.EqualTo, 387)]
    list(reader.pushFilters([kind((name,), v) for name, kind, v in names]))
    read = 0
    for piece in reader.partitions():
        with tile_archive.opened(f"{path}/{piece.name}")[0].open_input_file(f"{path}/{piece.name}") as f:
            counting = Counting(f)
            list(tile_archive.entries_of(counting, piece.ranges))
            read += counting.bytes
    size = sum(p.stat().st_size for p in (tmp_path / "tiles").glob("*.tiles"))
    assert 0 < read < size / 4


def test_archive_of_nothing(spark, tmp_path):
    tile_archive.write(spark.createDataFrame([], "id long, minzoom int, lon double, lat double"), str(tmp_path / "t"))
    assert tile_archive.read(spark, str(tmp_path / "t")).count() == 0


def test_sidecars(spark, tmp_path):
    """Columns by place, read back whole and in stretches that cut blocks; places without a value stay without."""
    rng = random.Random(9)
    rows = [(k, pool, mode, rng.choice([0, 25, 25, 5001, rng.randrange(5000)]), rng.choice([-1, 3, 3, 70])) for k in range(500) for pool in ("open", "future") for mode in ("subway", "brt") if rng.random() < 0.8 and not (pool == "future" and mode == "brt")]
    features = spark.createDataFrame([(f"s{k}", *r) for k, *r in rows], "street_id string, pool string, mode string, dist_m int, station_ord int")
    numbers = spark.createDataFrame([(f"s{k}", k) for k in range(500)], "street_id string, i long")
    sidecars.write(features, numbers, str(tmp_path / "s"), block=64)
    assert sorted(map(tuple, sidecars.read(spark, str(tmp_path / "s")).collect())) == sorted(rows)
    for low, high in ((0, 1), (63, 65), (100, 400), (499, 600)):
        got = sidecars.read(spark, str(tmp_path / "s"), low, high, ["subway"])
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if low <= r[0] < high and r[2] == "subway")
    for values in ([], [5], [7, 7, 7], [0, -1, 5001, 5001, -(1 << 31)], list(range(300))):
        assert sidecars.decoded(sidecars.coded(np.array(values, np.int64))).tolist() == values
