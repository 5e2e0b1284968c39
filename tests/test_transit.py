"""The numbers of the surveyed test suite, on its inline literals."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions import display, geo, text
from wayfare.operators import access, graph, nearest, ranges, schedule, stations, streets, viewport
from wayfare.operators import names as names_of
from wayfare.operators.tables import UNREACHABLE_MIN
from wayfare.plans import catalog
from wayfare.plans.synth import view
from wayfare.sources.curated import curated, rows

STATIONS = [
    ("a", "Alpha", "subway", -99.14, 19.43, "", "open"),
    ("b", "Bravo", "subway", -99.13, 19.43, "", "open"),
    ("c", "Central", "subway", -99.12, 19.43, "", "open"),
    ("c-brt", "Central", "brt", -99.1199, 19.4301, "", "open"),
    ("d", "Delta", "brt", -99.11, 19.43, "L1", "open"),
    ("future", "Future", "subway", -99.1, 19.43, "", "construction"),
]


@pytest.fixture(scope="module")
def nodes(spark):
    rows_ = [(i, k, n, m, x, y, r, s) for k, (i, n, m, x, y, r, s) in enumerate(STATIONS)]
    df = spark.createDataFrame(rows_, "id string, ord int, name string, mode string, lon double, lat double, route_ref string, status string")
    return df.withColumn("groups", text.route_groups(F.col("route_ref"), F.lit(""), F.lit("")))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_haversine(spark):
    assert abs(one(spark, geo.haversine(F.lit(-99.14), F.lit(19.43), F.lit(-99.13), F.lit(19.43)))[0] - 1050) < 30
    assert geo.haversine_py(-99.14, 19.43, -99.13, 19.43) == pytest.approx(1050, abs=30)


def test_time_scale(spark):
    for y, want in ((10, (10, 20, 40)), (45, (45, 90, 180)), (None, (15, 30, 60)), (500, (120, 240, 480)), (0.2, (1, 2, 4))):
        assert tuple(one(spark, *display.time_scale(F.lit(y).cast("double")))) == want


WINDOWS = [("a", None, 0, 300.0, 600.0, 10.0), ("a", "line-1/0", 0, 300.0, 600.0, 20.0), ("overnight", None, 6, 1440.0, 1740.0, 12.0)]


def test_waits(spark):
    w = spark.createDataFrame(WINDOWS, "station_id string, service_key string, weekday int, start_min double, end_min double, headway_min double")
    q = spark.createDataFrame([("a", 0, 360.0), ("a", 0, 280.0), ("overnight", 0, 60.0), ("missing", 0, 360.0)], "station_id string, weekday int, minute double")
    got = {(r.station_id, r.minute): (r.wait_min, r.scheduled) for r in schedule.station_wait(w, q).collect()}
    assert got == {("a", 360.0): (5.0, True), ("a", 280.0): (20.0, True), ("overnight", 60.0): (6.0, True), ("missing", 360.0): (4.0, False)}
    s = q.limit(1).withColumn("service_key", F.lit("line-1/0")).unionByName(q.limit(1).withColumn("service_key", F.lit("other")))
    got = {r.service_key: r.wait_min for r in schedule.service_wait(w, s).collect()}
    assert got == {"line-1/0": 10.0, "other": 5.0}


def street(spark, *lines):
    return spark.createDataFrame([(k, [{"lon": x, "lat": y} for x, y in pts]) for k, pts in enumerate(lines)], f"street_id long, pts {streets.POINTS}")


def test_nearest(spark, nodes):
    edges = street(spark, [(-99.1402, 19.4299), (-99.1402, 19.4301)])
    open_ = nodes.where("status = 'open'")
    got = access.nearest(edges, open_, 5).orderBy("rank").collect()
    assert [r.station_id for r in got[:2]] == ["a", "b"] and got[0].dist_m < 30 and len(got) == 5
    by_mode = {r["mode"]: r.station_id for r in access.nearest(edges, open_, 1, by_mode=True).collect()}
    assert by_mode == {"subway": "a", "brt": "c-brt"}
    assert access.nearest(edges, open_.limit(0), 5).count() == 0
    assert access.nearest(edges, open_, 5, per_range=2).orderBy("rank").collect() == got
    # what has no place doesn't count, and leaves the rest as it is
    odd = nodes.limit(3).select("id", (F.col("ord") + 50).alias("ord"), "name", "mode", F.lit(float("nan")).alias("lon"), F.when(F.col("ord") > 0, F.col("lat")).alias("lat"), "route_ref", "status", "groups")
    lines = edges.unionByName(street(spark, [(float("nan"), 19.43), (-99.14, 19.43)], [(-99.14, 19.43)]).withColumn("street_id", F.col("street_id") + 7))
    for n in (10_000, 2):
        assert access.nearest(lines, open_.unionByName(odd), 5, per_range=n).orderBy("rank").collect() == got
    broken = street(spark, [(-99.1402, 19.4299), (-99.1402, 19.4301), (float("nan"), 1.0), (-99.0, 19.0)])
    assert access.nearest(broken, open_, 5).orderBy("rank").collect() == got


def test_candidates(spark):
    """One range and many against all pairs, of streets near and far, lines of several edges, equal distances, and a place that many streets share."""
    rng = np.random.default_rng(2)
    places = rng.uniform((-99.3, 19.2), (-98.9, 19.6), (300, 2)).round(3)
    own = spark.createDataFrame([(k, 299 - k, ("subway", "brt", "monorail")[k % 3] if k != 7 else None, float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([places[:290], places[:10]]))], "id long, ord int, mode string, lon double, lat double")
    starts = np.concatenate([rng.uniform((-99.3, 19.2), (-98.9, 19.6), (390, 2)), [[-98.2, 19.4]] * 10])
    starts[100:180] = starts[100]
    lines = [[tuple(p + rng.uniform(-0.004, 0.004, 2)) for _ in range(rng.integers(2, 5))] for p in starts]
    edges = street(spark, *[[(float(x), float(y)) for x, y in line] for line in lines])
    got = access.candidates(edges, own, 3, 2)
    cells = access.candidates(edges, own, 3, 2, per_range=20)
    ref = own.agg({"lat": "avg"}).first()[0]
    xy = lambda p: np.array([geo.EARTH_RADIUS_M * np.radians(p[0]) * np.cos(np.radians(ref)), geo.EARTH_RADIUS_M * np.radians(p[1])])
    at = [(r.id, r.ord, r["mode"], *xy((r.lon, r.lat))) for r in own.collect()]
    want = set()
    for i, line in enumerate(lines):
        pts = np.array([xy(p) for p in line])
        far = nearest.squared(np.array([a[3] for a in at]), np.array([a[4] for a in at]), pts[:-1, 0], pts[:-1, 1], pts[1:, 0], pts[1:, 1]).min(0)
        order = sorted(range(len(at)), key=lambda c: (far[c], at[c][1]))
        for mode, n in ((None, 3), ("subway", 2), ("brt", 2), ("monorail", 2)):
            for rank, c in enumerate([c for c in order if mode is None or at[c][2] == mode][:n], 1):
                want.add((i, mode, rank, at[c][0], int(np.floor(np.sqrt(far[c]) + 0.5))))
    assert set(map(tuple, got.collect())) == want
    assert set(map(tuple, cells.collect())) == want


def test_streets_are_shuffled_once(spark, nodes):
    """No broadcast of stations, and the streets pass one exchange."""
    edges = street(spark, *[[(-99.14 + k / 1000, 19.42), (-99.14 + k / 1000, 19.43)] for k in range(30)])
    plans = []
    keep = nearest.stored
    nearest.stored = lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(df, name))[1]
    try:
        assert access.nearest(edges, nodes, 2, per_range=5).count() == 60
    finally:
        nearest.stored = keep
    plan = dict(plans)["nearest"]
    assert plan.count("Exchange") == 2 and "Broadcast" not in plan  # the streets' and the stations'


def test_neighbours(spark):
    """Links against all pairs, of lines, stations without a line and stations apart; the pairs looked at grow with the stations, not their square."""
    looked = {}
    for n in (200, 800):
        rng = np.random.default_rng(n)
        side = 0.02 * np.sqrt(n)
        rows_ = [(k, n - k, rng.choice(["subway", "brt", "regional_rail"]), float(rng.uniform(0, side) - 99), float(rng.uniform(0, side) + 19), [f"l{g}" for g in rng.choice(6, rng.integers(0, 3), replace=False)]) for k in range(n)]
        rows_.append((n, n, "brt", float("nan"), 19.0, []))
        own = spark.createDataFrame(rows_, "id int, ord int, mode string, lon double, lat double, groups array<string>")
        want = set()
        reach = {"subway": 3500.0, "brt": 2500.0, "regional_rail": 16000.0}
        for i, _, m, x, y, g in rows_[:-1]:
            near = [(d, o, j, h) for j, o, q, u, v, h in rows_[:-1] if q == m and j != i and 300 < (d := geo.haversine_py(x, y, u, v)) <= reach[m]]
            mine = [r for r in near if not g or not r[3] or set(g) & set(r[3])] or near
            want |= {(i, j, rank) for rank, (_, _, j, _) in enumerate(sorted(mine)[:3], 1)}
        assert {(r.src, r.dst, r["rank"]) for r in graph.ride_links(own).collect()} == want
        all_ = own.select("id", "ord", F.col("mode").alias("key"), "lon", "lat", F.lit(16000.0).alias("reach"))
        looked[n] = nearest.rings(all_, all_, 3, 300.0)[1]
    assert looked[800] < 6 * looked[200]


def test_crossing_roads(spark):
    own = street(spark, [(-99.14, 19.43), (-99.139, 19.43), (-99.138, 19.43)], [(-99.139, 19.429), (-99.139, 19.43), (-99.139, 19.431)])
    got = streets.split(own, streets.junctions(own), 200.0).orderBy("street_id", "seg_no").collect()
    assert [[(p.lon, p.lat) for p in r.pts] for r in got] == [[(-99.14, 19.43), (-99.139, 19.43)], [(-99.139, 19.43), (-99.138, 19.43)], [(-99.139, 19.429), (-99.139, 19.43)], [(-99.139, 19.43), (-99.139, 19.431)]]
    assert [r.i for r in streets.numbered(streets.split(own, streets.junctions(own))).orderBy("i").collect()] == [0, 1, 2, 3]


def test_length_cap():
    got = streets.cut([(-99.14, 19.43), (-99.13, 19.43)], set(), 200.0)
    assert len(got) >= 5
    assert all(sum(geo.haversine_py(*a, *b) for a, b in zip(s, s[1:], strict=False)) <= 200.1 for s in got)
    assert streets.cut([(1.0, 1.0), (1.0, 1.0)], set(), 200.0) == []
    assert len(streets.cut([(-99.14, 19.43), (-99.13, 19.43)], set(), float("inf"))) == 1


def times(spark, nodes, targets, **kw):
    dest = spark.createDataFrame([("x", t) for t in targets], "dest string, station_id string")
    return {r.station_id: r for r in graph.transit_times(dest, nodes, **kw).collect()}


def legs(spark, nodes, targets, **kw):
    dest = spark.createDataFrame([("x", t) for t in targets], "dest string, station_id string")
    out = {}
    for r in graph.routes(dest, nodes, **kw).orderBy("station_id", "leg_no").collect():
        out.setdefault(r.station_id, []).append(r)
    return out


@pytest.mark.parametrize("rows_", [graph.GRAPH_ROWS, 0])
def test_unscheduled_times(spark, nodes, rows_):
    """By a search and by joins."""
    own = nodes.where("status = 'open'")
    net = {"edges": graph.unscheduled_graph(own), "graph_rows": rows_}
    got = times(spark, own, ["d"], **net)
    assert got["d"].minutes == 0 and got["a"].minutes > got["c-brt"].minutes
    ways = legs(spark, own, ["d"], **net)
    assert sum(x.minutes for x in ways["a"]) == pytest.approx(got["a"].minutes) and "d" not in ways
    kinds = [x.type for x in ways["a"]]
    assert kinds[0] == "wait" and kinds.count("wait") == 1 and [x.leg_no for x in ways["a"]] == list(range(len(kinds)))
    # rides of one mode are one leg
    assert [(x.src, x.dst) for x in ways["a"] if x.type == "ride" and x["mode"] == "subway"] == [("a", "c")]
    assert times(spark, nodes, ["nowhere"], **net) == {}
    assert "future" in times(spark, nodes, ["d"], edges=graph.unscheduled_graph(nodes), graph_rows=rows_)


RIDES = [("a", "b", 5.0, "line-a/0"), ("b", "c", 5.0, "line-a/0"), ("b", "d", 4.0, "line-b/0")]
WAITS = [("a", "line-a/0", 2.0), ("b", "line-a/0", 2.0), ("b", "line-b/0", 7.0)]


@pytest.mark.parametrize("rows_", [graph.GRAPH_ROWS, 0])
def test_scheduled_times(spark, nodes, rows_):
    own = nodes.where("status = 'open'")
    rides = spark.createDataFrame(RIDES, "src string, dst string, minutes double, service_key string")
    waits = spark.createDataFrame(WAITS, "station_id string, service_key string, wait_min double")
    net = {"edges": spark.createDataFrame([], "src string, dst string, minutes double"), "rides": rides, "service_waits": waits, "graph_rows": rows_}
    got = times(spark, own, ["d"], **net)
    assert (got["d"].minutes, got["b"].minutes, got["a"].minutes, got["c"].minutes) == (0.0, 11.0, 18.0, UNREACHABLE_MIN)
    ways = legs(spark, own, ["d"], **net)
    assert got["a"].service_key == "line-a/0" and "c" not in ways
    assert [x.type for x in ways["a"]] == ["wait", "ride", "wait", "ride"] and sum(x.minutes for x in ways["a"]) == 18.0
    got, ways = times(spark, own, ["c", "d"], **net), legs(spark, own, ["c", "d"], **net)
    assert got["c"].minutes == got["d"].minutes == 0 and got["a"].minutes == 12.0
    assert [(x.type, x.src, x.dst) for x in ways["a"]] == [("wait", "a", "a"), ("ride", "a", "c")]
    # walks alone, on the same graph by joins
    walk = spark.createDataFrame([("a", "b", 2.0), ("b", "d", 3.0), ("a", "d", 9.0)], "src string, dst string, minutes double")
    best = graph.relax(spark.createDataFrame([("x", "d")], "dest string, node string"), walk)
    assert {r.node: r.minutes for r in best.collect()} == {"d": 0.0, "b": 3.0, "a": 5.0}


def test_search_and_joins_agree(spark):
    """On the network of the tables, for several destinations: times, what is boarded, and legs."""
    sf = "/root/testdata/sf0.001"
    net = catalog._scheduled(spark, sf, (0,)) | {"destinations": spark.createDataFrame([(1, 0), (1, 3), (2, 7)], "dest int, station_id long")}
    for what in (graph.transit_times, graph.routes):
        a, b = (sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in what(**net, graph_rows=n).collect()], key=str) for n in (graph.GRAPH_ROWS, 0))
        assert a == b and len(a) > 10


def test_best_access(spark):
    near = spark.createDataFrame([(1, "a", 20, 0), (1, "b", 80, 1)], "street_id long, station_id string, dist_m int, ord int")
    t = spark.createDataFrame([("a", 18.0), ("b", 11.0)], "station_id string, minutes double")
    r = access.best_access(near, t).first()
    assert (r.station_id, r.dist_m, r.total_min) == ("b", 80, 12.0)
    far = spark.createDataFrame([(1, "a", 100, 0), (1, "d", 500, 1), (1, None, 1, 2)], "street_id long, station_id string, dist_m int, ord int")
    assert access.best_access(far, spark.createDataFrame([("a", 30.0), ("d", 5.0)], "station_id string, minutes double")).first().station_id == "d"


def classified(spark, **tags):
    df = spark.createDataFrame([(tags,)], "tags map<string, string>")
    r = df.select(stations.classify().alias("mode"), stations.is_false_positive(stations.tag("name")).alias("bad"), stations.status(F.lit("2026-07-21").cast("date")).alias("s")).first()
    return r["mode"], r.bad, r.s.status


def test_classification(spark):
    assert classified(spark, name="Terminal de autobuses urbanos y suburbanos", amenity="bus_station")[0] == "excluded"
    assert classified(spark, name="Plaza Maguey", network="Metrobús")[:2] == ("brt", True)
    assert classified(spark, name="Lechería", network="Suburbano", railway="station")[0] == "commuter_rail"
    assert classified(spark, name="Cantil", network="Trolebús Línea 12", trolleybus="yes")[0] == "brt"
    assert classified(spark, name="X", network="Mexicable Línea 3")[2] == "future"
    assert classified(spark, name="X", opening_date="2026")[2] == "open" and classified(spark, name="X", opening_date="2026-08")[2] == "future"
    assert classified(spark, name="X", railway="prpopsed")[2] == "future" and classified(spark, name="X", railway="station")[2] == "open"


def test_reconcile(spark):
    assert len(rows()) == 66 and len({r[0] for r in rows()}) == 66
    per = {}
    for r in rows():
        per[r[9]] = per.get(r[9], 0) + 1
    assert per == {"AIFA": 7, "10": 12, "11": 15, "12": 32}
    own = curated(spark)
    old = own.where("name = 'Teotongo'").withColumn("id", F.lit("node/1")).withColumn("route_ref", F.lit(""))
    got = stations.reconcile(old, own)
    assert got.count() == 66 and stations.reconcile(got, own).count() == 66
    teotongo = got.where("name = 'Teotongo'").first()
    assert (round(teotongo.lon, 4), round(teotongo.lat, 4)) == (-98.9746, 19.3374)


def test_route_contexts_and_elements(spark):
    schema = "type string, id long, ord int, lon double, lat double, center struct<lon: double, lat: double>, tags map<string, string>, members array<struct<type: string, ref: long, role: string>>"
    df = spark.createDataFrame(
        [
            ("relation", 9, 0, None, None, None, {"network": "Metrobús", "ref": "4", "name": "Ruta 4"}, [("node", 1, "platform"), ("node", 2, "")]),
            ("node", 1, 1, -99.1, 19.4, None, {"name": "Uno"}, None),
            ("node", 2, 2, -99.2, 19.4, None, {"name": "Dos"}, None),
            ("way", 3, 3, None, None, (-99.3, 19.4), {"name": "Tres", "public_transport": "station", "station": "subway"}, None),
            ("node", 4, 4, -99.3, 19.4, None, {"name": "Tres", "public_transport": "station", "station": "subway", "railway": "construction"}, None),
        ],
        schema,
    )
    got = {r.id: r for r in stations.from_elements(df, F.lit("2026-07-21").cast("date")).collect()}
    assert set(got) == {"node/1", "way/3"}
    assert got["node/1"]["mode"] == "brt" and got["node/1"].route_ref == "4" and got["way/3"].ord == 3


def test_text(spark):
    assert one(spark, text.normalize(F.lit(" Estación Ñandú ")))[0] == "estacion nandu"
    assert one(spark, text.normalize_name(F.lit("Metro Línea 3 – Hidalgo Norte")))[0] == "3 hidalgo"
    match = lambda a, b: one(spark, text.names_match(F.lit(a), F.lit(b)))[0]
    assert match("Hidalgo", "Metro Hidalgo") and match("Santa Marta Norte", "Marta Santa") and not match("Norte", "Norte") and not match("Uno", "Dos")
    assert one(spark, text.gtfs_minutes(F.lit("25:10:30"), True), text.gtfs_minutes(F.lit("5:1:0"), True), text.gtfs_minutes(F.lit("5:1")), text.gtfs_weekday(F.lit("20240101")), text.service_key(F.lit("R"), F.lit("")), text.route_of_service(F.lit("a/R/0"))) == (1510.5, None, 301.0, 0, "R/0", "a/R")


def test_windows(spark):
    df = spark.createDataFrame([(k, float(m)) for k, ms in ((1, [300, 310, 320, 500, 510]), (2, [400]), (3, [10, 10])) for m in ms], "k int, minute double")
    got = {(r.k, r.start_min): (r.end_min, r.headway_min) for r in schedule.departure_windows(df, ["k"]).collect()}
    assert got == {(1, 300.0): (330.0, 10.0), (1, 500.0): (520.0, 10.0), (2, 400.0): (408.0, 8.0), (3, 10.0): (18.0, 8.0)}


def test_display(spark):
    assert one(spark, display.distance_color(F.lit(0)), display.distance_color(F.lit(9000)), display.time_color(F.lit(15), F.lit(15))) == ("#006837", "#7a001f", "#ffe34d")
    assert one(spark, display.tile_distance(F.lit(5001)), display.tile_distance(F.lit(37)), display.tile_distance(F.lit(38))) == (5001, 25, 50)
    assert one(spark, display.format_distance(F.lit(949.4)), display.format_distance(F.lit(950)), display.format_minutes(F.lit(7.2)), display.format_minutes(F.lit(12)), display.format_minutes(F.lit(121)), display.format_clock(F.lit(605))) == ("949 m", "1.0 km", "7 min", "10 min", "2 hr", "10:05")
    now = F.lit(dt.datetime(2024, 1, 1, 5, 30)).cast("timestamp")
    assert one(spark, *display.departure(now, "America/Mexico_City")) == (6, 23 * 60 + 30)


def test_distances_as_printf_has_them(spark):
    """Kilometres of all halves of a tenth, and of what stands beside them, as in the SQL of the table of a way."""
    metres = [m + d for m in range(950, 30_000, 100) for d in (-1, 0, 1) if m + d >= 950] + [1_234_450]
    got = {r.m: r.s for r in spark.createDataFrame([(m,) for m in metres], "m long").select("m", display.format_distance(F.col("m"), binary=True).alias("s")).collect()}
    assert got == {m: f"{m / 1000:.1f} km" for m in metres}


def test_complexes(spark, nodes):
    got = {r.station_id: r.complex_id for r in graph.complexes(nodes, spark.createDataFrame([("c", "c-brt"), ("c-brt", "d"), ("a", "gone")], "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "c-brt": "c", "d": "c"}


def test_route_rows(spark, nodes):
    """Waits go to the ride at first, then to the transfer; a change without a walk is a row too."""
    rows_ = [
        (0, "wait", "a", "a", "L/0", None, 2.0), (1, "ride", "a", "b", "L/0", "subway", 5.0), (2, "transfer", "b", "c", None, "subway", 1.0), (3, "transfer", "c", "c-brt", None, "subway", 2.0),
        (4, "wait", "c-brt", "c-brt", "M/1", None, 4.0), (5, "ride", "c-brt", "d", "M/1", "brt", 3.0), (6, "wait", "d", "d", "N/0", None, 1.0), (7, "ride", "d", "a", "N/0", None, 6.0), (8, "wait", "a", "a", None, None, 9.0),
    ]
    df = spark.createDataFrame([("x", "a", *r) for r in rows_], "dest string, station_id string, leg_no int, type string, src string, dst string, service_key string, mode string, minutes double")
    access_ = spark.createDataFrame([("a", 80)], "station_id string, dist_m int")
    services = spark.createDataFrame([("L", "subway", "1"), ("M", "brt", "")], "route_id string, mode string, name string")
    got = graph.route_rows(df, access_, nodes, services).orderBy("row_no").collect()
    assert [(r.label, r.detail, r.minutes) for r in got] == [
        ("Walk", "To Alpha · 80 m", 1.0), ("Metro 1", "Alpha → Bravo · 2 min wait", 7.0), ("Transfer", "Bravo → Central · to BRT · 4 min wait", 7.0), ("BRT", "Central → Delta", 3.0),
        ("Transfer", "At Delta · to Transit", 1.0), ("Transit", "Delta → Alpha", 6.0), ("Wait", "At Alpha", 9.0),
    ]


def test_all_names_are_matched(spark):
    """Against every pair, also of ids far apart, and where a name is within another."""
    names = ["Estación Chapultepec", "pulte", "Metro 1", "1", "ab", "xaby z", "La Raza Norte", "raza", "Villa del Sol Oriente", "sol villa", "metro_norte", "", None, "Pino Suárez", "SUAREZ pino", "12345", "345", "Chapultepec"]
    own = spark.createDataFrame([(1000 * k + 1, n) for k, n in enumerate(names)], "id long, name string")
    stops = spark.createDataFrame([(k, n) for k, n in enumerate(reversed(names))], "stop_id long, name string")
    every = own.crossJoin(stops.withColumnRenamed("name", "other"))
    want = {(r.id, r.stop_id) for r in every.where(text.names_match(F.col("name"), F.col("other"))).collect()}
    got = [tuple(r) for r in names_of.match_names(own, stops).collect()]
    assert set(got) == want and len(got) == len(want) > len(names)


def test_frequencies_of_all_orders(spark):
    """Every trip departs, and the calendar takes all orders."""
    sf = "/root/testdata/sf0.001"
    orders = view(spark, sf, "orders")
    assert catalog.QUERIES["frequency_expand"](spark, sf).select("trip_id").distinct().count() == orders.count()
    dates = orders.selectExpr("o_orderpriority", "o_orderkey % 12", "o_custkey % 5", "o_orderkey % 2").distinct().count()
    assert view(spark, sf, "all_calendar_dates").count() == dates
    same, every = (set(map(tuple, catalog.QUERIES[q](spark, sf).collect())) for q in ("service_weekdays", "service_weekdays_all"))
    assert same == every


def tangled(seed):
    """A network with walks and waits of no time, ties, and services that share stations."""
    rng = random.Random(seed)
    ids = [f"s{k}" for k in range(12)]
    walks = [(*rng.sample(ids, 2), rng.choice([0.0, 0.0, 0.35, 1.0, 4.0])) for _ in range(14)]
    rides = [(*rng.sample(ids, 2), rng.choice([0.5, 1.0, 2.0, 3.5]), f"line{rng.randrange(3)}/0") for _ in range(26)]
    waits = [(i, f"line{k}/0", rng.choice([0.0, 0.0, 1.0, 6.0])) for i in ids for k in range(3) if rng.random() < 0.7]
    return ids, walks, rides, waits


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_of_no_time(spark, seed):
    """Both forms find the same times, services and legs where walks and waits take none."""
    ids, walks, rides, waits = tangled(seed)
    own = spark.createDataFrame([(i, "subway") for i in ids], "id string, mode string")
    net = {
        "destinations": spark.createDataFrame([("x", "s0"), ("y", "s5"), ("y", "s7")], "dest string, station_id string"),
        "stations": own,
        "edges": spark.createDataFrame(walks, "src string, dst string, minutes double"),
        "rides": spark.createDataFrame(rides, "src string, dst string, minutes double, service_key string"),
        "service_waits": spark.createDataFrame(waits, "station_id string, service_key string, wait_min double"),
    }
    for what in (graph.transit_times, graph.routes):
        a, b = (sorted(map(tuple, what(**net, graph_rows=n).collect()), key=str) for n in (graph.GRAPH_ROWS, 0))
        assert a == b and len(a) > 20


def test_rounds_follow_buckets(spark):
    """A chain of many short steps takes a round for each bucket that it spans."""
    chain = spark.createDataFrame([(k + 1, k, 0.25) for k in range(64)] + [(100, 64, 50.0)], "src int, dst int, minutes double")
    got, rounds = graph.settled(spark.createDataFrame([("x", 0)], "dest string, node int"), chain, 4.0)
    found = {r.node: (r.cost / graph.QUANTA, r.hops) for r in got.collect()}
    assert found == {**{k: (k / 4, k) for k in range(65)}, 100: (66.0, 65)} and rounds == 6


def test_crowded_stations(spark):
    """Where all stations are next to each other shortcuts stay as many as the steps, and times and steps are the same as with all shortcuts; the driver takes few steps."""
    rng = random.Random(3)
    rows_ = [(a, b, rng.choice([0.0, 3.0, 3.5, 4.0, 9.0, 12.0])) for a in range(40) for b in range(40) if a != b and rng.random() < 0.8] + [(40 + k, 39 + k, 0.5) for k in range(30)]
    steps, dest = spark.createDataFrame(rows_, "src int, dst int, minutes double"), spark.createDataFrame([("x", 0), ("y", 7), ("y", 9)], "dest string, node int")
    cuts, whole = graph.shortcuts(steps.withColumn("cost", graph._cost("minutes")), 10 * graph.QUANTA, 5000)
    assert not whole and cuts.count() <= len(rows_)
    few, many = (sorted(map(tuple, graph.settled(dest, steps, most_cuts=n)[0].collect())) for n in (0, 10**9))
    assert few == many and len(few) == 2 * 70
    assert graph.GRAPH_ROWS <= 200_000


def test_walks_of_names(spark):
    """Walks are those of all pairs: of one name within 900 m, of others within the smaller or larger distance that is asked for."""
    rng = random.Random(4)
    rows_ = [(k, k, rng.choice(["Uno", "uno ", "Dos", "", None, f"n{k}"]), rng.uniform(-99.15, -99.13), rng.uniform(19.40, 19.42)) for k in range(120)]
    own = spark.createDataFrame(rows_, "id int, ord int, name string, lon double, lat double")
    pairs = own.toDF("a", "ao", "an", "ax", "ay").crossJoin(own.toDF("b", "bo", "bn", "bx", "by")).where("ao < bo").withColumn("m", geo.haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).collect()
    for close in (250.0, 1200.0):
        alike = lambda r: bool((r.an or "").strip()) and (r.an or "").strip().lower() == (r.bn or "").strip().lower() and r.m <= 900
        want = {(r.a, r.b): max(0.35, r.m / 80) if alike(r) else 3 + r.m / 80 for r in pairs if alike(r) or r.m <= close}
        got = graph.walking_links(own, close).collect()
        assert len(got) == len(want) > 100 and all(abs(want[r.src, r.dst] - r.minutes) < 1e-9 for r in got)


def test_pairs_meet_once(spark):
    """Pairs within reach are those of all pairs, each once, by ord, also on both sides of the zero lines and far north."""
    rng = random.Random(5)
    rows_ = [(k, rng.randrange(250), x + rng.uniform(-0.03, 0.03) * w, y + rng.uniform(-0.03, 0.03)) for k in range(300) for x, y, w in [rng.choice([(0.0, 0.0, 1), (-99.1, 19.4, 1), (20.0, 78.0, 4)])]]
    rows_ += [(300, 300, None, 0.0), (301, 301, float("nan"), 0.0), (302, 302, 0.01, None)]
    own = spark.createDataFrame(rows_, "id int, ord int, lon double, lat double")
    want = sorted((a[0], b[0]) for a in rows_[:300] for b in rows_[:300] if a[1] < b[1] and geo.haversine_py(a[2], a[3], b[2], b[3]) <= 900)
    assert sorted((r.a.id, r.b.id) for r in graph.near_pairs(own, 900.0).collect()) == want and len(want) > 300


def test_names_are_normalised_once(spark):
    """Names of stations and stops are normalised before they meet, not for each pair; names that are equal, lack or share words."""
    own = spark.createDataFrame([(1, 1, "Metro Niños Héroes", "subway", -99.1, 19.4), (2, 2, None, "subway", -99.1, 19.4), (3, 3, "Zócalo", "brt", -99.1, 19.4)], "id int, ord int, name string, mode string, lon double, lat double")
    stops = spark.createDataFrame([(7, "ninos heroes", "subway", -99.1, 19.401), (8, "Otra", "subway", -99.1, 19.4), (9, "Otra", "subway", -99.1, 19.41)], "stop_id int, name string, mode string, lon double, lat double")
    pairs = schedule.near_stops(own, stops)
    assert {(r.station_id, r.stop_id): r.matched for r in pairs.collect()} == {(1, 7): True, (1, 8): False, (2, 7): False, (2, 8): False}
    above = pairs._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "regexp_replace" not in above and "split" not in above


@pytest.fixture
def many_parts(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_keys(spark, many_parts):
    """Windows, headways and medians of keys that are dealt by ranges are those of keys in one task, and no range holds a hot key's rows."""
    rng = np.random.default_rng(5)
    rows_ = [("hot", 1, float(x)) for x in rng.integers(0, 300_000, 3000) / 100] + [("hot", 2, float(x)) for x in np.repeat(rng.integers(0, 90, 40), 30)]
    rows_ += [(f"k{k}", 1, float(x)) for k in range(30) for x in rng.integers(0, 2000, rng.integers(1, 12))] + [(None, 1, 5.0), ("k0", None, 5.0), ("k0", 1, None)]
    own = spark.createDataFrame(rows_, "stop string, day int, minute double")
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(schedule.departure_windows(own, ["stop", "day"], hot=60)) == key(schedule.departure_windows(own, ["stop", "day"]))
    for hot in (10, 10**6):
        got = {(r.stop, r.day): r.m for r in ranges.medians(own, ["stop", "day"], "minute", "m", hot).collect()}
        want = {k: float(np.median(x)) if x else None for k in {r[:2] for r in rows_} for x in [[r[2] for r in rows_ if r[:2] == k and r[2] is not None]]}
        assert got == want
    parts = ranges.dealt(own.where("stop = 'hot'"), ["stop", "day"], "minute").groupBy("stop", "day", "__part").count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 2000


def test_boxes(spark):
    """Counts of many boxes, thin and wide ones and such as hold nothing, are those of a filter each."""
    rng = np.random.default_rng(6)
    places = np.concatenate([rng.uniform((-1, -1), (1, 1), (700, 2)), rng.integers(-5, 6, (300, 2)) * 0.02])
    corners = np.concatenate([rng.uniform((-1.2, -1.2), (1, 1), (60, 2)), rng.integers(-5, 3, (30, 2)) * 0.02])
    sizes = np.concatenate([rng.choice([0.0, 0.01, 0.03, 0.3, 2.0], (60, 2)), rng.integers(0, 5, (30, 2)) * 0.02])
    box = [(k, float(x), float(y), float(x + w), float(y + h)) for k, ((x, y), (w, h)) in enumerate(zip(corners, sizes))] + [(900, 1.0, 1.0, -1.0, 2.0), (901, float("nan"), 0.0, 1.0, 1.0), (902, -1.0, None, 1.0, 1.0)]
    own = spark.createDataFrame([(float(x), float(y)) for x, y in places] + [(float("nan"), 0.0), (None, 0.0)], "lon double, lat double")
    got = {r.box_id: r.n for r in viewport.counts(own, spark.createDataFrame(box, "box_id int, west double, south double, east double, north double")).collect()}
    want = {k: sum(w <= x <= e and s <= y <= n for x, y in places) for k, w, s, e, n in box if k < 900} | {900: 0, 901: 0, 902: 0}
    assert got == want


@pytest.mark.parametrize("rows_", [graph.GRAPH_ROWS, 0])
def test_equal_ways_change(spark, rows_):
    """Of equal ways the one that leaves a service is taken, also if it has more steps; not where a wait for the service takes no time."""
    own = spark.createDataFrame([(k, k, "subway") for k in range(5)], "id long, ord int, mode string")
    rides = spark.createDataFrame([(1, 2, 3.0, "A"), (2, 3, 4.0, "A"), (2, 4, 1.0, "B"), (4, 3, 1.0, "B")], "src long, dst long, minutes double, service_key string")
    walk = spark.createDataFrame([(3, 0, 5.0)], "src long, dst long, minutes double")
    dest = spark.createDataFrame([(0, 0)], "dest int, station_id long")
    for wait, legs in ((4.0, [("wait", 1, 1), ("ride", 1, 2), ("wait", 2, 2), ("ride", 2, 3), ("transfer", 3, 0)]), (0.0, [("wait", 1, 1), ("ride", 1, 3), ("transfer", 3, 0)])):
        waits = spark.createDataFrame([(k, s, w) for k in range(1, 5) for s, w in (("A", wait), ("B", 2.0))], "station_id long, service_key string, wait_min double")
        got = graph.routes(dest, own, walk, service_waits=waits, rides=rides, graph_rows=rows_).where("station_id = 1").orderBy("leg_no").collect()
        assert [(r["type"], r["src"], r["dst"]) for r in got] == legs
