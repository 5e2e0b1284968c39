"""Exact nearest searches without a broadcast of what is searched.

Streets and stations are dealt by ranges of a curve through the cells of a grid, so a task
holds streets that lie together and the stations of the same range, in k-d trees. What a street
finds there bounds how far away its nearest can be; only if that reaches into the
box of another range's stations, the street is sent there in a second pass. Of other
ranges a task knows their boxes and counts, ``MOST_RANGES`` at most.

Neighbours among stations themselves are found by rings: a station looks into
cells of a radius, which doubles only for stations that haven't found enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayfare.functions import geo
from wayfare.operators.tables import drop, stored

#: Metres of a cell; streets and stations of a range on average; ranges.
CELL_M, PER_RANGE, MOST_RANGES = 50.0, 10_000, 1024
#: Streets that are searched together, at first; points of a leaf; edges and points whose distances are held at once.
TOGETHER, LEAF, EDGES, WIDE = 128, 32, 2048, 1024
FIRST_RING_M = 500.0
POINTS = pa.list_(pa.field("element", pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def curve(x: Column, y: Column, cell: float = CELL_M) -> Column:
    """The place of a point's cell on the Z curve: 21 bits of either axis in turns."""

    def spread(v: Column) -> Column:
        v = F.least(F.greatest(F.floor(v / cell) + F.lit(1 << 20), F.lit(0)), F.lit((1 << 21) - 1)).cast("long")
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


class Tree:
    """Points in leaves of neighbouring ones, each with its box."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        leaves, todo = [], [np.arange(len(x))] if len(x) else []
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            by = x if np.ptp(x[own]) > np.ptp(y[own]) else y
            halves = own[np.argpartition(by[own], len(own) // 2)]
            todo += [halves[: len(own) // 2], halves[len(own) // 2 :]]
        self.leaves = leaves
        box = lambda f, c: np.array([f(c[leaf]) for leaf in leaves])
        self.box = box(np.min, x), box(np.min, y), box(np.max, x), box(np.max, y)
        self.sizes = np.array([len(leaf) for leaf in leaves], np.int64)

    def near(self, cx: float, cy: float, k: int, half: float) -> tuple[np.ndarray, float]:
        """The points that may be among the k nearest of a line whose points are within half of the centre, in order; and how far the k-th is from the centre.

        The line's k-th is at most as far as the centre's and half, and whatever is further from the centre by half again can't be.
        """
        if not len(self.leaves):
            return np.zeros(0, np.int64), np.inf
        x1, y1, x2, y2 = self.box
        least = np.hypot(np.maximum(0, np.maximum(x1 - cx, cx - x2)), np.maximum(0, np.maximum(y1 - cy, cy - y2)))
        order = np.argsort(least, kind="stable")
        far = lambda which: np.hypot(self.x[which] - cx, self.y[which] - cy)
        reach = np.inf
        if self.sizes.sum() > k:
            enough = int(np.searchsorted(np.cumsum(self.sizes[order]), k)) + 1
            some = far(np.concatenate([self.leaves[leaf] for leaf in order[:enough]]))
            upper = np.partition(some, k - 1)[k - 1]
            some = far(np.concatenate([self.leaves[leaf] for leaf in order[least[order] <= upper]]))
            reach = float(np.partition(some, k - 1)[k - 1])
        there = np.concatenate([self.leaves[leaf] for leaf in np.flatnonzero(least <= reach + 2 * half + 1e-3)])
        return np.sort(there[far(there) <= reach + 2 * half + 1e-3]), reach


def squared(px: np.ndarray, py: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """geo.point_to_segment_squared() of every segment (a row) and point (a column)."""
    x1, y1, dx, dy = x1[:, None], y1[:, None], (x2 - x1)[:, None], (y2 - y1)[:, None]
    length = dx * dx + dy * dy
    t = np.where(length > 0, np.clip(((px - x1) * dx + (py - y1) * dy) / np.where(length > 0, length, 1.0), 0.0, 1.0), 0.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


class Lines:
    """Streets as edges with two places, in the order of their rows; edges without places are left out."""

    def __init__(self, pts: pa.ListArray):
        count = pc.list_value_length(pts).fill_null(0).to_numpy().astype(np.int64)
        flat = pts.flatten()
        x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        owner = np.repeat(np.arange(len(count)), count)
        a = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
        edges = np.stack([x[a], y[a], x[a + 1], y[a + 1]])
        fine = np.isfinite(edges).all(0)
        self.x1, self.y1, self.x2, self.y2 = edges[:, fine]
        self.begin = np.searchsorted(owner[a][fine], np.arange(len(count) + 1))

    def box(self, which: np.ndarray) -> np.ndarray:
        """Of each street x1, y1, x2, y2."""
        e, first = self.edges(which)
        return np.stack([np.minimum.reduceat(np.minimum(self.x1[e], self.x2[e]), first), np.minimum.reduceat(np.minimum(self.y1[e], self.y2[e]), first), np.maximum.reduceat(np.maximum(self.x1[e], self.x2[e]), first), np.maximum.reduceat(np.maximum(self.y1[e], self.y2[e]), first)])

    def edges(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = self.begin[which + 1] - self.begin[which]
        first = np.cumsum(many) - many
        return np.repeat(self.begin[which] - first, many) + np.arange(many.sum()), first

    def least(self, which: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """The squared distance of each street (a row) and point (a column), of some edges and points at a time."""
        out = np.full((len(which), len(px)), np.inf)
        e, first = self.edges(which)
        row = np.repeat(np.arange(len(which)), np.diff(np.append(first, len(e))))
        for lo in range(0, len(e), EDGES):
            own, rows = e[lo : lo + EDGES], row[lo : lo + EDGES]
            starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            for c in range(0, len(px), WIDE):
                part = np.minimum.reduceat(squared(px[c : c + WIDE], py[c : c + WIDE], self.x1[own], self.y1[own], self.x2[own], self.y2[own]), starts, 0)
                out[rows[starts], c : c + WIDE] = np.minimum(out[rows[starts], c : c + WIDE], part)
        return out


class Summary:
    """Of each range and mode (None for all) how many stations it has, and their box; ranges number from 0."""

    def __init__(self, rows: list[tuple], names: list[str | None]):
        self.names = names
        self.of = {name: np.array([r[1:] for r in rows if r[0] == name], float).reshape(-1, 6) for name in names}

    def needed(self, boxes: np.ndarray, own: int, wanted: list[tuple[str | None, int, np.ndarray]]) -> list[np.ndarray]:
        """For each street the other ranges that may hold one of its nearest: wanted has the squared distance of the k-th found, of each mode."""
        out: list[list[np.ndarray]] = [[] for _ in range(boxes.shape[1])]
        x1, y1, x2, y2 = (b[:, None] for b in boxes)
        for name, k, found in wanted:
            rows = self.of.get(name, np.zeros((0, 6)))
            if not len(rows):
                continue
            number, count, a, b, c, d = rows.T
            least = np.square(np.maximum(0, np.maximum(a - x2, x1 - c))) + np.square(np.maximum(0, np.maximum(b - y2, y1 - d)))
            most = np.square(np.maximum(c - x1, x2 - a)) + np.square(np.maximum(d - y1, y2 - b))
            order = np.argsort(most, 1)
            enough = np.cumsum(count[order], 1) >= k
            certain = np.where(enough.any(1), np.take_along_axis(most, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0], np.inf)
            bound = np.minimum(found, certain)
            reached = (least <= (bound * (1 + 1e-9) + 1e-6)[:, None]) & (number != own)[None, :]
            for street, r in zip(*np.nonzero(reached), strict=True):
                out[street].append(number[r])
        return [np.unique(np.array(x, np.int64)) for x in out]


def _searched(lines: Lines, stations: pa.Table, k: int, per_mode: int, names: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[str | None, np.ndarray, np.ndarray]]]]:
    """For some streets at a time, of stations in the order of ord: the streets, and for all stations (None) and each mode the squared distances and stations of the nearest, of smaller ord first."""
    x, y = stations["x"].to_numpy(), stations["y"].to_numpy()
    mode = stations["mode"].to_pylist()
    kinds: list[tuple[str | None, int, np.ndarray, Tree]] = []
    if k:
        kinds.append((None, k, np.arange(len(x)), Tree(x, y)))
    if per_mode:
        for name in names:
            own = np.array([p for p, m in enumerate(mode) if m == name], np.int64)
            kinds.append((name, per_mode, own, Tree(x[own], y[own])))
    count = lines.begin[1:] - lines.begin[:-1]
    todo = [np.flatnonzero(count)[lo : lo + TOGETHER] for lo in range(0, int((count > 0).sum()), TOGETHER)][::-1]
    while todo:
        some = todo.pop()
        x1, y1, x2, y2 = lines.box(some)
        cx, cy = (x1.min() + x2.max()) / 2, (y1.min() + y2.max()) / 2
        half = float(np.hypot(x2.max() - cx, y2.max() - cy))
        near = [tree.near(cx, cy, n, half) for _, n, _, tree in kinds]
        if len(some) > 4 and half > 2 * min((r for _, r in near), default=np.inf):  # too far apart for their stations
            todo += [some[len(some) // 2 :], some[: len(some) // 2]]
            continue
        got = []
        for (name, n, own, tree), (there, _) in zip(kinds, near, strict=True):
            far = lines.least(some, tree.x[there], tree.y[there])
            best = np.argsort(far, 1, kind="stable")[:, :n]
            got.append((name, np.take_along_axis(far, best, 1), own[there][best] if len(there) else best))
        yield some, got


def _kernel(k: int, per_mode: int, summary: Summary, street_type: pa.DataType, station_type: pa.DataType, first: bool):
    """Of the streets and stations of a range: (street_id, mode, rank, station_id, ord, d2, sure, pts, ranges). A street that may have nearer stations elsewhere has a
    row with its points and those ranges, and what it has found isn't sure."""
    names = [n for n in summary.names if n is not None]
    columns = ["street_id", "mode", "rank", "station_id", "ord", "d2", "sure", "pts", "ranges"]

    def run(key: tuple[pa.Scalar, ...], streets: pa.Table, stations: pa.Table) -> pa.Table:
        streets = streets.combine_chunks()
        streets = streets.take(pc.sort_indices(streets["code"]))
        pts = streets["pts"].combine_chunks().cast(POINTS)
        lines, ids = Lines(pts), streets["street_id"].combine_chunks()
        stations = stations.combine_chunks()
        stations = stations.take(pc.sort_indices(stations, sort_keys=[("ord", "ascending")]))
        own, ords = stations["station_id"].combine_chunks(), stations["ord"].combine_chunks().cast(pa.int64())
        out: list[pa.Table] = []
        schema = [pa.array([], t) for t in (street_type, pa.string(), pa.int32(), station_type, pa.int64(), pa.float64(), pa.bool_(), pts.type, pa.list_(pa.int32()))]
        for some, got in _searched(lines, stations, k, per_mode, names):
            sure = np.ones(len(some), bool)
            if first:
                kth = [(name, n, d2[:, n - 1] if d2.shape[1] >= n else np.full(len(some), np.inf)) for (name, d2, _), n in zip(got, [k] * bool(k) + [per_mode] * len(names), strict=False)]
                ranges = summary.needed(lines.box(some), key[0].as_py(), kth)
                asks = [p for p, r in enumerate(ranges) if len(r)]
                sure[asks] = False
                if asks:
                    at, none = pa.array(some[asks]), lambda t: pa.nulls(len(asks), t)  # noqa: B023
                    out.append(pa.table([ids.take(at), none(pa.string()), none(pa.int32()), none(station_type), none(pa.int64()), none(pa.float64()), none(pa.bool_()), pts.take(at), pa.array([ranges[p].tolist() for p in asks], pa.list_(pa.int32()))], names=columns))
            for name, d2, which in got:
                rows, n = d2.size, d2.shape[1]
                at = pa.array(which.ravel())
                out.append(pa.table([ids.take(pa.array(np.repeat(some, n))), pa.array([name] * rows, pa.string()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(some))), own.take(at), ords.take(at), pa.array(d2.ravel()), pa.array(np.repeat(sure, n) & first), pa.nulls(rows, pts.type), pa.nulls(rows, pa.list_(pa.int32()))], names=columns))
        return pa.concat_tables([pa.table(schema, names=columns), *out])

    return run


def candidates(streets: DataFrame, stations: DataFrame, k: int = 5, per_mode: int = 1, per_range: int = PER_RANGE) -> DataFrame:
    """(street_id, mode, rank, station_id, dist_m): a street's k nearest stations, with mode null, and the per_mode nearest of each mode.

    streets: street_id, which differ, and pts (array of lon, lat); stations: id, ord, mode, lon, lat. Equal
    distances go to the smaller ord; distances are planar about the mean station
    latitude. Either number may be 0. Stations and edges without two finite coordinates don't count, nor do streets without any edge. Streets are
    shuffled once, and those near the border of their range once more, to where their nearest may be.
    """
    spark = streets.sparkSession
    own = stations.where(geo.is_coordinate(F.col("lon"), F.col("lat")))
    ref = own.agg(F.avg("lat").alias("ref")).first()["ref"]
    street_type, station_type = streets.schema["street_id"].dataType, own.schema["id"].dataType
    kind = f"street_id {street_type.simpleString()}, mode string, rank int, station_id {station_type.simpleString()}, dist_m int"
    if ref is None or not (k or per_mode):
        return spark.createDataFrame([], kind)
    x, y = geo.project(F.col("lon"), F.col("lat"), ref)
    own = stored(own.select(F.col("id").alias("station_id"), "ord", "mode", x.alias("x"), y.alias("y")).withColumn("code", curve(F.col("x"), F.col("y"))), "nearest-stations")
    at = lambda p: geo.project(p["lon"], p["lat"], ref)
    lines = streets.select("street_id", F.transform("pts", lambda p: F.struct(at(p)[0].alias("x"), at(p)[1].alias("y"))).alias("pts")).where(F.size("pts") >= 2)
    home = F.try_element_at(F.filter("pts", lambda p: geo.is_coordinate(p["x"], p["y"])), F.lit(1))
    lines = lines.withColumn("code", curve(home["x"], home["y"])).where("code is not null")

    grid = [(q + 0.5) / MOST_RANGES for q in range(MOST_RANGES)]
    spread = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("code", grid, 20 * MOST_RANGES).alias("q")).first()
    cuts: list[int] = []
    for found in (spread(lines), spread(own)):
        parts = min(MOST_RANGES, -(-found["n"] // per_range))
        cuts += [found["q"][p * MOST_RANGES // parts] for p in range(1, parts)]
    bounds = sorted(set(cuts))[:: max(1, len(set(cuts)) // MOST_RANGES)] or []
    tasks = [cuts.count(b) for b in [-1, *bounds]]  # a place that has several cuts to itself has several tasks
    tasks = [max(1, n) for n in tasks]
    held, deal = F.array(*map(F.lit, [*bounds, *[2**62] * ((1 << len(bounds).bit_length()) - len(bounds))])), F.array(*map(F.lit, tasks))
    jumps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    number = F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), lambda p, s: F.when(F.element_at(held, p + s) <= F.col("code"), p + s).otherwise(p)) if bounds else F.lit(0)
    dealt = own.withColumn("range", number)
    per = [F.count(F.lit(1)).alias("n"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2")]
    rows = [(None, *r) for r in dealt.groupBy("range").agg(*per).collect()] if k else []
    rows += [tuple(r) for r in dealt.where("mode is not null").groupBy("mode", "range").agg(*per).collect()] if per_mode else []
    summary = Summary(rows, list(dict.fromkeys(r[0] for r in rows)))

    pts = lines.schema["pts"].dataType.simpleString()
    schema = f"street_id {street_type.simpleString()}, mode string, rank int, station_id {station_type.simpleString()}, ord long, d2 double, sure boolean, pts {pts}, ranges array<int>"
    types = [to_arrow_type(t) for t in (street_type, station_type)]
    guests = dealt.withColumn("task", F.explode(F.sequence(F.lit(0), F.element_at(deal, F.col("range") + 1) - 1))).drop("code").groupBy("range", "task")
    hosts = lines.withColumn("range", number).withColumn("task", F.pmod(F.hash("street_id"), F.element_at(deal, F.col("range") + 1)))
    first = stored(hosts.groupBy("range", "task").cogroup(guests).applyInArrow(_kernel(k, per_mode, summary, *types, True), schema), "nearest")
    sent = first.where("pts is not null").select("street_id", "pts", F.explode("ranges").alias("range"), F.lit(0).cast("long").alias("code"))
    sent = sent.withColumn("task", F.pmod(F.hash("street_id"), F.element_at(deal, F.col("range") + 1)))
    more = sent.groupBy("range", "task").cogroup(guests).applyInArrow(_kernel(k, per_mode, summary, *types, False), schema)
    sure, open_ = first.where("pts is null and sure"), first.where("pts is null and not sure").unionByName(more)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("street_id", "mode").orderBy("d2", "ord")))
    most = F.when(F.col("mode").isNull(), k).otherwise(per_mode)
    every = sure.unionByName(ranked(open_).where(F.col("rank") <= most))
    return every.select("street_id", "mode", "rank", "station_id", F.floor(F.sqrt("d2") + 0.5).cast("int").alias("dist_m"))


def rings(points: DataFrame, others: DataFrame, k: int, least_m: float, first_m: float = FIRST_RING_M) -> tuple[DataFrame, int]:
    """(src, dst, dst_ord, metres): of each point the k nearest others of its key that are further than least_m and within the point's reach; and the pairs that were looked at.

    points: id, key, lon, lat, reach; others: id, ord, key, lon, lat. A point that has found k
    within the ring is done, and so is one whose reach the ring spans, so however many others its reach holds it looks at those of a
    ring with few more than k. Equal distances go to the smaller ord; places that aren't finite don't count.
    """
    todo = stored(points.where(geo.is_coordinate(F.col("lon"), F.col("lat"))).where("key is not null").select("id", "key", "lon", "lat", "reach"), "rings-todo")
    there = stored(others.where(geo.is_coordinate(F.col("lon"), F.col("lat"))).where("key is not null").select(F.col("id").alias("dst"), F.col("ord").alias("dst_ord"), "key", F.col("lon").alias("x"), F.col("lat").alias("y")), "rings-others")
    radius, found, looked = first_m, [], 0
    while todo.limit(1).count():
        degrees = radius / 100_000.0
        cell = lambda c: F.floor(F.col(c) / degrees)  # noqa: B023, E731
        wide = F.ceil(F.lit(1.2) / F.greatest(F.lit(0.05), F.cos(F.radians(F.col("lat"))))).cast("int")
        near = todo.withColumn("cx", F.explode(F.sequence(cell("lon") - wide, cell("lon") + wide))).withColumn("cy", F.explode(F.sequence(cell("lat") - 1, cell("lat") + 1)))
        pairs = near.join(there.withColumn("cx", cell("x")).withColumn("cy", cell("y")), ["key", "cx", "cy"]).where("id <> dst")
        pairs = pairs.withColumn("metres", geo.haversine(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")))
        fits = (F.col("metres") > least_m) & (F.col("metres") <= F.least(F.lit(radius), F.col("reach")))
        best = Window.partitionBy("id", "key").orderBy(F.when(F.col("fits"), 0).otherwise(1), "metres", "dst_ord")
        ranked = pairs.withColumn("fits", fits).withColumn("r", F.row_number().over(best)).withColumn("seen", F.count(F.lit(1)).over(Window.partitionBy("id", "key")))
        got = stored(ranked.where((F.col("r") == 1) | (F.col("fits") & (F.col("r") <= k))).select("id", "key", "dst", "dst_ord", "metres", "fits", "r", "seen"), "rings")
        looked += got.where("r = 1").agg(F.sum("seen").alias("n")).first()["n"] or 0
        full = got.where("fits").groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("id", "key", F.lit(True).alias("full"))
        state = stored(todo.join(full, ["id", "key"], "left").withColumn("over", F.coalesce("full", F.lit(False)) | (F.col("reach") <= radius)).drop("full"), "rings-state")
        found.append(got.where("fits").join(state.where("over").select("id", "key"), ["id", "key"], "left_semi").select(F.col("id").alias("src"), "key", "dst", "dst_ord", "metres"))
        drop(todo)
        todo = stored(state.where("not over").drop("over"), "rings-todo")
        radius *= 2
    drop(todo, there)
    out = found[0] if found else points.sparkSession.createDataFrame([], f"src {points.schema['id'].dataType.simpleString()}, key {points.schema['key'].dataType.simpleString()}, dst {others.schema['id'].dataType.simpleString()}, dst_ord long, metres double")
    for df in found[1:]:
        out = out.unionByName(df)
    return out, looked
