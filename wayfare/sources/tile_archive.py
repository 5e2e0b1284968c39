"""Rows by tile in an archive: entries in the order of a Hilbert curve, each file with a directory of its own, and a list of the files.

A read takes zoom and box as filters (minzoom, cx, cy), turns them into ranges of the curve, opens the files that
meet them, and reads of each its directory and the entries' bytes, neighbouring ones at once.
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from wayfare.sources.json_ranges import opened

#: Cells of an axis are 2 to this; a tile's number is its first zoom before its place on the curve.
ORDER = 14
DEGREES = 0.05
MANIFEST, LAST = "files.json", b"TILES\x00\x00\x01"
ENTRY, END = struct.Struct("<qqii"), struct.Struct("<qq8s")
#: Bytes of a gap between two entries that are read at once.
GAP = 1 << 14


def hilbert(x: np.ndarray, y: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The places of cells on the curve."""
    x, y, d = x.astype(np.int64).copy(), y.astype(np.int64).copy(), np.zeros(len(x), np.int64)
    for s in (1 << k for k in reversed(range(order))):
        right, upper = (x & s) > 0, (y & s) > 0
        d += s * s * ((3 * right) ^ upper)
        turn = ~upper
        flip = turn & right
        x[flip], y[flip] = s - 1 - (x[flip] & (s - 1)), s - 1 - (y[flip] & (s - 1))
        x[turn], y[turn] = y[turn].copy(), x[turn].copy()
        x, y = x & (s - 1), y & (s - 1)
    return d


def curve_ranges(x1: int, y1: int, x2: int, y2: int, order: int = ORDER) -> list[tuple[int, int]]:
    """The stretches of the curve, ends exclusive, that the cells of a box make up."""
    out: list[tuple[int, int]] = []
    todo = [(0, 0, order)]
    while todo:
        x, y, k = todo.pop()
        size = 1 << k
        if x > x2 or y > y2 or x + size <= x1 or y + size <= y1:
            continue
        if k == 0 or (x >= x1 and y >= y1 and x + size - 1 <= x2 and y + size - 1 <= y2):
            low = int(hilbert(np.array([x]), np.array([y]))[0]) // (size * size) * size * size
            out.append((low, low + size * size))
            continue
        todo += [(x + dx, y + dy, k - 1) for dx in (0, size // 2) for dy in (0, size // 2)]
    merged: list[tuple[int, int]] = []
    for low, high in sorted(out):
        if merged and merged[-1][1] == low:
            merged[-1] = (merged[-1][0], high)
        else:
            merged.append((low, high))
    return merged


def cells(x: np.ndarray) -> np.ndarray:
    """Signed cells as places of the grid."""
    return np.clip(x.astype(np.int64) + (1 << ORDER - 1), 0, (1 << ORDER) - 1)


@dataclass
class Written(WriterCommitMessage):
    name: str
    low: int
    high: int
    size: int


@dataclass
class Piece(InputPartition):
    name: str
    ranges: list


class TileArchive(DataSource):
    """format("tile_archive"): the rows of an archive; options path, and schema and names for a read."""

    @classmethod
    def name(cls) -> str:
        return "tile_archive"

    def schema(self) -> str:
        fs, root = opened(self.options["path"])
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            return json.loads(f.read())["schema"]

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != "tile"))


class Writer(DataSourceArrowWriter):
    """Takes rows in the order of tile."""

    def __init__(self, path: str, ddl: str):
        self.path, self.ddl = path, ddl

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name, entries = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tiles", []
        zstd, held, at = zstandard.ZstdCompressor(level=3), [], 0
        with fs.open_output_stream(f"{root}/{name}") as out:

            def put(tile: int, tables: list[pa.Table]) -> None:
                sink = pa.BufferOutputStream()
                table = pa.concat_tables(tables).combine_chunks()
                with pa.ipc.new_stream(sink, table.schema) as w:
                    w.write_table(table)
                data = zstd.compress(sink.getvalue())
                entries.append((tile, out.tell(), len(data), table.num_rows))
                out.write(data)

            for batch in iterator:
                table = pa.Table.from_batches([batch])
                tile = table["tile"].to_numpy()
                table = table.drop_columns(["tile"])
                for lo, hi in zip(*(lambda c: (np.append(0, c), np.append(c, len(tile))))(np.flatnonzero(np.diff(tile)) + 1), strict=True):
                    if hi == lo:
                        continue
                    if held and tile[lo] != at:
                        put(at, held)
                        held = []
                    at = int(tile[lo])
                    held.append(table.slice(lo, hi - lo))
            if held:
                put(at, held)
            begin = out.tell()
            out.write(b"".join(ENTRY.pack(*e) for e in entries) + END.pack(begin, len(entries), LAST))
            size = out.tell()
        return Written(name, entries[0][0] if entries else 0, entries[-1][0] if entries else -1, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        files = [[m.name, m.low, m.high, m.size] for m in messages if m and m.high >= 0]
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"schema": self.ddl, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.name}")


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.least, self.most = {"minzoom": 0, "cx": -(1 << ORDER - 1), "cy": -(1 << ORDER - 1)}, {"minzoom": 31, "cx": (1 << ORDER - 1) - 1, "cy": (1 << ORDER - 1) - 1}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of zoom and cell choose the entries; Spark checks the rows, as cells beyond the grid share its border."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in self.least and isinstance(f.value, int):
                (name,), v = f.attribute, f.value
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.least[name] = max(self.least[name], v + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.most[name] = min(self.most[name], v - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Piece]:
        fs, root = opened(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())["files"]
        at = lambda bounds, c: int(cells(np.array([np.clip(bounds[c], -(1 << 40), 1 << 40)]))[0])
        box = curve_ranges(at(self.least, "cx"), at(self.least, "cy"), at(self.most, "cx"), at(self.most, "cy"))
        zooms = range(max(0, self.least["minzoom"]), min(31, self.most["minzoom"]) + 1)
        wanted = [((z << 2 * ORDER) + low, (z << 2 * ORDER) + high) for z in zooms for low, high in box]
        out = []
        for name, low, high, _ in files:
            first = bisect_left(wanted, (low + 1,))
            own = [r for r in wanted[max(0, first - 1) :] if r[0] <= high and r[1] > low] if len(wanted) < 1000 else [r for r in wanted if r[0] <= high and r[1] > low]
            if own:
                out.append(Piece(name, own))
        return out or [Piece("", [])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/{partition.name}") as f:
            yield from entries_of(f, partition.ranges)


def entries_of(f: pa.NativeFile, ranges: list) -> Iterator[pa.RecordBatch]:
    """The rows of a file's entries whose tiles lie in the ranges."""
    f.seek(f.size() - END.size)
    begin, count, mark = END.unpack(f.read(END.size))
    if mark != LAST:
        raise OSError("a file of the archive has no directory")
    f.seek(begin)
    entries = np.frombuffer(f.read(count * ENTRY.size), np.dtype([("tile", "<i8"), ("at", "<i8"), ("size", "<i4"), ("rows", "<i4")]))
    lows, highs = (np.array([r[k] for r in ranges], np.int64) for k in (0, 1))
    where = np.searchsorted(lows, entries["tile"], "right") - 1
    own = entries[(where >= 0) & (entries["tile"] < highs[where])]
    zstd = zstandard.ZstdDecompressor()
    cuts = np.flatnonzero(own["at"][1:] - (own["at"][:-1] + own["size"][:-1]) > GAP) + 1
    for stretch in np.split(own, cuts):
        if not len(stretch):
            continue
        low = int(stretch["at"][0])
        f.seek(low)
        data = f.read(int(stretch["at"][-1] + stretch["size"][-1]) - low)
        for _, at, size, _ in stretch.tolist():
            with pa.ipc.open_stream(zstd.decompress(data[at - low : at - low + size])) as r:
                yield from r


def write(rows: DataFrame, path: str, degrees: float = DEGREES, tasks: int | None = None) -> None:
    """Rows (minzoom, lon, lat and others) by tile: first zoom, and the cell of the place. Rows without a finite place or a zoom of 0 to 30 have no tile."""
    spark = rows.sparkSession
    spark.dataSource.register(TileArchive)
    fine = rows.where("lon is not null and lat is not null and abs(lon) <= 180 and abs(lat) <= 90 and minzoom between 0 and 30")
    fine = fine.withColumn("minzoom", F.col("minzoom").cast("int")).withColumn("cx", F.floor(F.col("lon") / degrees).cast("int")).withColumn("cy", F.floor(F.col("lat") / degrees).cast("int"))

    @F.pandas_udf("long")
    def tile(zoom, cx, cy):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series((zoom.to_numpy().astype(np.int64) << 2 * ORDER) + hilbert(cells(cx.to_numpy()), cells(cy.to_numpy())))

    numbered = fine.withColumn("tile", tile("minzoom", "cx", "cy"))
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered.repartitionByRange(tasks, "tile").sortWithinPartitions("tile").write.format("tile_archive").mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archive's rows, with cx and cy; filters on minzoom, cx and cy are pushed down to it."""
    spark.dataSource.register(TileArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tile_archive").load(path)


def viewport(spark: SparkSession, path: str, zoom: int, west: float, south: float, east: float, north: float, degrees: float = DEGREES) -> DataFrame:
    """The rows of the tiles that meet a box, up to a zoom."""
    at = lambda x: int(x // degrees)
    return read(spark, path).where((F.col("minzoom") <= zoom) & (F.col("cx") >= at(west)) & (F.col("cx") <= at(east)) & (F.col("cy") >= at(south)) & (F.col("cy") <= at(north)))
