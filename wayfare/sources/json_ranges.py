"""One large JSON file by byte ranges: the objects of a top-level array, read by several tasks.

Whether a byte stands in a string, and how deep, depends on all before it. So every range
is scanned from each state that it may begin in (outside of a string, in one, in one after a backslash);
a row for each range then chains the states from the file's start. Knowing its state, a task reads the objects that
begin in its range, to their ends.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
#: Bytes by which an object is read on beyond its range, and of the objects in a batch.
STEP, BATCH = 1 << 16, 4 << 20
#: Bytes after a key in which its array must begin.
GAP = 1024
QUOTE, BACKSLASH = ord('"'), ord("\\")
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path else os.path.abspath(path))


def scan(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of bytes that begin in a state: where brackets stand outside of strings, whether each opens (1) or closes (-1), where strings begin, and the state after."""
    b = np.frombuffer(data, np.uint8)
    slash = b == BACKSLASH
    at = np.arange(len(b))
    # a byte after an odd run of backslashes is escaped; the run may have begun before these bytes
    begin = np.maximum.accumulate(np.where(slash, -1, at)) if len(b) else at
    run = np.append(0, (at - begin)[:-1]) if len(b) else at
    if state == ESCAPED and len(b):
        lead = int(np.argmin(slash)) if not slash.all() else len(b)
        run[: lead + 1] += 1
    quotes = np.flatnonzero((b == QUOTE) & (run % 2 == 0))
    if state == ESCAPED and len(b) and b[0] == QUOTE:
        quotes = quotes[quotes != 0]
    within = np.zeros(len(b) + 1, np.int8)
    within[quotes + 1] = 1
    within = (np.cumsum(within) + (state != OUTSIDE)) % 2
    opens, closes = (b == ord("{")) | (b == ord("[")), (b == ord("}")) | (b == ord("]"))
    places = np.flatnonzero((opens | closes) & (within[:-1] == 0))
    after = INSIDE if within[-1] else OUTSIDE
    if after and len(b) and slash[-1] and (run[-1] % 2 == 0):
        after = ESCAPED
    return places, np.where(opens[places], 1, -1), quotes[within[quotes] == 0], after


def summary(data: bytes, more: bytes, key: str, state: int) -> dict:
    """What the chain needs of a range that begins in a state: the state after it, how the depth changes, at which relative depths how many objects begin,
    where the depth falls to each new least, and where the key's array begins (the last at each relative depth)."""
    places, steps, strings, after = scan(data, state)
    depth = np.cumsum(steps)
    objects = np.frombuffer(data, np.uint8)[places] == ord("{")
    counts = np.unique(depth[objects] - 1, return_counts=True)
    falls = {}
    least = np.minimum.accumulate(np.append(0, depth))
    for k in np.flatnonzero(np.diff(least)):
        falls[int(depth[k])] = int(places[k])
    begins = {}
    pattern = re.compile(re.escape(json.dumps(key).encode()) + rb"\s*:\s*\[")
    whole, known = data + more, set(strings.tolist())
    for m in pattern.finditer(whole):
        if m.start() in known:
            before = int(np.searchsorted(places, m.start()))
            begins[int(depth[before - 1]) if before else 0] = m.end()
    return {"state": after, "change": int(depth[-1]) if len(depth) else 0, "objects": {int(d): int(n) for d, n in zip(*counts, strict=True)}, "falls": falls, "begins": begins}


@dataclass
class Part(InputPartition):
    number: int
    low: int
    high: int
    state: int
    depth: int
    first: int


class JsonRanges(DataSource):
    """format("json_ranges"): place and value of each object, by the plan that objects_of() has made."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return "pos long, value string"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options["path"], json.loads(self.options["plan"]))


class RangeReader(DataSourceReader):
    def __init__(self, path: str, plan: dict):
        self.path, self.plan = path, plan

    def partitions(self) -> list[Part]:
        return [Part(k, *p) for k, p in enumerate(self.plan["parts"])] or [Part(0, 0, 0, 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        begin, end = self.plan["begin"], self.plan["end"]
        if partition.low >= partition.high:
            return
        fs, path = opened(self.path)
        with fs.open_input_file(path) as f:
            f.seek(partition.low)
            data = f.read(partition.high - partition.low)
            places, steps, _, state = scan(data, partition.state)
            depth = np.cumsum(np.append(partition.depth, steps))[1:]
            own = places + partition.low
            starts = np.flatnonzero((steps > 0) & (depth == 3) & (own >= begin) & (own < end) & (np.frombuffer(data, np.uint8)[places] == ord("{")))
            ends = np.flatnonzero((steps < 0) & (depth == 2))
            nth, rows, held = partition.first, [], 0
            last = np.searchsorted(ends, starts)
            for s, e in zip(starts.tolist(), last.tolist(), strict=True):
                if e < len(ends):
                    value = data[places[s] : places[ends[e]] + 1]
                else:
                    value = data[places[s] :] + self.onward(f, state, int(depth[-1]))
                rows.append((nth, value.decode()))
                nth, held = nth + 1, held + len(value)
                if held >= BATCH:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def onward(f: pa.NativeFile, state: int, depth: int) -> bytes:
        """What follows, to where the depth falls to 2."""
        out = []
        while data := f.read(STEP):
            places, steps, _, state = scan(data, state)
            own = depth + np.cumsum(steps)
            there = np.flatnonzero(own == 2)
            if len(there):
                return b"".join([*out, data[: places[there[0]] + 1]])
            depth = int(own[-1]) if len(own) else depth
            out.append(data)
        raise ValueError("the file ends in an object")

    @staticmethod
    def batch(rows: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["pos", "value"])


def objects_of(spark: SparkSession, path: str, key: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(pos, value): the objects of the array that the file's top-level object has under key, as text, numbered from 0.

    The array has objects only. A file without the key, or with an empty array, gives no rows; of several arrays under the key the last counts.
    """
    fs, own = opened(path)
    size = fs.get_file_info(own).size or 0
    lows = list(range(0, size, range_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in b.column(0).to_pylist():
                own_fs, place = opened(path)
                with own_fs.open_input_file(place) as f:
                    f.seek(low)
                    data = f.read(min(range_bytes, size - low))
                    more = f.read(len(key) + GAP)
                found = json.dumps([summary(data, more, key, s) for s in (OUTSIDE, INSIDE, ESCAPED)])
                yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([found])], names=["low", "found"])

    ranges = spark.createDataFrame([(low,) for low in lows], "low long").repartition(max(1, min(len(lows), 1000)), "low") if lows else spark.createDataFrame([], "low long")
    found = {r.low: json.loads(r.found) for r in ranges.mapInArrow(run, "low long, found string").collect()}  # a row for each range
    state, depth, chain, begin = OUTSIDE, 0, [], None
    for low in lows:
        part = found[low][state]
        chain.append((low, state, depth, part))
        if (at := part["begins"].get(str(1 - depth))) is not None:
            begin = low + at
        state, depth = part["state"], depth + part["change"]
    parts, end = [], None
    if begin is not None:
        for low, _, before, part in chain:
            if end is None and low + range_bytes > begin and before + min([0, *map(int, part["falls"])]) <= 1:
                end = _end(path, low, min(range_bytes, size - low), begin, chain[low // range_bytes])
        end = size if end is None else end
        first = 0
        for low, was, before, part in chain:
            high = min(low + range_bytes, size)
            if high <= begin or low >= end:
                continue
            parts.append((low, high, was, before, first))
            whole = low >= begin and high <= end
            first += part["objects"].get(str(2 - before), 0) if whole else _count(path, low, high, was, before, begin, end)
    plan = {"begin": begin or 0, "end": end or 0, "parts": parts}
    spark.dataSource.register(JsonRanges)
    return spark.read.format("json_ranges").option("plan", json.dumps(plan)).load(path)


def _bytes(path: str, low: int, size: int) -> bytes:
    fs, own = opened(path)
    with fs.open_input_file(own) as f:
        f.seek(low)
        return f.read(size)


def _end(path: str, low: int, size: int, begin: int, link: tuple) -> int | None:
    """Where in a range the array that begins at a place ends, if it does."""
    _, state, before, _ = link
    places, steps, _, _ = scan(_bytes(path, low, size), state)
    depth = before + np.cumsum(steps)
    there = np.flatnonzero((depth == 1) & (steps < 0) & (places + low >= begin))
    return int(places[there[0]]) + low if len(there) else None


def _count(path: str, low: int, high: int, state: int, before: int, begin: int, end: int) -> int:
    """The array's objects that begin in a range that it fills in part; there are two such ranges at most."""
    data = _bytes(path, low, high - low)
    places, steps, _, _ = scan(data, state)
    depth, own = before + np.cumsum(steps), places + low
    return int(((steps > 0) & (depth == 3) & (own >= begin) & (own < end) & (np.frombuffer(data, np.uint8)[places] == ord("{"))).sum())
