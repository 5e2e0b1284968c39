"""Columns of streets by position: for each pool and mode the distances and station indexes of all streets, in coded blocks.

A street's number is its place; a column is cut into blocks of ``BLOCK`` places, and a block's values are
coded as runs of equal steps from place to place. A read of places takes the blocks that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4096
#: What stands for a place without a value.
NONE = -(1 << 31)


def coded(values: np.ndarray) -> bytes:
    """Runs of equal steps: how many, then each run's length and step as zigzag numbers of 7 bits a byte."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    starts = np.flatnonzero(np.append(True, steps[1:] != steps[:-1])) if len(steps) else np.zeros(0, np.int64)
    numbers = np.column_stack([np.diff(np.append(starts, len(steps))), (steps[starts] << 1) ^ (steps[starts] >> 63)]).ravel()
    out = bytearray()
    for n in [len(starts), *numbers.tolist()]:
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def decoded(data: bytes) -> np.ndarray:
    numbers, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            numbers.append(n)
            n = shift = 0
    lengths, steps = (np.array(numbers[k::2], np.int64) for k in (1, 2))
    return np.cumsum(np.repeat((steps >> 1) ^ -(steps & 1), lengths))


def write(features: DataFrame, numbers: DataFrame, path: str, block: int = BLOCK) -> None:
    """features: street_id, pool, mode, dist_m, station_ord; numbers: street_id, i (from 0 on, without gaps). Streets without a number have no place; of several values for a place the least distance's stays."""
    placed = features.join(numbers.select("street_id", "i"), "street_id").groupBy("pool", "mode", "i").agg(F.min(F.struct("dist_m", "station_ord")).alias("v"))
    blocks = placed.groupBy("pool", "mode", F.floor(F.col("i") / block).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct((F.col("i") % block).cast("int").alias("at"), "v.dist_m", "v.station_ord"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = []
            for cells in b.column(3):
                flat = cells.values
                at = flat.field("at").to_numpy()
                out = []
                for name in ("dist_m", "station_ord"):
                    values = np.full(int(at[-1]) + 1, NONE, np.int64)
                    values[at] = flat.field(name).fill_null(NONE).to_numpy()
                    out.append(coded(values))
                columns.append(out)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([c[k] for c in columns], pa.binary()) for k in (0, 1))], names=["pool", "mode", "block", "distances", "indexes"])

    rows = blocks.mapInArrow(run, "pool string, mode string, block long, distances binary, indexes binary").withColumn("size", F.lit(block))
    rows.repartitionByRange("pool", "mode", "block").sortWithinPartitions("pool", "mode", "block").write.mode("overwrite").partitionBy("pool", "mode").parquet(path)


def read(spark: SparkSession, path: str, low: int = 0, high: int | None = None, modes: list[str] | None = None) -> DataFrame:
    """(i, pool, mode, dist_m, station_ord) of the places from low to high, exclusive; of the modes alone if given."""
    rows = spark.read.schema("block long, distances binary, indexes binary, size int, pool string, mode string").parquet(path)
    size = rows.agg(F.max("size").alias("size")).first()["size"] or 1
    rows = rows.where(F.col("block") >= low // size)
    if high is not None:
        rows = rows.where(F.col("block") <= (high - 1) // size)
    if modes is not None:
        rows = rows.where(F.col("mode").isin(modes) if modes else F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (block, d, s) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                far, station = decoded(d), decoded(s)
                i = np.arange(len(far)) + block * size
                own = np.flatnonzero((far != NONE) & (i >= low) & (i < (high if high is not None else 1 << 62)))
                same = [b.column(c).take(pa.array(np.full(len(own), k))) for c in (0, 1)]
                at = station[own]
                yield pa.RecordBatch.from_arrays([pa.array(i[own]), *same, pa.array(far[own].astype(np.int32)), pa.array(at.astype(np.int32), mask=at == NONE)], names=["i", "pool", "mode", "dist_m", "station_ord"])

    return rows.select("pool", "mode", "block", "distances", "indexes").mapInArrow(run, "i long, pool string, mode string, dist_m int, station_ord int")
