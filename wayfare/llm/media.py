"""Media columns: a Spark data source over directories of member archives.

An archive file holds members one after another, each with a header of its own,
and ends in the table of their offsets. The source plans partitions as byte ranges of the
files, a member belongs to the range that it begins in. Payloads stream through
Arrow in batches of bounded bytes. A member that fails to be read or doesn't
match its checksum is read again by its offset, alone. The writer's commit
lists the files of the tasks that succeeded; what failed attempts have left is
never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "id long, n_bytes long, media binary"
MEMBER = struct.Struct("<4s?qqqqI")  # mark, has id, id, n_bytes, media bytes, stored bytes, crc32 of what is stored
END = struct.Struct("<q4s")  # members, mark
MARK, LAST = b"MEM1", b"END1"
MANIFEST = "_members.json"
BATCH_BYTES = 8 << 20
RATE = 8000


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path as Spark names it, local, HDFS or an object store."""
    return pa.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    members: int


@dataclass
class Range(InputPartition):
    name: str
    low: int
    high: int


class Archive(DataSource):
    """format("member_archive"): id, n_bytes and media of each member. Option range_bytes: size of a partition."""

    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("range_bytes", 16 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"])


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.members"
        zstd, offsets = zstandard.ZstdCompressor(level=3), []
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for i, n, media in zip(*(batch.column(c).to_pylist() for c in ("id", "n_bytes", "media")), strict=True):
                    stored = zstd.compress(media)
                    offsets.append(out.tell())
                    out.write(MEMBER.pack(MARK, i is not None, i or 0, n, len(media), len(stored), zlib.crc32(stored)))
                    out.write(stored)
            out.write(np.array(offsets, "<i8").tobytes() + END.pack(len(offsets), LAST))
            size = out.tell()
        return Written(name, size, len(offsets))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([[m.name, m.size] for m in messages if m and m.members]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.name}")


class Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, tries: int = 3):
        self.path, self.range_bytes, self.tries = path, range_bytes, tries

    def partitions(self) -> list[Range]:
        fs, root = opened(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        return [Range(name, at, min(at + self.range_bytes, size)) for name, size in files for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def member(self, f: pa.NativeFile, at: int) -> tuple[int | None, int, bytes]:
        f.seek(at)
        mark, has, i, n, size, stored, crc = MEMBER.unpack(f.read(MEMBER.size))
        data = f.read(stored)
        if mark != MARK or len(data) != stored or zlib.crc32(data) != crc:
            raise OSError(f"member at {at} is damaged")
        return (i if has else None), n, zstandard.ZstdDecompressor().decompress(data, max_output_size=size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = opened(self.path)
        file = f"{root}/{partition.name}"
        f = fs.open_input_file(file)
        f.seek(f.size() - END.size)
        count, mark = END.unpack(f.read(END.size))
        if mark != LAST:
            raise OSError(f"{file} has no table of members")
        f.seek(f.size() - END.size - 8 * count)
        offsets = np.frombuffer(f.read(8 * count), "<i8")
        mine = offsets[np.searchsorted(offsets, partition.low) : np.searchsorted(offsets, partition.high)].tolist()
        rows, held = [], 0
        for at in mine:
            for left in reversed(range(self.tries)):
                try:
                    rows.append(self.member(f, at))
                    break
                except (OSError, struct.error, zstandard.ZstdError):
                    if not left:
                        raise
                    f = fs.open_input_file(file)  # a new connection, for this member's offset
            held += len(rows[-1][2])
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)
        f.close()

    @staticmethod
    def batch(rows: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "n_bytes", "media"])


def le(value: F.Column | int, size: int) -> F.Column:
    """An integer as little-endian bytes."""
    h = F.lpad(F.hex(F.lit(value).cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * k - 1, 2) for k in range(size, 0, -1))))


def as_wave(payload: F.Column) -> F.Column:
    """The bytes as a WAVE file of unsigned 8-bit samples, one channel."""
    n = F.octet_length(payload)
    return F.concat(F.lit(b"RIFF"), le(n + 36, 4), F.lit(b"WAVEfmt "), F.lit(struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)), F.lit(b"data"), le(n, 4), payload)


def write(docs: DataFrame, path: str, unit: int = 192, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Stores every whole text as a WAVE member.

    The text in UTF-8 (null: empty) is filled up with spaces to a positive multiple
    of ``unit`` bytes. Null and repeated ids are members like others; other columns are ignored.
    """
    spark = docs.sparkSession
    spark.dataSource.register(Archive)
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    base = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("raw"))
    n = F.octet_length("raw")
    full = (F.greatest(F.ceil(n / unit), F.lit(1)) * unit).cast("int")
    base = base.select("id", n.cast("long").alias("n_bytes"), F.concat("raw", F.encode(F.repeat(F.lit(" "), full - n), "UTF-8")).alias("payload"))
    base.select("id", "n_bytes", as_wave(F.col("payload")).alias("media")).write.format("member_archive").mode("append").save(path)


def features(wave: bytes) -> str:
    """Samples, seconds, mean, root mean square about 128, peak, and sign changes a sample."""
    x = np.frombuffer(wave, np.uint8, offset=44).astype(np.int16) - 128
    flips = np.count_nonzero(np.diff(np.signbit(x))) / max(1, len(x) - 1)
    return f"n={len(x)};s={len(x) / RATE:.4f};mean={x.mean():.4f};rms={np.sqrt((x.astype(np.float64) ** 2).mean()):.4f};peak={np.abs(x).max()};flips={flips:.6f}"


def read(spark: SparkSession, path: str, range_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_bytes, media, payload, feature) of every member, from the archives."""
    spark.dataSource.register(Archive)

    @F.pandas_udf("string")
    def feature(media):  # noqa: ANN001, ANN202
        return media.map(features)

    got = spark.read.format("member_archive").option("range_bytes", range_bytes).load(path)
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "media", F.expr("substring(media, 45)").alias("payload"), feature("media").alias("feature"))
