"""Token ids in files: canonical length-limited Huffman coding in independent blocks.

Codes come from the counts of all ids. A block holds documents in ascending order
of their ids, the codes of each from a byte of its own, and the bit length of
every run of ``RUN`` codes. From these checkpoints all runs of a block are decoded
side by side, each by one table look-up a code. Blocks are rows of a Parquet
dataset (path/blocks), so files appear when their task has succeeded; the code
lengths stand in path/code.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.llm.bpe import WordBpe
from wayfare.llm.common import drop, new_path, small_batches, stored

RUN = 128
#: Ids after which a block, and a part, ends.
BLOCK, PART = 1 << 18, 1 << 22
BLOCKS = "part int, block int, before long, n_ids long, doc_ids binary, nulls binary, lengths binary, sizes binary, marks binary, data binary"
#: Longest code in bits: two more than the ids of a vocabulary of 65536 need at least, and a table that a core's cache holds. With 7 bits before it, it fits a window of 32.
LONGEST = 18


class Encoder(WordBpe):
    """The tokenizers library over the distinct words of a batch, side by side in one text.

    White space never joins tokens of this vocabulary, and the last token of each
    word says so, which is where the words' ids are told apart again.
    """

    def __init__(self, path: str):
        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for i, t in self.tokens.items() if t.endswith(self.word_end)]] = True

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        words = list(words)
        out: dict[bytes, bytes] = {}
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.library.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            if len(cuts) != len(some) + 1 or cuts[-1] != len(raw):
                out.update((w, np.array(self.library.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()) for w in some)
            else:
                out.update((w, raw[a:b]) for w, a, b in zip(some, cuts, cuts[1:], strict=False))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol's code, 0 where the count is 0: package-merge, optimal under the limit."""
    used = np.flatnonzero(counts)
    longest = max(longest, len(used).bit_length())
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    weights, packages, levels = counts[used].astype(np.float64), np.zeros(0), []
    for _ in range(longest):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(weights) - 2
    for leaf in reversed(levels):
        n = int(np.count_nonzero(leaf[:take]))
        out[used[:n]] += 1
        take = 2 * (take - n)
    return out


class Code:
    """The canonical code of given lengths: by length, then symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.bits = int(lengths.max(initial=1))
        span = np.int64(1) << (self.bits - self.lengths[order])
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = (np.cumsum(span) - span) >> (self.bits - self.lengths[order])
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.length = np.ones(1 << self.bits, np.int64)
        filled = int(span.sum())
        self.symbol[:filled], self.length[:filled] = np.repeat(order, span), np.repeat(self.lengths[order], span)

    def encode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents' ids, one after another from starts on: bytes, each document's number of them, bits of each run of RUN."""
        bits, n = self.lengths[ids], np.diff([*starts, len(ids)])
        ends = np.concatenate([[0], np.cumsum(bits)])
        size = (ends[starts + n] - ends[starts] + 7) // 8
        first = np.cumsum(size) - size
        at = ends[:-1] + np.repeat(8 * first - ends[starts], n)
        value = self.codes[ids] << (32 - bits - (at & 7))
        low, total = at >> 3, int(size.sum())
        out = np.zeros(total + 4)
        for k in range(4):
            out += np.bincount(low + k, (value >> (24 - 8 * k)) & 255, total + 4)
        runs = self.runs(n, starts)
        marks = ends[np.minimum(runs[:, 0] + RUN, runs[:, 1])] - ends[runs[:, 0]]
        return out[:total].astype(np.uint8), size, marks.astype("<u2")

    @staticmethod
    def runs(n: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """First id and end of the document of each run."""
        k = -(-n // RUN)
        which = np.repeat(np.arange(len(n)), k)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
        return np.stack([starts[which] + RUN * inner, (starts + n)[which]], 1)

    def decode(self, data: bytes, n: np.ndarray, size: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The ids of a block's documents, one after another."""
        raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        k = -(-n // RUN)
        before = np.cumsum(marks.astype(np.int64)) - marks
        first = np.cumsum(k) - k
        at = np.repeat(8 * (np.cumsum(size) - size), k) + before - np.repeat(before[first] if len(before) else before, k)
        left = np.repeat(n, k) - RUN * (np.arange(len(k.repeat(k))) - np.repeat(first, k))
        out = np.zeros((len(at), RUN), np.uint32)
        top = 8 * len(data)
        for j in range(RUN):
            at = np.minimum(at, top)
            code = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.bits)
            out[:, j] = self.symbol[code]
            at = at + self.length[code]
        return out[np.arange(RUN) < left[:, None]]


def planes(ids: bytes, wide: bool) -> bytes:
    """Ids for the work table: 16 bits where the vocabulary fits, all low bytes and then all high ones."""
    a = np.frombuffer(ids, "<u4")
    return a.tobytes() if wide else (lambda x: x[:, 0].tobytes() + x[:, 1].tobytes())(a.astype("<u2").view(np.uint8).reshape(-1, 2))


def unplanes(data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(data, "<u4") if wide else np.frombuffer(data, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes all ids in ascending order of id_col, nulls first.

    Rows with equal ids stand side by side in any order; other columns are ignored. An empty table gives files without blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    size = max(library.get_vocab_size(), max(library.get_added_tokens_decoder(), default=0) + 1, end_id + 1)
    wide, end = size > 65536, np.array([end_id], "<u4").tobytes()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, names = encoder(vocabulary), np.zeros(size, np.int64), ["doc_id", "n", "ids", "counts"]
        for b in batches:
            ids = [x + end for x in own.encode_batch(b.column(1).to_pylist())]
            total += np.bincount(np.frombuffer(b"".join(ids), "<u4"), minlength=size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([planes(x, wide) for x in ids], pa.binary()), pa.nulls(b.num_rows, pa.binary())], names=names)
        # a row more for each task: how often it has each id
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    work = new_path(spark, "token-ids")
    schema = "doc_id long, n long, ids binary, counts binary"
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokens, schema).write.option("compression", "zstd").parquet(work)
    both = spark.read.schema(schema).parquet(work)
    encoded = both.where("counts is null").drop("counts")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    # at most a row for each id of the vocabulary comes to the driver
    per_id = both.where("counts is not null").select("counts").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in per_id.collect():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    held = spark.sparkContext.broadcast(lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(held.value), TaskContext.get().partitionId()
        rows, ids, before, no = [], 0, 0, 0

        def block() -> pa.RecordBatch:
            who, n, data, marks = zip(*rows, strict=True)
            none = np.array([w is None for w in who], np.uint8).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (no, pa.int32()), (before, pa.int64()), (ids, pa.int64()), (np.array([w or 0 for w in who], "<i8").tobytes(), pa.binary()), (none, pa.binary()), (np.array(n, "<u4").tobytes(), pa.binary()), (np.array(list(map(len, data)), "<u4").tobytes(), pa.binary()), (b"".join(marks), pa.binary()), (b"".join(data), pa.binary()))],
                names=["part", "block", "before", "n_ids", "doc_ids", "nulls", "lengths", "sizes", "marks", "data"],
            )

        for b in batches:
            own = [unplanes(x.as_py(), wide) for x in b.column(1)]
            n = np.array(list(map(len, own)), np.int64)
            if not len(n):
                continue
            data, sizes, marks = code.encode(np.concatenate(own), np.cumsum(n) - n)
            runs, cut = -(-n // RUN), np.cumsum(sizes)
            for who, m, d, c, r, k in zip(b.column(0).to_pylist(), n.tolist(), sizes.tolist(), cut.tolist(), runs.tolist(), np.cumsum(runs).tolist(), strict=True):
                if ids >= BLOCK:
                    yield block()
                    before, no, rows, ids = before + ids, no + 1, [], 0
                rows.append((who, m, data[c - d : c].tobytes(), marks[k - r : k].tobytes()))
                ids += m
        if rows:
            yield block()

    # parts are ranges of doc_id, as many as the ids need; rows of one id, or without one, are spread too
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    placed = encoded.select("doc_id", "ids", F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange(max(1, -(-int(counts.sum()) // PART)), *order).sortWithinPartitions(*order)
    made = ordered.select("doc_id", "ids").mapInArrow(blocks, BLOCKS)
    made.write.option("compression", "none").parquet(f"{path}/blocks")
    drop(spark, work)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids are little-endian unsigned 32-bit integers."""
    lengths = {r["id"]: r["bits"] for r in spark.read.schema("id int, bits int").parquet(f"{path}/code").collect()}
    table = np.zeros(max(lengths, default=0) + 1, np.uint8)
    table[list(lengths)] = list(lengths.values())
    held = spark.sparkContext.broadcast(table)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # the ids before each part: over a row for each part
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    firsts, _ = stored(sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first")), "token-parts")
    blocks = blocks.join(firsts, "part").withColumn("before", F.col("first") + F.col("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(held.value)
        for b in batches:
            for k in range(b.num_rows):
                row = {name: b.column(name)[k].as_py() for name in b.schema.names}
                n, sizes = np.frombuffer(row["lengths"], "<u4").astype(np.int64), np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                ids = code.decode(row["data"], n, sizes, np.frombuffer(row["marks"], "<u2")).astype("<u4")
                ends = np.cumsum(n)
                start = row["before"] + ends - n
                raw = memoryview(ids.tobytes())
                who = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([who, pa.array(start), pa.array(n), pa.array([bytes(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("before", "doc_ids", "nulls", "lengths", "sizes", "marks", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
