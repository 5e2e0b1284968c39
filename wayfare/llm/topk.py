"""Exact top-k inner products by columnar branch and bound.

Queries and candidates are packed into blocks, a row for each, of bounded bytes. A
block of queries meets the blocks of candidates in a join on ranges of candidates;
both sides stand in the shared folder, so nothing comes to the driver, and a task
holds some blocks and the k best of their queries.

Candidates stand in vertical layout, a row for each dimension, those with most mass
first. Scores add up one block of dimensions at a time; after each, what a pair has so
far plus the product of the norms of what remains must reach the query's k-th best
score. Candidates that no query of a tile needs, and queries that need none, are
compacted away; where few pairs are left, they go on as a list. What is left at the
end is exact. The first candidates of a task are scored in full and set the thresholds.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import small_batches, stored

DIMS = 8
#: Queries of a tile, which are alike; candidates that set the first thresholds.
TILE, SEED = 16, 256
#: Share of pairs under which they go on as a list.
SPARSE = 0.1
#: Bytes of a packed block; blocks of candidates in a range; blocks of queries whose best a task keeps at once.
BLOCK_BYTES, RANGE, HELD = 1 << 16, 64, 16
PACKED = "ids binary, width int, kind string, data binary"
OUT = "query_id long, vec_id long, score long"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of vectors; shorter ones end in zeros, which leave inner products alone."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def packed(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Rows (vec_id, v) in blocks of about ``block_bytes``, in the smallest whole numbers that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            low, high = x.min(initial=0), x.max(initial=0)
            kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
            step = max(1, block_bytes // max(1, x.shape[1] * np.dtype(kind).itemsize))
            parts = [(ids[a : a + step].tobytes(), x.shape[1], np.dtype(kind).name, x[a : a + step].astype(kind).tobytes()) for a in range(0, len(ids), step)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.binary(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["ids", "width", "kind", "data"])

    return rows.mapInArrow(run, PACKED)


def unpacked(ids: bytes, width: int, kind: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(data, kind).reshape(len(own), width).astype(np.int64)


class Best:
    """The k best candidates of each query so far. evaluated and possible count pairs times blocks of dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k, n = k, len(ids)
        # queries that are alike stand side by side: by the nearest of some of them
        near = vectors.astype(np.float64) @ vectors[:: max(1, TILE)].astype(np.float64).T
        order = np.argsort(near.argmax(1), kind="stable") if n else np.arange(0)
        self.ids, self.vectors = ids[order], vectors[order]
        self.score = np.full((n, k), np.iinfo(np.int64).min, np.int64)
        self.vec = np.zeros((n, k), np.int64)
        self.count = np.zeros(n, np.int64)
        self.evaluated = self.possible = 0

    def least(self) -> np.ndarray:
        """What a candidate must reach; anything, while there are fewer than k."""
        return np.where(self.count == self.k, self.score[:, -1].astype(np.float64), -np.inf)

    def merge(self, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        """q: query rows, in order."""
        hit = np.unique(q)
        old = np.arange(self.k) < self.count[hit, None]
        qs = np.concatenate([np.broadcast_to(hit[:, None], old.shape)[old], q])
        vs, ss = np.concatenate([self.vec[hit][old], vec]), np.concatenate([self.score[hit][old], score])
        order = np.lexsort((vs, -ss, qs))
        qs, vs, ss = qs[order], vs[order], ss[order]
        first = np.searchsorted(qs, hit)
        place = np.arange(len(qs)) - np.repeat(first, np.diff([*first, len(qs)]))
        keep = place < self.k
        self.vec[qs[keep], place[keep]], self.score[qs[keep], place[keep]] = vs[keep], ss[keep]
        self.count[hit] = np.minimum(self.k, np.diff([*first, len(qs)]))

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Searches the candidates, rows of x."""
        if (self.count < self.k).any() and len(ids) > SEED:
            self.add(ids[:SEED], x[:SEED])
            ids, x = ids[SEED:], x[SEED:]
        width = max(self.vectors.shape[1], x.shape[1])
        wide = [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (self.vectors, x)]
        top = float(np.abs(wide[0]).max(initial=0)) * float(np.abs(wide[1]).max(initial=0)) * max(width, 1)
        kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else object  # in which all sums are exact
        if kind is object:
            for at in range(len(self.ids)):
                scores = wide[1].astype(object) @ wide[0][at].astype(object)
                keep = np.flatnonzero(ids != self.ids[at])
                self.merge(np.full(len(keep), at), ids[keep], np.clip(scores[keep], -(2**63), 2**63 - 1).astype(np.int64))
            return
        order = np.argsort(-(wide[1].astype(np.float64) ** 2).sum(0), kind="stable")
        down = np.ascontiguousarray(wide[1][:, order].astype(kind).T)
        queries = wide[0][:, order].astype(kind)
        starts = list(range(0, width, DIMS)) or [0]
        rest = lambda m, axis: [np.sqrt((m.take(range(a + DIMS, width), axis).astype(np.float64) ** 2).sum(axis)).astype(np.float32) * np.float32(1.00001) for a in starts]
        rest_c, rest_q = rest(down, 0), rest(queries, 1)
        for lo in range(0, len(self.ids), TILE):
            tile = np.arange(lo, min(lo + TILE, len(self.ids)))
            self.possible += len(tile) * len(ids) * len(starts)
            q, scores, c = self.reach(tile, down, queries, starts, rest_q, rest_c)
            own = self.ids[q] != ids[c]
            if own.any():
                by_query = np.argsort(q[own], kind="stable")
                self.merge(q[own][by_query], ids[c[own][by_query]], scores[own][by_query].astype(np.int64))

    def reach(self, rows: np.ndarray, down: np.ndarray, queries: np.ndarray, starts: list[int], rest_q: list[np.ndarray], rest_c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query rows, scores and candidates of the pairs that may be among the best."""
        cols = np.arange(down.shape[1])
        need = self.least()
        need = need - 1e-3 - 1e-6 * np.abs(np.where(np.isfinite(need), need, 0.0))
        sums = np.zeros((len(rows), len(cols)), queries.dtype)
        pairs = None
        for n, a in enumerate(starts):
            block = slice(a, a + DIMS)
            if pairs is None:
                self.evaluated += sums.size
                sums = sums + queries[rows, block] @ down[block, cols]
                alive = sums + rest_q[n][rows, None] * rest_c[n][cols] >= need[rows, None]
                if np.count_nonzero(alive) < SPARSE * alive.size:
                    i, j = np.nonzero(alive)
                    pairs, got = (rows[i], cols[j]), sums[i, j]
                elif not alive.all():
                    r, c = alive.any(1), alive.any(0)
                    rows, cols, sums = rows[r], cols[c], sums[r][:, c]
            else:
                self.evaluated += len(got)
                got = got + np.einsum("ij,ji->i", queries[pairs[0], block], down[block, pairs[1]])
                keep = got + rest_q[n][pairs[0]] * rest_c[n][pairs[1]] >= need[pairs[0]]
                pairs, got = (pairs[0][keep], pairs[1][keep]), got[keep]
        if pairs is not None:
            return pairs[0], got, pairs[1]
        if len(cols) > self.k:  # at least the k-th best of these, or the one after it where one is the query itself
            floor = np.partition(sums, len(cols) - self.k - 1, 1)[:, len(cols) - self.k - 1]
            i, j = np.nonzero(sums >= np.maximum(need[rows], floor)[:, None])
        else:
            i, j = np.nonzero(sums >= need[rows][:, None])
        return rows[i], sums[i, j], cols[j]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.ids), 1000):
            there = np.arange(self.k) < self.count[lo : lo + 1000, None]
            ids = np.broadcast_to(self.ids[lo : lo + 1000, None], there.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a[there], pa.int64()) for a in (ids, self.vec[lo : lo + 1000], self.score[lo : lo + 1000])], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, block_bytes: int = BLOCK_BYTES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Components x become floor(scale * x). Queries are the rows whose id is divisible
    by ``every``, candidates all rows but those with the query's own id; equal scores
    go to the smaller id. Rows whose id or vector is null, or whose vector holds null
    or non-finite components, take no part; an empty vector is a zero vector, a
    shorter one ends in zeros. Repeated candidates each count; rows that repeat a
    query's id are one query, the one with the largest vector in array order.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.col("v")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    clean = clean.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    asked = clean.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    queries, _ = stored(packed(asked, block_bytes).withColumn("block", F.monotonically_increasing_id()), "topk-queries")
    candidates, _ = stored(packed(clean, block_bytes).withColumn("place", F.monotonically_increasing_id()), "topk-candidates")
    # as many ranges as keep all cores busy, and more where they would have more than RANGE blocks
    blocks = candidates.count()
    ranges = max(1, -(-blocks // RANGE), min(blocks, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left = queries.select("block", *(F.col(c).alias(f"q_{c}") for c in ("ids", "width", "kind", "data"))).withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    right = candidates.select(F.pmod(F.xxhash64("place"), F.lit(ranges)).cast("int").alias("range"), "ids", "width", "kind", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Best] = OrderedDict()
        for batch in batches:
            for at, block in enumerate(batch.column(0).to_pylist()):
                row = [c[at].as_py() for c in batch.columns[1:]]
                if block not in held:
                    held[block] = Best(*unpacked(*row[:4]), k)
                held.move_to_end(block)
                held[block].add(*unpacked(*row[4:]))
                if len(held) > HELD:
                    yield from held.popitem(last=False)[1].rows()
        for best in held.values():
            yield from best.rows()

    met = left.join(right.hint("merge"), "range").select("block", "q_ids", "q_width", "q_kind", "q_data", "ids", "width", "kind", "data")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.mapInArrow(run, OUT).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB, over a table embeddings: all pairs of queries and candidates.
SQL = """
with clean as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i]))::bigint as score
  from clean q join clean c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0)
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored) where rank <= 20
"""
