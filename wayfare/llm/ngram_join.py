"""Jaccard join of word n-grams by prefixes of token combinations.

Documents with equal shingle sets are one class from the start. The shingles of a
set stand in one order for all, rare ones first, by a sketch of counts over all
documents; two sets that are similar enough can't both have all of their first
shingles alone. A rare shingle of such a prefix is a key by itself. Frequent ones
are keys only by twos, very frequent ones by threes: the classes of frequent
shingles are cut by hash into parts, a part counts for a pair only if it shares
k of its shingles, and the prefix goes on until it holds as many shingles more as
parts can hide (k - 1 each). Parts grow in number with the prefix, so a text has a
number of keys in proportion to its length, however frequent its shingles are.

Whatever class holds k shared shingles of the prefix that ends first, the other
prefix holds them too, so similar sets share a key. Of keys with few sets all
pairs are looked at. Of others the sets meet one of them first; keys whose sets aren't
all connected then meet in blocks. Pairs pass a bound by parity maps and are verified on the full sets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wayfare.llm.blocks import alike, meetings, parity
from wayfare.llm.common import drop, small_batches, stored
from wayfare.llm.minhash import BROADCAST_IDS, components, mixed, shingles, similar

WORDS, PERCENT = 4, 85
#: Counters of the sketch, of which a chunk is a row; rows that are summed in one group.
COUNTERS, CHUNK, FAN = 1 << 23, 1 << 17, 256
SLOT = np.uint64(41)
#: Shingles that a task holds before it counts them.
HELD = 1 << 19
#: Counts over this many times a counter's mean make a shingle frequent, and 16 times that very frequent; FLOOR at least.
TIMES, FLOOR, VERY = 4, 512, 16
#: Shingles of a prefix for each part of the class by twos, and of that by threes.
TWOS, THREES = 4, 6
#: Sets of a key up to which all its pairs are looked at, and rows that are scanned at once.
FEW, ROWS = 8, 1 << 16
#: Rounds in which the sets of a key meet one of it, before those that are left meet in blocks.
ROUNDS = 2
BOTH, PROBE, INDEX = 3, 2, 1


def needs(n: int, percent: int) -> tuple[int, int]:
    """How many of a set's first shingles a similar set can't all lack: one of the same size at least, and any."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


@lru_cache(maxsize=8)
def steps(percent: int) -> np.ndarray:
    """The least size of each step; sets of sizes in one or two neighbouring steps may be similar, others can't."""
    out = [1]
    while out[-1] < 1 << 34:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def parts(step: int, percent: int) -> tuple[int, int]:
    """Into how many parts the two frequent classes are cut where sets meet in a step; 0 where sets are too small for classes."""
    least, low, high = (int(steps(percent)[max(0, step + k)]) for k in (-1, 0, 1))
    need = needs(low, percent)[1]
    two, three = max(1, need // TWOS), max(1, need // THREES)
    return (two, three) if least - two - 2 * three >= needs(high, percent)[1] else (0, 0)


def combined(tokens: np.ndarray, kind: np.ndarray, step: int, percent: int, need: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Where the prefix ends that needs ``need`` countable shingles, and its combined keys, which differ from step to step, with the place of each one's last shingle.

    tokens are in order, kind says how many of each are a key.
    """
    own = parts(step, percent)
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not own[0]:
        return need, *nothing
    rare = int(np.searchsorted(kind, 2))
    place = count = min(rare, need)
    held: dict[tuple[int, int], list[int]] = {}
    some: tuple[list[tuple[int, ...]], list[tuple[int, ...]]] = [], []
    for k, token in zip(kind[place:].tolist(), tokens[place:].tolist(), strict=True):
        if count >= need:
            break
        mates = held.setdefault((k, token % own[k - 2]), [])
        some[k - 2].extend((*c, place) for c in combinations(mates, k - 1))
        mates.append(place)
        count += len(mates) >= k
        place += 1
    keys, ends = [nothing[0]], [nothing[1]]
    for k, rows in enumerate(some, 2):
        if rows:
            at = np.array(rows)
            x = np.full(len(at), step * 4 + k, np.uint64)
            for c in range(k):
                x = mixed(x * np.uint64(0xA0761D6478BD642F) + tokens[at[:, c]])
            keys.append(x)
            ends.append(at[:, -1])
    return place, np.concatenate(keys), np.concatenate(ends)


def keys_of(own: np.ndarray, level: np.ndarray, percent: int, frequent: int, very: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A set's keys, whether each is for the index, the probe or both, and the places of single ones (from 1; 0 for combined ones)."""
    n = len(own)
    step = int(np.searchsorted(steps(percent), n, "right")) - 1
    rank = level[(own >> SLOT).astype(np.int64)]
    index, probe = needs(n, percent)
    order = np.argsort(rank, kind="stable")  # own is sorted, so equal ranks stand by value
    tokens = own[order]
    kind = 1 + (rank[order] >= frequent).astype(np.int64) + (rank[order] >= very)
    rare = int(np.searchsorted(kind, 2))
    here, above = parts(step, percent)[0], parts(step + 1, percent)[0]
    alone = max(min(probe, rare) if here else probe, min(index, rare) if above else index)  # single keys
    place = np.arange(1, alone + 1, dtype=np.int64)
    keys, kinds = tokens[:alone], np.where(place <= index, BOTH, PROBE)
    if here and probe > rare:
        _, found, at = combined(tokens, kind, step, percent, probe)
        ends = combined(tokens, kind, step, percent, index)[0]
        keys = np.concatenate([keys, found])
        kinds = np.concatenate([kinds, np.where(at < ends, BOTH, PROBE)])
    if above and index > rare:
        _, found, _ = combined(tokens, kind, step + 1, percent, index)
        keys = np.concatenate([keys, found])
        kinds = np.concatenate([kinds, np.full(len(found), INDEX)])
    place = np.concatenate([place, np.zeros(len(keys) - len(place), np.int64)])
    return keys, kinds, place


def _packed(counts: np.ndarray) -> bytes:
    """A chunk of counters: those that aren't 0 as steps and counts, or all."""
    at = np.flatnonzero(counts)
    kind = np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
    if 8 * len(at) < len(counts):
        return b"S" + zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + counts[at].astype(np.uint64).tobytes(), 1)
    return (b"D" if kind is np.uint32 else b"Q") + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data[1:])
    if data[:1] != b"S":
        return np.frombuffer(raw, np.uint32 if data[:1] == b"D" else np.uint64).astype(np.int64)
    n, out = len(raw) // 12, np.zeros(CHUNK, np.int64)
    out[np.cumsum(np.frombuffer(raw[: 4 * n], np.uint32))] = np.frombuffer(raw[4 * n :], np.uint64)
    return out


def may_be_alike(n: np.ndarray, spot: np.ndarray, node: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that share a key are of sizes, and have it at places, that allow the similarity, and it is for the smaller one's index and the other's probe."""
    kind, place = spot % 4, spot // 4
    swap = (n[i] > n[j]) | ((n[i] == n[j]) & (node[i] > node[j]))
    x, y = np.where(swap, j, i), np.where(swap, i, j)
    share = -(-percent * (n[x] + n[y]) // (100 + percent))
    left = 1 + np.minimum(n[x] - place[x], n[y] - place[y])
    same = n[x] == n[y]  # of equal sizes either may be the one in the index
    way = ((kind[x] & INDEX > 0) & (kind[y] & PROBE > 0)) | (same & (kind[y] & INDEX > 0) & (kind[x] & PROBE > 0))
    return way & (left >= share) & (n[x] >= share)


def _scanned(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, n, spot) in the order of key: pairs (a, b) of keys with up to ``FEW`` rows, and the rows of others as they are."""
    names = ["key", "a", "n", "spot", "b"]
    held: list[list[np.ndarray]] = []
    going: int | None = None  # a key with more rows than FEW, which may go on

    def out(key: np.ndarray, node: np.ndarray, n: np.ndarray, spot: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal going
        first = np.append(True, key[1:] != key[:-1])
        length = np.diff(np.append(np.flatnonzero(first), len(key)))
        run = np.repeat(length, length)
        many = (run > FEW) | (key == going if going is not None else np.zeros(len(key), bool))
        stay = 0
        if not last:
            if many[-1]:
                going = int(key[-1])
            else:
                stay, going = int(length[-1]), None
        end = len(key) - stay
        own = np.flatnonzero(many[:end])
        a, b, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], (n.astype(np.int64), spot.astype(np.int64), node)
        for d in range(1, FEW):
            i = np.flatnonzero((key[:end][d:] == key[:end][:-d]) & ~many[:end][d:]) if end > d else np.zeros(0, np.int64)
            ok = (node[i] != node[i + d]) & may_be_alike(*cells, i, i + d, percent)
            a.append(np.minimum(node[i], node[i + d])[ok])
            b.append(np.maximum(node[i], node[i + d])[ok])
        pairs = np.unique(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=0)
        k = len(pairs)
        columns = (
            pa.concat_arrays([pa.array(key[own]), pa.nulls(k, pa.int64())]),
            pa.array(np.append(node[own], pairs[:, 0])),
            pa.concat_arrays([pa.array(n[own], pa.int32()), pa.nulls(k, pa.int32())]),
            pa.concat_arrays([pa.array(spot[own], pa.int32()), pa.nulls(k, pa.int32())]),
            pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(pairs[:, 1])]),
        )
        yield pa.RecordBatch.from_arrays(list(columns), names=names)
        held[:] = [[c[end:] for c in (key, node, n, spot)]] if stay else []

    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
        if rows >= ROWS:
            yield from out(*map(np.concatenate, zip(*held, strict=True)), False)
            rows = sum(len(h[0]) for h in held)
    if held:
        yield from out(*map(np.concatenate, zip(*held, strict=True)), True)


class Join:
    """The state of one run."""

    def __init__(self, spark: SparkSession, docs: DataFrame, percent: int, words: int, floor: int):
        self.spark, self.docs, self.percent, self.words, self.floor, self.paths = spark, docs, percent, words, floor, []
        self.labels: DataFrame | None = None

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        self.paths.append(path)
        return df

    def sign(self) -> None:
        """Sizes and digests of all sets, and each task's counts of their shingles, from one reading of the texts."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "n", "digest", "chunk", "counts"]
            tally, held = np.zeros(COUNTERS, np.uint32), [np.zeros(0, np.uint64)]

            def count() -> None:
                np.add.at(tally, (np.concatenate(held) >> SLOT).astype(np.intp), np.uint32(1))
                held[:] = [np.zeros(0, np.uint64)]

            for b in batches:
                sets = shingles(b.column(1).to_pylist(), words)
                held += sets
                if sum(map(len, held)) > HELD:
                    count()
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                none = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), *none], names=names)
            count()
            packed = {k: _packed(own) for k in range(COUNTERS // CHUNK) if (own := tally[k * CHUNK : (k + 1) * CHUNK]).any()}
            none = pa.nulls(len(packed), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(packed), pa.binary()), pa.array(packed.keys(), pa.int32()), pa.array(packed.values(), pa.binary())], names=names)

        both = self.docs.mapInArrow(run, "doc_id long, n long, digest binary, chunk int, counts binary").withColumn("task", F.spark_partition_id())
        both = self.keep(both, "ngram-signed")
        self.signed = both.where("chunk is null").select("doc_id", "n", "digest")
        self.classes = self.keep(self.signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), "ngram-classes")
        self.sketch(both.where("chunk is not null").select("chunk", "counts", "task"))

    def sketch(self, tallies: DataFrame) -> None:
        """The levels of all counters, a byte each, and the levels from which shingles are frequent and very frequent."""

        def added(table: pa.Table) -> pa.Table:
            total = np.zeros(CHUNK, np.int64)
            for c in table.column("counts").to_pylist():
                total += _unpacked(c)
            return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": [_packed(total)], "task": table.column("lot").slice(0, 1)})

        tasks = (tallies.agg(F.max("task")).first()[0] or 0) + 1
        while True:  # a tree of sums, FAN rows to a group
            tallies = tallies.withColumn("lot", F.floor(F.col("task") / FAN).cast("int")).groupBy("chunk", "lot").applyInArrow(added, "chunk int, counts binary, task int")
            tasks = -(-tasks // FAN)
            if tasks == 1:
                break
        levels = lambda x: np.minimum(255, np.round(4 * np.log2(x + 1))).astype(np.uint8)
        self.level, total = np.zeros(COUNTERS, np.uint8), 0
        for chunk, packed, _ in tallies.collect():  # COUNTERS / CHUNK rows
            counts = _unpacked(packed)
            self.level[chunk * CHUNK : (chunk + 1) * CHUNK] = levels(counts)
            total += int(counts.sum())
        from_ = max(self.floor, TIMES * total / COUNTERS)
        self.frequent, self.very = int(levels(np.array(from_))), int(levels(np.array(VERY * from_)))

    def index(self) -> None:
        """entries (key, node, n, spot): the keys that more than ``FEW`` classes have, with place and kind as one number; few (a, b): the pairs of the others; heads (node, n, bits)."""
        held, percent, words, frequent, very = self.spark.sparkContext.broadcast(self.level), self.percent, self.words, self.frequent, self.very

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = shingles(b.column(1).to_pylist(), words)
                got = [keys_of(s, held.value, percent, frequent, very) if len(s) else (s, np.zeros(0, np.int64), np.zeros(0, np.int64)) for s in sets]
                flat = [np.concatenate([np.zeros(0, kind), *[g[c] for g in got]]) for c, kind in ((0, np.uint64), (1, np.int64), (2, np.int64))]
                cells = pa.StructArray.from_arrays([pa.array(flat[0].view(np.int64)), pa.array((flat[2] * 4 + flat[1]).astype(np.int32))], names=["key", "spot"])
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]), pa.int32()), cells)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(list(map(parity, sets)), pa.binary()), keys], names=["node", "n", "bits", "keys"])

        whole = self.docs.mapInArrow(run, "node long, n int, bits binary, keys array<struct<key: long, spot: int>>").where("n > 0")
        reps = self.classes.where("rep is not null").select(F.col("rep").alias("node"))
        reps = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps
        heads = self.keep(whole.join(reps, "node", "left_semi"), "ngram-heads")
        self.heads = heads.select("node", "n", "bits")
        # a key has a set once at most, so it holds a small part of all rows, however frequent it is
        ranged = heads.select("node", "n", F.inline("keys")).select("key", "node", "n", "spot").repartition("key").sortWithinPartitions("key")
        met = self.keep(ranged.mapInArrow(lambda batches: _scanned(batches, percent), "key long, a long, n int, spot int, b long"), "ngram-met")
        self.entries = met.where("key is not null").select("key", F.col("a").alias("node"), "n", "spot")
        self.few = met.where("key is null").select("a", "b").distinct()

    def gather(self) -> None:
        """(node, own): the sets of the classes that may have to be verified."""
        words = self.words
        near = self.near.select(F.explode(F.array("a", "b")).alias("node"))
        ids = self.keep(self.entries.select("node").unionByName(near).distinct(), "ngram-ids")
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingles(b.column(1).to_pylist(), words)], pa.binary())], names=["node", "own"])

        self.sets = self.keep(self.docs.join(wanted, self.docs["doc_id"] == wanted["node"], "left_semi").mapInArrow(run, "node long, own binary"), "ngram-sets")

    def labelled(self, df: DataFrame, node: str, name: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(name, F.col(node))
        return df.join(self.labels.select(F.col("node").alias(node), F.col("label").alias("__label")), node, "left").withColumn(name, F.coalesce("__label", node)).drop("__label")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those whose parity maps allow the similarity."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.num_rows
                n = np.concatenate([b.column(2).to_numpy(), b.column(3).to_numpy()])
                ok = pa.array(alike(n, [*b.column(4).to_pylist(), *b.column(5).to_pylist()], percent)(np.arange(rows), np.arange(rows, 2 * rows)) if rows else [], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

        side = lambda p: self.heads.select(F.col("node").alias(p), F.col("n").alias(f"n_{p}"), F.col("bits").alias(f"bits_{p}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that are linked, by their full sets."""
        percent = self.percent
        sets, left = self.sets, self.sets
        if pairs.count() <= BROADCAST_IDS:  # then only the sets in question are shuffled
            pairs = F.broadcast(pairs)
            left = sets.join(F.broadcast(pairs.select(F.col("a").alias("node")).distinct()), "node", "left_semi")
        rows = pairs.join(sets.toDF("b", "own_b"), "b").join(left.toDF("a", "own_a"), "a").select("a", "b", "own_a", "own_b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                linked = pa.array([similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair), percent) for pair in zip(b.column(2), b.column(3), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(linked), b.column(1).filter(linked)], names=["a", "b"])

        return self.keep(rows.mapInArrow(run, "a long, b long"), "ngram-links")

    def connect(self, links: DataFrame) -> bool:
        """Joins components by the links between them; whether there were any."""
        edges = self.keep(self.labelled(self.labelled(links, "a", "la"), "b", "lb").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")), "ngram-edges")
        if not edges.limit(1).count():
            return False
        found, path = components(edges)
        self.paths.append(path)
        if self.labels is None:
            self.labels = found
        else:
            old = self.labels.join(found.toDF("label", "__new"), "label", "left").select("node", F.coalesce("__new", "label").alias("label"))
            self.labels = self.keep(old.unionByName(found.join(self.labels, "node", "left_anti")), "ngram-labelled")
        return True

    def stars(self, round_: int) -> DataFrame:
        """Pairs of one class of each key and those of it that aren't connected with it; each round another one, of the label that most have."""
        own = self.labelled(self.entries.select("key", "node"), "node", "label")
        per = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.min_by("node", F.xxhash64("node", F.lit(round_))).alias("node"))
        pivot = per.groupBy("key").agg(F.max_by(F.struct("node", "label"), F.struct("c", "label")).alias("p"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        pivot = self.keep(pivot.select("key", F.col("p.node").alias("pivot"), F.col("p.label").alias("main")), "ngram-pivots")
        met = own.join(pivot, "key").where("label <> main")
        return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()

    def rest(self, forest: bool) -> DataFrame:
        """Pairs in different components that share a key and may be similar, from the keys with several components."""
        percent = self.percent
        own = self.labelled(self.entries, "node", "label")

        def judge(cols: dict[str, pa.Array]):
            n, spot, node = (cols[c].to_numpy().astype(np.int64) for c in ("n", "spot", "node"))
            check = alike(n, cols["bits"].to_pylist(), percent)

            def passes(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = may_be_alike(n, spot, node, i, j, percent)
                ok[ok] = check(i[ok], j[ok])
                return ok

            return passes

        return meetings(own, self.heads.select("node", "bits"), judge, forest)

    def run(self) -> DataFrame:
        self.sign()
        if self.percent < 100:
            self.index()
            self.near = self.keep(self.possible(self.few), "ngram-possible")
            self.gather()
            self.connect(self.verified(self.near))
            for k in range(ROUNDS):
                if not self.connect(self.verified(self.keep(self.possible(self.stars(k)), "ngram-possible"))):
                    break
            # what blocks find is connected by few of its pairs; then all pairs that are left are verified
            self.connect(self.verified(self.keep(self.rest(True), "ngram-rest")))
            self.connect(self.verified(self.keep(self.rest(False), "ngram-rest")))
        of_class = self.keep(self.labelled(self.classes.select("digest", F.col("rep").alias("node")), "node", "label"), "ngram-of-class")
        got = self.signed.where("n > 0").join(of_class.select("digest", "label"), "digest").select("doc_id", "n", F.col("label").alias("component_id"))
        got = got.union(self.signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
        out, _ = stored(got.select("doc_id", F.col("n").alias("n_shingles"), F.col("component_id").cast(LongType())), "ngram-components")
        drop(self.spark, *self.paths)
        return out


def join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", floor: int = FLOOR) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    ``words``-word shingles; component_id is the smallest id reachable over links.
    Texts that are null, empty or white space have no shingles and no links; texts
    with fewer words are one shingle. Ids are whole numbers, as columns or text of
    them. Rows that share an id count as linked. Rows with a null id are in the component of the documents with an
    equal set, and have a null component where there are none. An empty table gives
    an empty result. floor is the count below which no shingle is frequent.
    """
    small_batches(docs.sparkSession)
    return Join(docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), percent, words, floor).run()


#: The join's rows over documents.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
own AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM d),
s AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM own),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ WHERE 100 * c >= 85 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS label FROM own UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.node)
SELECT own.doc_id, len(own.s)::BIGINT AS n_shingles, min(r.label) AS component_id FROM own JOIN reach r ON r.node = own.doc_id GROUP BY ALL
"""
