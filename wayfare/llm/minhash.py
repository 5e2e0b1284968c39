"""Near-duplicate components by MinHash bands and sequential Bayesian verification.

Documents with equal shingle sets are one class from the start. Classes that
agree in all rows of a band are candidates. A candidate pair's signatures are
compared batch by batch; it is dropped as soon as the posterior probability of a
similarity at or over the threshold, given the matches so far and a uniform
prior, is below ``MISS``. Survivors are verified on the full shingle sets.

Only components matter, so no bucket is expanded into its pairs as long as its
members can be connected otherwise:

1. every class is checked against the smallest class that it shares a bucket with;
2. every class against the smallest of each of its buckets, if they aren't connected yet;
3. the classes of buckets whose members still aren't all connected across components,
   where their rarest shingles allow the similarity: an exact search by the order of
   their shingles. A set is found by the first shingles of its own (``1 - 2t / (1 + t)`` of
   them, a seventh at 0.75) among the first quarter of another's, so texts that share a
   passage, or most of a text but less than they must, never meet in what they share. Sets whose first
   shingles are common too meet in the buckets that they share, block by block: signatures and
   parity maps are compared in the task, and only pairs that pass both are written down.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.blocks import LEAST, alike, folded, meetings, parity
from wayfare.llm.common import drop, small_batches, stored

WORDS = 5
BANDS, ROWS = 48, 5
HASHES = BANDS * ROWS
STEP = 40
#: Chance to drop a pair at the threshold in a batch. A pair of similarity 0.75 shares none of the bands with chance (1 - 0.75**5)**48 = 2.3e-6.
MISS = 1e-7
#: Beyond so many rows ids of candidates are joined by a shuffle instead of a broadcast.
BROADCAST_IDS = 500_000
#: Characters whose shingles are hashed side by side.
AT_ONCE = 1 << 18
#: Sets that have a shingle among their first, beyond which they meet in buckets instead.
COMMON = 64
#: Words of 64 bits of the smallest parity map, which stand beside a set's first shingles.
MAP = [f"bits{k}" for k in range(LEAST // 8)]
#: Slots of the sketch of shingle counts, and the bits of a shingle's hash below its slot.
COUNTERS, SLOT = 1 << 20, np.uint64(44)

_rng = np.random.default_rng(20240117)
FACTORS = (_rng.integers(0, 2**31, HASHES, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
OFFSETS = _rng.integers(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """sets_of(), some texts at a time."""
    out, some, held = [], [], 0
    for t in texts:
        some.append(t)
        held += len(t or "")
        if held >= AT_ONCE:
            out += sets_of(some, words)
            some, held = [], 0
    return out + sets_of(some, words) if some else out


def sets_of(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's set of shingles as sorted 64-bit hashes: words between ASCII white
    space, A-Z lower-cased, some at a time; all words as one where there are fewer."""
    raw = [(t or "").encode().lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in raw], np.int64)
    code = np.frombuffer(b"".join(t + b" " for t in raw), np.uint8)
    blank = (code == 32) | ((code >= 9) & (code <= 13))
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    at = np.flatnonzero(begins)
    empty = np.zeros(0, np.uint64)
    if not len(at):
        return [empty] * len(texts)
    small = np.int32 if len(code) < 2**31 else np.int64
    word = np.cumsum(begins, dtype=small) - 1
    inside = np.where(blank, small(0), np.arange(len(code), dtype=small) - at.astype(small)[np.maximum(word, 0)])
    del word
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(inside.max()), 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)
    value = np.where(blank, np.uint64(0), (code.astype(np.uint64) + np.uint64(1)) * powers[inside])
    every = mixed(np.add.reduceat(value, at))
    first = np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)]))
    count = np.diff(first)
    some = mixed(sum((every[k : len(every) - words + 1 + k] * np.uint64(pow(0xD1342543DE82EF95, k + 1, 2**64)) for k in range(words)), np.uint64(0))) if len(every) >= words else empty
    out = []
    for a, n in zip(first[:-1].tolist(), count.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(some[a : a + n - words + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for k in range(a, a + n):
                whole = mixed(whole * np.uint64(0xA0761D6478BD642F) + every[k : k + 1])
            out.append(whole)
        else:
            out.append(empty)
    return out


def signature(own: np.ndarray) -> np.ndarray:
    x = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(least, (FACTORS[:, None] * x[lo : lo + 2048] + OFFSETS[:, None]).min(1), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: its number and its rows."""
    key = np.arange(BANDS, dtype=np.uint64)
    for row in sig.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0xA0761D6478BD642F) + row.astype(np.uint64))
    return key.view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """After each batch, the matches that a pair needs to stay.

    With a uniform prior the posterior of the chance p of a match after m of n is
    Beta(m + 1, n - m + 1), and P(p >= t) the chance of at most m successes in n + 1
    trials at t. Signatures keep a byte of each hash, so p is J + (1 - J) / 256.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        at_most, m = 0.0, -1
        while at_most < miss:
            m += 1
            at_most += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, label): the smallest node of each node's component, of edges (a, b). Labels spread along edges and are followed to their own label, until nothing changes."""
    spark = edges.sparkSession
    both, at_edges = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    labels, at = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
    while True:
        # both sides of each join are plain tables, so a node with very many edges is split
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), "label")
        follow = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        new, new_at = stored(spread.join(follow, "new", "left").select("node", F.least(F.col("new"), F.col("further")).alias("label"), F.col("label").alias("old")), "near-labels")
        changed = new.where("label <> old").limit(1).count()
        drop(spark, at)
        labels, at = new.select("node", "label"), new_at
        if not changed:
            drop(spark, at_edges)
            return labels, at


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label, n, own) with the parity map in place of the set."""
    for b in batches:
        bits = [parity(np.frombuffer(v.as_buffer(), np.uint64)) for v in b.column(3)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bits, pa.binary())], names=["node", "label", "n", "bits"])


def _judge(percent: int):
    """Of two sets of a bucket whether sizes, signatures and parity maps allow the similarity."""
    least = least_matches(percent / 100)

    def judge(cols: dict[str, pa.Array]):
        n = cols["n"].to_numpy()
        sig = np.frombuffer(b"".join(cols["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
        maps = alike(n, cols["bits"].to_pylist(), percent)

        def passes(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            stays = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            stays = stays[maps(i[stays], j[stays])]
            matches = np.zeros(len(stays), np.int64)
            for k, need in enumerate(least):
                part = slice(k * STEP, (k + 1) * STEP)
                matches = matches + (sig[i[stays], part] == sig[j[stays], part]).sum(1)
                kept = matches >= need
                stays, matches = stays[kept], matches[kept]
            out = np.zeros(len(i), bool)
            out[stays] = True
            return out

        return passes

    return judge


class Search:
    """The state of one run: classes, and the components found so far."""

    def __init__(self, spark: SparkSession, docs: DataFrame, percent: int):
        self.spark, self.docs, self.percent, self.paths = spark, docs, percent, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        self.paths.append(path)
        return df

    def sign(self) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = shingles(b.column(1).to_pylist())
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([None if s is None else band_keys(s) for s in sigs], pa.list_(pa.int64())),
                        pa.array([None if s is None else s.astype(np.uint8).tobytes() for s in sigs], pa.binary()),
                    ],
                    names=["doc_id", "n", "digest", "keys", "sig"],
                )

        self.signed = self.keep(self.docs.mapInArrow(run, "doc_id long, n long, digest binary, keys array<long>, sig binary"), "near-signed")
        full = self.signed.where("n > 0")
        # copies meet map-side first
        reps = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "keys", "sig"), "doc_id").alias("x"))
        self.classes = self.keep(reps.select("digest", "rep", "x.n", "x.keys", "x.sig"), "near-classes")

    def buckets(self) -> None:
        """(key, node, pivot): the classes of each bucket with more than one, and the smallest of it."""
        entries = self.classes.where("rep is not null").select(F.explode("keys").alias("key"), F.col("rep").alias("node"))
        shared = self.keep(entries.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "pivot"), "near-shared")
        self.members = self.keep(entries.join(shared, "key").select("key", "node", "pivot"), "near-members")

    def label(self, df: DataFrame, node: str, name: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(name, F.col(node))
        return df.join(self.labels.select(F.col("node").alias(node), F.col("label").alias("__label")), node, "left").withColumn(name, F.coalesce("__label", node)).drop("__label")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that are linked."""
        least, percent = least_matches(self.percent / 100), self.percent
        sigs = self.classes.select(F.col("rep").alias("node"), "sig")
        both = pairs.join(sigs.toDF("b", "sig_b"), "b").join(sigs.toDF("a", "sig_a"), "a").select("a", "b", "sig_a", "sig_b")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
                stays, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                for k, need in enumerate(least):
                    part = slice(k * STEP, (k + 1) * STEP)
                    matches = matches + (x[stays, part] == y[stays, part]).sum(1)
                    kept = matches >= need
                    stays, matches = stays[kept], matches[kept]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(stays)), batch.column(1).take(pa.array(stays))], names=["a", "b"])

        left = self.keep(both.mapInArrow(compare, "a long, b long").distinct(), "near-survivors")
        sets = self.sets.select("node", "own")
        rows = left.join(sets.toDF("b", "own_b"), "b").join(sets.toDF("a", "own_a"), "a").select("a", "b", "own_a", "own_b")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                linked = [similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair), percent) for pair in zip(batch.column(2), batch.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(linked, pa.bool_())), batch.column(1).filter(pa.array(linked, pa.bool_()))], names=["a", "b"])

        return self.keep(rows.mapInArrow(verify, "a long, b long"), "near-links")

    def connect(self, links: DataFrame) -> bool:
        """Joins components by the links between them; whether there were any."""
        edges = self.label(self.label(links, "a", "la"), "b", "lb").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        edges = self.keep(edges, "near-between")
        if not edges.limit(1).count():
            return False
        found, path = components(edges)
        self.paths.append(path)
        if self.labels is None:
            self.labels = found
            return True
        # classes that had a label get their label's new one; labels that had been classes of their own come new
        old = self.label_of(found)
        new = found.join(self.labels, "node", "left_anti")
        self.labels = self.keep(old.unionByName(new), "near-labelled")
        return True

    def label_of(self, found: DataFrame) -> DataFrame:
        return self.labels.join(found.toDF("label", "__new"), "label", "left").select("node", F.coalesce("__new", "label").alias("label"))

    def gather(self) -> None:
        """(node, n, own): the sets of the classes that share a bucket, as sorted hashes, for all that follows."""
        ids = self.keep(self.members.select("node").distinct(), "near-ids")
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        texts = self.docs.join(wanted, self.docs["doc_id"] == wanted["node"], "left_semi").select("doc_id", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = shingles(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "own"])

        self.sets = self.keep(texts.mapInArrow(run, "node long, n long, own binary"), "near-sets")

    def apart(self) -> DataFrame:
        """Pairs of classes that lie in buckets with several components, in different ones, and may be similar.

        Exact but for sets whose first shingles over ``COMMON`` others have among theirs, which
        crowd() finds by their bands: let the sets' shingles stand in one order, rare ones first, and two sets have sizes m <= n. They can only share the p shingles that they must, t / (1 + t) of m + n,
        if one of the first m - ceil(2t / (1 + t) * m) + 1 of the smaller is among the first
        n - ceil(t * n) + 1 of the larger, with enough left behind both places. The larger has at most m / t
        shingles, so sets meet in steps of their size by that ratio, a step up at most. A small parity map
        beside each shingle drops pairs in the join that differ in too many, without error.
        Rarity is by a sketch of ``COUNTERS`` sums, which is what comes to the driver; any order is right.
        """
        percent = self.percent
        rows = self.label(self.members.select("key", "node"), "node", "label")
        mixed_keys = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        mixed_keys = self.keep(mixed_keys, "near-mixed")
        nodes = self.keep(rows.join(mixed_keys, "key").select("node", "label").distinct(), "near-nodes")
        own = nodes.join(self.sets, "node").select("node", "label", "n", "own")
        total = own.agg(F.sum("n").alias("n")).first()["n"] or 0
        own = self.keep(own.repartition(1 + total // AT_ONCE), "near-apart")

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(COUNTERS, np.int64)
            for batch in batches:
                slots = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) >> SLOT
                total += np.bincount(slots.astype(np.int64), minlength=COUNTERS)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

        sums = own.select("own").mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        rarity = np.zeros(COUNTERS, np.int32)
        rarity[sums.column("slot").to_numpy()] = np.minimum(sums.column("n").to_numpy(), 2**31 - 1)
        held = self.spark.sparkContext.broadcast(rarity)

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first, place, index, maps = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)], []
                for value in batch.column(3):
                    x = np.frombuffer(value.as_buffer(), np.uint64)
                    n = len(x)
                    order = np.lexsort((x, held.value[(x >> SLOT).astype(np.int64)]))[: n - -(-percent * n // 100) + 1]
                    first.append(x[order].view(np.int64))
                    place.append(np.arange(1, len(order) + 1, dtype=np.int32))
                    index.append(place[-1] <= n - -(-2 * percent * n // (100 + percent)) + 1)
                    maps.append(np.frombuffer(folded(parity(x)), np.int64))
                many = np.array(list(map(len, first[1:])), np.int64)
                again = [np.repeat(c, many) for c in (*(batch.column(k).to_numpy() for k in (0, 1, 2)), *np.array(maps, np.int64).reshape(-1, len(MAP)).T)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(place)), pa.array(np.concatenate(index)), *map(pa.array, again)], names=["shingle", "place", "index", "node", "label", "n", *MAP])

        schema = ", ".join(["shingle long, place int, index boolean, node long, label long, n long", *(f"{m} long" for m in MAP)])
        heads = self.keep(own.mapInArrow(prefixes, schema), "near-heads")
        # of each shingle the component that most have it in: of two in different components one isn't in that
        per = heads.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c"), F.count_if("index").alias("i")).groupBy("shingle")
        per = per.agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("all"), F.sum("i").alias("indexed"))
        every = self.keep(per.where("labels > 1 and indexed > 0").select("shingle", "main", (F.col("all") > COMMON).alias("common")), "near-heads-shared")
        shared = every.where("not common").drop("common")
        held_by = heads.join(every.where("common").select("shingle"), "shingle", "left_semi").select("node").distinct()
        crowded = self.keep(own.join(held_by, "node", "left_semi").mapInArrow(_maps, "node long, label long, n long, bits binary"), "near-crowded")
        self.crowded = self.keep(self.members.select("key", "node").join(mixed_keys, "key").join(crowded.select("node"), "node", "left_semi"), "near-crowded-keys")
        self.traits = crowded.drop("label").join(self.classes.select(F.col("rep").alias("node"), "sig"), "node")
        step = F.floor(F.log(F.col("n").cast("double")) / math.log(max(100 / percent, 1.01)) + 1e-9)
        open_ = self.keep(heads.join(shared, "shingle").withColumn("step", step).withColumn("rare", F.col("label") != F.col("main")), "near-heads-open")
        side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("place", "node", "label", "n", "rare", *MAP)]
        x = open_.where("index").select("shingle", F.explode(F.array("step", F.col("step") + 1)).alias("step"), *side("x"))
        y = open_.select("shingle", "step", *side("y"))
        share = F.ceil(F.lit(percent) * (F.col("x_n") + F.col("y_n")) / (100 + percent))
        left = F.lit(1) + F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
        differ = sum((F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in MAP), F.lit(0))
        near = (100 * F.col("x_n") >= percent * F.col("y_n")) & (left >= share) & (differ <= F.col("x_n") + F.col("y_n") - 2 * share) & (F.struct("x_n", "x_node") < F.struct("y_n", "y_node"))
        met = x.where("x_rare").join(y, ["shingle", "step"]).unionByName(x.where("not x_rare").join(y.where("y_rare"), ["shingle", "step"]))
        pairs = met.where((F.col("x_label") != F.col("y_label")) & near)
        return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()

    def crowd(self, forest: bool) -> DataFrame:
        """Pairs of the crowded sets, in different components, that share a bucket and may be similar."""
        entries = self.keep(self.label(self.crowded, "node", "label"), "near-crowded-labels")
        return meetings(entries, self.traits, _judge(self.percent), forest)

    def run(self) -> DataFrame:
        self.labels: DataFrame | None = None
        self.sign()
        self.buckets()
        self.gather()
        pivots = self.members.where("node <> pivot")
        self.connect(self.verified(pivots.groupBy(F.col("node").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b")))
        stars = pivots.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        stars = self.label(self.label(stars, "a", "la"), "b", "lb").where("la <> lb").select("a", "b")
        self.connect(self.verified(stars))
        self.connect(self.verified(self.apart()))
        # crowded buckets are connected by few of their pairs; then all pairs that are left are verified
        self.connect(self.verified(self.crowd(True)))
        self.connect(self.verified(self.crowd(False)))

        of_class = self.keep(self.label(self.classes.select("digest", F.col("rep").alias("node")), "node", "label"), "near-of-class")
        got = self.signed.where("n > 0").select("doc_id", "n", "digest").join(of_class.select("digest", "label"), "digest").select("doc_id", "n", F.col("label").alias("component_id"))
        got = got.union(self.signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
        kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
        out, _ = stored(got.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept")), "near-components")
        drop(self.spark, *self.paths)
        return out


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked if 100 * intersection >= percent * union of their shingle
    sets. component_id is the smallest id reachable over links. Texts that are
    null, empty or white space have no shingles and no links. Ids are whole numbers, as columns or text of them. Rows that share an id
    count as linked; rows with a null id follow the documents with an equal set,
    and have a null component, and are kept, where there are none. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    return Search(spark, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), percent).run()
