"""Pairs within groups of any size: members meet in bounded blocks inside tasks, and only the pairs that pass are emitted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block; two blocks meet in one row.
BLOCK = 512
#: Pairs that are judged side by side.
AT_ONCE = 1 << 15
#: Bytes of the smallest parity map; sets of more elements have longer ones, of as many bits at least, always by powers of two.
LEAST = 32

Columns = dict[str, pa.Array]
#: From the columns of a batch's members, a function of two index arrays that says which pairs pass.
Judge = Callable[[Columns], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def parity(own: np.ndarray) -> bytes:
    """A bit for each residue of the set's hashes: whether an odd number of them has it.

    Bits in which two maps differ are at most the shingles that one set has and the
    other lacks, so they bound the similarity from above, without error.
    """
    size = LEAST
    while size * 8 < len(own):
        size *= 2
    odd = np.bincount((own & np.uint64(size * 8 - 1)).astype(np.int64), minlength=size * 8) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int = LEAST) -> bytes:
    """The map of the same set with fewer bits."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def most_apart(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The elements that sets of these sizes may have alone, if their similarity is to be percent at least."""
    both = x + y
    return both - 2 * -(-percent * both // (100 + percent))


def alike(n: np.ndarray, maps: list[bytes], percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Says of pairs of sets whether their parity maps allow the similarity: those of the least size first, then those of the smaller of the two sizes."""
    stack = lambda some, size: np.frombuffer(b"".join(folded(m, size) for m in some), np.uint64).reshape(len(some), -1)
    small, sizes = stack(maps, LEAST), np.array(list(map(len, maps)), np.int64)

    def check(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = most_apart(n[i], n[j], percent)
        ok = np.bitwise_count(small[i] ^ small[j]).sum(1, dtype=np.int64) <= most
        size = np.minimum(sizes[i], sizes[j])
        for s in np.unique(size[ok]).tolist():
            if s > LEAST:
                pair = np.flatnonzero(ok & (size == s))
                used, where = np.unique(np.concatenate([i[pair], j[pair]]), return_inverse=True)
                wide = stack([maps[k] for k in used.tolist()], s)
                x, y = where[: len(pair)], where[len(pair) :]
                for lo in range(0, len(pair), 4096):
                    part = slice(lo, lo + 4096)
                    ok[pair[part]] = np.bitwise_count(wide[x[part]] ^ wide[y[part]]).sum(1, dtype=np.int64) <= most[pair[part]]
        return ok

    return check


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of edges between labels the places of some that connect the same labels without a cycle."""
    labels, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(labels)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(where[: len(a)].tolist(), where[len(a) :].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            out.append(k)
    return np.array(out, np.int64)


def meetings(entries: DataFrame, traits: DataFrame, judge: Judge, forest: bool, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: the pairs of different labels under a key of entries (key, node, label, ...) that pass, by what entries and traits (node, ...) have of them.

    Members of a key's most frequent label never meet each other: of two different labels one isn't
    that. The rest, in blocks, meets all members, in blocks; a block pair is a row, so no task holds a
    whole key, and within it pairs are judged without being written down. With ``forest`` only as many pairs of a batch
    are written as connect its labels in the way that all of them would.
    """
    per = entries.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    sizes = per.groupBy("key").agg(F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    cut = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = sizes.where("labels > 1").select("key", "main", cut("all").alias("wide"), F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("narrow"))
    # a member's keys are one row until it has its traits, so these are joined once a member, not once a key
    at = entries.join(sizes, "key").groupBy("node").agg(F.collect_list(F.struct(*(c for c in entries.columns if c != "node"), "main", "wide", "narrow")).alias("at"))
    own = at.join(traits, "node").select(*traits.columns, F.inline("at"))
    own = own.withColumn("own", F.struct("node", "label", *(c for c in (*entries.columns, *traits.columns) if c not in ("key", "node", "label"))))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    meets = lambda i, j, rare, whole: F.struct(i.alias("i"), j.alias("j"), rare.alias("rare"), whole.alias("whole"))
    each = lambda n, to: F.transform(F.sequence(F.lit(0), F.col(n) - 1), to)
    yes, no, rest = F.lit(True), F.lit(False), F.col("label") != F.col("main")
    # in keys of one block a member stands once, and says whether it is one of the rest
    single = F.array(meets(F.lit(0), F.lit(0), rest, yes))
    rare = each("wide", lambda j: meets(part("narrow"), j, yes, no))
    whole = each("narrow", lambda i: meets(i, part("wide"), no, yes))
    places = F.when(F.col("wide") == 1, single).when(rest, F.concat(rare, whole)).otherwise(whole)
    rows = own.select("key", "own", F.inline(places)).groupBy("key", "i", "j").agg(F.collect_list(F.struct("rare", "whole", "own")).alias("members")).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            count = pc.list_value_length(lists).to_numpy().astype(np.int64)
            flat = lists.flatten()
            side, other = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("rare", "whole"))
            cols = dict(zip([f.name for f in flat.field("own").type], flat.field("own").flatten(), strict=True))
            node, label = cols["node"].to_numpy(), cols["label"].to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            left, right = np.flatnonzero(side), np.flatnonzero(other)
            n_right = np.bincount(row[right], minlength=len(count))
            ends, first_right = np.cumsum(n_right[row[left]]), (np.cumsum(n_right) - n_right)[row[left]]
            passes, a, b = judge(cols), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            labels = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            total = int(ends[-1]) if len(ends) else 0
            for lo in range(0, total, AT_ONCE):
                pair = np.arange(lo, min(total, lo + AT_ONCE))
                at = np.searchsorted(ends, pair, "right")
                i = left[at]
                j = right[first_right[at] + pair - (ends[at] - n_right[row[i]])]
                open_ = label[i] != label[j]
                i, j = i[open_], j[open_]
                if len(i):
                    ok = np.flatnonzero(passes(i, j))
                    if forest:
                        ok = ok[_forest(label[i[ok]], label[j[ok]])]
                    a.append(node[i[ok]])
                    b.append(node[j[ok]])
                    labels[0].append(label[i[ok]])
                    labels[1].append(label[j[ok]])
            found, of = np.column_stack([np.concatenate(a), np.concatenate(b)]), np.column_stack([np.concatenate(c) for c in labels])
            if forest:
                found = found[_forest(of[:, 0], of[:, 1])]
            both = np.unique(np.sort(found, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()
