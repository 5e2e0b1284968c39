from __future__ import annotations

import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from wayfare.llm import ngram_join
from wayfare.llm.blocks import alike, parity


def sets(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, percent=85):
    own = [(i, sets(t)) for i, t in rows]
    up = {i: i for i, _ in own}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(own, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {(i, len(s), top(i)) for i, s in own}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows = []
    for k in range(50):
        rows.append(" ".join([word() for _ in range(rng.randint(3, 60))] + (passage if k % 2 == 0 else [])))
    for size in (12, 90, 200):
        base = [word() for _ in range(size)]
        for _ in range(35):  # copies of one text, each with edits of its own, some beyond the threshold
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    parts = [[word() for _ in range(12)] for _ in range(14)]
    rows += [" ".join(w for p in sorted(rng.sample(range(14), 11)) for w in parts[p]) for _ in range(40)]  # texts of shared paragraphs
    rows += [rows[0]] * 4 + [rows[60].upper()] * 3 + ["one two", "One\ttwo", "one", "a b c d", "", " \n", None]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("floor", [2, 64])
def test_brute_force(spark, floor):
    """With hardly any shingle frequent, and with nearly all of them."""
    rows = corpus(floor)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as node", "'x' as key")
    times = ngram_join.TIMES
    ngram_join.TIMES = 0
    try:
        assert set(map(tuple, ngram_join.join(df, floor=floor).collect())) == brute(rows)
    finally:
        ngram_join.TIMES = times


def test_other_thresholds(spark):
    rows = corpus(5)[:90]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (60, 100):
        assert set(map(tuple, ngram_join.join(df, percent, floor=2).collect())) == brute(rows, percent)


def test_similar_sets_share_a_key():
    """Whatever the levels of the shingles are: one of the smaller set's index keys is among the larger one's probe keys, or the other way round for equal sizes."""
    rng = np.random.default_rng(3)
    for _ in range(500):
        percent = int(rng.choice([60, 75, 85, 95]))
        n = int(rng.integers(1, 400))
        level = rng.choice([3, 30, 60], ngram_join.COUNTERS, p=rng.dirichlet([1, 1, 1])).astype(np.uint8)
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        most = n * (100 - percent) // (100 + percent) + 1
        keep = x[rng.permutation(n)[: n - int(rng.integers(0, most + 1))]]
        y = np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, most + 1)), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < percent * (len(x) + len(y) - both):
            continue
        x, y = sorted((x, y), key=len)
        (kx, wx, _), (ky, wy, _) = (ngram_join.keys_of(s, level, percent, 20, 50) for s in (x, y))
        assert set(kx[wx & ngram_join.INDEX > 0].tolist()) & set(ky[wy & ngram_join.PROBE > 0].tolist())
        assert alike(np.array([len(x), len(y)]), [parity(x), parity(y)], percent)(np.array([0]), np.array([1]))[0]


def test_keys_grow_with_the_text():
    """However frequent the shingles are."""
    level = np.full(ngram_join.COUNTERS, 200, np.uint8)
    for n in (200, 2000, 20_000):
        own = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
        assert len(ngram_join.keys_of(own, level, 85, 20, 250)[0]) < 1.5 * n
        assert len(ngram_join.keys_of(own, level, 85, 20, 50)[0]) < 4 * n


def test_odd_rows(spark):
    long = " ".join(f"w{k % 977}x{k % 1009}" for k in range(60_000))
    rows = [(1, "a b c d e"), (1, "x y z u v"), (2, "x y z u v"), (None, "a b c d e"), (None, "q r s t"), (None, None), (3, long), (4, long + " end"), (5, "Ä B c D"), (6, "Ä b C d"), (7, "ä b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as component_id", "'k' as bits")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.join(df).collect())
    many = len(sets(long))
    assert got == sorted([("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 2, 1), ("None", 1, None), ("None", 0, None), ("3", many, 3), ("4", many + 1, 3), ("5", 1, 5), ("6", 1, 5), ("7", 1, 7)])
    assert ngram_join.join(df.limit(0)).count() == 0


def test_memory_of_counts():
    """A task that counts shingles holds its counters and little besides, no second array of their number."""

    class Taken(Exception):
        pass

    class Docs:
        def mapInArrow(self, run, schema):
            raise Taken(run)

    with pytest.raises(Taken) as taken:
        ngram_join.Join(None, Docs(), 85, 4, 512).sign()
    texts = [" ".join(f"w{k}x{j}" for j in range(2000)) for k in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts[k : k + 40])], names=["doc_id", "text"]) for k in range(0, 400, 40)]
    tracemalloc.start()
    got = list(taken.value.args[0](iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(int(ngram_join._unpacked(v).sum()) for b in got for v in b.column(4).drop_null().to_pylist()) == 400 * 1997
    assert peak < 4 * ngram_join.COUNTERS + (40 << 20)
