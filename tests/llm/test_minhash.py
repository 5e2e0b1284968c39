from __future__ import annotations

import itertools
import random
import re

import numpy as np

from wayfare.llm import minhash


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    own = [(i, sets(t)) for i, t in rows]
    up = {i: i for i, _ in own}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(own, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {(i, len(s), top(i), top(i) == i) for i, s in own}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(40)]
    rows = []
    for k in range(60):
        rows.append(" ".join([word() for _ in range(rng.randint(20, 60))] + (passage if k % 3 == 0 else [])))
    base = [word() for _ in range(80)]
    for _ in range(60):  # copies of one text, each with edits of its own, some beyond the threshold
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = word()
        rows.append(" ".join(own))
    rows += [rows[0]] * 5 + [rows[70].upper()] * 3 + ["one two", "One\ttwo", "one", "", " \n", None]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


def test_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as digest")
        assert set(map(tuple, minhash.near_duplicates(df).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "only here it is now"), (4, None), (4, None), (None, None), (9, "w " * 30000)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (3, 2, 3, True), (None, 1, None, True), (4, 0, 4, True), (4, 0, 4, True), (None, 0, None, True), (9, 1, 9, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior_bounds():
    need = minhash.least_matches(0.75)
    rng = np.random.default_rng(0)
    hits = rng.random((20000, minhash.HASHES)) < 0.75
    for k, m in enumerate(need):
        assert (hits[:, : (k + 1) * minhash.STEP].sum(1) >= m).all()
    low = rng.random((2000, minhash.HASHES)) < 0.3
    assert (low[:, : minhash.STEP].sum(1) < need[0]).mean() > 0.2 and (low.sum(1) < need[-1]).all()


def test_shared_most_but_not_enough(spark):
    """Texts that have 80 of 100 shingles in common, under the threshold, are compared in hundreds of pairs at most, not in all."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(84)]
    rows = [(k, " ".join([word() for _ in range(20)] + base)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []

    class Counting(minhash.Search):
        def apart(self):
            pairs = super().apart()
            seen.append(pairs.count())
            return pairs

    got = Counting(spark, docs, 75).run()
    assert set(map(tuple, got.collect())) == brute(rows)
    assert seen[0] < 400


def test_unlike_sizes(spark):
    """Pairs at the edge of the similarity, of unlike sizes."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows = []
    for k in range(40):
        base = [word() for _ in range(rng.randint(30, 120))]
        rows += [base, base + [word() for _ in range(int((len(base) - 4) * rng.choice([0.1, 0.3, 0.33, 0.34, 0.4])))]]
    rows = [(k, " ".join(r)) for k, r in enumerate(rows)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(map(tuple, got.collect())) == brute(rows)


def test_texts_of_shared_paragraphs(spark):
    """Texts of 28 out of 40 paragraphs share most of their shingles, and few are linked: pairs are compared in blocks, and few are written down."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    parts = [[word() for _ in range(9)] for _ in range(40)]
    for n in (200, 400, 500):
        rows = [(k, " ".join(w for p in sorted(rng.sample(range(40), 28)) for w in parts[p])) for k in range(n)]
        seen = []

        class Counting(minhash.Search):
            def verified(self, pairs):
                seen.append(pairs.count())
                return super().verified(pairs)

        got = Counting(spark, spark.createDataFrame(rows, "doc_id long, text string"), 75).run()
        assert set(map(tuple, got.collect())) == brute(rows)
        assert sum(seen) < 50 * n
