from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from wayfare.llm import divergence


def brute(rows, least=3, top=200):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in terms}:
        own = [r for r in terms if r[0] == lang]
        docs = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= least)
        count = {s: Counter(t for _, q, ts in own if q == s for t in ts if docs[t] >= least) for s in {r[1] for r in own}}
        count[None] = Counter(t for _, _, ts in own for t in ts if docs[t] >= least)
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            if s is None:
                continue
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o not in (None, s)]
            items = [(f(p[s][t], p[None][t]), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", items, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)}
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcÄé中\U0001f600xyz") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    rows = []
    for _ in range(160):
        lang = rng.choice(["en", "en", "de", None, "xx"])
        source = f"s{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])}" if rng.random() < 0.9 else None
        text = " ".join(rng.choice(words[: 20 + 10 * rng.randrange(7)]) + rng.choice(["", "1", "-", "\t"]) for _ in range(rng.randint(0, 40)))
        rows.append((lang, source, rng.choice([text, text, text.upper(), None, ""])))
    return [*rows, *rows[:9], ("zz", "only", "one two"), ("yy", "a", ""), ("yy", "b", "1 2 3"), ("yy", "c", None), ("", "s0", "A b")]


@pytest.mark.parametrize("block,rounds,top", [(1 << 16, 10, 200), (7, 2, 5)])
def test_brute_force(spark, block, rounds, top):
    rows = corpus(block)
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as slot", "'t' as term", "2 as block", "3 as n")
    got = list(map(tuple, divergence.audit(df, block=block, rounds=rounds, top=top).collect()))
    assert len(got) == len(set(got)) and set(got) == brute(rows, top=top)


def test_one_source_and_nothing(spark):
    df = spark.createDataFrame([("en", "a", "x y " * 50_000)] * 3, "lang string, source string, text string")
    assert [tuple(r)[:3] for r in divergence.audit(df).collect()] == []
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        total = int(rng.integers(1, 9 * 10**15))
        count = rng.integers(0, total, 50)
        assert divergence.share(count, total).tolist() == [1 + 10**9 * (c + 1) // total for c in count.tolist()]
    counts = rng.integers(0, 5, 1000)
    at = np.flatnonzero(counts)
    assert divergence.unpacked(divergence.packed(at, counts[at]), 1000).tolist() == counts.tolist()


@pytest.mark.parametrize("players", [2, 3, 8, 21])
def test_all_meet_once(spark, players):
    from pyspark.sql import functions as F

    even = players + players % 2
    rows = spark.range(players).crossJoin(spark.range(even - 1).withColumnRenamed("id", "r")).select("id", "r", divergence.met(F.col("id"), F.col("r"), F.lit(even)).alias("m")).collect()
    met = [(r.id, r.m) for r in rows if r.m < players]
    assert sorted(met) == [(a, b) for a in range(players) for b in range(players) if a != b]
    assert all(b in {x.id for x in rows if x.r == r.r and x.m == r.id} for r in rows if (b := r.m) < players)
