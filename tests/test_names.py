"""Matches of names against all pairs, and how many pairs are looked at."""

from __future__ import annotations

import random
import re

import pytest

from wayfare.operators import names


def plain(a: str, b: str) -> bool:
    """The rule for names that are normalised, in plain Python."""
    if not a or not b:
        return False
    wa, wb = ({w for w in x.split(" ") if len(w) > 2} for x in (a, b))
    fewer = min(len(wa), len(wb))
    return a == b or (len(a) >= 5 and (a in b or b in a)) or (fewer > 0 and 5 * len(wa & wb) >= 3 * fewer)


def frames(spark, xs, ys):
    return spark.createDataFrame([(x,) for x in xs], "x string"), spark.createDataFrame([(y,) for y in ys], "y string")


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.choice([1, 1, 2, 3, 3, 4, 6])))
    some = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(400)] + ["", None, None]
    rng.shuffle(some)
    stations, stops = list(enumerate(some[:200])), list(enumerate(some[150:]))
    tidy = lambda n: re.sub(" +", " ", n or "").strip()
    want = sorted((i, j) for i, x in stations for j, y in stops if plain(tidy(x), tidy(y)))
    got = names.match_names(spark.createDataFrame(stations, "id long, name string"), spark.createDataFrame(stops, "stop_id long, name string"))
    assert sorted(map(tuple, got.collect())) == want and want


def test_common_words_are_no_keys(spark):
    """Names that all hold two of three common words beside rare ones: pairs looked at follow the names, not their square."""
    rng = random.Random(5)
    letters = "abcdefghijklmnop"
    rare = lambda: "".join(rng.choice(letters) for _ in range(7))
    for n in (200, 800):
        xs = sorted({" ".join([*rng.sample(["colonia", "centro", "avenida"], 2), rare(), rare(), rare()]) for _ in range(n)})
        ys = xs[: n // 4] + [" ".join(reversed(x.split(" "))) for x in xs[n // 4 : n // 2]] + [x[3:-2] for x in xs[n // 2 :]]
        first, second = frames(spark, xs, ys)
        words = names.shared_words(first, second)
        assert {tuple(r) for r in words.collect()} >= {(x, y) for x in xs for y in ys if 5 * len({*x.split()} & {*y.split()}) >= 3 * min(len(x.split()), len(y.split()))}
        assert words.count() < 2 * n
        looked = names.aligned(second, "y", first, "x").count() + names.aligned(first, "x", second, "y").count()
        assert len(xs) * 3 // 4 <= looked < 4 * n
        assert {tuple(r) for r in names.contained(first, second).collect()} == {(x, y) for x in xs for y in ys if x in y or y in x}


def test_long_and_empty(spark):
    long = "z" * 5000 + " quinto " + "y" * 5000
    first, second = frames(spark, [long, "quint", "zz"], ["quinto", "z", long])
    assert {tuple(r) for r in names.contained(first, second).collect()} == {(long, "quinto"), (long, "z"), (long, long), ("quint", "quinto"), ("quint", long)}
    none = spark.createDataFrame([], "id long, name string"), spark.createDataFrame([(1, "a")], "stop_id long, name string")
    assert names.match_names(*none).count() == 0
