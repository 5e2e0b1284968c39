from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wayfare.llm import spelling


def words_of(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return out


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) == 1:
        return any(y[:k] + y[k + 1 :] == x for k in range(len(y)))
    return len(x) == len(y) and sum(a != b for a, b in zip(x, y)) == 1


def brute(n, times=5):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def dictionary(seed, letters="abc", size=400):
    rng = random.Random(seed)
    out = {}
    for _ in range(size):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        out[w] = rng.choice([5, 6, 30, 200, 5000])
    for stem in ("prefixed", "é" * 7, "x" * 90, "y" * 200):  # skewed blocks, and long words
        for _ in range(30):
            k = rng.randrange(len(stem))
            out[stem[:k] + rng.choice(["", "q", "ß", stem[k]]) + stem[k + rng.randint(0, 1) :]] = rng.choice([5, 25, 125, 700])
    return out


@pytest.mark.parametrize("limit", [4, 128])
def test_brute_force(spark, limit):
    """Blocks as they come, and cut as far as they can be."""
    n = dictionary(limit)
    got = list(map(tuple, spelling.group(spark.createDataFrame(list(n.items()), "word string, n long"), limit=limit).collect()))
    assert len(got) == len(n) and set(got) == brute(n)


def test_documents(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = []
    for k in range(120):
        text = []
        for _ in range(rng.randint(0, 80)):
            w = rng.choice(base[: 5 + 11 * rng.randrange(6)])
            p = rng.randrange(len(w))
            text.append(w if rng.random() < 0.8 else w[:p] + rng.choice("abÀß") + w[p + 1 :])
        rows.append((k if k % 9 else None, rng.choice([" ", "1", ", "]).join(text)))
    rows += [(500, None), (501, ""), (502, "z" * 50_000), (503, " ".join(base).upper() * 5), (503, " ".join(base).upper() * 5), (504, "ŸŠabcdefg ×÷" * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'w' as word")
    n = {w: k for w, k in words_of(rows).items() if k >= 5}
    assert set(map(tuple, spelling.variants(df).collect())) == brute(n) and len(n) > 30
    assert spelling.variants(df.limit(0)).count() == 0


def test_dictionary_of_odd_rows(spark):
    df = spark.createDataFrame([("abcdef", None), ("abcdeg", 0), (None, 7), ("abcdeh", 50)], "word string, n long")
    assert sorted(map(tuple, spelling.group(df).collect())) == [("abcdef", None, "abcdef", 0, 2, None), ("abcdeg", None, "abcdeg", 0, 2, None), ("abcdeh", None, "abcdeh", 50, 2, None)]
    with pytest.raises(ValueError, match="more frequent"):
        spelling.group(df, times=1)


def test_near():
    rng = random.Random(4)
    some = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    codes, turned = (np.array(w, "U9").view(np.uint32).reshape(len(some), 9) for w in (some, [w[::-1] for w in some]))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(150), np.arange(150)))
    want = [one_edit(some[a], some[b]) for a, b in zip(i, j)]
    assert spelling.near(codes, turned, np.array(list(map(len, some))), i, j).tolist() == want == [spelling.one_edit(some[a], some[b]) for a, b in zip(i, j)]
