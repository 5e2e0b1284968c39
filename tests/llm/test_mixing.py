from __future__ import annotations

import duckdb
import pytest

from wayfare.llm import mixing


def mixed(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, taken int")
    return df, sorted(map(tuple, mixing.mix(df, **kw).collect()), key=str)


ROWS = [(k, " ".join(["w"] * (k * 37 % 91)), f"s{k % 7}" if k % 11 else None, "x", 1) for k in range(300)] + [(1000, None, "s1", "x", 1), (1001, "", None, "x", 1), (None, "a b c", "s2", "x", 1)]


def test_against_sql(spark):
    df, got = mixed(spark, ROWS)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toArrow())
    assert got == sorted(con.sql(mixing.SQL).fetchall(), key=str) and len(got) == 303


def taken(got):
    per = {}
    for _, size, source_size, target, taken, *_ in got:
        assert taken <= 3 * size
        per.setdefault((source_size, target), []).append(taken)
    return {k: sum(t) for k, t in per.items()}


def test_targets_are_met(spark):
    _, got = mixed(spark, ROWS, block=16)
    per = taken(got)
    assert all(abs(t - target) <= 5 * max(1, min(16, target // 2048)) for (_, target), t in per.items())
    assert abs(sum(target for _, target in per) - sum(r[1] for r in got)) < 1e-6
    assert mixed(spark, ROWS, block=16)[1] == got


def test_large_sources_take_whole_blocks(spark):
    rows = [(k, " ".join(["w"] * (500 + k % 4)), f"s{k % 4}", "", 0) for k in range(600)]
    _, got = mixed(spark, rows, block=8, least_slots=256)
    assert all(abs(t - target) <= 8 * 6 for (_, target), t in taken(got).items())


def test_schedule_decides(spark, monkeypatch):
    """Other points take other words, and first slots follow the order of the slots."""
    _, got = mixed(spark, ROWS)
    assert all((r[5] > 0) == (r[4] > 0) == (r[6] is not None) for r in got)
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    assert [r[4] for r in mixed(spark, ROWS)[1]] != [r[4] for r in got]


def test_hot_and_empty(spark):
    hot = [(k, "a b c d", "big", "", 0) for k in range(500)] + [(500, "z", "tiny", "", 0)]
    _, got = mixed(spark, hot)
    tiny = [r for r in got if r[0] == 500]
    assert tiny[0][3] == 3.0 and 0 <= tiny[0][4] <= 3 and abs(sum(r[4] for r in got) - 2001) <= 6
    assert mixed(spark, hot[:0])[1] == []
    assert mixed(spark, [(1, "", "a", "", 0), (2, None, None, "", 0)])[1] == [(1, 0, 0, 0.0, 0, 0, None), (2, 0, 0, 0.0, 0, 0, None)]


def test_repeated_rows(spark):
    """Equal rows, and rows without an id, keep their number."""
    rows = [(None, "a b c", "s", "", 0)] * 40 + [(None, "d", "s", "", 0)] * 3 + [(7, "e f", "s", "", 0)] * 30
    _, got = mixed(spark, rows)
    assert sorted((r[0] or 0, r[1]) for r in got) == sorted((r[0] or 0, len(r[1].split())) for r in rows)
    assert sum(r[4] for r in got) == 183 and all(r[2] == 183 for r in got)


@pytest.mark.parametrize("weights", [(6400, 3200), (100, 9500), (1, 9599)])
def test_schedule_is_spread(spark, weights):
    a, b = weights
    per = spark.createDataFrame([("a", 10_000, 5, float(a)), ("b", 10_000, 1, float(b))], "source string, source_size long, weight int, target double")
    slots = mixing.schedule(mixing.blocks(per, 10, 1)).orderBy("slot").collect()
    got = [r.s for r in slots]
    share = got.count("a") / len(got)
    assert abs(share - a / (a + b)) <= 4 / len(got)
    assert all(abs(got[:k].count("a") - share * k) <= 5 for k in range(len(got)))
    assert [r.rank for r in slots if r.s == "b"] == list(range(got.count("b")))


def test_points_are_exact(spark):
    for slot in (0, 1, 12345, 2**31 + 7, 2**39 + 3):
        assert spark.range(1).select(mixing.point(mixing.F.lit(slot).cast("long"))).first()[0] == slot * mixing.GOLDEN % mixing.POINTS
