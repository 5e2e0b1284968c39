from __future__ import annotations

import uuid

import numpy as np
import pytest
from tokenizers import Tokenizer

from wayfare.llm import tokenfile
from wayfare.llm.common import new_path
from wayfare.llm.queries import VOCABULARY


@pytest.mark.parametrize("counts", [[5], [1, 1], [0, 3, 0, 9, 1], [2**k for k in range(40)], list(range(1, 3000))])
def test_code(counts):
    counts = np.array(counts)
    lengths = tokenfile.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= tokenfile.LONGEST
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    code = tokenfile.Code(lengths)
    rng = np.random.default_rng(0)
    used = np.flatnonzero(counts)
    n = np.array([0, 1, 127, 128, 129, 1000, 0, 5], np.int64)
    ids = rng.choice(used, n.sum())
    data, size, marks = code.encode(ids, np.cumsum(n) - n)
    assert code.decode(data.tobytes(), n, size, marks).tolist() == ids.tolist()



def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 64)
    monkeypatch.setattr(tokenfile, "PART", 700)
    rows = [(k, f"the cat {k} sat " * (k % 5)) for k in range(60)] + [(100, None), (101, ""), (-5, "minus"), (None, "none"), (7, "again"), (102, "long word " * 20000)] + [(None, f"no id {k}") for k in range(90)] + [(50, "one id")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as part").repartition(3)
    path = new_path(spark, "tokens")
    tokenfile.write(df, path, VOCABULARY)
    got = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(VOCABULARY)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda x: (x is not None, x or 0))
    want = sorted((i is not None, i or 0, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]
    # rows of one id, or without one, lie in several parts
    parts = spark.read.parquet(f"{path}/blocks").collect()
    assert len({r.part for r in parts}) > 10 and len({r.part for r in parts if 1 in r.nulls}) > 1
    path = new_path(spark, "tokens")
    tokenfile.write(df.limit(0), path, VOCABULARY)
    assert tokenfile.read(spark, path).count() == 0


def test_ids_are_read_once(spark, monkeypatch, tmp_path):
    """The counts for the code come from the pass that encodes; the ids of a document are unpacked once."""
    monkeypatch.setattr(tokenfile, "unplanes", lambda data, wide, own=tokenfile.unplanes, at=str(tmp_path): (open(f"{at}/{uuid.uuid4().hex}", "w").close(), own(data, wide))[1])
    docs = spark.createDataFrame([(k, f"the cat {k} sat") for k in range(20)], "doc_id long, text string").repartition(2)
    path = new_path(spark, "tokens")
    tokenfile.write(docs, path, VOCABULARY)
    assert len(list(tmp_path.iterdir())) == 20
    assert tokenfile.read(spark, path).count() == 20
