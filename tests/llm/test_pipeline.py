from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_minhash import brute
from wayfare.llm import mixing, pii, quality
from wayfare.llm.bpe import WordBpe
from wayfare.llm.common import stored, table
from wayfare.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against a plain version of it, on what the one before kept."""
    docs = table(spark, SF, "documents").selectExpr("*", "1 as score", "2 as __gone", "'x' as kept", "3 as base")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out, _ = stored(stage(spark, frames[-1], SF), name.replace(" ", "-"))
        frames.append(out)
    assert all(f.columns == docs.columns for f in frames[:-1])
    raw, good, once, clean, mixed, ids = [f.toPandas() for f in frames]
    model = quality.fit(docs, table(spark, SF, "labels"))
    x, n = quality.passages(raw.text.tolist())
    assert sorted(good.doc_id) == sorted(raw.doc_id[model.score(x, n) >= 0.3])
    kept = {r[0] for r in brute(list(zip(good.doc_id.tolist(), good.text.tolist(), strict=True))) if r[3]}
    assert sorted(once.doc_id) == sorted(kept)
    new = {i: pii.redacted(t, pii.all_spans(t, pii.trained())[1]) for i, t in zip(once.doc_id, once.text, strict=True)}
    assert dict(zip(clean.doc_id, clean.text, strict=True)) == new and (clean.n_chars == clean.text.str.len()).all()
    con = duckdb.connect()
    con.register("documents", frames[3].select("doc_id", "text", "source").toArrow())
    want = {i: int(np.floor(taken / size + 0.5)) for i, size, _, _, taken, *_ in con.sql(mixing.SQL).fetchall() if size}
    assert mixed.doc_id.value_counts().to_dict() == {i: k for i, k in want.items() if k}
    bpe = WordBpe(VOCABULARY)
    assert sorted(zip(ids.doc_id, ids.ids.map(bytes), strict=True)) == sorted(zip(mixed.doc_id, bpe.encode_batch(mixed.text.tolist()), strict=True))
    assert not any(re.search(pii.DOMAIN, t) for t in clean.text)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "x y"), (None, "x y"), (3, None), (4, ""), (5, "very long text of many words, " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs, _ = stored(stage(spark, docs, SF), "odd")
    assert sorted({r.doc_id or 0 for r in docs.collect()} - {5}) == [0, 1]
    empty = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty, _ = stored(stage(spark, empty, SF), "none")
    assert empty.count() == 0


def test_token_ids_are_decoded(spark):
    docs = spark.createDataFrame([(1, "A plain text, twice: a plain text."), (2, ""), (3, None)], "doc_id long, text string")
    bpe = WordBpe(VOCABULARY)
    for r in corpus_pipeline.encode(spark, docs, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(bpe.decode(bytes(r.ids)).encode()).hexdigest() and (r.n_tokens > 0) == (r.doc_id == 1)


@pytest.mark.parametrize("name", ["pipeline"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()
