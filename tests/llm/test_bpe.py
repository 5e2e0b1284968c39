from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfare.llm.bpe import WordBpe, encode
from wayfare.llm.queries import VOCABULARY
from wayfare.llm.tokenfile import Encoder

LIBRARY = Tokenizer.from_file(VOCABULARY)
OWN = [WordBpe(VOCABULARY), Encoder(VOCABULARY)]
ODD = ["", None, " \t\n", "ΑΣ ΣΑΣ İstanbul", "a\x1cb c\x1d", "<|endoftext|>x<|startoftext|> <|endof", "it's we'll 12.5€ 日本語 " + "ab" * 300, "é ́x Å", "x" * 5000, "😀😀 naïve", "ǅ ŉ ß ẞ ﬁ", "a. b, .c !! ?x"]


@pytest.mark.parametrize("own", OWN)
def test_odd(own):
    for text, ids in zip(ODD, own.encode_batch(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeTHINGtion'  \n.,é1Σ<|>")) | st.characters(codec="utf-8", exclude_categories=["Cs", "Cn", "Co"]), max_size=80))
def test_like_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    for own in OWN:
        ids = own.encode_batch([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert OWN[0].decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_query_rows(spark):
    df = spark.createDataFrame([(1, "The cat", "x"), (1, "The cat", "x"), (None, None, "y"), (2, "", "z")], "doc_id long, text string, ids string")
    got = encode(df, VOCABULARY).collect()
    assert [r.n_tokens for r in got] == [2, 2, 0, 0] and got[2].decoded == "" and got[0].decoded == "the</w> cat</w>"
    assert hashlib.sha256(bytes(got[2].ids)).hexdigest() == hashlib.sha256(b"").hexdigest()
    assert encode(df.limit(0), VOCABULARY).count() == 0


def test_very_long_text(spark):
    text = "The cat sat, on 12 mats. " * 60_000 + "x" * 20_000
    got = encode(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), VOCABULARY).orderBy("doc_id").collect()
    assert np.frombuffer(got[0].ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids and got[1].n_tokens == 1
