from __future__ import annotations

import re

import numpy as np
import pytest

from wayfare.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_patterns():
    rng = np.random.default_rng(1)
    for _ in range(5000):
        t = "".join(rng.choice(list("0123.. 5-@@ab_%+()é"), size=rng.integers(1, 40)))
        assert plain(t) == pii.base_spans(t), t


def test_field_finds_what_was_held_out():
    weights = pii.trained()
    hit = extra = missed = 0
    for text, spans in pii.sentences(200, seed=5):
        found = set(pii.all_spans(text, weights)[1])
        hit, extra, missed = hit + len(found & set(spans)), extra + len(found - set(spans)), missed + len(set(spans) - found)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


@pytest.mark.parametrize("text", ["version 3.0 of 2024-01-02 12:30", "see page 1234567", "order 9876543210123456 shipped", "we met at noon. dot the i", "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"])
def test_clean_text_stays(text):
    assert pii.all_spans(text, pii.trained())[1] == []


def test_disguised_forms():
    for text, kind in (("call (651) 555-8500 now", "phone"), ("mail anna [at] example [dot] org please", "email")):
        base, spans = pii.all_spans(text, pii.trained())
        assert not base and [s[0] for s in spans] == [kind]
    assert pii.redacted("to a@b.co, 1.2.3.4", pii.all_spans("to a@b.co, 1.2.3.4", pii.trained())[1]) == "to [EMAIL], [IP]"


@pytest.mark.parametrize("form", ["anna@example.org", "anna [at] example [dot] org", "anna at example dot org", "anna(at)example.org", "anna (at) example (dot) org", "anna(AT)example.org", "anna [At] mail.example.org"])
def test_each_form_without_digits(form):
    text = f"write to {form} please"
    spans = pii.all_spans(text, pii.trained())[1]
    assert spans == [("email", 9, 9 + len(form))]
    assert pii.redacted(text, spans) == "write to [EMAIL] please"


@pytest.mark.parametrize("text", ["look at home. The end", "at noon.", "they met at the house, at last", "-at" * 3000])
def test_other_words_at_stay(text):
    assert pii.all_spans(text, pii.trained())[1] == []


def test_rows(spark):
    rows = [(1, "a@b.co 10.0.0.1"), (1, "a@b.co 10.0.0.1"), (None, None), (2, ""), (3, "9" * 30000), (4, "x@" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as base", "'k' as spans")
    got = pii.find(df, redact=True).collect()
    assert [[s["kind"] for s in r.spans] for r in got] == [["email", "ip"], ["email", "ip"], [], [], [], []]
    assert got[0].redacted == "[EMAIL] [IP]" and got[2].redacted is None
    assert pii.find(df.limit(0)).count() == 0


def test_long_stretches_are_whole():
    """In digits without a gap a span is found wherever it stands, and in every case of the words."""
    weights = pii.trained()
    for pad in range(4000, 4130, 7):
        text = ("7 " * 3000)[:pad] + "call (415) 555-2671 or anna [at] mail [dOT] org " + "7 " * 500
        at = pad + 5
        assert ("phone", at, at + 14) in pii.all_spans(text, weights)[1]
        assert ("email", at + 18, at + 42) in pii.all_spans(text, weights)[1]


def whole(text, weights, sure=2.0):
    """What the field over the whole text adds to the base spans."""
    base = pii.base_spans(text)
    atoms = [(a.group(), *a.span()) for a in pii.ATOM.finditer(text)]
    added, done = [], 0
    for i, j, kind, value in pii.best(text, atoms, weights):
        start, end = atoms[i][1], atoms[j - 1][2]
        if value >= sure and start >= done and not any(s < end and e > start for _, s, e in base):
            added.append((kind, start, end))
            done = end
    return sorted([*base, *added], key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))


@pytest.mark.parametrize("n", [20, 48, 49, 50, 55, 60])
def test_long_names_are_found(n):
    """A segment may have 80 characters, on whichever side of its sign they stand."""
    weights = pii.trained()
    for name, host in (("x" * n, "example"), ("anna", "y" * n)):
        form = f"{name} at {host} dot com"
        text = f"please write to {form} now"
        assert len(form) <= 80 and pii.all_spans(text, weights)[1] == [("email", 16, 16 + len(form))] == whole(text, weights)


def test_stretches_give_what_the_whole_text_gives():
    rng = np.random.default_rng(8)
    weights = pii.trained()
    parts = ["at", "dot", "call", "phone", "mail", ":", "is", "[at]", "(dot)", "x" * 70, "y" * 45, "z" * 130, "a@b.co", "555", "555-8500", "(651)", "+1", "1.2.3", "4111", "1111", "é²", "_", "com", "anna", "-", ".", "\n", "host", "٣٤"]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", "", "  ", " " * 90]) for _ in range(int(rng.integers(1, 40))))
        assert pii.all_spans(text, weights)[1] == whole(text, weights), text


def test_no_segment_without_a_sign_is_chosen():
    weights = pii.trained()
    for glued in (True, False):
        for top in (True, False):
            for cue in (None, *pii.CUES):
                found = ["bias", "letters", "digits=0", f"glued={glued}", "address=False", "dots=False", f"top={top}", *([f"cue={cue}"] if cue else [])]
                assert all(sum(weights.get((k, x), 0.0) for x in found) < 0 for k in pii.KINDS)
