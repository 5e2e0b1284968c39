"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns find the plain forms. Around digits, at signs and the words of
spelt-out addresses (at, dot) the field scores whole candidate segments, by features of the span as
a whole, and bounded-entity dynamic programming chooses boundaries and types
together: no segment has more than ``LONGEST`` atoms or ``WIDEST`` characters, so the work is linear in
the text. Its weights are trained by the gradient of the conditional likelihood
over generated sentences, on first use and alike everywhere.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that fails at the start of a run of digits fails inside it too, so runs are tried once
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each begins where the run before its at sign does, or where the last match ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """The plain forms, by kind and start; ends are exclusive, in code points."""
    out: list[Span] = [("email", *s) for s in emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# --- the field ---

ATOM = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
SIGN = re.compile("[0-9@]")
DOT = re.compile(r"\bdot\b", re.I)
# the word at after what can part it from a name, before a host with a dot in any form; a segment is no longer than 80
AT = re.compile(r"[ \[(+-]at\b(?=[\])]? ?[a-z0-9-]{1,80}(?:\.| ?[\[(]?\bdot\b[\])]? ?)[a-z0-9-])", re.I)
LONGEST, WIDEST = 15, 80
CUES = {"phone": {"phone", "tel", "call", "mobile", "fax", "cell"}, "card": {"card", "visa", "mastercard", "amex"}, "email": {"email", "mail", "contact"}, "ip": {"ip", "host", "server"}}


def signs(text: str) -> list[int]:
    """Where digits, at signs, the word dot and the word at of an address stand: without these a text has no segment that the field can be sure of."""
    found = [m.start() for m in SIGN.finditer(text)]
    words = [m.start() + 1 for m in AT.finditer(text)]
    if "dot" in text.lower():
        words += [m.start() for m in DOT.finditer(text)]
    return sorted({*found, *words}) if words else found


def _from(text: str, at: int, least: int) -> int:
    """Where the atom at a place begins, after the two atoms before it that its features look at; not before ``least``."""
    inner = lambda k: text[k - 1].isalnum() and text[k].isalnum()
    while at > least and inner(at):
        at -= 1
    for _ in range(2):
        while at > least and text[at - 1].isspace():
            at -= 1
        at = max(at - 1, least)
        while at > least and inner(at):
            at -= 1
    return at


def windows(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Atoms around the signs: a stretch goes on as long as the next sign's surroundings touch it.

    A segment that the field may choose has a sign in it and at most ``WIDEST`` characters, so a stretch
    that holds as many before and after each sign, whole atoms, and the two atoms that the first segment's features look
    at, gives what the whole text would.
    """
    low = high = -1
    for at in signs(text):
        if high < 0 or at - WIDEST > high:
            start = _from(text, max(0, at - WIDEST), max(high, 0))
            if high >= 0 and start > high:
                yield [(a.group(), *a.span()) for a in ATOM.finditer(text, low, high)]
                low = start
            elif high < 0:
                low = start
        high = max(high, min(at + WIDEST, len(text)))
        while 0 < high < len(text) and text[high - 1].isalnum() and text[high].isalnum():
            high += 1
    if high >= 0:
        yield [(a.group(), *a.span()) for a in ATOM.finditer(text, low, high)]


def features(text: str, atoms: list[tuple[str, int, int]], i: int, j: int) -> list[str] | None:
    """Of the segment of atoms i to j, exclusive, as a whole; None where it can be no entity."""
    first, last = atoms[i][0], atoms[j - 1][0]
    if not (first[0].isalnum() or first in "+(") or not last[-1].isalnum():
        return None
    start, end = atoms[i][1], atoms[j - 1][2]
    if end - start > WIDEST:
        return None
    span = text[start:end]
    digits = NOT_DIGIT.sub("", span)
    low = span.lower()
    mailed = "@" in span or re.search(r"\bat\b", low) is not None
    if not (len(digits) >= 7 or (digits.count("") > 4 and span.count(".") >= 3) or mailed) or "\n" in span:
        return None
    letters = sum(c.isalpha() for c in span)
    shape = re.sub(r"[^\W\d_]+", "a", NOT_DIGIT.sub(lambda m: m.group(), re.sub(r"[0-9]+", lambda m: f"{len(m.group())}", span)))
    before = atoms[i - 1][0].lower() if i else ""
    two = atoms[i - 2][0].lower() if i > 1 else ""
    glued = (start > 0 and not text[start - 1].isspace() and (text[start - 1].isalnum() or text[start - 1] in "-.@_#$€/:+")) or (end < len(text) and (text[end].isalnum() or (text[end] in "-@_/%:" or (text[end] == "." and end + 1 < len(text) and text[end + 1].isalnum()))))
    out = ["bias", f"shape={shape}" if not letters else "letters", f"digits={len(digits)}", f"glued={glued}"]
    if not letters:
        out.append("sep=" + "".join(sorted(set(NOT_DIGIT.findall(span.replace(" ", "_")))))[:8])
        out.append(f"luhn={luhn(digits) and 13 <= len(digits) <= 19}")
        parts = span.split(".")
        out.append(f"quad={len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}")
        out.append(f"parts={len(re.findall('[0-9]+', span))}")
    else:
        spelt = re.fullmatch(r"[a-z0-9_+-]+(?:(?:\.| ?[\[(]?\bdot\b[\])]? ?)[a-z0-9_+-]+)*(?:@| ?[\[(]?\bat\b[\])]? ?)[a-z0-9-]+(?:(?:\.| ?[\[(]?\bdot\b[\])]? ?)[a-z0-9-]+)+", low)
        out.append(f"address={spelt is not None}")
        out.append(f"dots={'dot' in re.findall('[a-z]+', low)}")
        out.append(f"top={low.rsplit('.', 1)[-1].rsplit(' ', 1)[-1] in ('com', 'org', 'net', 'edu', 'de', 'fr', 'es', 'io', 'info')}")
    out += [f"cue={k}" for k, words in CUES.items() if before in words or (before in ":#." and two in words) or (before == "is" and two in words)]
    return out


def candidates(text: str, atoms: list[tuple[str, int, int]]) -> list[list[tuple[int, list[str]]]]:
    """For each end, the segments' starts and features."""
    out: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(atoms) + 1)]
    for i in range(len(atoms)):
        for j in range(i + 1, min(len(atoms), i + LONGEST) + 1):
            f = features(text, atoms, i, j)
            if f:
                out[j].append((i, f))
    return out


Weights = dict[tuple[str, str], float]


def scores(weights: Weights, found: list[list[tuple[int, list[str]]]]) -> list[list[tuple[int, str, float, list[str]]]]:
    return [[(i, k, sum(weights.get((k, x), 0.0) for x in f), f) for i, f in own for k in KINDS] for own in found]


def best(text: str, atoms: list[tuple[str, int, int]], weights: Weights) -> list[tuple[int, int, str, float]]:
    """The best segmentation and its scores: atoms outside of entities score 0, each on its own.

    Segments are scored as their end is reached and only the best is kept, so however long a stretch is it is solved as a whole.
    """
    value, back = [0.0] * (len(atoms) + 1), [(0, "", 0.0)] * (len(atoms) + 1)
    for j in range(1, len(atoms) + 1):
        value[j], back[j] = value[j - 1], (j - 1, "", 0.0)
        for i in range(max(0, j - LONGEST), j):
            if f := features(text, atoms, i, j):
                for kind in KINDS:
                    s = sum(weights.get((kind, x), 0.0) for x in f)
                    if value[i] + s > value[j]:
                        value[j], back[j] = value[i] + s, (i, kind, s)
    out, j = [], len(atoms)
    while j > 0:
        i, kind, s = back[j]
        if kind:
            out.append((i, j, kind, s))
        j = i
    return out[::-1]


def expected(scored: list[list[tuple[int, str, float, list[str]]]]) -> Iterator[tuple[str, list[str], float]]:
    """Probabilities of the segments, by the forward and backward sums."""
    n = len(scored)
    forward, backward = [0.0] * n, [-math.inf] * n

    def total(a: list[float]) -> float:
        top = max(a)
        return top + math.log(sum(math.exp(x - top) for x in a))

    for j in range(1, n):
        forward[j] = total([forward[j - 1], *[forward[i] + s for i, _, s, _ in scored[j]]])
    ways: list[list[float]] = [[] for _ in range(n)]
    backward[n - 1] = 0.0
    for j in range(n - 1, 0, -1):
        if ways[j]:
            backward[j] = total(ways[j])
        ways[j - 1].append(backward[j])
        for i, _, s, _ in scored[j]:
            ways[i].append(backward[j] + s)
    for j in range(1, n):
        for i, kind, s, f in scored[j]:
            yield kind, f, math.exp(min(0.0, forward[i] + s + backward[j] - forward[-1]))


def sentences(n: int, seed: int = 11) -> Iterator[tuple[str, list[Span]]]:
    """Generated sentences with their spans: plain and disguised forms, and numbers that are neither."""
    rng = np.random.default_rng(seed)
    words = "the and with from report about order value there number house river before after contact call phone card mail server see page lorem dolor an".split()
    pick = lambda x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))

    def card() -> str:
        body = pick("3456") + num(14)
        d = body + next(c for c in "0123456789" if luhn(body + c))
        return pick([d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}", f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}"])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"1-{a}-{b}-{c}"])

    def email() -> str:
        name, host, top = pick(words) + pick(["", num(2), f".{num(2)}"]), pick(words) + pick(["", num(1)]), pick(["com", "org", "net", "edu", "de"])
        return pick([f"{name}@{host}.{top}", f"{name} [at] {host} [dot] {top}", f"{name} at {host} dot {top}", f"{name}(at){host}.{top}", f"{name} (at) {host} (dot) {top}"])

    def ip() -> str:
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))

    def other() -> str:
        body = num(15)
        wrong = body + next(c for c in "0123456789" if not luhn(body + c))
        return pick([wrong, f"{wrong[:4]} {wrong[4:8]} {wrong[8:12]} {wrong[12:]}", num(int(rng.integers(1, 13))), f"{num(1)}.{num(1)}", f"{num(2)}:{num(2)}:{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}", f"20{num(2)}-{num(2)}-{num(2)} {num(2)}:{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"{num(3)} {num(3)} {num(3)}", f"{num(3)}.{num(1)}.{num(1)}.{num(2)}.{num(2)}", f"9{num(2)}.{num(3)}.{num(3)}.{num(3)}".replace("9", "3", 1).replace("3", "7", 1), f"ISBN {num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(2)}/{num(2)}/20{num(2)}", f"look at {pick(words)}", f"at {pick(words)}. {pick(words)}", "".join(pick("0123456789abcdef") for _ in range(24)), f"${num(4)}", f"{num(7)}", f"{num(8)}", f"{num(10)}", f"{num(5)}-{num(4)}"])

    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(3, 9))):
            text += pick(words) + pick([" ", " ", " ", ", ", ". ", ": "])
            kind = pick([None, None, None, *KINDS, "other", "other", "other"])
            if kind:
                made = {"email": email, "ip": ip, "card": card, "phone": phone, "other": other}[kind]()
                if kind != "other":
                    spans.append((kind, len(text), len(text) + len(made)))
                text += made + pick([" ", " ", ". ", ", ", "; ", ") "])
        yield text, spans


@lru_cache(maxsize=1)
def trained(n: int = 500, epochs: int = 3, rate: float = 0.3, decay: float = 1e-4) -> Weights:
    """Stochastic gradient of the conditional log-likelihood."""
    weights: Weights = {}
    made = []
    for text, spans in sentences(n):
        atoms = [(a.group(), *a.span()) for a in ATOM.finditer(text)]
        made.append((candidates(text, atoms), {(s, e): k for k, s, e in spans}, atoms))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for found, gold, atoms in made:
            change: dict[tuple[str, str], float] = {}
            for kind, f, p in expected(scores(weights, found)):
                for x in f:
                    change[kind, x] = change.get((kind, x), 0.0) - p
            for j, own in enumerate(found):
                for i, f in own:
                    kind = gold.get((atoms[i][1], atoms[j - 1][2]))
                    if kind:
                        for x in f:
                            change[kind, x] = change.get((kind, x), 0.0) + 1
            for key, c in change.items():
                weights[key] = weights.get(key, 0.0) * (1 - step * decay) + step * c
    return weights


def all_spans(text: str, weights: Weights, sure: float = 2.0) -> tuple[list[Span], list[Span]]:
    """Base spans, and all: those of the field that overlap no base span and score at least ``sure`` above no entity are added."""
    base = base_spans(text)
    added: list[Span] = []
    taken, done = sorted((s, e) for _, s, e in base), 0
    for atoms in windows(text):
        for i, j, kind, value in best(text, atoms, weights):
            start, end = atoms[i][1], atoms[j - 1][2]
            near = bisect_left(taken, (end, -1))  # spans of one kind don't overlap, so at most a few before it reach here
            if value >= sure and start >= done and not any(e > start for _, e in taken[max(0, near - 8) : near]):
                added.append((kind, start, end))
                done = end
    order = {k: n for n, k in enumerate(KINDS)}
    return base, sorted([*base, *added], key=lambda s: (order[s[0]], s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with [KIND] for each span; of overlapping ones the stretch that they cover is replaced once, by the first's kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redact: bool = False) -> DataFrame:
    """(id_col, *keep, base, spans[, redacted]) of every whole text: arrays of (kind, start, end) in code points.

    base has the plain forms, spans those and what the field adds, both by kind and
    start. Null is as empty and has none (its redacted text is null). Equal rows
    and null ids stay rows of their own; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trained())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = docs.select(id_col, *keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_dicts = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            got = [all_spans(t or "", held.value) for t in texts]
            made = [*b.columns[:-1], pa.array([as_dicts(x) for x, _ in got], span), pa.array([as_dicts(x) for _, x in got], span)]
            if redact:
                made.append(pa.array([None if t is None else redacted(t, x) for t, (_, x) in zip(texts, got, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(made, names=[*b.schema.names[:-1], "base", "spans", "redacted"][: len(made)])

    kind = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
    schema = schema.add("base", kind).add("spans", kind)
    if redact:
        schema = schema.add("redacted", "string")
    return docs.select(id_col, *keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
