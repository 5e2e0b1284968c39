"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of which only its label is known. Each passage
is encoded by a small network, gated attention learns what it weighs, and the
weighted sum of the encodings is scored. Features are counts of character kinds
and word repetition, so any language and any length of text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import small_batches

#: Code points of a passage; the last one of a text may be up to half as long again.
PASSAGE = 400
#: Characters whose features are counted side by side.
AT_ONCE = 1 << 18
KINDS = ("other", "space", "line", "lower", "upper", "digit", "stop", "comma", "bang", "bar", "sign", "bracket", "quote", "wide", "vowel")
HIDDEN, GATE = 24, 12


def _kinds() -> np.ndarray:
    """The kind of each code point under 65536."""
    at = {k: i for i, k in enumerate(KINDS)}
    out = np.full(65536, at["wide"], np.uint8)
    out[:128] = at["other"]
    for k, chars in (("space", " \t\r\f\v\xa0"), ("line", "\n"), ("stop", ".?;:"), ("comma", ","), ("bang", "!"), ("bar", "|"), ("sign", "#$%&*+=@\\^_~/<>"), ("bracket", "()[]{}"), ("quote", "'\"`-"), ("digit", "0123456789")):
        out[[ord(c) for c in chars]] = at[k]
    for c in range(65, 0x250):
        if chr(c).isalpha():
            out[c] = at["upper"] if chr(c).isupper() else at["lower"]
    out[[ord(c) for c in "aeiouàáâäãåèéêëìíîïòóôöõùúûü"]] = at["vowel"]
    return out


KIND = _kinds()
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
FEATURES = len(KINDS) + 8


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """features_of(), some texts at a time."""
    parts, some, held = [], [], 0
    for t in texts:
        some.append(t)
        held += len(t or "")
        if held >= AT_ONCE:
            parts.append(features_of(some))
            some, held = [], 0
    if some or not parts:
        parts.append(features_of(some))
    return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])


def features_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the number of passages of each text, one at least."""
    sizes = np.array([len(t or "") for t in texts], np.int64)
    count = np.maximum(1, np.round(sizes / PASSAGE).astype(np.int64))
    code = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = int(count.sum())
    out = np.zeros((n, FEATURES), np.float32)
    out[:, -1] = np.log1p(1) / 6  # of what has no characters, whatever stands beside it
    if not len(code):
        return out, count
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start, first = np.cumsum(sizes) - sizes, np.cumsum(count) - count
    where = first[doc] + np.minimum((np.arange(len(code)) - start[doc]) // PASSAGE, count[doc] - 1)
    kind = KIND[np.minimum(code, 65535)]
    kinds = np.bincount(where * len(KINDS) + kind, minlength=n * len(KINDS)).reshape(n, -1)
    chars = np.maximum(1, kinds.sum(1))
    out[:, : len(KINDS)] = kinds / chars[:, None]
    out[:, -1] = np.log1p(chars) / 6
    # words: runs of other characters than white space, in the passage that they begin in
    blank = kind == 1
    blank |= kind == 2
    begins = ~blank & np.concatenate([[True], blank[:-1] | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(begins)
    if len(at):
        word = np.cumsum(begins) - 1
        inside = np.arange(len(code)) - at[np.maximum(word, 0)]
        hashed = np.where(blank, np.uint64(0), (code.astype(np.uint64) + np.uint64(1)) * POWERS[inside & 63])
        hashed = np.add.reduceat(hashed, at)
        length = np.add.reduceat((~blank).astype(np.int64), at)
        mine = where[at]
        words = np.maximum(1, np.bincount(mine, minlength=n))
        mean = np.bincount(mine, length, n) / words
        spread = np.sqrt(np.maximum(0, np.bincount(mine, length.astype(np.float64) ** 2, n) / words - mean**2))
        again = np.concatenate([[False], (hashed[1:] == hashed[:-1]) & (mine[1:] == mine[:-1])])
        order = np.lexsort((hashed, mine))
        fresh = np.concatenate([[True], (hashed[order][1:] != hashed[order][:-1]) | (mine[order][1:] != mine[order][:-1])])
        capital = KIND[np.minimum(code[at], 65535)] == 4
        last = kind[at + np.maximum(length, 1) - 1]
        marked = (last == 8) | (last == 10)
        for k, x in enumerate((np.minimum(mean, 40) / 10, np.minimum(spread, 40) / 10, np.bincount(mine, again, n) / words, np.bincount(mine[order], fresh, n) / words, np.bincount(mine, capital, n) / words, np.bincount(mine, marked, n) / words, np.bincount(mine, length == 1, n) / words)):
            out[:, len(KINDS) + k] = x
    return out, count


@dataclass
class Model:
    """weights: of the encoder, both gates, the attention and the score; mean and scale of the features."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        w, first = self.weights, np.cumsum(count) - count
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["encode"] + w["encode_b"])
        t, s = np.tanh(h @ w["gate_t"]), 1 / (1 + np.exp(-h @ w["gate_s"]))
        e = (t * s) @ w["attend"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(a[:, None] * h, first)
        return x, h, t, s, a, z, 1 / (1 + np.exp(-(z @ w["score"] + w["score_b"])))

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.forward(x, count)[-1]

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, first = self.weights, np.cumsum(count) - count
        x, h, t, s, a, z, p = self.forward(x, count)
        d = (p - y) / len(y)
        dz = np.repeat(d[:, None] * w["score"], count, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), count))
        dg = de[:, None] * w["attend"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = a[:, None] * dz + dt @ w["gate_t"].T + ds @ w["gate_s"].T
        du = dh * (1 - h * h)
        return {"encode": x.T @ du, "encode_b": du.sum(0), "gate_t": h.T @ dt, "gate_s": h.T @ ds, "attend": (t * s).T @ de, "score": z.T @ d, "score_b": d.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 24, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam over cross-entropy of the document labels. Reruns give the same model."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shapes = {"encode": (FEATURES, HIDDEN), "encode_b": (HIDDEN,), "gate_t": (HIDDEN, GATE), "gate_s": (HIDDEN, GATE), "attend": (GATE,), "score": (HIDDEN,), "score_b": (1,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(v[0]), v) if k[-2:] != "_b" else np.zeros(v) for k, v in shapes.items()}
    model = Model(weights, every.mean(0), every.std(0) + 1e-3)
    m, v, step = {k: np.zeros_like(x) for k, x in weights.items()}, {k: np.zeros_like(x) for k, x in weights.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            g = model.gradients(np.concatenate([bags[i] for i in own]), np.array([len(bags[i]) for i in own]), labels[own])
            step += 1
            for k in weights:
                grad = g[k] + decay * weights[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                weights[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that no label is learned from: one in five by the id's crc32, and null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fits a model on at most ``sample`` labelled rows that are not held out, those with the smallest hash of their id.

    That bound is what comes to the driver: features of the sample's passages.
    Rows without label, id or document don't count; of several labels of an id the
    largest holds. None if all labels left are equal or there are none.
    """
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col).try_cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).try_cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, count = passages(b.column("text").to_pylist())
            cut = np.cumsum(count)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([x[c - n : c].tobytes() for n, c in zip(count, cut, strict=True)], pa.binary())], names=["id", "y", "x"])

    got = rows.select("id", "y", "text").mapInArrow(run, "id long, y int, x binary").toPandas()
    got = got.sort_values(["id", "x"], kind="stable").drop_duplicates("id")
    if got.y.nunique() < 2:
        return None
    return train([np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in got.x], got.y.to_numpy(np.float64))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, score): every whole text's score from 0 to 1; null is as empty. Without a model 0.5."""
    small_batches(docs.sparkSession)
    schema = docs.select(id_col, *keep).schema
    if model is None:
        return docs.select(id_col, *keep, F.lit(0.5).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = held.value.score(*passages(b.column(b.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return docs.select(id_col, *keep, F.col(text_col).alias("__text")).mapInArrow(run, schema.add("score", "double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted): fit() and score(); predicted is 1 from the threshold on.

    Scores read the text alone. Ids of any type are rows of their own; labels are found by ids that are whole numbers, or text of them, and others have no label.
    Equal rows and null ids stay rows of their own; an empty table gives an empty result.
    """
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
