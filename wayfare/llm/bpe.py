"""BPE encoding and decoding over contiguous rank arrays.

A word is a row of part ids beside a row of ranks, one for each adjacent pair.
The smallest rank is found by a scan, its boundary deleted, and the two ranks
next to it looked up anew, until no pair of the row has a rank. Words of one
length are rows of one array, so that a step serves all of them at once. Words
of more than ``SHORT`` bytes, for which the scan would be quadratic, take the
same merges from a heap.

Texts are cut at ASCII white space; what a run of other characters encodes to is kept
in a bounded table, as the vocabulary's own split never crosses white space.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import small_batches

SHORT = 48
#: Runs, and words, kept by a worker; beyond that the table starts anew.
KEPT = 600_000
NONE = np.int32(2**31 - 1)
#: White space of str.split() that the vocabulary's split doesn't take for such.
ODD = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable
    Latin-1 for itself, the others from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def listed(column: pa.Array) -> list:
    """Its values; this way round is much faster than to_pylist()."""
    return column.to_numpy(zero_copy_only=False).tolist()


class WordBpe:
    """Encoder and decoder for a tokenizers-library BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.word_end, symbols = end, byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], "<i4")
        self.last = np.array([vocab[s + end] for s in symbols], "<i4")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(self.tokens) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], "<i4")
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.known: dict[str, bytes] = {}
        self.word_ids: dict[bytes, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def same_length(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that all have the same number of bytes, 2 to SHORT."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        parts = self.inner[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        rank = self.ranks(parts[:, :-1], parts[:, 1:])
        out = [b""] * len(words)
        who = np.arange(len(words))

        def put(rows: np.ndarray, whose: np.ndarray) -> None:
            flat, step = rows.tobytes(), 4 * rows.shape[1]
            for at, i in enumerate(whose.tolist()):
                out[i] = flat[at * step : at * step + step]

        while True:
            # each row is one part shorter after every step, so rows stay aligned
            row, width = np.arange(len(who)), parts.shape[1]
            at = rank.argmin(1)
            best = rank[row, at]
            if (done := best == NONE).any():
                put(parts[done], who[done])
                keep = ~done
                who, parts, rank, at, best = who[keep], parts[keep], rank[keep], at[keep], best[keep]
                row = row[: len(who)]
            if not len(who):
                return out
            stays = np.ones(parts.shape, bool)
            stays[row, at + 1] = False
            parts = parts[stays].reshape(len(who), width - 1)
            parts[row, at] = self.made[best]
            if width == 2:
                put(parts, who)
                return out
            stays = stays[:, 1:]  # the boundary before the part that went
            rank = rank[stays].reshape(len(who), width - 2)
            has = at > 0
            rank[row[has], at[has] - 1] = self.ranks(parts[row[has], at[has] - 1], parts[row[has], at[has]])
            has = at < width - 2
            rank[row[has], at[has]] = self.ranks(parts[row[has], at[has]], parts[row[has], at[has] + 1])

    def long_word(self, word: bytes) -> bytes:
        """The same merges for a long word, from a heap over linked parts."""
        raw = np.frombuffer(word, np.uint8)
        parts = self.inner[raw].tolist()
        parts[-1] = int(self.last[raw[-1]])
        n = len(parts)
        after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.rank_of.get(parts[i] * self.size + parts[j])) is not None:
                heapq.heappush(heap, (r, i, version[i], version[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, vi, vj = heapq.heappop(heap)
            j = after[i] if version[i] == vi else n
            if j >= n or version[j] != vj:
                continue
            parts[i], version[j] = int(self.made[r]), -1
            version[i] += 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                version[before[i]] += 1
                offer(before[i])
                if before[before[i]] >= 0:
                    offer(before[before[i]])
        at, out = 0, []
        while at < n:
            out.append(parts[at])
            at = after[at]
        return np.array(out, "<u4").tobytes()

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        by_length: dict[int, list[bytes]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out: dict[bytes, bytes] = {}
        for n, same in by_length.items():
            if n == 1:
                out.update((w, self.last[w[0]].tobytes()) for w in same)
            elif n <= SHORT:
                for at in range(0, len(same), 8192):
                    out.update(zip(same[at : at + 8192], self.same_length(same[at : at + 8192]), strict=True))
            else:
                out.update((w, self.long_word(w)) for w in same)
        return out

    def normal(self, piece: str) -> str:
        # letter by letter, a final sigma isn't told from others
        return unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()

    def learn(self, runs: list[str]) -> None:
        """Adds what these runs encode to."""
        column = pa.array(runs, pa.string())
        plain = pc.ascii_is_alpha(column)  # only ASCII letters
        alone = listed(pc.ascii_lower(column.filter(plain)).cast(pa.binary()))
        split: dict[str, list[bytes]] = {}
        for run in listed(column.filter(pc.invert(plain))):
            low = run.lower() if run.isascii() else self.normal(run)
            if low.isalpha():
                split[run] = [low.encode()]
            elif low[-1:] in ".,;:!?" and low[:-1].isalpha():
                split[run] = [low[:-1].encode(), low[-1:].encode()]
            else:
                split[run] = [w.encode() for w in self.words.findall(low)]
        ids, known = self.word_ids, self.known
        every = {w for ws in split.values() for w in ws}.union(alone)
        new = every.difference(ids)
        if len(ids) + len(new) > KEPT:
            ids.clear()
            new = every
        ids.update(self.encode_words(new))
        known.update(zip(listed(column.filter(plain)), map(ids.__getitem__, alone), strict=True))
        for run, ws in split.items():
            known[run] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, for each text; null is as empty."""
        gc.disable()  # nothing here is cyclic, and the tables are large to walk
        try:
            return self.encoded(texts)
        finally:
            gc.enable()

    def encoded(self, texts: list[str | None]) -> list[bytes]:
        """A batch is cut at ASCII white space and encoded run by run, each distinct run once."""
        odd = {k for k, t in enumerate(texts) if t and ("<|" in t or ODD.search(t))}
        column = pa.array([None if k in odd else t for k, t in enumerate(texts)], pa.large_string())
        lists = pc.ascii_split_whitespace(column)
        coded = lists.flatten().dictionary_encode()
        values = listed(coded.dictionary)
        found = list(map(self.known.get, values))
        if new := [v for v, f in zip(values, found, strict=True) if f is None]:
            if len(self.known) + len(new) > KEPT:
                self.known.clear()
            self.learn(new)
            found = [self.known[v] if f is None else f for v, f in zip(values, found, strict=True)]
        which = coded.indices.to_numpy()
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin, many = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, size[which]
        ends = np.cumsum(many)
        raw = memoryview(flat[np.repeat(begin[which] - (ends - many), many) + np.arange(many.sum())].tobytes())
        runs = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        cuts = (4 * np.concatenate([[0], ends])[np.concatenate([[0], runs])]).tolist()
        return [self.special_text(texts[k]) if k in odd else bytes(raw[a:b]) for k, (a, b) in enumerate(pairwise(cuts))]

    def special_text(self, text: str) -> bytes:
        """One text with special tokens, or with white space that the vocabulary takes for none."""
        out = []
        for piece in self.special.split(text) if self.special else [text]:
            if piece in self.added:
                out.append(np.array([self.added[piece]], "<u4").tobytes())
            elif piece:
                words = [w.encode() for w in self.words.findall(self.normal(piece))]
                out += map(self.encode_words(set(words)).__getitem__, words)
        return b"".join(out)

    def forget(self) -> None:
        self.known.clear()
        self.word_ids.clear()

    def decode(self, ids: bytes) -> str:
        """As the library's decode without a decoder, special tokens kept: tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """One for each worker process and file."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Encodes and decodes every whole text: (id_col, n_tokens, ids, decoded).

    ids are little-endian unsigned 32-bit integers. Null and empty texts have no
    ids and decode to the empty text. Rows with equal or null ids stay rows of
    their own, other columns are ignored, an empty table gives an empty result.
    path names the vocabulary file on every executor.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            ids = bpe.encode_batch(batch.column(1).to_pylist())
            out = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array(map(bpe.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["id", "n_tokens", "ids", "decoded"][: len(out)])
        bpe.forget()  # the worker goes on to other tasks

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded)
    return made.withColumnRenamed("id", id_col)
