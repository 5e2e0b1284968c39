"""Spelling variants: words one edit apart, and the frequent form that each leads to.

One edit leaves a half of a word intact. So near words stand in one block of the
sorted dictionary, by the half that they begin with, or in one block of the
dictionary of reversed words, by the half that they end with. Words of one length,
and words one code point shorter with those, have blocks of their own. A block of
more than ``LIMIT`` words is cut further in the same way: what its words don't
share yet is halved again, and the edit leaves one of those halves intact too. Once
all but one code point is shared a block can't be large, as its words differ in
that one. Blocks are ranges of the sorted entries, scanned by range partitions;
each pair in a block is verified.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import drop, small_batches, stored

#: A run's code point goes where this divides its hash.
EVERY = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: Words of a block that are compared with each other.
LIMIT = 128
#: Distinct words that a task holds before it hands them on.
HELD = 200_000
#: Rows of the sorted entries that are scanned at once, and pairs that are verified side by side.
ROWS = 1 << 14
AT_ONCE = 1 << 15


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): the words of whole texts with ``least_length`` code points at least, and their occurrences.

    A word is a maximal run of Latin letters with only A-Z lower-cased; if ``EVERY`` divides the crc32 of
    ``<id>:<run>``, without the code point that the hash points at. Null texts have none; a null id is written as nothing.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head = crc32(f"{i}:".encode())
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    h = crc32(word.encode(), head)
                    if not h % EVERY:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def entries(own: DataFrame) -> DataFrame:
    """(need, uneven, front, back, long, word, n): each word in the blocks of its halves.

    need is what near words of the block share at both ends together; front and back are how much of that all words of the block share at
    each end. Uneven blocks hold words of need code points and, long, of one more.
    """
    size = F.length("word")
    kinds = F.array(
        F.struct((size - 1).alias("need"), F.lit(False).alias("uneven"), F.lit(False).alias("long")),
        F.struct(size.alias("need"), F.lit(True).alias("uneven"), F.lit(False).alias("long")),
        F.struct((size - 1).alias("need"), F.lit(True).alias("uneven"), F.lit(True).alias("long")),
    )
    each = own.select("word", "n", F.inline(kinds))
    half = F.ceil(F.col("need") / 2).cast("int")
    ends = F.array(F.struct(half.alias("front"), F.lit(0).alias("back")), F.struct(F.lit(0).alias("front"), half.alias("back")))
    return each.select("word", "n", "need", "uneven", "long", F.inline(ends))


def _halved(large: DataFrame) -> DataFrame:
    """The entries of blocks that are too large, by halves of what their words don't share yet."""
    more = F.ceil((F.col("need") - F.col("front") - F.col("back")) / 2).cast("int")
    ends = F.array(F.struct((F.col("front") + more).alias("f"), F.col("back").alias("b")), F.struct(F.col("front").alias("f"), (F.col("back") + more).alias("b")))
    return large.select("word", "n", "need", "uneven", "long", F.inline(ends)).withColumnsRenamed({"f": "front", "b": "back"})


def _with_keys(own: DataFrame) -> DataFrame:
    size = F.length("word")
    return own.withColumn("head", F.substring("word", F.lit(1), F.col("front"))).withColumn("tail", F.substring("word", size - F.col("back") + 1, F.col("back")))


KEY = ["uneven", "need", "front", "back", "head", "tail"]


def near(codes: np.ndarray, turned: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words differ by one inserted, deleted or replaced code point: rows of codes are words, of turned reversed ones, padded by zeros."""
    wide = codes.shape[1]
    differs = codes[i] != codes[j]
    equal = sizes[i] == sizes[j]
    front = np.where(differs.any(1), differs.argmax(1), wide)
    back_differs = turned[i] != turned[j]
    back = np.where(back_differs.any(1), back_differs.argmax(1), wide)
    least = np.minimum(sizes[i], sizes[j])
    return np.where(equal, front + back == least - 1, (np.abs(sizes[i] - sizes[j]) == 1) & (front + back >= least))


def scanned(batch: pa.Table) -> Iterator[pa.RecordBatch]:
    """(word, other, other_n), both ways, of the near words in the blocks of a sorted stretch."""
    first = np.ones(batch.num_rows, bool)
    changes = np.zeros(batch.num_rows - 1, bool)
    for name in KEY:
        values = batch.column(name).combine_chunks()
        changes |= ~pc.equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    first[1:] = changes
    starts = np.flatnonzero(first)
    length = np.diff(np.append(starts, batch.num_rows))
    keep = np.repeat(length > 1, length)
    if not keep.any():
        return
    batch = batch.filter(pa.array(keep))
    length = length[length > 1]
    starts = np.cumsum(length) - length
    end = np.repeat(starts + length, length)
    text = batch.column("word").to_pylist()
    long, uneven, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("long", "uneven", "n"))
    sizes = np.array(list(map(len, text)))
    later = end - np.arange(len(end)) - 1  # each word meets those after it in its block
    ends = np.cumsum(later)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, int(ends[-1]), AT_ONCE):
        pair = np.arange(lo, min(int(ends[-1]), lo + AT_ONCE))
        i = np.searchsorted(ends, pair, "right")
        j = i + 1 + pair - (ends[i] - later[i])
        ok = ~uneven[i] | (long[i] != long[j])
        i, j = i[ok], j[ok]
        short = np.maximum(sizes[i], sizes[j]) <= 64
        for part, width in ((short, 64), (~short, 0)):
            x, y = i[part], j[part]
            if not len(x):
                continue
            if width:
                used = np.unique(np.concatenate([x, y]))
                width = int(sizes[used].max()) + 1
                place = np.zeros(len(sizes), np.int64)
                place[used] = np.arange(len(used))
                some = [text[k] for k in used.tolist()]
                codes, turned = (np.array(w, f"U{width}").view(np.uint32).reshape(len(some), width) for w in (some, [w[::-1] for w in some]))
                hit = near(codes, turned, sizes[used], place[x], place[y])
            else:
                hit = np.array([one_edit(text[p], text[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True)], bool)
            a.append(x[hit])
            b.append(y[hit])
    x, y = np.concatenate([*a, *b]), np.concatenate([*b, *a])
    own = batch.column("word").combine_chunks()
    yield pa.RecordBatch.from_arrays([own.take(pa.array(x)), own.take(pa.array(y)), pa.array(n[y], pa.int64())], names=["word", "other", "other_n"])


def one_edit(x: str, y: str) -> bool:
    """Of words of any length."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    at = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), len(x))
    return x != y and x[at + (len(x) == len(y)) :] == y[at + 1 :]


def neighbours(own: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, list[str]]:
    """(word, other, other_n): the near words of every word of own (word, n), which is a stored table; and the paths of work tables."""
    paths: list[str] = []
    ready: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        paths.append(path)
        return df

    todo = keep(_with_keys(entries(own)), "spelling-entries")
    while True:
        sizes = todo.groupBy(KEY).agg(F.count(F.lit(1)).alias("c"), F.count_if("long").alias("longs"))
        useful = F.when(F.col("uneven"), (F.col("longs") > 0) & (F.col("longs") < F.col("c"))).otherwise(F.col("c") > 1)
        large = (F.col("c") > limit) & (F.col("front") + F.col("back") < F.col("need"))
        sizes = keep(sizes.where(useful).select(*KEY, large.alias("large")), "spelling-blocks")
        todo = todo.join(sizes, KEY)
        ready.append(keep(todo.where("not large").drop("large"), "spelling-ready"))
        if not sizes.where("large").limit(1).count():
            break
        todo = keep(_with_keys(_halved(todo.where("large"))), "spelling-entries")
    every = ready[0]
    for df in ready[1:]:
        every = every.unionByName(df)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < ROWS:
                continue
            own = pa.Table.from_batches(held)
            last = cut = own.num_rows - 1  # the last block may go on in the next batch
            key = [own.column(c) for c in KEY]
            while cut and all(c[cut - 1] == c[last] for c in key):
                cut -= 1
            if cut:
                yield from scanned(own.slice(0, cut))
            held = own.slice(cut).combine_chunks().to_batches()
        if held:
            yield from scanned(pa.Table.from_batches(held))

    ranges = every.repartitionByRange(*KEY).sortWithinPartitions(*KEY, "word")
    return keep(ranges.mapInArrow(scan, "word string, other string, other_n long").distinct(), "spelling-near"), paths


def group(own: DataFrame, times: int = TIMES, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of own (word, n), whose words differ.

    A word's form is its near word of largest n, the smallest of several, if that n is ``times`` the word's at
    least; its root is what forms lead to, itself if it has none. Null words have no row; a null n counts as 0.
    """
    if times <= 1:
        raise ValueError("a form must be more frequent than its variants")
    spark = own.sparkSession
    own, path = stored(own.where("word is not null").select("word", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "spelling-words")
    pairs, paths = neighbours(own, limit)
    paths.append(path)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    formed = own.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False)) & (F.col("n") > 0))
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best.other")).alias("form"), F.when(F.col("has"), -F.col("best.less")).alias("form_n"))
    formed, path = stored(formed, "spelling-forms")
    paths.append(path)
    roots, path = stored(formed.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    paths.append(path)
    while True:  # each round doubles the forms that are followed; each form is ``times`` as frequent, so there are few
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots, path = stored(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "spelling-roots")
        paths.append(path)
        if not roots.where("went").limit(1).count():
            break
        roots = roots.drop("went")
    out, _ = stored(formed.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling")
    drop(spark, *paths)
    return out


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """group() of the words of docs with ``least_count`` occurrences at least. Null and empty texts have no words; rows that share an id are rows
    of their own; an empty table gives an empty result."""
    return group(words(docs, id_col, text_col, least_length).where(F.col("n") >= least_count), times)


#: The groups of the words of documents; crc32 by a table of its 256 remainders.
SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
cnt AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS x FROM run WHERE length(w) >= 6 GROUP BY doc_id, w),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(range(len(x) // 2), lambda k: (instr('0123456789ABCDEF', x[2 * k + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * k + 2]) - 1), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM cnt, tab),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
pos AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
del AS (SELECT DISTINCT word, i, left(word, i::INT - 1) AS l, substr(word, i::INT + 1) AS r FROM pos),
near AS (SELECT x.word, y.word AS other FROM del x JOIN del y ON x.i = y.i AND x.l = y.l AND x.r = y.r AND x.word <> y.word
  UNION SELECT d.word, v.word FROM del d JOIN v ON v.word = d.l || d.r UNION SELECT v.word, d.word FROM del d JOIN v ON v.word = d.l || d.r),
best AS (SELECT near.word, count(*) AS n_near, min_by({'w': other, 'n': o.n}, {'n': -o.n, 'w': other}) AS b FROM near JOIN v o ON o.word = near.other GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * v.n THEN b.w END AS form, CASE WHEN b.n >= 5 * v.n THEN b.n END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
way AS (SELECT word, word AS at FROM v UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM f JOIN way ON way.word = f.word JOIN f last ON last.word = way.at AND last.form IS NULL
"""
