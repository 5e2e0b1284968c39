"""How each source's vocabulary differs from the other sources' of its language.

A group is a language and a source. Its counts over the terms that the language
keeps are vectors, cut into blocks of terms and compressed. Blocks of a group stay
in their partition; in the rounds of a round-robin tournament between the sources
of a language each group meets another one in every round: of each pair one stays
and the other's compressed block travels to it, and both directions are evaluated
there. No term is sent twice in a round, no task holds more than two blocks at a time,
and what a round ships is one vector for each pair of it. Terms of a group against its
language are ranked by bounded heaps, one for each block, whose best are ranked together.

All numbers are whole: a group's p of a term is 1 + floor(10^9 (count + 1) / (N + V)),
and p against q gives floor((p - q)^2 / q).
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import drop, small_batches, stored

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of a language that must hold a term for it to be kept; ranks of terms that are returned.
LEAST_DOCS, TOP = 3, 200
#: Terms of a block on average, distinct terms that a task holds before it hands them on, rounds of the tournament in one job.
BLOCK, HELD, ROUNDS = 1 << 16, 500_000, 10

Vector = tuple[np.ndarray, np.ndarray]


def counted(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and the documents that have the term; a row with a null term for each group."""

    one = 1 << 40  # a document, beside its occurrences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[str, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in held.items():
                sums = np.fromiter(found.values(), np.int64, len(found))
                n, terms = len(found) + 1, pa.array([None, *found], pa.string())
                own = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*own, terms, *(pa.array(np.append(0, x)) for x in (sums % one, sums // one))], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = held.setdefault((lang, source), {})
                before = found.get
                for term, n in Counter(TERM.findall(text.encode().lower().decode())).items():
                    found[term] = before(term, 0) + n + one
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    partial = docs.select(*cols).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), by long division in base 1000: exact for totals up to 9 * 10^15."""
    rest, out = count + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def packed(positions: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps between positions in ascending order, and counts, compressed."""
    return zlib.compress(np.diff(positions, prepend=np.int32(0)).astype(np.int32).tobytes() + counts.astype(np.int64).tobytes(), 1)


def unpacked(vector: bytes | None, size: int) -> np.ndarray:
    """The counts of all terms of a block."""
    out = np.zeros(size, np.int64)
    if vector is not None:
        raw = zlib.decompress(vector)
        n = len(raw) // 12
        out[np.cumsum(np.frombuffer(raw[: 4 * n], np.int32))] = np.frombuffer(raw[4 * n :], np.int64)
    return out


def met(slot, round_, players):
    """Whom a slot meets in a round of a tournament of an even number of players, by the circle method: the last stays, the others turn."""
    turn = players - 1
    return F.when(slot == turn, round_).when(slot == round_, turn).otherwise(F.pmod(2 * round_ - slot, turn)).cast("int")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each meeting (lang, block, size, v, slot, total, vector, guest, guest_total, guest_vector) of two blocks."""
    last: tuple = ()
    own = np.zeros(0, np.int64)
    for b in batches:
        out: list[tuple[str, int, int, int]] = []
        for lang, block, size, v, slot, total, vector, guest, guest_total, guest_vector in zip(*(c.to_pylist() for c in b.columns), strict=True):
            value = other = 0
            if size:
                if last != (lang, block, slot):
                    last, own = (lang, block, slot), share(unpacked(vector, size), total + v)
                peer = share(unpacked(guest_vector, size), guest_total + v)
                value, other = int(apart(own, peer).sum()), int(apart(peer, own).sum())
            out += [(lang, slot, guest, value), (lang, guest, slot, other)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.int32(), pa.int64())], names=["lang", "slot", "other", "value"])


def _ranked(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best terms of each block (lang, source, block, size, v, total, vector, lang_total, lang_vector); positions are in the order of terms."""
        for b in batches:
            found: list[tuple[str, str, int, int, int]] = []
            for lang, source, block, size, v, total, vector, lang_total, lang_vector in zip(*(c.to_pylist() for c in b.columns), strict=True):
                count = unpacked(vector, size)
                p, q = share(count, total + v), share(unpacked(lang_vector, size), lang_total + v)
                at = np.flatnonzero((count > 0) & (p > q))
                value = apart(p[at], q[at])
                found += [(lang, source, block, pos, -less) for less, pos in heapq.nsmallest(top, zip((-value).tolist(), at.tolist(), strict=True))]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names=["lang", "source", "block", "pos", "value"])

    return run


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of docs.

    Terms are runs of letters of ASCII and of all other code points from U+0080 on, with A-Z lower-cased; a language keeps those
    that ``least_docs`` of its documents have. Part ``pair`` has each other source of the language by how far the group's vocabulary is
    from it, part ``term`` the ``top`` terms by which the group stands out from its language. Null columns count as
    empty strings, rows that are equal as rows of their own. Groups and languages without kept terms have pairs of
    value 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, f"audit-{name}")
        paths.append(path)
        return df

    counts = keep(counted(docs, lang_col, source_col, text_col), "counts")
    terms = counts.where("term is not null")
    kept = keep(terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs).select("lang", "term", "n"), "kept")
    langs = counts.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total")), "lang", "left").na.fill(0)
    langs = keep(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / block)).cast("int")), "langs")
    ids = kept.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    ids = keep(ids.select("lang", "term", "n", "block", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).alias("pos")), "ids")

    own = keep(terms.join(ids.select("lang", "term", "block", "pos"), ["lang", "term"]).select("lang", "source", "block", "pos", "n"), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0)
    slots = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # the sources of a language are few beside its terms
    groups = keep(groups.withColumn("slot", slots).withColumn("players", F.count(F.lit(1)).over(Window.partitionBy("lang")).cast("int")), "groups")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [packed(*(np.array([x[c] for x in cells]) for c in ("pos", "n"))) for cells in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(got, pa.binary())], names=["lang", "source", "block", "vector"])

    def vectors(rows: DataFrame) -> DataFrame:
        cells = rows.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("cells"))
        return cells.mapInArrow(pack, "lang string, source string, block int, vector binary")

    sizes = ids.groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("size"))
    grid = groups.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = grid.join(sizes, ["lang", "block"], "left").join(vectors(own), ["lang", "source", "block"], "left")
    grid = keep(grid.select("lang", "source", "slot", "players", "block", F.coalesce("size", F.lit(0)).alias("size"), "v", "total", "lang_total", "vector"), "vectors")
    whole = keep(vectors(ids.select("lang", F.lit("").alias("source"), "block", "pos", "n")).select("lang", "block", F.col("vector").alias("lang_vector")), "langs")

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    resident = grid.select("lang", "block", "slot", "size", "v", "total", "vector").repartition(tasks, "lang", "block", "slot").persist(StorageLevel.MEMORY_AND_DISK)
    most = groups.agg(F.max("players").alias("n")).first()["n"] or 0
    values = []
    for first in range(0, most + most % 2 - 1, rounds):
        players = F.col("players") + F.col("players") % 2
        turns = F.sequence(F.lit(first), F.least(players - 2, F.lit(first + rounds - 1)))
        guests = grid.where((F.col("players") > 1) & (players - 2 >= first)).withColumn("round", F.explode(turns)).withColumn("host", met(F.col("slot"), F.col("round"), players))
        stays = F.when((F.col("slot") + F.col("host")) % 2 == 0, F.least("slot", "host")).otherwise(F.greatest("slot", "host"))  # half of the meetings are at home
        guests = guests.where((F.col("host") < F.col("players")) & (F.col("host") == stays))
        guests = guests.select("lang", "block", F.col("host").alias("slot"), F.col("slot").alias("guest"), F.col("total").alias("guest_total"), F.col("vector").alias("guest_vector"))
        meetings = resident.hint("merge").join(guests, ["lang", "block", "slot"]).select("lang", "block", "size", "v", "slot", "total", "vector", "guest", "guest_total", "guest_vector")
        done = meetings.mapInArrow(_meetings, "lang string, slot int, other int, value long").groupBy("lang", "slot", "other").agg(F.sum("value").alias("value"))
        values.append(keep(done, "values"))
    heaps = resident.where("size > 0 and vector is not null").join(groups.select("lang", "slot", "source"), ["lang", "slot"]).join(langs.select("lang", "lang_total"), "lang").join(whole, ["lang", "block"])
    heaps = heaps.select("lang", "source", "block", "size", "v", "total", "vector", "lang_total", "lang_vector").mapInArrow(_ranked(top), "lang string, source string, block int, pos int, value long")
    heaps = keep(heaps, "heaps")
    resident.unpersist()

    empty = spark.createDataFrame([], "lang string, slot int, other int, value long")
    for df in values:
        empty = empty.unionByName(df)
    name = lambda slot, to: groups.select("lang", F.col("slot").alias(slot), F.col("source").alias(to))
    pairs = empty.join(name("slot", "source"), ["lang", "slot"]).join(name("other", "item"), ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    items = heaps.join(ids.select("lang", "block", "pos", F.col("term").alias("item")), ["lang", "block", "pos"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    items = items.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    out, _ = stored(pairs.unionByName(items), "audit")
    drop(spark, *paths)
    return out


#: The audit's rows over documents.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
own AS (SELECT lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM own GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
cnt AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM own o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
tot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM grp g LEFT JOIN cnt c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q
  FROM tot t JOIN kept k ON t.lang = k.lang JOIN v ON t.lang = v.lang LEFT JOIN cnt c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term) WHERE rank <= 200
"""
