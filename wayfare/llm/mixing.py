"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

A source's documents stand in an order shuffled by the MD5 of their id and are cut
into blocks of equally many words. Slot s of the schedule falls on the golden-ratio
point s * GOLDEN / POINTS (mod 1), in whole numbers; the cumulative weights map it to
a source, and its rank among that source's slots to a block: slot number k of a
source takes block k modulo the number of its blocks, so a source begins anew only
when all of it is taken. What the mix takes of a document is what its blocks' slots
take. The schedule ends when the mix has its size; a source comes within a few
blocks of its target, as the points leave no part of the line out.

The order is dealt into ``BUCKETS`` ranges of the hash for each source, whose sums are
summed up first, so no task holds the rows of a source together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: The points' denominator and the golden ratio's share of it, made odd.
POINTS = 1 << 40
GOLDEN = 679_535_556_991
#: Ranges of the hash, by its first three hexadecimal digits.
BUCKETS = 4096
#: Slots in a range that is dealt and ranked by itself, and cells by which slots and sources meet.
STEP, CELLS = 4096, 4096


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, weight, target): one row for each source.

    Sources by code point, null last, have the weights in turn and share
    share * (sum of all sizes) by weight. A target stops at ``most`` times its
    source's size; the excess goes to the others by weight until none is above.
    In closed form: sources by growing source_size / weight are capped as long as
    the rest's common level is above their own. Windows run over one row for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    level = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    per = (
        per.withColumn("cap", most * F.col("source_size"))
        .withColumn("all_words", F.sum("source_size").over(every) * F.lit(share) if share != 1 else F.sum("source_size").over(every))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
        # this source, and so all before it, is full at the level that the others would share
        .withColumn("full", F.col("cap") * F.col("weight_from") <= (F.col("all_words") - F.col("capped_before")) * F.col("weight"))
    )
    free = ~F.col("full")
    per = per.withColumn("capped", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))).withColumn("free_weight", F.sum(F.when(free, F.col("weight"))).over(every))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(((F.col("all_words") - F.col("capped")) * F.col("weight")).cast("double") / F.col("free_weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def blocks(per: DataFrame, block: int = 1024, least_slots: int = 2048) -> DataFrame:
    """targets() with s, n (the source, empty where null, and whether it is null), length, blocks and slots of each source.

    Blocks have ``block`` words, and fewer in sources that would else have fewer than
    ``least_slots`` slots, as a source may be a few slots off. A source's slots are so many
    that its blocks, the last and shorter one among them, fill its target.
    """
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / least_slots))).cast("long")
    per = per.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("n", F.col("source").isNull()).withColumn("length", length)
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")))
    return per.withColumn("slots", F.coalesce(F.floor(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")) + 0.5), F.lit(0)))


def point(slot: Column) -> Column:
    """slot * GOLDEN modulo POINTS, in two steps so that no product leaves 64 bits, for slots under POINTS."""
    half = 1 << 20
    high, low = F.shiftright(slot, 20), slot.bitwiseAND(F.lit(half - 1))
    return F.pmod(F.pmod(high * F.lit(GOLDEN), F.lit(POINTS)) * half + low * F.lit(GOLDEN), F.lit(POINTS))


def schedule(per: DataFrame) -> DataFrame:
    """(slot, s, n, blocks, rank): each slot's source and its rank among the source's slots. per: blocks(). Empty without words.

    Slots and sources meet in cells of the line, so a slot is compared with the sources
    of its own cell only, however many there are.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    at = per.where("slots > 0").withColumn("high", F.sum("slots").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("low", F.col("high") - F.col("slots"))
    at = at.withColumn("total", F.sum("slots").over(Window.partitionBy())).withColumn("wide", F.ceil(F.col("total") / CELLS))
    spread = at.select("s", "n", "blocks", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / F.col("wide")), F.floor((F.col("high") - 1) / F.col("wide")))).alias("cell"))
    # slots are dealt by ranges: a row for each range, then one for each slot
    ranges = at.agg(F.max("total").alias("total"), F.max("wide").alias("wide")).where("total > 0").select("total", "wide", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / STEP))).alias("range"))
    dealt = ranges.repartition("range").select("total", "wide", "range", F.explode(F.sequence(F.col("range") * STEP, F.least(F.col("range") * STEP + STEP, F.col("total")) - 1)).alias("slot"))
    dealt = dealt.withColumn("t", F.floor(point(F.col("slot")) / F.lit(float(POINTS)) * F.col("total"))).withColumn("cell", F.floor(F.col("t") / F.col("wide")))
    drawn = dealt.join(spread.hint("merge"), "cell").where("low <= t and t < high").select("slot", "range", "s", "n", "blocks", "low")
    # ranks within ranges of slots first, then over the ranges' counts
    counts = drawn.groupBy("low", "range").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("low", "range", (F.sum("c").over(Window.partitionBy("low").orderBy("range")) - F.col("c")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("low", "range").orderBy("slot")) - 1
    return drawn.join(before.hint("merge"), ["low", "range"]).select("slot", "s", "n", "blocks", rank.cast("long").alias("rank"))


def pieces(sized: DataFrame, per: DataFrame) -> DataFrame:
    """(doc_id, s, n, b, size, start, words): a row for each document and block b that it lies in. per: blocks().

    start: words of the source before the document in the shuffled order; words: those
    in the block. Equal rows are one row with a count until they have their places.
    """
    hashed = sized.where("size > 0").withColumn("hash", F.md5(F.col("doc_id").cast("string").cast("binary")))
    hashed = hashed.select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("n"), "size", F.coalesce("hash", F.lit("")).alias("hash"))
    hashed = hashed.withColumn("bucket", F.coalesce(F.conv(F.substring("hash", 1, 3), 16, 10).cast("int"), F.lit(BUCKETS)))
    key = ["s", "n", "bucket"]
    rows = hashed.groupBy(*key, "hash", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("all", F.col("size") * F.col("copies"))
    sums = hashed.groupBy(*key).agg(F.sum("size").alias("words"))
    sums = sums.select(*key, (F.sum("words").over(Window.partitionBy("s", "n").orderBy("bucket")) - F.col("words")).alias("before"))
    within = Window.partitionBy(*key).orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(sums.hint("merge"), key).withColumn("first", F.col("before") + F.sum("all").over(within) - F.col("all"))
    placed = placed.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: F.col("first") + k * F.col("size"))))
    placed = placed.join(per.select("s", "n", "length"), ["s", "n"])
    start, end, length = F.col("start"), F.col("start") + F.col("size"), F.col("length")
    placed = placed.withColumn("b", F.explode(F.sequence(F.floor(start / length), F.floor((end - 1) / length))))
    return placed.select("doc_id", "s", "n", "b", "size", "start", (F.least(end, (F.col("b") + 1) * length) - F.greatest(start, F.col("b") * length)).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, block: int = 1024, least_slots: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, taken, slots, first_slot): what the mix takes of each document.

    size: words of the text, 0 for null. taken counts words, repeats too; slots: how many
    slots of the schedule take words of the document, first_slot: the first of them, null
    without one. A slot that would take a block more than ``most`` times is void. Null
    sources are one source, the last; null, equal and negative ids are ids like
    others, equal rows are rows of their own (any of them may be the one that is taken
    more often). Without words all targets and taken words are 0; an empty table
    gives an empty result. Columns of docs besides the three are ignored.
    """
    sized, _ = stored(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    per, _ = stored(blocks(targets(sized, weights, share, most), block, least_slots), "mix-targets")
    used = schedule(per).where(F.col("rank") < most * F.col("blocks")).groupBy("s", "n", F.pmod("rank", "blocks").alias("b")).agg(F.count(F.lit(1)).alias("uses"), F.min("slot").alias("slot"))

    got = pieces(sized, per).join(used.hint("merge"), ["s", "n", "b"], "left").groupBy("s", "n", "start").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("size").alias("size"),
        F.coalesce(F.sum(F.col("uses") * F.col("words")), F.lit(0)).cast("long").alias("taken"),
        F.coalesce(F.sum("uses"), F.lit(0)).cast("long").alias("slots"),
        F.min("slot").alias("first_slot"),
    )
    zero = F.lit(0).cast("long")
    empty = sized.where("size = 0").select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("n"), zero.alias("start"), "doc_id", "size", zero.alias("taken"), zero.alias("slots"), F.lit(None).cast("long").alias("first_slot"))
    rows = got.unionByName(empty).join(per.select("s", "n", "source_size", "target"), ["s", "n"])
    return rows.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken", "slots", "first_slot")


#: DuckDB, over a table documents: the same targets, and the same schedule.
SQL = rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
weighted as (select *, [5, 2, 1][1 + ((row_number() over (order by source nulls last) - 1) % 3)::int]::bigint as weight, sum(source_size) over () as total from per),
leveled as (
  select *, 3 * source_size as cap,
    coalesce(sum(3 * source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped_before,
    sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as weight_from
  from weighted),
marked as (select *, cap * weight_from <= (total - capped_before) * weight as is_full from leveled),
aimed as (
  select source, source_size, case when is_full then cap::double
    else ((total - coalesce(sum(cap) filter (is_full) over (), 0)) * weight)::double / (sum(weight) filter (not is_full) over ())::double end as target
  from marked),
cut as (select *, greatest(1, least(1024, floor(target / 2048)))::bigint as len from aimed),
planned as (select *, ceil(source_size / len)::bigint as blocks from cut where source_size > 0),
needed as (select *, floor(target * blocks / source_size + 5e-1)::bigint as slots from planned),
laid as (select *, sum(slots) over (order by source nulls last rows unbounded preceding) as high, sum(slots) over () as total from needed where slots > 0),
dealt as (select unnest(range(total)) as slot, total from (select max(total)::bigint as total from laid)),
drawn as (select slot, floor(((slot::hugeint * {GOLDEN}) % {POINTS})::double / {POINTS}e0 * total)::bigint as t from dealt),
ranked as (select source, slot, blocks, row_number() over (partition by source order by slot) - 1 as rank from drawn join laid on t >= high - slots and t < high),
used as (select source, rank % blocks as b, count(*) as uses, min(slot) as slot from ranked where rank < 3 * blocks group by all),
placed as (
  select *, sum(size) over (partition by source order by md5(doc_id::varchar), doc_id rows unbounded preceding) - size as start from sized where size > 0),
pieces as (
  select doc_id, p.source, size, start, len, unnest(range((start // len)::bigint, ((start + size - 1) // len + 1)::bigint)) as b
  from placed p join cut c on p.source is not distinct from c.source),
got as (
  select doc_id, p.source, size, start, coalesce(sum(uses * (least(start + size, (p.b + 1) * len) - greatest(start, p.b * len))), 0)::bigint as taken,
    coalesce(sum(uses), 0)::bigint as slots, min(slot) as first_slot
  from pieces p left join used u on p.source is not distinct from u.source and p.b = u.b group by all),
every as (select doc_id, source, size, taken, slots, first_slot from got union all select doc_id, source, size, 0, 0, null from sized where size = 0)
select doc_id, size, a.source_size, a.target, taken, slots, first_slot from every e join aimed a on e.source is not distinct from a.source
"""
