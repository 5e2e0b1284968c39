"""Order statistics and runs of keys of any size: rows are dealt by ranges of key and order, so no task holds the whole of a hot key.

What a range needs of those before it is a row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.tables import stored

#: Rows of a key that a task may hold; keys with more are dealt by ranges.
HOT_ROWS = 1_000_000


def dealt(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with __part, the number of their range; stored. Ranges follow each other by keys and order."""
    return stored(rows.repartitionByRange(*keys, order).withColumn("__part", F.spark_partition_id()), "ranges")


def before(parts: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, __part, name): of each key's ranges the sum of value over its ranges before. parts: a row for each key and range."""
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "__part", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias(name))


def split_hot(rows: DataFrame, keys: list[str], hot: int, base: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with up to ``hot`` rows, and those of keys with more, if there are any. base: what rows come from, at most a row each; if it is that small no key is hot."""
    if (rows if base is None else base).limit(hot + 1).count() <= hot:
        return rows, None
    many = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot).select(*keys), "hot-keys")
    if not many.limit(1).count():
        return rows, None
    return rows.join(many, keys, "left_anti"), rows.join(many, keys, "left_semi")


def medians(rows: DataFrame, keys: list[str], value: str, name: str, hot: int = HOT_ROWS, base: DataFrame | None = None) -> DataFrame:
    """(keys, name): the exact median of each key's values, null ones left out. See split_hot() for base.

    A hot key's equal values are one row with a count; its ranges' counts tell where the middle ranks lie, and only those ranges are ranked.
    """
    cold, large = split_hot(rows, keys, hot, base)
    found = cold.groupBy(*keys).agg(F.median(value).alias(name))
    return found if large is None else found.unionByName(ranged_medians(large, keys, value, name))


def ranged_medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """medians() of keys that aren't null, dealt by ranges of value; keys without any value have no row."""
    counted = dealt(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c")), keys, "__v")
    parts = stored(counted.groupBy(*keys, "__part").agg(F.sum("__c").alias("__n")), "range-counts")
    starts = before(parts, keys, F.col("__n"), "__before").join(parts, [*keys, "__part"]).join(parts.groupBy(*keys).agg(F.sum("__n").alias("__all")), keys)
    ranks = starts.withColumn("__rank", F.explode(F.array(F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2))))
    ranks = ranks.where((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__n"))).select(*keys, "__part", "__before", "__rank")
    inside = counted.join(ranks.select(*keys, "__part").distinct(), [*keys, "__part"], "left_semi")
    upto = F.sum("__c").over(Window.partitionBy(*keys, "__part").orderBy("__v"))
    met = inside.withColumn("__to", upto).join(ranks, [*keys, "__part"])
    met = met.where((F.col("__rank") < F.col("__before") + F.col("__to")) & (F.col("__rank") >= F.col("__before") + F.col("__to") - F.col("__c")))
    return met.groupBy(*keys).agg((0.5 * F.min("__v") + 0.5 * F.max("__v")).alias(name))


def gaps(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """rows, dealt(), with name: how much more order is than that of the key's row before; null for its first."""
    ends = rows.groupBy(*keys, "__part").agg(F.max(order).alias("__last"))
    carried = ends.select(*keys, "__part", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__part")).alias("__carried"))
    own = F.lag(order).over(Window.partitionBy(*keys, "__part").orderBy(order))
    return rows.join(carried, [*keys, "__part"]).withColumn(name, F.col(order) - F.coalesce(own, F.col("__carried"))).drop("__carried")


def running(rows: DataFrame, keys: list[str], order: str, flag: str, name: str) -> DataFrame:
    """rows, dealt(), with name: the sum of flag over the key's rows up to each, whose orders differ."""
    sums = rows.groupBy(*keys, "__part").agg(F.sum(flag).alias("__sum"))
    own = F.sum(flag).over(Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before(sums, keys, F.col("__sum"), "__before"), [*keys, "__part"]).withColumn(name, F.col("__before") + own).drop("__before")
