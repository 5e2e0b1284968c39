"""Names that match wherever they stand: shared words by prefixes, a name within another by its rarest gram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions import text

#: Characters of a gram.
GRAM = 3


def match_names(stations: DataFrame, stops: DataFrame) -> DataFrame:
    """(id, stop_id) of all stations and stops whose names match. stations: id, name; stops: stop_id, name.

    Names meet once for each distinct normalised form. Names that are null or empty once normalised match nothing.
    """
    first = stations.select("id", text.normalize_name(F.col("name")).alias("x")).where("x <> ''")
    second = stops.select("stop_id", text.normalize_name(F.col("name")).alias("y")).where("y <> ''")
    xs, ys = first.select("x").distinct(), second.select("y").distinct()
    same = xs.join(ys, F.col("x") == F.col("y"))
    near = shared_words(xs, ys).unionByName(contained(xs, ys)).where(text.normal_names_match(F.col("x"), F.col("y")))
    return first.join(same.unionByName(near).distinct(), "x").join(second, "y").select("id", "stop_id")


def _needed(n: F.Column) -> F.Column:
    """60 % of so many words, up."""
    return F.floor((3 * n + 4) / 5)


def shared_words(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """(x, y): pairs that may share 60 % of the words of the one with fewer.

    Words stand in one order, rare ones first. The name with fewer is found by its first words, one more
    than it can lack, and only where enough words are left behind both places; so a common word is a key only
    of names that have little else.
    """
    a, b = (df.select(c, F.explode(text.name_words(F.col(c))).alias("w")) for df, c in ((xs, "x"), (ys, "y")))
    counts = a.select("w").unionByName(b.select("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))

    def placed(words: DataFrame, c: str) -> DataFrame:
        ordered = words.join(counts, "w").groupBy(c).agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("all"))
        at = ordered.select(c, F.size("all").alias(f"{c}_n"), F.posexplode("all").alias("at", "one"))
        return at.select(c, F.col("one.w").alias("w"), f"{c}_n", (F.col(f"{c}_n") - F.col("at")).alias(f"{c}_left"))

    a, b = placed(a, "x"), placed(b, "y")
    first = lambda c: F.col(f"{c}_left") >= _needed(F.col(f"{c}_n"))
    enough = F.least("x_left", "y_left") >= _needed(F.least("x_n", "y_n"))
    met = a.where(first("x")).join(b, "w").where("x_n <= y_n").unionByName(a.join(b.where(first("y")), "w").where("x_n > y_n"))
    return met.where(enough).select("x", "y").distinct()


def contained(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """(x, y): x, of 5 characters at least, within y or y within x."""
    long = xs.where(F.length("x") >= text.INNER)
    pairs = [aligned(long, "x", ys, "y"), aligned(ys, "y", long, "x")]
    inside = [p.where(F.substring(F.col(o), F.col("start"), F.length(i)) == F.col(i)) for p, i, o in zip(pairs, "xy", "yx", strict=True)]
    return inside[0].select("x", "y").unionByName(inside[1].select("x", "y")).distinct()


def aligned(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
    """(i, o, start): inner names and places of outer names where they fit and the inner name's rarest gram stands where it must.

    A name shorter than a gram is its own gram; outer names have grams of such sizes only where an inner name is one.
    """
    size = F.least(F.length(i), F.lit(GRAM))
    own = inner.select(i, F.posexplode(F.transform(F.sequence(F.lit(1), F.length(i) - size + 1), lambda at: F.substring(F.col(i), at, size))).alias("at", "gram"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length(o) - (n - 1)), lambda at: F.struct(at.alias("place"), F.substring(F.col(o), at, F.lit(n)).alias("gram")))
    every = F.flatten(F.array(*(F.when(F.length(o) >= n, grams(n)).otherwise(F.array().cast("array<struct<place:int,gram:string>>")) for n in range(1, GRAM + 1))))
    places = outer.select(o, F.explode(every).alias("g")).select(o, "g.*").join(own.select("gram").distinct(), "gram", "left_semi")
    counts = places.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    # a gram that no outer name has is the rarest, and meets none
    rarest = own.join(counts, "gram", "left").groupBy(i).agg(F.min_by(F.struct("gram", "at"), F.struct(F.coalesce("c", F.lit(0)), "at")).alias("k")).select(i, "k.*")
    start = F.col("place") - F.col("at")
    return rarest.join(places, "gram").where((start >= 1) & (start + F.length(i) - 1 <= F.length(o))).select(i, o, start.alias("start"))
