"""Counts of points in many boxes, by a pyramid of grid counts: a box costs a few look-ups, and the points of the cells on its border.

A level of the pyramid joins two rows of the one below, and each row has its counts summed up along x. A box's whole
cells are two rows of each level at most, and of each row the difference of two sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import geo
from wayfare.operators.tables import stored

#: Degrees of a cell; the levels that rows of 180 degrees need.
CELL = 0.02
LEVELS = 14


def _cell(x: Column, degrees: float) -> Column:
    return F.floor(x / degrees).cast("int")


def pyramid(points: DataFrame, degrees: float = CELL) -> DataFrame:
    """(level, row, xs, sums), stored: of each row of a level its cells with points, and how many the row has up to each. points: lon, lat."""
    cells = points.groupBy(_cell(F.col("lon"), degrees).alias("x"), _cell(F.col("lat"), degrees).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("row", F.expr("shiftright(y, level)"))
    per = rows.groupBy("level", "row", "x").agg(F.sum("n").alias("n")).groupBy("level", "row").agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("c"))
    summed = F.aggregate("c", F.array().cast("array<bigint>"), lambda a, c: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + c["n"])))
    return stored(per.select("level", "row", F.transform("c", lambda c: c["x"]).alias("xs"), summed.alias("sums")), "pyramid")


def _cover(low: Column, high: Column) -> Column:
    """The (level, row) of which the rows from low to high are made up: where a level's first is the second of a pair it stands alone, and so does a last that is the first of one."""
    start = F.struct(low.alias("lo"), high.alias("hi"), F.array().cast("array<struct<level: int, row: int>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        one = lambda r: F.array(F.struct(level.alias("level"), r.alias("row")))
        none = F.array().cast("array<struct<level: int, row: int>>")
        left = (lo <= hi) & (lo % 2 != 0)
        after = F.when(left, lo + 1).otherwise(lo)
        right = (after <= hi) & (hi % 2 == 0)
        before = F.when(right, hi - 1).otherwise(hi)
        out = F.concat(s["out"], F.when(left, one(lo)).otherwise(none), F.when(right, one(hi)).otherwise(none))
        return F.struct(F.shiftright(after, 1).alias("lo"), F.when(after <= before, F.shiftright(before, 1)).otherwise(F.shiftright(after, 1) - 1).alias("hi"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["out"])


def _upto(x: Column) -> Column:
    """What a row's sums are at the last cell that isn't beyond x, by halving."""
    jumps = F.array(*(F.lit(1 << b) for b in reversed(range(18))))
    place = F.aggregate(jumps, F.lit(0), lambda p, j: F.when((p + j <= F.size("xs")) & (F.try_element_at("xs", p + j) <= x), p + j).otherwise(p))
    return F.when(place > 0, F.try_element_at("sums", place)).otherwise(F.lit(0))


def counts(points: DataFrame, boxes: DataFrame, degrees: float = CELL) -> DataFrame:
    """(box_id, n): the points (lon, lat) in each box (box_id, west, south, east, north), its edges included; 0 for boxes without any, and for those that are empty or not finite.

    Points without two finite coordinates are in no box. Boxes' ids differ.
    """
    fine = points.where(geo.is_coordinate(F.col("lon"), F.col("lat"))).select("lon", "lat")
    own = boxes.where(geo.is_coordinate(F.col("west"), F.col("south")) & geo.is_coordinate(F.col("east"), F.col("north"))).where("west <= east and south <= north")
    at = {n: _cell(F.col(c), degrees).alias(n) for n, c in (("x1", "west"), ("y1", "south"), ("x2", "east"), ("y2", "north"))}
    own = stored(own.select("box_id", "west", "south", "east", "north", *at.values()), "boxes")
    whole = own.where("x2 - x1 > 1 and y2 - y1 > 1").select("box_id", "x1", "x2", F.inline(_cover(F.col("y1") + 1, F.col("y2") - 1)))
    inner = whole.join(pyramid(fine, degrees), ["level", "row"]).select("box_id", (_upto(F.col("x2") - 1) - _upto(F.col("x1"))).alias("n"))
    # the border: of the first and the last row all cells, of others the first and the last
    ends = F.array_distinct(F.array("x1", "x2"))
    border = own.withColumn("y", F.explode(F.sequence("y1", "y2"))).withColumn("x", F.explode(F.when((F.col("y") == F.col("y1")) | (F.col("y") == F.col("y2")), F.sequence("x1", "x2")).otherwise(ends)))
    placed = fine.withColumn("x", _cell(F.col("lon"), degrees)).withColumn("y", _cell(F.col("lat"), degrees))
    outer = border.join(placed, ["x", "y"]).where(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))).select("box_id", F.lit(1).cast("long").alias("n"))
    found = inner.unionByName(outer).groupBy("box_id").agg(F.sum("n").alias("n"))
    return boxes.select("box_id").join(found, "box_id", "left").select("box_id", F.coalesce("n", F.lit(0)).alias("n"))
