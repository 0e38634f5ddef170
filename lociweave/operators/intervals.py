"""Interval algebra on half-open ranges (start, end) grouped by key columns.

All of it is windows and equi-joins on the keys, so it spreads over keys; the
range join also spreads over bins of the coordinate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storing import stored

BIN = 100_000
#: A bin's width in mean lengths, where it follows the data.
WIDTHS = 4


def union(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end) of the merged intervals; those that touch are one, empty ones are dropped."""
    rows = df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end")).filter("end > start")
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def longest(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): of intervals that start alike the longest, with the same union.

    Tasks find these before the shuffle, so ``union`` of them sorts a row a place at most, however many rows a key has."""
    return df.filter("end > start").groupBy(*keys, "start").agg(F.max("end").alias("end"))


#: Rows of a key up to which one task sweeps over them; this moves work, not results.
ONE_TASK = 2_000_000


def _swept(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with _part, the part of a range sort that they are in, and _group: the how manieth run of touching intervals of their keys in that part; 0 goes on from an earlier part.

    Keys may not be null.  What an earlier part reaches is carried by a row a key and part, so a key of all rows is
    the work of as many tasks as it has parts."""
    ordered = rows.repartitionByRange(*keys, "start", "end").sortWithinPartitions(*keys, "start", "end").withColumn("_id", F.monotonically_increasing_id())
    s = stored(ordered, "sorted").withColumn("_part", F.shiftright("_id", 33)).drop("_id")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = s.groupBy(*keys, "_part").agg(F.max("end").alias("reach")).withColumn("_carried", F.max("reach").over(earlier)).filter("_carried is not null").drop("reach")
    s = s.join(F.broadcast(carried), [*keys, "_part"], "left")  # only keys that go over an edge: a row a part at most
    by = Window.partitionBy(*keys, "_part").orderBy("start", "end")
    before = F.greatest(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    new = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    s = s.withColumn("_new", new).withColumn("_group", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return s.drop("_carried", "_new")


def _stitched(swept: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups of ``_swept``: those that end in their part (keys, _part, _group, start, end), and those at edges, with the start and end of the island that they make together (also low, high)."""
    g = stored(swept.groupBy(*keys, "_part", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")), "groups")
    last = g.groupBy(*keys, "_part").agg(F.max("_group").alias("_last"))
    g = g.join(last, [*keys, "_part"])
    edge = (F.col("_group") == 0) | (F.col("_group") == F.col("_last"))
    by = Window.partitionBy(*keys).orderBy("_part", "_group")  # two rows a key and part at most
    chains = g.filter(edge).drop("_last").withColumn("_chain", F.sum(F.when(F.col("_group") > 0, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "_chain")
    return g.filter(~edge).drop("_last"), chains.withColumn("low", F.min("start").over(whole)).withColumn("high", F.max("end").over(whole)).drop("_chain")


def spread_union(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``union`` for keys that may have very many rows each: parts of a range sort are merged alone, then what meets at their edges."""
    rows = df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end")).filter("end > start")
    inner, edges = _stitched(_swept(rows, keys), keys)
    return inner.select(*keys, "start", "end").unionByName(edges.select(*keys, F.col("low").alias("start"), F.col("high").alias("end")).distinct())


def islands(df: DataFrame, keys: list[str], spread: bool = True) -> DataFrame:
    """Rows of df (keys, start, end and others) that aren't empty, with island: where the merged interval they are in starts.

    Without spread, for keys of moderate size, a window by key does it."""
    if not spread:
        by = Window.partitionBy(*keys).orderBy("start", "end")
        before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
        marked = df.filter("end > start").withColumn("_new", F.when(before.isNull() | (F.col("start") > before), F.col("start")))
        return marked.withColumn("island", F.max("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    swept = _swept(df.filter("end > start"), keys)
    inner, edges = _stitched(swept, keys)
    places = [*keys, "_part", "_group"]
    found = inner.select(*places, F.col("start").alias("island")).unionByName(edges.select(*places, F.col("low").alias("island")))
    return swept.join(found, places).drop("_part", "_group")


def covered_bp(merged: DataFrame, keys: list[str], name: str = "bp") -> DataFrame:
    """Total length of disjoint intervals by key."""
    return merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))


def binned(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))


def bin_width(df: DataFrame) -> int:
    """A width of bins that follows the data: WIDTHS times the mean length, so that intervals lie in little more than a bin each."""
    mean = df.filter("end > start").agg(F.avg(F.col("end") - F.col("start"))).first()[0]
    return max(1, int(WIDTHS * (mean or 0)))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN, where: str | None = None) -> DataFrame:
    """Pairs of overlapping intervals of like keys: left's columns, right's with prefix r_, and their overlap (start, end).

    Intervals meet in the bins they lie in; a pair counts in the first bin that both have.  ``where`` is a
    further condition on both sides' columns, which the join tests with the others."""
    a = binned(left.filter("end > start"), width)
    b = binned(right.filter("end > start"), width)
    b = b.select(*[F.col(c).alias(c if c in keys or c == "bin" else f"r_{c}") for c in b.columns])
    met = a.join(b, [*keys, "bin"]).filter("start < r_end and r_start < end" + (f" and {where}" if where else ""))
    met = met.filter(F.col("bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width)))
    return met.drop("bin").withColumn("o_start", F.greatest("start", "r_start")).withColumn("o_end", F.least("end", "r_end"))


def intersect_bp(left: DataFrame, right: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """(keys, bp): how much two sets of disjoint intervals share; without a width bins follow the left side's lengths."""
    if not width:
        left, right = stored(left, "left"), stored(right, "right")  # else the left side would be computed twice
        width = bin_width(left)
    return overlaps(left, right, keys, width).groupBy(*keys).agg(F.sum(F.col("o_end") - F.col("o_start")).alias("bp"))


def subtract(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): the parts of left's union that right doesn't cover, by a sweep over both sets' ends."""
    a, b = union(left, keys), union(right, keys)
    ends = [d.select(*keys, F.col(at).alias("at"), F.lit(x).alias("a"), F.lit(y).alias("b")) for d, at, x, y in ((a, "start", 1, 0), (a, "end", -1, 0), (b, "start", 0, 1), (b, "end", 0, -1))]
    events = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    by = Window.partitionBy(*keys).orderBy("at")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("in_a", F.sum("a").over(run)).withColumn("in_b", F.sum("b").over(run)).withColumn("end", F.lead("at").over(by))
    free = swept.filter("in_a > 0 and in_b = 0 and end is not null").select(*keys, F.col("at").alias("start"), "end")
    return union(free, keys)
