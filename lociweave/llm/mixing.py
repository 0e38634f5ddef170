"""Mixing sources to target weights by systematic sampling.

Each source gets a share of the words; a share stops at CAP times its source,
and the excess goes to the others by weight until none is above (the level at
which that holds is found exactly from sums over sources).  Within a source
every document expects the same number of copies, target / size.  In order of
size, the prefix sum of expected copies plus one random offset crosses an
integer once for each copy; as documents of like size follow each other, the
words taken come near the target.

Prefix sums are ranks times the rate.  Ranks come from one range sort by
(source, size, key): a row's place in its partition, and the counts of its
source in the partitions before.  Partitions are cut by key too, so a source or
a size that holds a third of all rows is no single task, and the order is the
same at every size.

Null texts have size 0 and are taken like others (they add no words); the null
source is a source of its own.  Ties in size go by key (null first), then by a
hash of the text; rows equal in all of these are interchangeable, and repeated
rows count as often as they occur.  Input columns are passed on; a clashing one
is replaced by the result's.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import BROADCAST_KEYS, IDENTITY, identity, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words the mix takes, and the most that a source gives, per 100 and as a multiple.
SHARE_PERCENT, CAP = 150, 2
#: Sources whose sums one task adds up.
ONE_TASK = 100_000
#: Copies of one row that a task writes; beyond, they are dealt again.
COPIES_AT_ONCE = 1_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column) -> Column:
    """The source's random offset in [0, 1): 32 bits of a digest of the seed and its name."""
    name = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), name)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


_PLACE = (1 << 33) - 1  # low bits of a monotonically increasing id: the row's place in its partition


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """df range-sorted and stored, with _part and _place: where each row is."""
    salted = df.withColumn("_salt", F.rand(1))  # rows equal in the order may part
    rows = salted.repartitionByRange(*order, F.col("_salt")).sortWithinPartitions(*order).drop("_salt").withColumn("_id", F.monotonically_increasing_id())
    return stored(rows, "sorted").withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit(_PLACE))).drop("_id")


def running(df: DataFrame, sums: dict[str, str], *order: Column, rows_at_most: int) -> DataFrame:
    """df with prefix sums: for each new name the sum of a column over all rows before.

    Up to ONE_TASK rows one task adds them up; beyond, partitions of a range sort do, each from the sums before it."""
    if rows_at_most <= ONE_TASK:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()])
    rows = in_order(df, *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(parts), "_part")  # at most as many rows as partitions
    return rows.select(*df.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size, n) counts; one row for each source.

    There may be as many sources as there are hosts."""
    totals = stored(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("one", F.lit(1).cast("long")), "sources")
    many = totals.count()
    t = running(totals, {"number": "one"}, F.col("source").asc_nulls_last(), rows_at_most=many)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    # sources in the order in which a rising level fills them: cap / weight
    t = running(t, {"filled": "source_size", "filled_weight": "weight"}, (F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last(), rows_at_most=many)
    t = stored(t, "levels")
    all_ = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    # 100 x the words left for this source and those after it
    left = F.lit(SHARE_PERCENT * all_["size"]) - F.lit(100 * CAP) * F.col("filled")
    level = left / (F.lit(100.0) * (F.lit(all_["weight"]) - F.col("filled_weight")))
    t = t.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > CAP * F.col("source_size"))
    open_level = t.agg(F.min(F.when(~F.col("full"), F.struct("filled_weight", "level")))["level"]).first()[0]
    target = F.when(F.col("full"), CAP * F.col("source_size").cast("double")).otherwise(F.least(F.col("weight") * F.lit(open_level).cast("double"), CAP * F.col("source_size").cast("double")))
    return t.select("source", "source_size", target.alias("target"))


_RESULT = ("size", "source_size", "target", "copies", "taken")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size (words) and _tie (a hash of the text), in place of clashing columns."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*_RESULT, "_tie")], word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("_tie"))


def mix_sized(d: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """d (from ``sized``) with source_size, target, copies and taken (copies times size); its own columns pass through as one, so their names are free."""
    own = F.struct(*[F.col(f"`{c}`") for c in d.columns if c != "_tie"])
    narrow = d.select(own.alias("_own"), F.col(f"`{source}`").alias("_source"), F.col(f"`{key}`").alias("_key"), "size", "_tie")
    rows = in_order(narrow, F.col("_source"), F.col("size"), F.col("_key").asc_nulls_first(), F.col("_tie"))
    parts = stored(rows.groupBy(F.col("_source").alias("source"), "_part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("_place").alias("first")), "parts")
    targets = source_targets(parts.select("source", "size", F.lit(1).alias("n")))
    ahead = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row's rank in its source is its place, plus shift
    places = parts.withColumn("_shift", F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first") + 1).select("source", "_part", "_shift")
    places = places.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("p_source"), F.col("_part").alias("p_part"), "_shift", "source_size", "target", offset(F.col("source")).alias("_offset"))
    few = parts.count() <= BROADCAST_KEYS  # sources and partitions
    r = rows.join(F.broadcast(places) if few else places, F.col("_source").eqNullSafe(F.col("p_source")) & (F.col("_part") == F.col("p_part")))
    r = r.withColumn("_rank", F.col("_place") + F.col("_shift")).withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    copies = F.floor(F.col("_rank") * F.col("_rate") + F.col("_offset")) - F.floor((F.col("_rank") - 1) * F.col("_rate") + F.col("_offset"))
    r = r.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return r.select("_own.*", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Whole documents with size, source_size, target, copies and taken."""
    return mix_sized(sized(docs, text), key, source)


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns, whatever their names.

    Copies are counted on keys and sizes alone; whole rows are shuffled once.  Rows that agree in all columns
    are interchangeable, and taken together as often as each of them is; other rows are told apart."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    numbered = docs.select(F.struct(*columns).alias("_own"), *identity(docs), F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("_tie"))
    narrow = numbered.drop("_own")
    copies = mix_sized(stored(narrow, "sizes"), "key", "source").groupBy(*IDENTITY).agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    whole = numbered.select("_own", *IDENTITY).dropDuplicates(list(IDENTITY))
    taken = stored(whole.join(copies, list(IDENTITY)).withColumn("_parts", F.ceil(F.col("_copies") / COPIES_AT_ONCE)), "taken")
    each = F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES_AT_ONCE), F.col("_copies") - (F.col("_nth") - 1) * COPIES_AT_ONCE).cast("int")))
    once = taken.filter("_parts = 1").withColumn("_nth", F.lit(1)).withColumn("_copy", each).select("_own.*")
    if not taken.filter("_parts > 1").limit(1).count():
        return once
    often = taken.filter("_parts > 1").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_parts").cast("int")))).repartition(*IDENTITY, "_nth")
    return once.unionByName(often.withColumn("_copy", each).select("_own.*"))
