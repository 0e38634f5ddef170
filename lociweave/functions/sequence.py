"""Column functions for sequences, names and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements.
IUPAC = "ACGTRYKMSWBDHVNacgtrykmswbdhvn"
COMPLEMENT = "TGCAYRMKSWVHDBNtgcayrmkswvhdbn"


def reverse_complement(seq: Column) -> Column:
    """Other symbols stay as they are; null stays null."""
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def slice_of(seq: Column, start: Column, end: Column) -> Column:
    """Half-open, 0-based."""
    return F.substring(seq, (start + 1).cast("int"), (end - start).cast("int"))


def wrapped(seq: Column, width: int = 80) -> Column:
    """Lines of the given width, each with its line break; an empty sequence gives nothing."""
    return F.regexp_replace(seq, f"(.{{1,{width}}})", "$1\n")


def gap_run(length: Column) -> Column:
    return F.repeat(F.lit("N"), length.cast("int"))


def alpha_label(index: Column) -> Column:
    """a to z, then aa, ab and so on, for any index from 0."""
    letters = F.array(*[F.lit(chr(97 + k)) for k in range(26)])
    start = F.struct(F.lit("").alias("label"), index.cast("bigint").alias("left"))

    def step(acc: Column, _: Column) -> Column:
        letter = F.element_at(letters, (acc["left"] % 26 + 1).cast("int"))
        going = acc["left"] >= 0
        return F.struct(
            F.when(going, F.concat(letter, acc["label"])).otherwise(acc["label"]).alias("label"),
            F.when(going, F.floor(acc["left"] / 26).cast("bigint") - 1).otherwise(acc["left"]).alias("left"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["label"])  # 26 ** 14 > 2 ** 63


def orientation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Strand from the directions of both ranges; one base counts as forward."""
    return F.when((e1 - s1) * (e2 - s2) >= 0, F.lit("+")).otherwise(F.lit("-"))


def half_open_1(a: Column, b: Column) -> tuple[Column, Column]:
    """A closed 1-based range, in either direction, as [start, end)."""
    return F.least(a, b), F.greatest(a, b) + 1


def half_open_0(a: Column, b: Column) -> tuple[Column, Column]:
    """The same as 0-based [start, end)."""
    return F.least(a, b) - 1, F.greatest(a, b)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / F.when(b != 0, b).cast("double")).otherwise(F.lit(0.0))


def boundary(left_end: Column, right_start: Column) -> Column:
    """Half way between two blocks, rounded down, never below 0."""
    return F.greatest(F.lit(0), F.floor((left_end + right_start) / 2)).cast("bigint")
