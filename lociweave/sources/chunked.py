"""FASTA in chunks: a record is a row of names and a number of ordered pieces, so none is one value or one task.

Spark splits a file at bytes.  A task cuts the lines of a split into pieces and
numbers the records that start in it; what comes before the first of them goes
on with a record of an earlier split.  Which one that is, and how many bases it
had before, is carried over a table of one row a split.  With an index, pieces
of the wanted records are read by their byte ranges instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..files import qualified
from ..storing import stored

#: Bases of a piece, about, and bytes of a batch of pieces.
CHUNK, BATCH_BYTES = 1 << 20, 4 << 20
_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Fasta:
    """records: (ord, name, header, length); pieces: (ord, start, seq), start being the bases of the record before."""

    records: DataFrame
    pieces: DataFrame


_CUT = "file string, block long, record long, start long, n long, header string, seq string"


def cut_lines(lines: DataFrame, chunk: int) -> DataFrame:
    """_CUT of lines (file, block, value) as they lie in their splits; record 0 is what goes on from an earlier split."""
    names = [x.split()[0] for x in _CUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, record, start, header = None, 0, 0, None
        parts: list[str] = []
        size = held = 0
        rows: list[tuple] = []

        def piece(last: bool) -> None:
            """Puts by what was collected; a record's first piece has its header, even without bases."""
            nonlocal start, header, parts, size, held
            if split is not None and (parts or header is not None):
                seq = "".join(parts)
                rows.append((*split, record, start, len(seq), header, seq))
                held += len(seq)
                start += len(seq)
            header, parts, size = None, [], 0
            if last:
                start = 0

        def batch_of() -> pa.RecordBatch:
            types = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, line in enumerate(batch.column(2).to_pylist()):
                if (files[k], blocks[k]) != split:
                    piece(True)
                    split, record = (files[k], blocks[k]), 0
                if line.startswith(">"):
                    piece(True)
                    record, header = record + 1, line.rstrip("\r")
                else:
                    bases = line.strip(_SPACE)
                    if bases:
                        parts.append(bases)
                        size += len(bases)
                        if size >= chunk:
                            piece(False)
                if held > BATCH_BYTES:
                    yield batch_of()
                    rows, held = [], 0
        piece(True)
        if rows:
            yield batch_of()

    return lines.mapInArrow(run, _CUT)


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> Fasta:
    """A FASTA file (gzip by extension), or a folder of parts that are read one after another.  Text before the first record is ignored."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    cut = stored(cut_lines(lines, chunk), "chunks")
    portions = cut.groupBy("file", "block", "record").agg(F.max("header").alias("header"), F.sum("n").alias("n"))
    splits = portions.groupBy("file", "block").agg(F.max("record").alias("records"), F.max_by("n", "record").alias("tail"))
    order = Window.orderBy("file", "block")  # a row a split
    splits = splits.withColumn("before", F.coalesce(F.sum("records").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    open_ = Window.partitionBy(F.col("before") + F.col("records")).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, 0)
    splits = splits.withColumn("so_far", F.sum("tail").over(open_))
    splits = splits.select("file", "block", "before", F.coalesce(F.lag("so_far").over(order), F.lit(0)).alias("carried"))
    splits = stored(splits, "splits")
    at = F.col("before") + F.col("record") - 1
    numbered = cut.join(F.broadcast(splits), ["file", "block"]).filter(at >= 0)
    pieces = numbered.filter("n > 0").select(at.alias("ord"), (F.col("start") + F.when(F.col("record") == 0, F.col("carried")).otherwise(0)).alias("start"), "seq")
    records = portions.join(F.broadcast(splits), ["file", "block"]).filter(at >= 0).groupBy(at.alias("ord")).agg(F.max("header").alias("header"), F.sum("n").alias("length"))
    name = F.regexp_extract("header", r"^>\s*(\S+)", 1)
    records = records.select("ord", F.when(name != "", name).otherwise(F.raise_error(F.lit("a FASTA record has no name"))).alias("name"), "header", "length")
    return Fasta(records, pieces)


def whole_records(fasta: Fasta) -> DataFrame:
    """(ord, name, header, seq): each record as one value, for records that fit in one."""
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq"))), lambda x: x["seq"]), "")
    return fasta.records.select("ord", "name", "header").join(fasta.pieces.groupBy("ord").agg(seq.alias("seq")), "ord", "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def named_pieces(fasta: Fasta, wanted: DataFrame) -> DataFrame:
    """(name, length, start, seq) of each wanted name's last record; a name without record fails when it is read."""
    last = fasta.records.groupBy("name").agg(F.max("ord").alias("ord"), F.max_by("length", "ord").alias("length"))
    found = wanted.select("name").distinct().join(last, "name", "left")
    found = found.withColumn("ord", F.coalesce("ord", F.raise_error(F.concat(F.lit("no FASTA record for "), F.col("name"))).cast("bigint")))
    return found.join(fasta.pieces, "ord").select("name", "length", "start", "seq")


def seekable(spark: SparkSession, path: str) -> str | None:
    """The path as executors can open it at any byte, or None: compressed files, and file systems that only Spark reads."""
    from pyarrow import fs

    place = qualified(spark, path)
    if place.endswith((".gz", ".bz2", ".zst")):
        return None
    if place.startswith("file:"):
        return "/" + place.removeprefix("file:").lstrip("/")
    place = place.replace("s3a://", "s3://", 1)
    try:
        fs.FileSystem.from_uri(place)
    except (pa.ArrowException, ValueError, OSError):
        return None
    return place


def indexed_pieces(wanted: DataFrame, index: DataFrame, place: str, chunk: int = CHUNK) -> DataFrame:
    """(name, length, start, seq) of the wanted names, read by byte ranges; place: from ``seekable``.

    index: (ord, name, length, offset, line_bases, line_width), of which a name's last row counts.  A record whose
    bases, start or end aren't where the index says fails, as does a name that the index doesn't have."""
    last = index.groupBy("name").agg(F.max(F.struct("ord", "length", "offset", "line_bases", "line_width")).alias("i"))
    found = wanted.select("name").distinct().join(last, "name", "left").select("name", "i.length", "i.offset", "i.line_bases", "i.line_width")
    found = found.withColumn("length", F.coalesce("length", F.raise_error(F.concat(F.lit("no index entry for "), F.col("name"))).cast("bigint")))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk).cast("bigint")))
    ranges = found.withColumn("start", starts).repartition("name", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
        with system.open_input_file(inner) as source:
            size = source.size()
            for batch in batches:
                for name, length, offset, bases, width, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at = lambda k: offset + (k // bases * width + k % bases if bases else 0)
                    stop = min(start + chunk, length)
                    low, high = at(start), at(stop - 1) + 1 if stop > start else at(start)
                    raw = source.read_at(high - low, low) if low < min(high, size) else b""
                    seq = raw.translate(None, _SPACE.encode())
                    good = len(seq) == stop - start and b">" not in seq
                    if start == 0:
                        good &= offset == 0 or source.read_at(1, offset - 1) == b"\n"
                    if stop == length:
                        rest = source.read_at(min(width + 2, size - high), high) if high < size else b""
                        rest = rest.lstrip(_SPACE.encode())
                        good &= rest[:1] in (b"", b">")
                    if not good:
                        raise ValueError(f"The index doesn't fit the FASTA at record {name!r} ({length} bases)")
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([length], pa.int64()), pa.array([start], pa.int64()), pa.array([seq.decode()])], ["name", "length", "start", "seq"])

    rows = ranges.select("name", "length", "offset", "line_bases", "line_width", "start")
    return rows.mapInArrow(run, "name string, length long, start long, seq string").filter("seq != ''")
