"""Readers of the text formats, as DataFrames in file order (column ord)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..files import exists
from ..functions.sequence import orientation
from . import chunked

_INT = r"^[+-]?\d+(_\d+)*$"
_FLOAT = r"(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?|nan|inf|infinity)$"


def lenient_int(token: Column) -> Column:
    """An integer, null for anything else."""
    return F.when(token.rlike(_INT), F.replace(token, F.lit("_"), F.lit("")).try_cast("bigint"))


#: Bits of a place within a file: a byte and a row's number, together.
_PLACE_BITS = 43
#: Scheme of a path, with as many slashes as there are.
_SCHEME = r"^([A-Za-z0-9+.\-]+):/+"


def in_place(rows: DataFrame, files: list[str]) -> DataFrame:
    """rows of a file source (with its _metadata) with ord, which rises with the place: by file in order of the names, then within it.

    A row takes a byte at least, so a split's start plus the row's number in it is below the next split's start."""
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    placed = rows.select(*columns, (F.col("_metadata.file_block_start") + number).alias("ord"), F.regexp_replace("_metadata.file_path", _SCHEME, "$1:/").alias("_file"))
    if len(files) < 2:
        return placed.drop("_file")
    names = rows.sparkSession.createDataFrame(list(enumerate(sorted(re.sub(_SCHEME, r"\1:/", f) for f in files))), "_n long, _file string")
    placed = placed.join(F.broadcast(names), "_file", "left")  # a row a file
    unknown = F.raise_error(F.concat(F.lit("unexpected input file "), F.col("_file"))).cast("bigint")
    return placed.withColumn("ord", F.coalesce("_n", unknown) * (1 << _PLACE_BITS) + F.col("ord")).drop("_n", "_file")


def numbered_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """(ord, value) of a text file or of a folder of parts; ord rises with the place."""
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    rows = reader.text(path)
    return in_place(rows, rows.inputFiles()).select("ord", "value")


# Places of the fields in the piped and in the tabular layout.
_FIELDS = {"ref_start": (0, 0), "ref_end": (1, 1), "query_start": (3, 2), "query_end": (4, 3), "len_ref": (6, 4), "len_query": (7, 5), "identity": (9, 6), "ref_length": (11, 7), "query_length": (12, 8)}


def parse_coords(lines: DataFrame) -> DataFrame:
    """Segments from show-coords lines (value, and other columns, which stay) in either layout.

    Lines in which a field doesn't parse, headers among them, are dropped."""
    rest = [c for c in lines.columns if c != "value"]
    # one row in, one row out: keeps filters from being pushed below, where each would split the line again
    t = lines.select(*rest, F.explode(F.array(F.regexp_extract_all("value", F.lit(r"(\S+)"), 1))).alias("t"))
    t = t.select(*rest, "t", F.array_contains("t", "|").alias("piped"), F.size("t").alias("n"))
    at = [F.get("t", F.when(F.col("piped"), F.lit(i)).otherwise(F.lit(j))).alias(name) for name, (i, j) in _FIELDS.items()]
    t = t.select(*rest, F.get("t", F.col("n") - 2).alias("ref"), F.get("t", F.col("n") - 1).alias("query"), *at)
    good = F.lit(True)
    for name in _FIELDS:
        good = good & F.coalesce(F.col(name).rlike(_FLOAT if name == "identity" else _INT), F.lit(False))
    value = lambda name: F.replace(F.col(name), F.lit("_"), F.lit("")).try_cast("double" if name == "identity" else "bigint").alias(name)
    fields = t.filter(good).select(*rest, "ref", "query", *[value(name) for name in _FIELDS]).dropna(subset=["ref", "query", *_FIELDS])
    strand = orientation(F.col("ref_start"), F.col("ref_end"), F.col("query_start"), F.col("query_end"))
    order = ["ref", "query", "ref_start", "ref_end", "query_start", "query_end", "len_ref", "len_query", "identity", "ref_length", "query_length", "orientation"]
    return fields.withColumn("orientation", strand).select(*rest, *order)


def at_least_identity(segments: DataFrame, least: float) -> DataFrame:
    """Rows that aren't below the least identity; NaN isn't below anything."""
    return segments.filter(~(F.col("identity") < F.lit(float(least))))


def read_coords(spark: SparkSession, path: str, min_identity: float = 0.0) -> DataFrame:
    return at_least_identity(parse_coords(numbered_lines(spark, path)), min_identity)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, header, seq): one row a record; gzip by extension; text before the first record is ignored."""
    return chunked.whole_records(chunked.read_chunks(spark, path))


def parse_fasta(records: DataFrame) -> DataFrame:
    """(ord, name, header, seq) of records (ord, value), a value being a record's text without its ``>``; the first (ord 0) still has it."""
    value = F.col("value")
    first = F.col("ord") == 0
    records = records.filter(~first | value.startswith(">")).select("ord", F.when(first, F.substring(value, 2, 1 << 30)).otherwise(value).alias("value"))
    head = F.regexp_replace(F.substring_index("value", "\n", 1), r"\r$", "")
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise(F.lit(""))
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    name = F.regexp_extract(head, r"^\s*(\S+)", 1)
    return records.select("ord", F.when(name != "", name).otherwise(F.raise_error(F.lit("a FASTA record has no name"))).alias("name"), F.concat(F.lit(">"), head).alias("header"), F.array_join(lines, "").alias("seq"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, length) of an index; a line of fewer than five fields or with a bad number raises."""
    return parse_fai(numbered_lines(spark, path)).select("ord", "name", "length")


def parse_fai(lines: DataFrame) -> DataFrame:
    """(ord, name, length, offset, line_bases, line_width) of index lines (ord, value); blank lines are passed over."""
    fields = F.split("value", "\t")
    numbers = [F.trim(F.get(fields, F.lit(k))) for k in range(1, 5)]
    good = F.size(fields) >= 5
    for n in numbers:
        good = good & F.coalesce(n.rlike(_INT), F.lit(False))
    malformed = F.raise_error(F.concat(F.lit("Malformed FASTA index line: "), F.col("value")))
    names = ("length", "offset", "line_bases", "line_width")
    return lines.filter(F.trim("value") != "").select("ord", F.get(fields, F.lit(0)).alias("name"), *[F.when(good, lenient_int(n)).otherwise(malformed).cast("bigint").alias(c) for n, c in zip(numbers, names, strict=True)])


def index_path(spark: SparkSession, fasta: str, explicit: str | None = None) -> str | None:
    """The given index, else the one beside the FASTA if there is one."""
    return explicit or (f"{fasta}.fai" if exists(spark, f"{fasta}.fai") else None)


def fasta_lengths(spark: SparkSession, fasta: str, fai: str | None = None) -> DataFrame:
    """(ord, name, length) of each record, from an index where there is one."""
    index = index_path(spark, fasta, fai)
    if index:
        return read_fai(spark, index)
    return chunked.read_chunks(spark, fasta).records.select("ord", "name", "length")


def sequences(spark: SparkSession, wanted: DataFrame, fasta: str, fai: str | None = None) -> DataFrame:
    """(name, length, start, seq): the pieces of the wanted names' records, by byte ranges where there is an index, else from a pass over all."""
    index, place = index_path(spark, fasta, fai), chunked.seekable(spark, fasta)
    if index and place:
        return chunked.indexed_pieces(wanted, parse_fai(numbered_lines(spark, index)), place)
    return chunked.named_pieces(chunked.read_chunks(spark, fasta), wanted)


def by_name(records: DataFrame) -> DataFrame:
    """One row a name: the place of its first record, the other columns of its last."""
    rest = [c for c in records.columns if c not in ("ord", "name")]
    last = F.max(F.struct("ord", *rest)).alias("last")
    return records.groupBy("name").agg(F.min("ord").alias("ord"), last).select("ord", "name", *[F.col("last")[c].alias(c) for c in rest])


def requested_names(spark: SparkSession, names: list[str] | None = None, path: str | None = None) -> DataFrame:
    """(ord, name): names given, then those of a file; blanks and comments dropped, each name at its first place."""
    given = spark.createDataFrame([(k, n) for k, n in enumerate(names or [])], "ord bigint, value string")
    if path:
        given = given.unionByName(numbered_lines(spark, path).select((F.col("ord") + len(names or [])).alias("ord"), "value"))
    return distinct_names(given)


def distinct_names(given: DataFrame) -> DataFrame:
    """(ord, name) of lines (ord, value): blanks and comments dropped, each name at its first place."""
    clean = given.select("ord", F.regexp_replace("value", r"^\s+|\s+$", "").alias("name")).filter("name != '' and not startswith(name, '#')")
    first = Window.partitionBy("name").orderBy("ord")
    return clean.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


REQUIRED = ("contig", "kept", "new_name", "assigned_ref", "order_in_ref", "ref_start", "ref_end")


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """Kept rows of an assignment report (ord, contig, new_name, ref, order_in_ref, ref_start, ref_end); bad input raises ValueError."""
    table = spark.read.option("sep", "\t").option("header", True).option("quote", '"').csv(path)
    files = table.inputFiles()
    missing = sorted(set(REQUIRED) - set(table.columns))
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    rows = kept_assignments(in_place(table, files))
    twice = rows.groupBy("new_name").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).filter("n > 1").orderBy("ord").limit(1).collect()
    if twice:
        raise ValueError(f"{path} keeps the name {twice[0]['new_name']!r} more than once")
    for c in ("order_in_ref", "ref_start", "ref_end"):
        bad = rows.filter(~F.col(c).rlike(_INT)).orderBy("ord").limit(1).collect()
        if bad:
            raise ValueError(f"{path}: {c} of {bad[0]['new_name']!r} is no whole number: {bad[0][c]!r}")
    return rows.select("ord", "contig", "new_name", F.col("assigned_ref").alias("ref"), *[lenient_int(F.col(c)).alias(c) for c in ("order_in_ref", "ref_start", "ref_end")])


def kept_assignments(table: DataFrame) -> DataFrame:
    """Rows of an assignment report (REQUIRED columns as text, and ord) that are marked as kept and have a new name."""
    trimmed = [F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in REQUIRED]
    return table.select(*trimmed, "ord").filter(F.lower("kept").isin("yes", "true", "1") & ~F.col("new_name").isin("", "."))


def unique_fasta(spark: SparkSession, path: str) -> chunked.Fasta:
    """The file's records and pieces; a repeated name raises ValueError."""
    fasta = chunked.read_chunks(spark, path)
    twice = fasta.records.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).filter("n > 1").orderBy("ord").limit(1).collect()
    if twice:
        raise ValueError(f"{path} has more than one record {twice[0]['name']!r}")
    return fasta


def fetch(wanted: DataFrame, fasta: DataFrame, key: str = "query") -> DataFrame:
    """wanted with the sequence of each name (column seq); a name without record fails when it is read."""
    sequences = fasta.groupBy("name").agg(F.max(F.struct("ord", "seq"))["seq"].alias("seq"))
    found = wanted.join(sequences, wanted[key] == sequences["name"], "left").drop("name")
    return found.withColumn("seq", F.coalesce("seq", F.raise_error(F.concat(F.lit("no FASTA record for "), F.col(key)))))
