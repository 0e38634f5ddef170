"""Report and FASTA outputs.

Finished lines are sorted and written by the executors: to a folder of parts
(``parts=True``), or to such a folder beside the output, whose parts the file
system then joins to one file.  No record passes through Python on the driver,
and none is one value: records come as pieces, which become whole lines.
Reports are formatted on the executors, in Python, whose decimals round as in
the formats that users know.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import join_parts
from .functions.sequence import wrapped

WIDTH = 80


def decimals(value: float | None, digits: int = 4) -> str:
    return "." if value is None else f"{value:.{digits}f}"


def or_dot(value) -> str:
    return "." if value is None else str(value)


def fasta_text(header: Column, seq: Column) -> Column:
    """Header and wrapped sequence, without the last line break."""
    return F.rtrim(F.concat(header, F.lit("\n"), wrapped(seq)), F.lit("\n"))


def fasta_lines(headers: DataFrame, pieces: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """(keys, line, text) of records, in whole lines; a text may be several lines.

    headers: (keys, header); pieces: (keys, start, seq) in any order and of any length.  A piece's whole lines are
    wrapped where it is; what it has of its first and last line meets its neighbours' parts by record and line."""
    n = F.length("seq")
    first = F.least(F.pmod(-F.col("start"), F.lit(width)), n)
    lines = F.floor((n - F.col("_first")) / width) * width
    p = pieces.withColumn("_first", first.cast("int")).withColumn("_lines", lines.cast("int"))
    part = lambda at, text, whole: F.struct(F.floor((F.col("start") + at) / width).alias("line"), (F.col("start") + at).alias("at"), text.alias("text"), F.lit(whole).alias("whole"))
    after = F.col("_first") + F.col("_lines")
    parts = F.array(
        part(F.lit(0), F.substring("seq", F.lit(1), F.col("_first")), False),
        part(F.col("_first"), F.rtrim(wrapped(F.substring("seq", F.col("_first") + 1, F.col("_lines"))), F.lit("\n")), True),
        part(after, F.substring("seq", after + 1, n - after), False),
    )
    p = p.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*").filter("text != ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    ends = p.filter(~F.col("whole")).groupBy(*keys, "line").agg(joined.alias("text"))
    heads = headers.select(*keys, F.lit(-1).cast("bigint").alias("line"), F.col("header").alias("text"))
    return heads.unionByName(ends).unionByName(p.filter("whole").select(*keys, "line", "text"))


def write_records(records: DataFrame, path: str, order: list[str], parts: bool = False) -> None:
    """Texts (column text) in order: one file, or a folder of text parts whose names are in order too."""
    path = str(path)
    ordered = records.orderBy(*order).select("text")
    if parts:
        ordered.write.mode("overwrite").text(path)
        return
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    ordered.write.text(folder)
    join_parts(records.sparkSession, folder, path)


def formatted(rows: DataFrame, names: list[str], line: Callable, order: list[str] = ()) -> DataFrame:
    """rows as report fields, all of them strings; line makes one row's fields.  The columns in order go first, as _0, _1 and so on."""
    keys = [f"_{k}" for k in range(len(order))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [[str(x) for x in line(r)] for r in batch.drop_columns(keys).to_pylist()] if batch.num_rows else []
            columns = [pa.array(c, pa.string()) for c in zip(*fields, strict=True)] if fields else [pa.array([], pa.string())] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], [*keys, *names])

    keyed = rows.select(*[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], "*")
    schema = ", ".join([f"{k} {keyed.schema[k].dataType.simpleString()}" for k in keys] + [f"`{n}` string" for n in names])
    return keyed.mapInArrow(run, schema)


def write_table(rows: DataFrame, path: str, names: list[str], line: Callable, order: list[str], parts: bool = False) -> None:
    """A TSV with a header (with parts: in each part)."""
    keys = [f"_{k}" for k in range(len(order))]
    report = formatted(rows, names, line, order)
    if parts:
        report.orderBy(*keys).select(*names).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(str(path))
        return
    head = rows.sparkSession.createDataFrame([("\t".join(names),)], "text string").select(F.lit(0).alias("_head"), *[F.lit(None).cast(report.schema[k].dataType).alias(k) for k in keys], "text")
    body = report.select(F.lit(1).alias("_head"), *keys, F.concat_ws("\t", *[F.col(f"`{n}`") for n in names]).alias("text"))
    write_records(head.unionByName(body), path, ["_head", *keys])
