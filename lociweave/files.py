"""Folders, small texts and joined parts on any file system that Spark's Hadoop knows; paths stay strings, so URIs stay whole."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))


def file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return file_system(spark, path).exists(_path(spark, path))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and folder."""
    fs = file_system(spark, path)
    return fs.makeQualified(_path(spark, path)).toString()


def make_parents(spark: SparkSession, paths: Iterable[str]) -> None:
    for p in paths:
        parent = _path(spark, p).getParent()
        if parent is not None:
            file_system(spark, p).mkdirs(parent)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs = file_system(spark, path)
    fs.setWriteChecksum(False)
    out = fs.create(_path(spark, path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """One file of a folder's parts, in the order of their names; the folder goes.

    A file system that can put files one after another does so; elsewhere the bytes are copied as a stream."""
    fs, target = file_system(spark, path), _path(spark, path)
    parts = sorted((s.getPath().getName(), s.getPath()) for s in fs.listStatus(_path(spark, folder)) if s.getPath().getName().startswith("part-") and s.getLen())
    places = [p for _, p in parts]
    fs.setWriteChecksum(False)
    fs.delete(target, True)
    if places and fs.getScheme() == "hdfs":
        fs.rename(places[0], target)
        if places[1:]:
            gateway = spark.sparkContext._gateway
            rest = gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(places) - 1)
            for k, p in enumerate(places[1:]):
                rest[k] = p
            fs.concat(target, rest)
    else:
        out = fs.create(target, True)
        try:
            for p in places:
                source = fs.open(p)
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                source.close()
        finally:
            out.close()
    fs.delete(_path(spark, folder), True)
