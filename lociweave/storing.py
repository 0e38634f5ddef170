"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .files import _path, file_system


#: The local folder of each application that has none of its own; the setting itself can't be changed in a running session.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset, and the session is local, a local folder (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="lociweave-")
        found = _LOCAL[context.applicationId]
    return found.rstrip("/")


#: For each open ``removed_after`` the tables written since.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from the shared folder; lost executors don't undo it.

    The table stays, since what is made of it is computed later; ``removed_after`` removes it when that is done."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lociweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _OPEN:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all tables that were stored within; results must have been written or collected by then."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        for path in paths:
            file_system(spark, path).delete(_path(spark, path), True)
