"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on;
what a stage gets has been written and read again.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import jaccard, mixing, packing, rules, secrets
from lociweave.llm.store import BROADCAST_KEYS, IDENTITY, identity, small_batches, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _own_columns(df: DataFrame) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio.

    Null and empty texts fail and go; rows without doc_id are judged like others, but are never part of the
    target; repeated rows are judged alike and stay as often as they occur; equal scores get equal verdicts.
    An empty table gives an empty one.  Columns other than those of documents are not passed on."""
    target = rules.trusted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _own_columns(rules.apply_rules(_own_columns(docs), target).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles to 0.8 or more: that with the smallest doc_id.

    Of rows that share a doc_id, also when their texts are unlike, each is a document of its own, told apart
    and ordered by all its columns; of rows equal in all columns one stays.  Rows without doc_id stay, as do
    all null and empty texts but repeated rows.  An empty table gives an empty one."""
    docs = _own_columns(docs)
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.limit(1).count():
        groups = jaccard.similar_documents(docs.select("doc_id", "text"), words=5, percent=80)
        return _own_columns(_without(docs, groups.filter("doc_id != component_id").select("doc_id")))
    rows = docs.select("*", *identity(docs))
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *IDENTITY))
    groups = jaccard.similar_documents(rows.select(row.alias("row"), "text"), key="row", words=5, percent=80)
    groups = stored(groups.filter("row is not null").groupBy("row").agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    names = [F.col("row")[c].alias(c) for c in IDENTITY]
    kept = _without(rows, groups.filter("row != first or n > 1").select(*names))
    once = rows.join(groups.filter("row = first and n > 1").select(*names), list(IDENTITY), "left_semi").dropDuplicates(list(IDENTITY))
    return _own_columns(kept.unionByName(once))


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is none of the keys: by broadcast if they are few, else by a shuffled anti join."""
    gone = stored(keys, "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, gone.columns, "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; n_chars follows the text.

    Null and empty texts stay as they are; rows with equal texts, also without doc_id, are masked alike and
    stay as often as they occur.  An empty table gives an empty one."""
    return _own_columns(secrets.redact(_own_columns(docs)))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them.

    Null texts have size 0 and are taken like others; the null source is a source of its own; ties in size go
    by doc_id (null first); rows equal in all columns are interchangeable.  An empty table gives an empty one."""
    return mixing.take(_own_columns(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences.

    Null and empty texts are one piece with the end token; rows without doc_id and repeated rows are packed as
    often as they occur; pieces of equal length are interchangeable.  An empty table gives an empty result."""
    return packing.pack_documents(_own_columns(docs).select("doc_id", "text"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]
#: No stage but the mixing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
