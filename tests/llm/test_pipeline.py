import glob
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lociweave.llm import oracle, queries

from ..test_queries import rows_of
from .test_operators import SCHEMA, WORD, plain_components, shingles

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(1)
    vocabulary = [f"wo{i}" for i in range(900)]
    good = [" ".join(rng.choices(vocabulary, k=80)) for _ in range(30)]
    near = [good[0] + " more", good[1] + " end here", good[0] + " more"]
    secret = "0123456789abcdef0123456789abcdef01234567"
    texts = [*good, *near, "too short", None, "", "again again " * 50, f'{good[2]} token = "{secret}" {good[3]}']
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = pipeline.quality_rules(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k, t, *_ in rows if len(WORD.findall(t or "")) >= 50 and "again" not in t]
    single = pipeline.near_duplicates(spark, kept, folder)
    groups = plain_components({r["doc_id"]: shingles(r["text"], 5) for r in kept.collect()}, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(groups.values())) and len(set(groups.values())) < len(groups)
    masked = pipeline.secret_scan(spark, single, folder)
    assert masked.columns == docs.columns and masked.count() == single.count()
    assert not masked.filter(F.col("text").contains(secret)).count() and masked.filter(F.col("text").contains("[SECRET]")).count() == 1
    assert not masked.filter("n_chars != length(text)").count()
    mixed = pipeline.source_mixing(spark, masked, folder)
    assert mixed.columns == docs.columns and mixed.join(masked, docs.columns, "left_anti").count() == 0
    words = F.sum(F.size(F.split("text", r"\s+")))
    assert mixed.agg(words).first()[0] == pytest.approx(1.5 * masked.agg(words).first()[0], rel=0.1)
    packed = pipeline.best_fit_packing(spark, mixed, folder)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert pipeline.run(spark, folder).count() == packed.count()
    nothing = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0


def test_near_duplicates_keep_rows_without_key(spark, tmp_path):
    rows = [(None, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11)]
    out = pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "None"]


def test_near_duplicates_keep_unlike_texts_of_one_key(spark, tmp_path):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "en", "t", 1), (2, b, "en", "s", 1), (3, "c", None, "x", 1), (3, "c", "x", None, 1), (4, None, None, None, None), (4, None, None, None, None)]
    for n in (1, 3):
        out = pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(n), str(tmp_path)).collect()
        assert sorted((r["doc_id"], r["text"] or "") for r in out) == sorted([(1, a), (1, b), (3, "c"), (4, "")])
        first = first if n > 1 else out
        assert sorted(map(str, out)) == sorted(map(str, first))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, FOLDER)
    result = c.execute(oracle.ORACLE_SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


def test_queries_are_numbered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
