import re
from collections import Counter

import pytest

from tessaro.llm.registry import ORACLE_SQL, QUERIES

from .corpus import SCHEMA, corpus
from .test_quality_rules import LABELS, labelled

pipeline = pytest.importorskip("corpus_pipeline")


def test_registry():
    assert {int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]


def test_stages_run_on_what_the_last_one_kept(spark, tmp_path):
    rows, labels = labelled()
    rows += [(1000 + i, t, l, s, n) for i, (_, t, l, s, n) in enumerate(corpus())]
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == columns
        out.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        now = {r["doc_id"] for r in docs.collect()}
        assert now and now <= before
        before = now
    packed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, pipeline.run(spark, sf).collect())) == Counter(map(key, packed))


def test_empty_corpus(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{sf}/labels.parquet")
    assert pipeline.run(spark, sf).count() == 0
