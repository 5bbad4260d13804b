"""Queries of whole results against their SQL, on small tables with nulls."""

import duckdb
import pytest

from tessaro.llm.registry import ORACLE_SQL, QUERIES

from .corpus import SCHEMA, corpus, sentence
from .test_turns import SCHEMA as TURNS
from .test_turns import conversations


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    import random

    sf, rng = str(tmp_path_factory.mktemp("sf")), random.Random(12)
    unit = sentence(rng, 5)
    rows = [r for r in {r[0]: r for r in corpus(9, 120)}.values() if r[0] is not None]
    rows += [(2000 + i, f"{sentence(rng, i)}\n{' '.join([unit] * (i % 7))}\n\n# {sentence(rng, 3)}.\n{unit}", "en", "s", 0) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    turns = list({r[:2]: r for r in conversations(4)}.values())
    spark.createDataFrame(turns, TURNS).write.parquet(f"{sf}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    return sf, con


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_conversation_repair", "op13_merkle_fingerprints"])
def test_query_against_sql(spark, data, name):
    sf, con = data
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    pick = sorted(got.columns)
    assert pick == sorted(want.columns)
    mine = sorted((tuple(r[c] for c in pick) for r in got.collect()), key=repr)
    theirs = sorted((tuple(r[want.columns.index(c)] for c in pick) for r in want.fetchall()), key=repr)
    assert mine == theirs and len(mine) > 50
