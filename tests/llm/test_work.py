from types import SimpleNamespace

import pytest

from tessaro.llm import _work
from tessaro.llm._work import ranks, release, settle, shared_folder, small_table, written


def test_no_machine_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
    session.conf = SimpleNamespace(get=lambda key, default=None: "hdfs://x/y/")
    assert shared_folder(session) == "hdfs://x/y"


def test_settled_files_are_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_work, "shared_folder", lambda _: str(tmp_path))
    mark = written()
    first = settle(spark.range(5))
    second = settle(first.selectExpr("id + 1 as id"), over=first)
    third = settle(second)
    assert len(list(tmp_path.iterdir())) == 2  # the first was replaced
    release(spark, mark, keep=[third])
    assert len(list(tmp_path.iterdir())) == 1 and third.count() == 5
    release(spark, mark)
    assert not list(tmp_path.iterdir())


def test_a_query_leaves_nothing_once_released(spark, tmp_path, monkeypatch):
    from tessaro.llm.ngram_join import ngram_components

    from .corpus import frame

    monkeypatch.setattr(_work, "shared_folder", lambda _: str(tmp_path))
    mark = written()
    ngram_components(frame(spark), 4, 85).collect()
    assert list(tmp_path.iterdir())
    release(spark, mark)
    assert not list(tmp_path.iterdir())


def test_ranks_over_ranges(spark):
    values = [f"v{i * 37 % 101:03d}" for i in range(101)] + [None, None, "v005"]
    got = {r["v"]: r["rank"] for r in ranks(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values) - {None}))} | {None: 101}
    assert ranks(spark.createDataFrame([], "v string"), "v").count() == 0


def test_joins_of_checked_size(spark, monkeypatch):
    left, right = spark.createDataFrame([(1,), (None,), (3,)], "k int"), spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    want = {(1, "a"), (None, "b"), (3, None)}
    for most in (10, 0):
        monkeypatch.setattr(_work, "BROADCAST_ROWS", most)
        assert {tuple(r) for r in _work.join_small(left, right, ["k"], "left").collect()} == want


def test_small_tables(spark):
    rows = [{"a": 1, "b": None}, {"a": 2**40, "b": "x"}]
    assert [r.asDict() for r in small_table(spark, rows, "a: bigint, b: string").collect()] == rows
