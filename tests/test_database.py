import pytest
from pyspark.sql import functions as F

from tessaro.operators.database import Conflict, Database
from tessaro.streaming import ingest

CHUNKS = "user_id string, document_id string, content string"


def chunks(spark, ids, text="t"):
    return spark.createDataFrame([(f"u{i % 3}", str(i), f"{text}{i}") for i in ids], CHUNKS)


@pytest.fixture
def database(spark, tmp_path):
    made = Database(spark, f"{tmp_path}/db", buckets=8)
    with made.change() as change:
        change.append("document_chunks", chunks(spark, range(60)))
    return made


def held(database, version=None):
    return {r["document_id"]: r["content"] for r in database.read("document_chunks", version).collect()}


def test_a_delete_rewrites_its_buckets_only(spark, database):
    with database.change() as change:
        change.delete("document_chunks", chunks(spark, [7]))
    before, after = (database.state(v)["tables"]["document_chunks"]["folders"] for v in (1, 2))
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 8
    assert held(database).keys() == {str(i) for i in range(60)} - {"7"} and len(held(database, 1)) == 60


def test_failed_and_beaten_changes_leave_nothing(spark, database):
    with pytest.raises(ZeroDivisionError), database.change() as change:
        change.delete("document_chunks", chunks(spark, range(60)))
        1 / 0
    with pytest.raises(Conflict), database.change() as slow:
        slow.delete("document_chunks", chunks(spark, [1]))
        with database.change() as fast:
            fast.delete("document_chunks", chunks(spark, [2]))
    assert database.versions() == [1, 2] and held(database).keys() == {str(i) for i in range(60)} - {"2"}
    assert database.vacuum(1) == 2 and database.versions() == [2] and len(held(database)) == 59


def test_tables_change_together(spark, database):
    with database.change() as change:
        change.append("documents", spark.createDataFrame([("u1", "1", "a"), ("u2", "2", "b")], "user_id string, id string, filename string"))
        change.replace("document_chunks", chunks(spark, [1, 2, 100], "new"))
    assert held(database)["1"] == "new1" and held(database)["100"] == "new100" and len(held(database)) == 61
    with database.change() as change:
        gone = change.read("documents").where("id = '1'")
        change.delete("document_chunks", gone.selectExpr("user_id", "id as document_id"))
        change.delete("documents", gone)
        assert change.read("documents").count() == 1 and database.read("documents").count() == 2
    assert [r["id"] for r in database.read("documents").collect()] == ["2"] and "1" not in held(database)
    with database.change() as change:  # a part of the key: every bucket is looked at; nulls match nothing
        change.delete("document_chunks", spark.createDataFrame([("u0",), (None,)], "user_id string"))
    assert {int(i) % 3 for i in held(database)} == {1, 2}
    with database.change() as change:
        change.delete("document_chunks", database.read("document_chunks"))
    assert held(database) == {} and Database(spark, database.root + "-none").state()["tables"] == {}


def files_in(folder, names):
    for n in names:
        (folder / n).write_text(f"name,age\n{n},3\n" if n.endswith("csv") else f"text of {n}")


def test_a_stream_restarted_in_mid_batch(spark, tmp_path, monkeypatch):
    folder, state = tmp_path / "in", f"{tmp_path}/state"
    folder.mkdir()
    files_in(folder, ["a.csv", "b.txt", "c.txt", "d.md"])
    database = Database(spark, f"{tmp_path}/db", buckets=4)
    start = lambda: ingest.stream_files(spark, str(folder), database, state, "u", max_files=2, parsers=("text",))
    commit, calls = ingest.commit_files, []

    def stops(when):
        def stopping(*args, **options):
            calls.append(args[3])
            if when == "before":
                raise RuntimeError("executor lost")
            commit(*args, **options)
            raise RuntimeError("driver lost")

        return stopping

    for when in ("before", "after"):
        monkeypatch.setattr(ingest, "commit_files", stops(when))
        with pytest.raises(Exception, match="lost"):
            start().awaitTermination()
    assert calls == [("files", 0)] * 2 and database.versions() == [1]
    monkeypatch.setattr(ingest, "commit_files", commit)
    start().awaitTermination()
    files_in(folder, ["e.txt"])
    start().awaitTermination()
    found = {r["filename"]: r["chunk_count"] for r in database.read("documents").collect()}
    assert found == {"a.csv": 2, "b.txt": 1, "c.txt": 1, "d.md": 1, "e.txt": 1}
    assert database.read("document_chunks").count() == 6 and database.versions() == [1, 2, 3]


def test_a_file_that_comes_again_replaces_its_chunks(spark, tmp_path):
    database = Database(spark, f"{tmp_path}/db", buckets=4)
    for text in ("one", "two " * 500):
        files = spark.createDataFrame([("/in/x.txt", bytearray(text.encode()))], "path string, content binary")
        ingest.commit_files(database, files, "u", parsers=("text",))
    assert [r["chunk_count"] for r in database.read("documents").collect()] == [database.read("document_chunks").count()] != [1]
    assert database.read("document_chunks").agg(F.max("chunk_index")).first()[0] == database.read("document_chunks").count() - 1
