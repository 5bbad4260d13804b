"""The service's tables on files: changes rewrite only the buckets that they touch, and are seen all at once or not at all.

Rows of a table are dealt into buckets by a hash of its key columns, such as (user,
document).  Files never change.  A version is a manifest: for every table and bucket the
folders that hold its rows.  A change writes new folders first; its one commit is the
rename of the next manifest to its number, which fails if another writer was faster, so
readers see the old version or the new one, of all tables together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table; versions whose files are kept by ``vacuum``.
BUCKETS, KEPT = 64, 5
#: Key columns of the service's tables: what is deleted together lies together.
KEYS = {
    "documents": ("user_id", "id"), "document_chunks": ("user_id", "document_id"), "chat_sessions": ("user_id", "id"), "chat_messages": ("session_id",),
}


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


class Database:
    """Tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, tuple[str, ...]] = KEYS, buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _manifest(self, version: int) -> str:
        return f"manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        """Numbers of the committed versions, in order."""
        folder = self._path("manifests")
        if not self._files.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(folder))
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def state(self, version: int | None = None) -> dict:
        """A version's manifest, the last one by default; before the first commit there are no tables."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}, "batches": {}}
        at = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.root}/{self._manifest(at)}", wholetext=True).first()["value"]
        return json.loads(text)

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, of some buckets only if given."""
        return self._rows(self.state(version)["tables"][name], buckets)

    def _rows(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        chosen = table["folders"].items() if buckets is None else [(str(b), table["folders"].get(str(b), [])) for b in buckets]
        paths = [f"{self.root}/{folder}/bucket={b}" for b, folders in chosen for folder in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, name: str) -> Column:
        """Where a row of the table belongs, by its key columns."""
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.buckets)).cast("int")

    @contextmanager
    def change(self, batch: tuple[str, int] | None = None) -> Iterator[Change]:
        """Changes of any tables, committed at the end of the block, all or none.

        batch: a stream's name and number, committed with the change; see ``has_batch``.
        """
        begun = Change(self, self.state())
        yield begun
        begun._commit(batch)

    def has_batch(self, stream: str, number: int) -> bool:
        """Whether a batch of a stream, or a later one, is in the last version."""
        return self.state()["batches"].get(stream, -1) >= number

    def vacuum(self, keep: int = KEPT) -> int:
        """Deletes versions but the last ones, and folders that no kept version names, those of failed changes among them; how many went.  No change may be under way."""
        for old in self.versions()[:-keep]:
            self._files.delete(self._path(self._manifest(old)), False)
        named = {f.split("/")[1] for v in self.versions() for t in self.state(v)["tables"].values() for folders in t["folders"].values() for f in folders}
        data = self._path("data")
        gone = [s.getPath() for s in self._files.listStatus(data) if s.getPath().getName() not in named] if self._files.exists(data) else []
        for path in gone:
            self._files.delete(path, True)
        return len(gone)


class Change:
    """What is to be committed together.  Later steps see earlier ones."""

    def __init__(self, database: Database, state: dict):
        self.database, self.base = database, state["version"]
        self.state = json.loads(json.dumps(state))

    def read(self, name: str) -> DataFrame:
        return self.database._rows(self.state["tables"][name])

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; the table is made of the first ones."""
        folders = self._written(name, rows)
        table = self.state["tables"].setdefault(name, {"schema": json.loads(rows.schema.json()), "folders": {}})
        for b, folder in folders.items():
            table["folders"].setdefault(b, []).append(folder)

    def delete(self, name: str, gone: DataFrame) -> None:
        """Deletes the rows whose keys are in gone(key columns, or the first of them); nulls match nothing.  Only buckets that hold such keys are written anew."""
        self._rewrite(name, gone, None)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Puts rows in the place of all rows of their keys."""
        if name not in self.state["tables"]:
            return self.append(name, rows)
        self._rewrite(name, rows.select(*self.database.keys[name]), rows)

    def _rewrite(self, name: str, gone: DataFrame, rows: DataFrame | None) -> None:
        table, keys = self.state["tables"].get(name), list(self.database.keys[name])
        if table is None:
            return
        given = [k for k in keys if k in gone.columns]
        gone = gone.select(*given).distinct()
        # A whole key names its bucket; a part of one can be in any.  There are never more numbers than buckets.
        touched = [r["b"] for r in gone.select(self.database.bucket(name).alias("b")).distinct().collect()] if given == keys else list(range(self.database.buckets))
        kept = self.database._rows(table, touched).join(gone, given, "left_anti")
        kept = kept.select(*StructType.fromJson(table["schema"]).names)
        folders = self._written(name, kept if rows is None else kept.unionByName(rows.select(*kept.columns)))
        for b in map(str, touched):
            table["folders"][b] = [folders[b]] if b in folders else []

    def _written(self, name: str, rows: DataFrame) -> dict[str, str]:
        """The new folder of each bucket that has rows."""
        db, folder = self.database, f"data/{name}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", db.bucket(name)).repartition("bucket").write.partitionBy("bucket").parquet(f"{db.root}/{folder}")
        made = (s.getPath().getName() for s in db._files.listStatus(db._path(folder)))
        return {n.removeprefix("bucket="): folder for n in made if n.startswith("bucket=")}

    def _commit(self, batch: tuple[str, int] | None) -> None:
        db = self.database
        self.state["version"] = self.base + 1
        if batch:
            self.state["batches"][batch[0]] = batch[1]
        draft, final = db._path(f"drafts/{uuid.uuid4().hex}.json"), db._path(db._manifest(self.base + 1))
        out = db._files.create(draft, False)
        out.write(json.dumps(self.state).encode())
        out.close()
        db._files.mkdirs(db._path("manifests"))
        options = db.spark.sparkContext._gateway.new_array(db._hadoop.Options.Rename, 0)
        try:
            db._hadoop.FileContext.getFileContext(draft.toUri(), db._conf).rename(draft, final, options)
        except Exception as e:  # the number is taken
            if db._files.exists(final):
                raise Conflict(f"version {self.base + 1} was committed by another change") from e
            raise
