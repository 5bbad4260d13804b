"""Tables in the folder that driver and executors share: an index is built once, written, and read by every search."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that are Python objects at a time, and rows made of them that leave together.
TAKEN, MADE = 64, 4096

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if all runs on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessaro-core-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table of Parquet files, in the order and the files that it has."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def each_row(rows: DataFrame, make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that make gives of each row's columns.

    However many rows an Arrow batch has, few of them are Python objects at a time, and
    what is made of them leaves in batches of bounded size.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind, prefers_large_types=False)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for some in batches:
            for lo in range(0, some.num_rows, TAKEN):
                for row in zip(*(c.to_pylist() for c in some.slice(lo, TAKEN).columns)):
                    for out in make(*row):
                        made.append(out)
                        if len(made) >= MADE:
                            yield batch(made)
                            made = []
        if made:
            yield batch(made)

    return rows.mapInArrow(run, kind)
