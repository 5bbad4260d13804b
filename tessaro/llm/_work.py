"""Shared folder for cut lineage, distributed ranks, joins of checked size, and small expression helpers."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaro.functions.binding import let  # noqa: F401

#: ASCII white space; a word is a longest run of other characters.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a side that is broadcast, and bytes of its files: some tens of MB at most.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000
#: Bits of a bitmap of numbers (8 MB).
BITS = 2**26

_own: list[str] = []
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset: a temporary one if all runs on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessaro-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def settle(df: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive lost executors.

    over: a settled DataFrame that df was made of and that nothing else needs; it is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessaro-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    if (old := getattr(over, "settled_at", None)) is not None:
        _delete(spark, [old])
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def written() -> int:
    """A mark for ``release``: how much has been settled so far."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Deletes what was settled after the mark, but for keep.  Call it when the results made of it have been used or written."""
    held = {getattr(df, "settled_at", None) for df in keep}
    _delete(spark, [p for p in _written[since:] if p and p not in held])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gone = set(paths)
    _written[:] = [p if p not in gone else "" for p in _written]
    while _written and not _written[-1]:
        _written.pop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows that the driver knows, as one literal: read by the JVM, without Python workers.  schema: ``name: type, ...``"""
    every = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(every).alias("row")).select("row.*")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right's other columns, joined where keys are equal or both null."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def is_small(df: DataFrame) -> bool:
    """Whether a settled table may be broadcast: its rows and the bytes of its files are counted."""
    return df.count() <= BROADCAST_ROWS and file_bytes(df) <= BROADCAST_BYTES


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files of a settled table; 0 of any other."""
    if (at := getattr(df, "settled_at", None)) is None:
        return 0
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def join_small(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """join_on without a shuffle of left while right, a settled table, is small; a plain join beyond."""
    return join_on(left, F.broadcast(right) if is_small(right) else right, keys, how)


def bitmap(numbers: DataFrame, number: str) -> np.ndarray:
    """The lowest bits of a column of well mixed numbers; never more than a million longs come to the driver."""
    bit = F.col(number).bitwiseAND(F.lit(BITS - 1))
    parts = numbers.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({number} & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[parts["at"].to_numpy(np.int64)] = parts["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def in_bitmap(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the lowest bits of each number (unsigned)."""
    bit = numbers & np.uint64(BITS - 1)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def may_be_among(number: Column, numbers: DataFrame) -> Column:
    """Whether number shares its lowest bits with one of numbers, a table of that column alone: true for all of them, and for a few others.

    Rows are told apart where they are; only numbers travel.
    """
    bits = bitmap(numbers.toDF("number"), "number")
    return F.arrow_udf(lambda some: pa.array(in_bitmap(bits, some.to_numpy().view(np.uint64))), "boolean")(number)


def ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, rank): distinct values numbered from 0 in ascending order, null last; ranges of values are sorted apart."""
    order = F.col(column).asc_nulls_last()
    parts = settle(df.select(column).distinct().repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a range: as many as shuffle partitions.
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.withColumn("_place", place).join(counts, "_part").select(column, (F.col("_place") + F.col("_before")).alias("rank"))


def running_before(df: DataFrame, keys: list[str], block: str, order: list[Column], value: str) -> DataFrame:
    """Adds ``before``: the sum of value over the rows of the same keys that come earlier.

    Rows of keys are ordered by block, then by order.  Sums go block by block, so that
    a key of very many rows is never sorted in one task.
    """
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias("_block_sum"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, block, F.coalesce(F.sum("_block_sum").over(earlier), F.lit(0)).alias("_block_before"))
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_inner_before", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    before = (F.col("_inner_before") + F.col("_block_before")).alias("before")
    return join_on(placed, sums, [*keys, block]).select(*df.columns, before)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


class Remembered(dict):
    """make(key) for the keys met of late: when ``most`` are held a new generation begins, and the one before is still looked up."""

    def __init__(self, make: Callable[[bytes], Any], most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: bytes) -> Any:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value
